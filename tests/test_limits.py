"""Data on both sides of limits that once cut rows or texts, and the small operators no registered query reaches."""

import time

from pyspark.sql import functions as F

from attestry.functions import normalize as N
from attestry.functions import patterns as X
from attestry.operators import chunking as C
from attestry.operators import citations as W
from attestry.operators import dialog as K
from attestry.operators import fuzzyjoin
from attestry.operators import layout as L
from attestry.sources import records
from attestry.streaming import streams


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def test_numbers_of_any_length(spark):
    for n in (3, 4, 10, 59, 60, 61, 70, 200):
        digits = "9" * n
        want = f"{int(digits):,}"
        assert one(spark, N.norm_numbers(F.col("t")), t=digits) == want
        assert one(spark, N.norm_currency(F.col("t")), t=digits + "원") == want + "원"
    assert one(spark, N.norm_numbers(F.col("t")), t="a1234 2024-01-05 1234567-01-05 12345") == "a1234 2024-01-05 1,234567-01-05 12,345"


def test_keywords_with_special_characters(spark):
    assert one(spark, X.highlight(F.col("t"), ["$5", "a\\b", "x\\Ey"]), t="cost $5 or a\\b or x\\Ey") == "cost <mark>$5</mark> or <mark>a\\b</mark> or <mark>x\\Ey</mark>"
    assert one(spark, N.expand_terms(F.col("t"), {"USD": "$ \\ dollar"}), t="5 USD") == "5 $ \\ dollar"


def test_repeats_are_judged_on_whole_texts(spark):
    a, b = "x" * 200 + "one", "x" * 200 + "two"
    df = spark.createDataFrame([("d", a, 1), ("d", b, 2), ("d", a + " ", 3)], "doc_id string, text string, start_char int")
    assert {r.start_char for r in C.dedupe_chunks(df).collect()} == {1, 2}
    assert {r.start_char for r in C.dedupe_chunks(df, parity=True).collect()} == {1}
    rows = [("d", "t", "y" * 600 + e, ["l"], 1, i) for i, e in enumerate(("p", "q", "p"))]
    rec = spark.createDataFrame(rows, "doc_id string, title string, body string, departments array<string>, page int, index int")
    assert {r["index"] for r in L.dedupe_records(rec).collect()} == {0, 1}
    assert {r["index"] for r in L.dedupe_records(rec, parity=True).collect()} == {0}


def test_long_equal_strings_are_candidates(spark):
    for n in (3_000, 12_000):
        df = spark.createDataFrame([("e" * n,)], "text string")
        assert fuzzyjoin.fuzzy_candidates(df, df, "ratio", 1.0).count() == 1


def test_logs_come_newest_first(spark):
    logs = spark.createDataFrame([(i, f"2024-01-01 0{t}:00:00", "2024-01-01") for i, t in enumerate((3, 1, 5, 2))], "log_id long, timestamp string, log_date string")
    logs = logs.withColumn("log_date", F.to_date("log_date")).repartition(3)
    assert [r.log_id for r in records.load_logs(logs, "2024-01-01").collect()] == [2, 0, 3, 1]


def test_newest_version_of_a_batch_wins(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    for text in ("zzz old", "aaa new"):
        spark.createDataFrame([(1, text)], "doc_id bigint, text string").coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)
    streams.ingest_stream(spark, src, out, cp, buckets=2).awaitTermination()
    assert [r.text for r in spark.read.parquet(out).collect()] == ["aaa new"]


def test_fixed_names_anywhere_in_a_text(spark):
    assert one(spark, L.match_substrings(F.col("t"), ["beta", "alpha", "gamma"]), t="xalphay beta") == ["beta", "alpha"]


def test_invalid_citations_leave_no_empty_facts(spark):
    got = one(spark, W.drop_empty_facts(F.array(F.lit("[9]"), F.lit("fact [1] [9]")), F.array(F.lit("1"))), t="")
    assert got == ["fact [1]"]


def test_memory_becomes_evidence(spark):
    resp = spark.createDataFrame([(1, "s", 1, "Plain.\nCited [2] line.")], "response_id long, session_id string, seq int, answer string")
    src = spark.createDataFrame([(1, 2, "doc")], "response_id long, display_index long, doc_id string")
    rows = K.memory_evidence(K.memory_facts(resp, src)).collect()
    assert [(r.chunk_id, r.text, r.score) for r in rows] == [("memory-doc-1", "Cited [2] line.", 1.5)]


def test_key_term_order_is_a_struct(spark):
    msgs = spark.createDataFrame([("s", 1, "user", "budget report budget"), ("s", 2, "assistant", "annual budget plan")], "session_id string, seq int, role string, content string")
    rows = K.key_terms(msgs).collect()
    assert all(r.term_no.r in (0, 1) for r in rows)


def test_responses_without_evidence_stay(spark):
    from attestry.operators import audit

    pairs = spark.createDataFrame([(1, "one two three.", "one two three."), (2, "lonely words.", "")], "response_id long, answer string, evidence_text string")
    ev = spark.createDataFrame([(1, "one two three.")], "response_id long, text string")
    got = {r.response_id: r for r in audit.citation_accuracy(pairs, ev, mode="contains").collect()}
    assert got[1].overall_score == 1.0 and got[2].overall_score == 0.0 and not got[2].is_valid
