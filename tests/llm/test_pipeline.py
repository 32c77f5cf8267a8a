import random
import sys

import corpus_pipeline
from pyspark.sql.types import LongType, MapType, StringType, StructField, StructType

from attestry.llm import minhash, queries
from tests.llm.conftest import sentence
from tests.llm.test_minhash import brute, near_copies


def test_stages_keep_clean_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).cache()
        counts.append(docs.count())
        assert docs.columns[: len(columns)] == columns
    assert len(corpus_pipeline.STAGES) == 5 and counts == sorted(counts, reverse=True)
    assert counts[3] == counts[2] and counts[5] == counts[4] and counts[5] > 0.6 * counts[0]
    assert docs.where("not round_trip or not parity or n_ids <> size(ids)").isEmpty()


def test_stages_on_odd_rows(spark, sf, odd_docs, no_docs):
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, odd_docs, sf)
        assert set(odd_docs.columns) <= set(kept.columns)
        n = kept.count()
        assert 0 < n <= odd_docs.count() and stage(spark, no_docs, sf).count() == 0
        if "dedup" in name and "MinHash" in name:
            assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in minhash.near_duplicates(odd_docs).where("kept").collect()}


def test_every_operator_has_one_query():
    import __spark_entry__ as entry

    names = [q for q in entry.queries() if q.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries() and set(queries.ORACLES) <= set(names)
    assert "attestry.llm" in sys.modules


def test_one_row_of_each_group_stays(spark, sf):
    """Equal rows, rows of one doc_id with several texts and rows without a doc_id, against brute force on the rows."""
    rng = random.Random(11)
    a, b, c, d, e = (sentence(rng, 80) for _ in range(5))
    rows = [(1, a), (1, a), (1, a), (2, b), (2, c), (3, c), (None, d), (None, d), (None, e), (4, e), (5, ""), (5, ""), (None, None), (None, None)]
    rows += [(rng.choice([None, 20 + i % 3, 30 + i]), t) for i, t in enumerate(t for _ in range(4) for t in near_copies(rng, 5))]
    docs = spark.createDataFrame([(i, t, f"s{n % 2}") for n, (i, t) in enumerate(rows)], "doc_id long, text string, source string")
    groups = {}
    for n, (size, group) in brute([(n, t) for n, (_, t) in enumerate(rows)], corpus_pipeline.NEAR_PERCENT).items():
        groups.setdefault(group if size else ("none", n), []).append(n)
    kept = corpus_pipeline.near_duplicates(spark, docs, sf)
    got = sorted((str(r.doc_id), str(r.text)) for r in kept.collect())
    assert kept.columns == docs.columns and len(got) == len(groups)
    least = {g: min((rows[n][0] is None, rows[n][0] or 0) for n in of) for g, of in groups.items()}
    for g, of in groups.items():
        assert any((str(rows[n][0]), str(rows[n][1])) in got for n in of if (rows[n][0] is None, rows[n][0] or 0) == least[g])
    # the next stage cuts what still stands twice from end to end: one copy of each text has come through
    left = [r.text for r in corpus_pipeline.repeated_passages(spark, kept, sf).collect()]
    assert all(left.count(t) == 1 for t in (a, b, c, d, e))


def test_near_copies_link_from_four_fifths(spark, sf):
    """Texts of w words that differ in the last k share w - 4 - k of w - 4 + k shingles."""
    pairs = {0.85: (78, 6), 0.82: (104, 10), 0.80: (49, 5), 0.79: (89, 10)}  # 68/80, 90/110, 40/50, 75/95
    rows = []
    for n, (w, k) in enumerate(pairs.values()):
        words = [f"w{n}x{i}" for i in range(w)]
        rows += [(2 * n, " ".join(words)), (2 * n + 1, " ".join(words[:-k] + [f"y{n}x{i}" for i in range(k)]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect()) == [0, 2, 4, 6, 7]
    assert sorted(r.doc_id for r in minhash.near_duplicates(docs).where("kept").collect()) == [0, 2, 3, 4, 5, 6, 7]


def test_columns_of_any_name_come_through(spark, sf):
    """Names with spaces and dots, names that helpers use, a map column: every stage returns them with their values."""
    rng = random.Random(4)
    names = ["doc_id", "text", "my col", "a.b", "_row", "_k1", "k1", "row", "doc", "id", "rank", "key"]
    rows = [(n, sentence(rng, 60), *[100 * n + j for j in range(len(names) - 2)], {"k": n}) for n in range(30)]
    schema = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), *[StructField(c, LongType()) for c in names[2:]],
                         StructField("a map", MapType(StringType(), LongType()))])
    docs = spark.createDataFrame(rows, schema)
    want = {r["doc_id"]: tuple(r)[2:] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        got = docs.collect()
        assert got and all(tuple(r)[2 : len(schema)] == want[r["doc_id"]] for r in got), name
        assert docs.columns[: len(schema)] == schema.names
