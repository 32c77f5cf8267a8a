"""Sources, vectors, logs, streams, and plans."""

import datetime as dt
import json
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from attestry.operators import lexical, oplog, vector
from attestry.session import TABLES
from attestry.sources import corpus, records, snapshots
from attestry.streaming import streams
from check import canon


def test_vector_grid_equals_broadcast(spark):
    r = random.Random(5)
    rows = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(60)]
    v = spark.createDataFrame(rows, "chunk_id int, embedding array<double>")
    q = v.withColumnRenamed("chunk_id", "query_id")
    key = lambda d: {(x.query_id, x.rank): (x.chunk_id, round(x.score, 6)) for x in d.collect()}
    one = key(vector.vector_topk(q, v, 4, exclude_self=True))
    assert one == key(vector.vector_topk(q, v, 4, exclude_self=True, block=16))
    scope = q.select("query_id").join(v.select("chunk_id"), F.col("chunk_id") % 2 == F.col("query_id") % 2)
    got = vector.vector_topk(q, v, 3, scope=scope).collect()
    assert all(x.chunk_id % 2 == x.query_id % 2 for x in got) and len(got) == 180


def test_rerank_scores(spark):
    import numpy as np

    pairs = spark.createDataFrame([(1, "q", "abc"), (2, "q", "")], "id int, query string, text string")
    out = vector.score_pairs(pairs, lambda qs, ts: np.array([len(t) - 1.0 for t in ts]))
    assert [round(r.rerank_score, 6) for r in out.orderBy("id").collect()] == [0.880797, 0.268941]


def test_sources_round_trip(spark, tmp_path):
    files = tmp_path / "in"
    files.mkdir()
    (files / "a.pdf").write_bytes(b"x" * 10)
    (files / "b.txt").write_text("y")
    inv = corpus.corpus_inventory(corpus.scan_corpus(spark, str(files)))
    assert sorted((r.name, r.size, r.type) for r in inv.collect()) == [("a.pdf", 10, "PDF"), ("b.txt", 1, "TXT")]
    assert corpus.inventory_totals(inv).first().files == 2
    assert sorted(r.reason for r in corpus.intake_gate(inv).collect()) == ["bad_type", "ok"]
    wl = tmp_path / "w.txt"
    wl.write_text("# c\n총무과\n\n회계과\n")
    assert sorted(r.name for r in corpus.read_whitelist(spark, str(wl)).collect()) == ["총무과", "회계과"]
    d = spark.createDataFrame([("f.pdf", 1, 1, "지시", "t", "b", "", ["총무과"], "ko", "x", "d")], records.DIRECTIVE_SCHEMA)
    records.write_directives(d, str(tmp_path / "dir"))
    assert records.read_directives(spark, str(tmp_path / "dir")).collect() == d.collect()
    g = tmp_path / "g.json"
    g.write_text(json.dumps({"questions": [{"id": "q1", "question": "q", "answer": "a", "documents": ["d"], "evidence_spans": [{"doc": "d", "page": 3, "start": 150, "end": 280}]}]}))
    assert records.golden_spans(records.read_golden(spark, str(g))).first().asDict() == {"id": "q1", "span_no": 0, "doc_id": "d", "page": 3, "start": 150, "end": 280}
    log = spark.createDataFrame([("2024-01-05T10:00:00", "s", "hello", "normal")], "timestamp string, session_id string, query string, query_type string")
    log = log.withColumn("performance_metrics", F.struct(F.lit(7.0).alias("total_time_ms"), F.lit(3).alias("total_tokens")))
    records.write_query_log(log, str(tmp_path / "log"))
    flat = oplog.flatten_logs(records.read_query_log(spark, str(tmp_path / "log"))).first()
    assert (flat.total_time_ms, flat.tokens, str(flat.log_date)) == (7.0, 3, "2024-01-05")
    records.write_eval(log.select("query"), log.select("query"), str(tmp_path / "ev"), "r1")
    assert spark.read.parquet(str(tmp_path / "ev" / "details")).first().run_id == "r1"
    snapshots.write_snapshot(log.select("query"), str(tmp_path / "snap"), "1")
    assert snapshots.read_snapshot(spark, str(tmp_path / "snap"), "1").count() == 1


def test_index_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(1, 1, "alpha beta"), (2, 2, "beta")], "chunk_id int, doc_id int, text string")
    lexical.write_index(lexical.build_lexical_index(docs), str(tmp_path))
    idx = lexical.read_index(spark, str(tmp_path))
    assert {r.term: r.df for r in idx.terms.collect()} == {"alpha": 1, "beta": 2}


def test_repeats_against_brute_force(spark):
    r = random.Random(2)
    rows = [(i, "hot" if r.random() < .6 else f"q{r.randint(0, 5)}", dt.datetime(2024, 1, 1) + dt.timedelta(seconds=r.randint(0, 4000))) for i in range(300)]
    got = {x.log_id: x.is_repeat for x in oplog.mark_repeats(spark.createDataFrame(rows, "log_id int, query string, timestamp timestamp"), 30).collect()}
    last, want = {}, {}
    for i, q, t in sorted(rows, key=lambda x: (x[2], x[0])):
        want[i] = q in last and (t - last[q]).total_seconds() <= 30
        last[q] = t
    assert got == want


def limiter(rows, limit, window):
    ok, out = {}, {}
    for i, k, t in sorted(rows, key=lambda x: (x[2], x[0])):
        live = [a for a in ok.get(k, []) if a > t - window]
        out[i] = len(live) < limit
        ok[k] = live + [t] if out[i] else live
    return out


def test_rate_limit_batch_and_stream(spark, tmp_path):
    times = [0, 10, 20, 61, 65, 71]
    rows = [(i, "a", t) for i, t in enumerate(times)] + [(100 + i, "b", random.Random(i).randint(0, 300)) for i in range(40)]
    df = spark.createDataFrame([(i, k, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=t)) for i, k, t in rows], "id int, user string, ts timestamp")
    want = limiter(rows, 2, 60)
    assert [want[i] for i in range(6)] == [True, True, False, True, False, True]
    got = {r.request_id: r.accepted for r in streams.rate_limit_batch(df, "user", "id", "ts", 2, 60).collect()}
    assert got == want
    src = str(tmp_path / "src")
    df.coalesce(1).write.parquet(src)
    out = streams.rate_limit(spark.readStream.schema(df.schema).parquet(src), "user", "id", "ts", 2, 60)
    q = out.writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.request_id: r.accepted for r in spark.table("limited").collect()} == want


def test_ttl_and_dedupe_streams(spark, tmp_path):
    rows = [(1, "k", 0), (2, "k", 300), (3, "k", 700), (4, "j", 10)]
    df = spark.createDataFrame([(i, k, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=t)) for i, k, t in rows], "id int, key string, ts timestamp")
    assert {r.request_id: r.kept for r in streams.dedupe_ttl_batch(df, "key", "id", "ts", 600).collect()} == {1: True, 2: False, 3: True, 4: True}
    src = str(tmp_path / "src")
    df.where("id <> 3").coalesce(1).write.parquet(src)
    q = (streams.dedupe_ttl(spark.readStream.schema(df.schema).parquet(src), "key", "ts").select("key").writeStream.format("memory").queryName("once")
         .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    q.awaitTermination()
    assert sorted(r.key for r in spark.table("once").collect()) == ["j", "k"]


def test_ingest_replaces_documents(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    put = lambda rows: spark.createDataFrame(rows, "doc_id bigint, text string").write.mode("append").parquet(src)
    for batch in ([(1, "old one"), (2, "two")], [(1, "new one")]):
        put(batch)
        streams.ingest_stream(spark, src, out, cp, buckets=4).awaitTermination()
    assert {r.doc_id: r.text for r in spark.read.parquet(out).collect()} == {1: "new one", 2: "two"}


def test_entry_and_registry(spark):
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(o) > 120
    rows = entry.entry(spark)
    assert rows.columns == ["query_id", "chunk_id", "rrf_score", "keyword_relevance", "include_reason", "position"] and rows.count() > 0


SAMPLE = ["r3_bm25_topk", "r6_vector_topk", "r22_hybrid_retrieve", "s13_manifest_diff", "p14_mask_pii", "c1_chunk_blocks", "l5_assign_by_interval",
          "e2_token_f1", "a1_log_statistics", "a14_mark_repeats", "v5_audit_responses", "v12_citation_map", "t2_topic_change", "k7_rewrite_queries", "x4_sessionize"]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_oracle_sample(spark, sf, duck, name):
    got = canon(entry.queries()[name](spark, sf).toPandas())
    want = canon(duck.execute(entry.oracle_sql()[name]).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False, atol=1e-9, check_exact=False)


PAIRWISE = ["r3_bm25_topk", "r9_rrf", "r13_keyword_relevance", "r25_retrieval_eval", "l5_assign_by_interval", "e4_citation_iou", "v4_citation_validity",
            "v6_entity_variations", "v12_citation_map", "v13_line_citations", "fz_fuzzy_join", "t1_two_stage", "s4_upsert_by_doc", "k9_memory_facts"]


@pytest.mark.parametrize("name", PAIRWISE)
def test_no_cartesian_plans(spark, sf, name):
    plan = entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_plan_shapes(spark, sf):
    plan = lambda n: entry.queries()[n](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan("r3_bm25_topk")
    scan = plan("a1_type_counts")
    assert "ReadSchema: struct<" in scan and "user_id" not in scan.split("ReadSchema: struct<")[1].split(">")[0]
    assert "Exchange" not in plan("c1_chunk_blocks") and "Exchange" not in plan("p9_normalise")


@pytest.mark.parametrize("seed,k", [(1, 3), (2, 10), (3, 1)])
def test_pruned_search_equals_all_pairs(spark, seed, k):
    """Random corpora with common and rare words, equal chunks (ties) and ids in queries."""
    r = random.Random(seed)
    vocabulary = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200)]
    text = lambda n: " ".join(vocabulary[min(int(r.expovariate(.04)), 199)] for _ in range(n))
    docs = [(i, i % 40, text(r.randint(1, 60))) for i in range(300)]
    docs += [(300 + i, 40 + i, docs[i][2]) for i in range(20)]
    queries = [(q, text(r.randint(1, 15)) + (f" {q}" if q % 3 == 0 else "")) for q in range(40)] + [(90, ""), (91, "unknown")]
    index = lexical.index_of(lexical.build_lexical_index(spark.createDataFrame(docs, "chunk_id int, doc_id int, text string")).postings, store=True)
    q = spark.createDataFrame(queries, "query_id int, text string")
    rows = lambda prune: sorted(tuple(x) for x in lexical.bm25_topk(q, index, k, prune=prune).select("query_id", "rank", "chunk_id", "doc_id", "score").collect())
    assert rows(True) == rows(False) and len(rows(True)) >= 40 * min(k, 2)


def test_search_stops_reading_common_terms():
    """The lists behind the threshold are looked up for the survivors only, with the same result."""
    import numpy as np

    n = 1000
    doc = np.concatenate([np.arange(3), np.arange(n)])
    part = np.concatenate([np.full(3, 1.0), np.full(n, 0.5)])
    best, value = lexical.best_of_lists([(10.0, "rare", 10.0, 0, 3), (0.5, "common", 1.0, 3, 3 + n)], doc, part, score := np.zeros(n), 3)
    assert best.tolist() == [0, 1, 2] and value.tolist() == [10.5] * 3 and not score.any()


def test_only_a_partial_match_lifts_a_hit(spark):
    """A keyword that the text holds only in a near form brings the hit over the relevance floor."""
    from attestry.operators import fusion

    chunks = spark.createDataFrame([(1, 1, "zzzz planetarium qqqq xxxx"), (2, 2, "zzzz qqqq xxxx vvvv")], "chunk_id int, doc_id int, text string")
    queries = spark.createDataFrame([(7, "planetariun")], "query_id int, text string")
    hits = spark.createDataFrame([(7, c, c, .01) for c in (1, 2)], "query_id int, chunk_id int, doc_id int, rrf_score double")
    index = lexical.build_lexical_index(chunks)
    for postings in (None, index.postings):
        rel = {x.chunk_id: x.keyword_relevance for x in fusion.with_keyword_relevance(hits, queries, chunks, postings=postings).collect()}
        assert rel[1] - .25 < .3 and rel[1] >= .25 > .15 > rel[2]
        kept = fusion.relevance_filter(fusion.with_keyword_relevance(hits, queries, chunks, postings=postings)).collect()
        assert {x.chunk_id for x in kept} == {1}


def test_keywords_are_linked_to_words_of_hits_only(spark, monkeypatch):
    """Words of chunks that no query hit are not compared with the keywords, and their absence changes no score."""
    from attestry.operators import fusion

    chunks = spark.createDataFrame([(1, 1, "zzzz planetarium qqqq"), (2, 2, "planetaria vvvv"), (3, 3, "planetarius wwww")], "chunk_id int, doc_id int, text string")
    queries = spark.createDataFrame([(7, "planetariun")], "query_id int, text string")
    hits = spark.createDataFrame([(7, 1, 1, .01), (7, 2, 2, .01)], "query_id int, chunk_id int, doc_id int, rrf_score double")
    postings, asked, link = lexical.build_lexical_index(chunks).postings, [], fusion.keyword_links
    monkeypatch.setattr(fusion, "keyword_links", lambda keywords, words: asked.append({x.word for x in words.collect()}) or link(keywords, words))
    related = lambda **more: sorted(map(tuple, fusion.with_keyword_relevance(hits, queries, chunks, postings=postings, **more).collect()))
    found = related()
    assert {"planetarium", "planetaria", "vvvv"} <= asked[0] and not {"planetarius", "wwww"} & asked[0]
    words = spark.createDataFrame([(w,) for w in ("planetarium", "planetaria", "planetarius")], "word string")
    assert found == related(links=link(spark.createDataFrame([("planetariun",)], "keyword string"), words))


def test_computed_vectors_are_not_counted(spark, monkeypatch):
    """A number of vectors that is known replaces the count, and the result does not depend on it."""
    v = spark.range(50).selectExpr("id AS chunk_id", "array(double(id % 7), double(id % 5), 1D) AS embedding")
    q = v.withColumnRenamed("chunk_id", "query_id")
    rows, counted = lambda df: sorted(map(tuple, df.collect())), []
    once = rows(vector.vector_topk(q, v, 3))
    monkeypatch.setattr(type(v), "count", lambda df: counted.append(df.columns) or 50)
    assert rows(vector.vector_topk(q, v, 3, n_vectors=20_000)) == once and counted == [["query_id", "_qe"]]


def test_search_moves_each_posting_once(spark, monkeypatch):
    """Many shards and packs that cut chunks in two give what scoring all pairs gives; postings are never repeated for blocks of queries."""
    r = random.Random(5)
    word = lambda: f"w{chr(97 + min(int(r.expovariate(.2)), 25))}{chr(97 + r.randint(0, 3))}"
    docs = spark.createDataFrame([(i, i, " ".join(word() for _ in range(r.randint(1, 40)))) for i in range(200)], "chunk_id int, doc_id int, text string")
    q = spark.createDataFrame([(i, " ".join(word() for _ in range(9)) + f" {i}") for i in range(60)], "query_id int, text string")
    index = lexical.index_of(lexical.build_lexical_index(docs).postings, store=True)
    monkeypatch.setattr(lexical, "SHARD_POSTINGS", 150)
    monkeypatch.setattr(lexical, "BLOCK_QUERIES", 7, raising=False)
    out = lexical.bm25_topk(q, index, 5)
    plan = out._jdf.queryExecution().toString()
    assert "CoGroup" not in plan and plan.count("MapInArrow") >= 3
    rows = lambda df: sorted(tuple(x) for x in df.select("query_id", "rank", "chunk_id", "doc_id", "score").collect())
    assert rows(out) == rows(lexical.bm25_topk(q, index, 5, prune=False))


def test_packs_hold_whole_queries(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(lexical, "PACK_TERMS", 4)
    asked = pa.table({"query_id": [1, 1, 1, 2, 2, 2, 2, 2, 3], "term": list("abcabcdea"), "idf": [1.0] * 9, "avgdl": [2.0] * 9})
    packs = [lexical._load(x) for b in lexical._pack_queries(iter(asked.to_batches(max_chunksize=2))) for x in b["pack"].to_pylist()]
    ids = [set(p["query_id"].to_pylist()) for p in packs]
    assert len(ids) > 1 and sum(map(len, ids)) == 3 and sum(p.num_rows for p in packs) == 9


def test_index_tasks_follow_the_text(spark, monkeypatch):
    """More text is counted by more tasks, and a chunk that comes in two rows still has one posting a term."""
    docs = spark.range(40).selectExpr("id AS chunk_id", "id AS doc_id", "repeat(concat('alpha beta', id, ' alpha '), 20) AS text")
    docs = docs.unionByName(docs.where("chunk_id = 3"))
    rows = lambda index: sorted(tuple(r) for r in index.postings.collect())
    want = rows(lexical.build_lexical_index(docs))
    monkeypatch.setattr(lexical, "TASK_TEXT", 500)
    index = lexical.build_lexical_index(docs)
    size = docs.selectExpr("sum(octet_length(text))").first()[0]
    assert index.postings.rdd.getNumPartitions() == -(-size // 500) > 4
    assert rows(index) == want and (3, 3, 80, "alpha", 80) in want


def test_grid_cells_and_intervals(spark):
    """Grid cells are joined without an aggregation, as by hand; the blocks of the interval join are read once."""
    from attestry.operators import layout

    r = random.Random(3)
    rows = [(d, p, float(r.randrange(0, 500, 25)), float(r.randrange(0, 60, 3)), r.choice(["a", "b", "c", None])) for d in (1, 2) for p in (0, 1) for _ in range(60)]
    rows = [(d, p, x, y, x + 10, y + 8, t) for d, p, x, y, t in sorted(set(rows), key=str)]
    words = spark.createDataFrame(rows, "doc_id long, page long, x0 double, y0 double, x1 double, y1 double, text string")
    edges = spark.createDataFrame([(d, p, [0.0, 100.0, 300.0]) for d in (1, 2) for p in (0, 1)], "doc_id long, page long, edges array<double>")
    want, anchors = {}, {}
    for d, p, x, y, x1, y1, t in sorted(rows, key=lambda w: (w[0], w[1], w[3], w[2])):
        seen = anchors.setdefault((d, p), [])
        at = next((a for a in seen if abs((y + y1) / 2 - a) < 10), None)
        if at is None:
            seen.append(at := (y + y1) / 2)
        want.setdefault((d, p, at, sum(e < (x + x1) / 2 for e in (0, 100, 300))), []).append((x, t or "", t))
    out = layout.to_grid(words, edges)
    assert {tuple(c)[:4]: c.cell for c in out.collect()} == {k: " ".join(t for _, _, t in sorted(v, key=lambda w: w[:2]) if t) for k, v in want.items()}
    assert "ObjectHashAggregate" not in out._jdf.queryExecution().toString()

    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(len(b))
            yield b

    blocks = spark.createDataFrame([(1, 0, i, 30.0 * i, 30.0 * i + 9) for i in range(20)], "doc_id long, page long, block_no long, y_top double, y_bottom double")
    lines = spark.createDataFrame([(1, 0, 45.0 * i, ["x"] if i % 3 else []) for i in range(12)], "doc_id long, page long, y_center double, labels array<string>")
    got = layout.assign_by_interval(blocks.mapInPandas(count, blocks.schema), lines)
    assert got.count() == 20 and read.value == 20


def test_search_in_rounds(spark, monkeypatch):
    """More shards than a round has: the result stays, and no shuffle repeats the queries for all of them."""
    r = random.Random(6)
    word = lambda: f"w{chr(97 + min(int(r.expovariate(.2)), 25))}"
    docs = spark.createDataFrame([(i, i % 90, " ".join(word() for _ in range(r.randint(1, 40)))) for i in range(150)], "chunk_id int, doc_id int, text string")
    q = spark.createDataFrame([(i, " ".join(word() for _ in range(5)) + f" {i}") for i in range(30)], "query_id int, text string")
    index = lexical.index_of(lexical.build_lexical_index(docs).postings, store=True)
    want = sorted(map(tuple, lexical.bm25_topk(q, index, 4, prune=False).select("query_id", "rank", "chunk_id", "doc_id", "score").collect()))
    monkeypatch.setattr(lexical, "SHARD_POSTINGS", 40)
    monkeypatch.setattr(lexical, "ROUND_SHARDS", 1)  # a task for each core, then
    cut, rounds = lexical.cut_lineage, []

    def count(df):
        stored = cut(df)
        if "score" in df.columns:
            rounds.append(stored)
        return stored

    monkeypatch.setattr(lexical, "cut_lineage", count)
    out = lexical.bm25_topk(q, index, 4).select("query_id", "rank", "chunk_id", "doc_id", "score")
    assert sorted(map(tuple, out.collect())) == want
    shards = -(-(index.terms.agg(F.sum("df")).first()[0]) // 40)
    assert len(rounds) == -(-shards // spark.sparkContext.defaultParallelism) > 2


def test_stored_tables_leave_no_shuffle(spark):
    """What a stored table was made of is gone from the shuffle folder once it is written."""
    import glob
    import time

    from attestry.scale import cut_lineage

    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    held = lambda: {f for d in folders for f in glob.glob(f"{d}/**/shuffle_*.data", recursive=True)}
    before = held()
    table = cut_lineage(spark.range(1000).repartition(3, "id"))
    until = time.time() + 20
    while held() - before and time.time() < until:  # files go a moment later
        time.sleep(.2)
    assert not held() - before and table.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_responses_take_their_evidence_in_parts(spark, sf, monkeypatch):
    """No part gathers most of the evidence, together they lose none, and the texts of a response move once."""
    from attestry.operators import audit as A
    from attestry.plans.catalog import audit as V

    whole = V.cited_documents(spark, sf)
    rows = lambda df: sorted(map(tuple, df.collect()))
    want = rows(A.audit_pairs(V.responses(spark, sf), whole).select("response_id", F.md5("response_text"), F.md5("evidence_text")))
    pairs, seen = A.audit_pairs, []
    monkeypatch.setattr(V.A, "audit_pairs", lambda r, e, **how: (seen.append(e.count()), pairs(r, e, **how))[1])
    assert rows(V.v1(spark, sf)) == want
    assert sum(seen) == whole.count() and 0 < max(seen) < 0.6 * sum(seen)
    p = pairs(V.responses(spark, sf), whole, parts=True).withColumn("answer", F.col("raw"))
    assert rows(A.citation_accuracy(p, mode="contains")) == rows(A.citation_accuracy(p.drop("evidence_parts"), whole, mode="contains"))


def test_quality_metrics_store_no_texts(spark, sf):
    """a4 needs the documents' ids only: before, it stored and read back the texts that responses cite."""
    files = entry.queries()["a4_quality_metrics"](spark, sf).inputFiles()
    assert any(f.endswith("documents.parquet") for f in files)
