"""Lexical index and BM25 top-k for whole tables of queries."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry import params as P
from attestry.functions.patterns import find_all
from attestry.functions.tokens import clean_query, tokens
from attestry.params import Params
from attestry.scale import cut_lineage

#: Bytes of text whose postings one task counts: its table of terms takes some 30 times as much.
TASK_TEXT = 4_000_000
#: Postings of a shard, which one search task holds; postings and query terms that are packed at a time.
SHARD_POSTINGS = 4_000_000
#: Shards searched at a time, at least; queries are repeated for each of them on disk.
ROUND_SHARDS = 24
PACK_POSTINGS = 500_000
PACK_TERMS = 100_000
#: Cells of the rows that a shard holds of its commonest terms.
ROW_CELLS = 8_000_000
#: Scores are rounded to six digits: one counts as lower only by more than that.
SLACK = 2e-6
# Postings carry one extra entry per chunk for its document id, so that an id typed in a query matches it.
ID_TERM = "@id:"


@dataclass(frozen=True)
class LexicalIndex:
    """postings(chunk_id, doc_id, dl, term, tf), terms(term, df), corpus(n, avgdl: one row)."""

    postings: DataFrame
    terms: DataFrame
    corpus: DataFrame


def tokenize(df: DataFrame, col: str, script: str = "any", stop: Sequence[str] = P.STOP_WORDS) -> DataFrame:
    """R1. One row per token with its position; the stop list is a literal filter, not a join."""
    return df.select("*", F.posexplode(tokens(F.col(col), script, stop)).alias("pos", "token"))


def build_lexical_index(
    chunks: DataFrame, text: str = "text", chunk_id: str = "chunk_id", doc_id: str = "doc_id", script: str = "any"
) -> LexicalIndex:
    """R2. Postings with the chunk length stored beside each entry.

    The text moves once, hash-partitioned by chunk; term counting then stays inside that partitioning, and a
    later per-(query, chunk) sum needs no second shuffle either.  There are as many partitions as the text needs, so
    that the memory of a task does not grow with the corpus.
    """
    size = chunks.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = max(chunks.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_TEXT))
    base = chunks.select(
        F.col(chunk_id).alias("chunk_id"), F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")
    ).repartition(n, "chunk_id")
    toks = base.select("chunk_id", "doc_id", tokens(F.col("_text"), script).alias("_t"))
    entries = toks.select(
        "chunk_id", "doc_id", F.size("_t").cast("bigint").alias("dl"),
        F.explode(F.concat("_t", F.array(F.concat(F.lit(ID_TERM), F.col("doc_id").cast("string"))))).alias("term"),
    )
    postings = entries.groupBy("chunk_id", "doc_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    return index_of(postings)


def index_of(postings: DataFrame, store: bool = False) -> LexicalIndex:
    """Derive term and corpus statistics from a postings table.

    ``store`` writes the three tables once into the checkpoint folder: a search then reads two small tables where it
    would scan the postings for them."""
    keep = cut_lineage if store else (lambda df: df)
    postings = keep(postings)
    is_id = F.col("term").startswith(ID_TERM)
    terms = keep(postings.where(~is_id).groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    corpus = keep(postings.where(is_id).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")))
    return LexicalIndex(postings, terms, corpus)


def write_index(index: LexicalIndex, path: str) -> None:
    """R2. Persist postings sorted by term inside files, so that a term filter skips row groups by min/max, with the
    statistics beside them."""
    index.postings.repartition("chunk_id").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
    index.terms.write.mode("overwrite").parquet(f"{path}/terms")
    index.corpus.write.mode("overwrite").parquet(f"{path}/corpus")


def read_index(spark, path: str) -> LexicalIndex:
    return LexicalIndex(**{name: spark.read.parquet(f"{path}/{name}") for name in ("postings", "terms", "corpus")})


def query_terms(queries: DataFrame, text: str = "text", query_id: str = "query_id", script: str = "any") -> DataFrame:
    """Distinct (query_id, term), including one id term per white-space word."""
    c = clean_query(F.col(text))
    ids = F.transform(find_all(c, r"\S+"), lambda w: F.concat(F.lit(ID_TERM), w))
    return queries.select(
        F.col(query_id).alias("query_id"), F.explode(F.array_distinct(F.concat(tokens(c, script), ids))).alias("term")
    )


def top_k(df: DataFrame, k: int, score: str = "score", key: str = "query_id", tie: str = "chunk_id") -> DataFrame:
    """Rank by rounded score, then id.  ``rank <= k`` is pushed below the shuffle (WindowGroupLimit), so each
    task sends at most k rows per query."""
    w = Window.partitionBy(key).orderBy(F.col(score).desc(), F.col(tie).asc())
    return df.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)


def _weights(queries: DataFrame, index: LexicalIndex, text: str, query_id: str, script: str) -> DataFrame:
    """(query_id, term, idf, avgdl) of the query terms; an id term counts 1, a term the index lacks is left out."""
    stats = index.corpus.select(F.struct("n", "avgdl")).scalar()
    q = query_terms(queries, text, query_id, script)
    is_id = F.col("term").startswith(ID_TERM)
    ids = index.postings.where(is_id).select("term", F.lit(1).cast("bigint").alias("df")).distinct()
    return q.join(index.terms.unionByName(ids), "term").withColumn("_st", stats).select(
        "query_id", "term", F.when(is_id, 1.0).otherwise(F.log(F.col("_st.n") / (F.col("df") + 1)) + 1).alias("idf"), F.col("_st.avgdl").alias("avgdl"))


def bm25_topk(
    queries: DataFrame,
    index: LexicalIndex,
    k: int = Params.topk_bm25,
    text: str = "text",
    query_id: str = "query_id",
    script: str = "any",
    scope: DataFrame | None = None,
    mode: str = "first",
    k1: float = Params.bm25_k1,
    b: float = Params.bm25_b,
    prune: bool = True,
) -> DataFrame:
    """R3. BM25 top-k with OR semantics: (query_id, chunk_id, doc_id, score, rank).

    The postings of the query terms meet the queries in shards of chunks, where a query's terms are added up in the
    order of their upper bounds, until the terms left over cannot lift a new chunk to the k-th best score: from there
    on they are only looked up for chunks that can still reach it (``best_of_lists``).  Shards send at most their own
    best k and ties.  ``prune=False`` scores all pairs by joins; so does a search with a ``scope``, whose
    candidates are few.
    R8: ``scope`` (query_id, doc_id) restricts candidates before ranking (``mode="first"``, exact) or after an
    over-fetch of 3k (``mode="overfetch"``).
    """
    weights = _weights(queries, index, text, query_id, script)
    within = scope if mode == "first" else None
    depth = k if scope is None or mode == "first" else 3 * k
    if prune and within is None:
        ranked = _sharded(weights, index, depth, k1, b)
    else:
        norm = k1 * ((1 - b) + b * F.col("dl") / F.col("avgdl"))
        part = F.when(F.col("term").startswith(ID_TERM), F.col("idf")).otherwise(F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + norm))
        scored = _in_scope(index.postings.join(weights, "term").groupBy("query_id", "chunk_id", "doc_id").agg(F.sum(part).alias("score")), within)
        ranked = top_k(scored.withColumn("score", F.round("score", 6)), depth)
    return ranked if depth == k else top_k(_in_scope(ranked.drop("rank"), scope), k)


def _in_scope(df: DataFrame, scope: DataFrame | None) -> DataFrame:
    return df if scope is None else df.join(scope, ["query_id", "doc_id"], "left_semi")


def _sharded(weights: DataFrame, index: LexicalIndex, k: int, k1: float, b: float) -> DataFrame:
    """(query_id, chunk_id, doc_id, score, rank): the best k of each query.

    Shards are hashes of the chunk id, as many as the postings need, one task each.  Every posting moves once, packed
    with others of its shard; then all queries stream past the shard, packed too, so that what is repeated for each
    shard are a few bytes a query term.  Beyond ``ROUND_SHARDS`` (or a task for each core) shards are searched in rounds,
    of which each keeps its best k only: what stands on disk at a time grows with the queries, not with queries times
    shards."""
    spark = weights.sparkSession
    n_postings = index.terms.agg(F.sum("df")).first()[0] or 0
    cores = spark.sparkContext.defaultParallelism
    n_shards = max(cores, -(-n_postings // SHARD_POSTINGS))
    a_round = max(cores, ROUND_SHARDS)
    postings = index.postings.select("chunk_id", "doc_id", "dl", "term", "tf", F.pmod(F.hash("chunk_id"), F.lit(n_shards)).alias("shard"))
    packed = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("pack", T.BinaryType())])
    asked = weights.select("query_id", "term", "idf", "avgdl").repartition("query_id").sortWithinPartitions("query_id").mapInArrow(_pack_queries, packed)
    schema = T.StructType([weights.schema["query_id"], *[index.postings.schema[c] for c in ("chunk_id", "doc_id")], T.StructField("score", T.DoubleType())])

    def search(first: int, end: int) -> DataFrame:
        """The best k of each query in the shards from ``first`` to before ``end``."""
        stored = postings.where(F.col("shard").between(first, end - 1)).withColumn("shard", F.col("shard") - first).mapInArrow(_pack_postings, packed)
        repeated = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(end - first - 1))))
        meet = stored.unionByName(repeated).repartitionById(end - first, F.col("shard")).sortWithinPartitions("shard", "kind")
        found = meet.mapInArrow(_search_shards(k, k1, b), schema)
        return top_k(found.withColumn("score", F.round("score", 6)), k)

    if n_shards <= a_round:
        return search(0, n_shards)
    asked = cut_lineage(asked)
    n_rounds = -(-n_shards // a_round)
    edges = [i * n_shards // n_rounds for i in range(n_rounds + 1)]
    rounds = [cut_lineage(search(a, e).drop("rank")) for a, e in zip(edges, edges[1:], strict=False)]
    return top_k(reduce(DataFrame.unionByName, rounds), k)


def _dump(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def _load(pack: bytes) -> pa.Table:
    return pa.ipc.open_stream(pack).read_all()


def _packs(shards: list[int], kind: int, tables: list[pa.Table]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array([kind] * len(shards), pa.int32()), pa.array(map(_dump, tables), pa.binary())], ["shard", "kind", "pack"])


def _coded(table: pa.Table, *names: str) -> pa.Table:
    for name in names:
        table = table.set_column(table.column_names.index(name), name, table[name].combine_chunks().dictionary_encode())
    return table


def _pack_postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings -> a row for each shard and some 500,000 postings read."""
    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        shard = t["shard"].to_numpy()
        order = np.argsort(shard, kind="stable")
        names, at = np.unique(shard[order], return_index=True)
        t = t.drop_columns("shard").take(pa.array(order))
        ends = [*at[1:], len(shard)]
        return _packs(names.tolist(), 0, [_coded(t.slice(a, e - a), "chunk_id", "term") for a, e in zip(at, ends, strict=True)])

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= PACK_POSTINGS:
            yield flush(held)
            held, n = [], 0
    if n:
        yield flush(held)


def _pack_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(query_id, term, idf, avgdl) with a query's rows side by side -> rows of whole queries, some 100,000 terms each."""
    held: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        if held.num_rows >= PACK_TERMS:
            query = held["query_id"].combine_chunks()
            same = np.flatnonzero(pc.not_equal(query, query[-1]).to_numpy(zero_copy_only=False))
            cut = int(same[-1]) + 1 if len(same) else 0  # the last query may go on
            if cut:
                yield _packs([0], 1, [_coded(held.slice(0, cut), "query_id", "term")])
                held = held.slice(cut)
    if held is not None and held.num_rows:
        yield _packs([0], 1, [_coded(held, "query_id", "term")])


class _Shard:
    """Postings of one shard by term, chunks ascending."""

    def __init__(self, packs: list[bytes], avgdl: float, k1: float, b: float) -> None:
        self.place = place = {}
        codes, ats, tfs, names, docs, dls, n = [], [], [], [], [], [], 0
        while packs:
            t = _load(packs.pop())
            term, chunk = t["term"].combine_chunks(), t["chunk_id"].combine_chunks()
            own = np.fromiter((place.setdefault(x, len(place)) for x in term.dictionary.to_pylist()), dtype=np.int32, count=len(term.dictionary))
            at = chunk.indices.to_numpy()
            first = np.zeros(len(chunk.dictionary), dtype=np.int64)
            first[at] = np.arange(len(at))  # some posting of each chunk, for its document and length
            codes.append(own[term.indices.to_numpy()])
            ats.append(at + np.int32(n))
            tfs.append(t["tf"].to_numpy().astype(np.int32))
            names.append(chunk.dictionary)
            docs.append(t["doc_id"].take(pa.array(first)).combine_chunks())
            dls.append(t["dl"].to_numpy()[first].astype(np.float64))
            n += len(first)
        chunk = pa.chunked_array(names).combine_chunks().dictionary_encode()  # a chunk can be in two packs
        self.chunks = chunk.dictionary
        global_at = chunk.indices.to_numpy()
        first = np.zeros(len(self.chunks), dtype=np.int64)
        first[global_at] = np.arange(n)
        self.docs, dl = pa.chunked_array(docs).take(pa.array(first)).combine_chunks(), np.concatenate(dls)[first]
        code, at, tf = np.concatenate(codes), global_at[np.concatenate(ats)], np.concatenate(tfs)
        del codes, ats, tfs
        order = np.argsort(code * np.int64(len(self.chunks)) + at)
        code, tf, self.doc = code[order], tf[order], at[order].astype(np.int64)
        del order, at
        self.edges = np.searchsorted(code, np.arange(len(place) + 1)).tolist()
        norm = k1 * ((1 - b) + b * dl / avgdl)
        self.part = tf * (k1 + 1) / (tf + norm[self.doc])
        ids = np.zeros(len(place), dtype=bool)
        ids[[i for x, i in place.items() if x.startswith(ID_TERM)]] = True
        self.part[ids[code]] = 1.0
        self.top = np.maximum.reduceat(self.part, self.edges[:-1]).tolist()  # a term's bound in this shard
        self.score = np.zeros(len(self.chunks))
        # the commonest terms, whose lists are added faster chunk by chunk
        self.rows = {}
        sizes = np.diff(self.edges)
        for i in np.argsort(-sizes)[: ROW_CELLS // max(1, len(self.chunks))].tolist():
            if sizes[i] * 16 < len(self.chunks):
                break
            a, e = self.edges[i], self.edges[i + 1]
            self.rows[i] = np.zeros(len(self.chunks))
            self.rows[i][self.doc[a:e]] = self.part[a:e]

    def search(self, asked: pa.Table, k: int) -> pa.Table:
        queries, terms = asked["query_id"].combine_chunks(), asked["term"].combine_chunks()
        place = [self.place.get(x) for x in terms.dictionary.to_pylist()]
        of_query: list[list[tuple]] = [[] for _ in range(len(queries.dictionary))]
        for q, t, idf in zip(queries.indices.to_pylist(), terms.indices.to_pylist(), asked["idf"].to_pylist(), strict=True):
            i = place[t]
            if i is not None:
                of_query[q].append((idf * self.top[i], i, idf, self.edges[i], self.edges[i + 1]))
        found_q, found_d, found_s = [], [np.zeros(0, dtype=np.int64)], [np.zeros(0)]
        for q, lists in enumerate(of_query):
            if lists:
                lists.sort(reverse=True)
                best, value = best_of_lists(lists, self.doc, self.part, self.score, k, self.rows)
                found_q += [q] * len(best)
                found_d.append(best)
                found_s.append(value)
        d = pa.array(np.concatenate(found_d))
        return pa.table([queries.dictionary.take(pa.array(found_q, pa.int64())), self.chunks.take(d), self.docs.take(d), pa.array(np.concatenate(found_s))],
                        ["query_id", "chunk_id", "doc_id", "score"])


def _search_shards(k: int, k1: float, b: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, packs, shard = None, [], None
        for batch in batches:
            for i in range(batch.num_rows):
                name, kind, pack = (c[i].as_py() for c in batch.columns)
                if name != now:
                    now, packs, shard = name, [], None
                if kind == 0:
                    packs.append(pack)
                elif packs or shard:
                    asked = _load(pack)
                    shard = shard or _Shard(packs, asked["avgdl"][0].as_py(), k1, b)
                    yield from shard.search(asked, k).to_batches()

    return run


def best_of_lists(
    lists: list[tuple], doc: np.ndarray, part: np.ndarray, score: np.ndarray, k: int, rows: dict[int, np.ndarray] | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Chunks and scores of the best k of one query, with all that come within ``SLACK`` of the k-th.

    ``lists`` are (bound, term, weight, start, end), greatest bound first: ranges of ``doc`` (ascending) and ``part``;
    ``rows`` has the same parts for every chunk, 0 where the term is missing, of some terms.
    ``score`` holds zeros and does so again afterwards."""
    rows = rows or {}
    left = [*np.cumsum([t[0] for t in lists][::-1])[::-1].tolist(), 0.0]  # bound of all lists from here on
    floor, i = 0.0, 0
    while i < len(lists):
        if floor and left[i] < floor - SLACK:
            break
        _, term, weight, a, e = lists[i]
        row = rows.get(term)
        if row is None:
            score[doc[a:e]] += weight * part[a:e]
        else:
            score += weight * row
        i += 1
        # the threshold can stop the reading only once it may exceed what is left; a few lists are read sooner than it is found
        if i % 3 == 0 and i < len(lists) and left[0] - left[i] > left[i] and lists[i][4] - lists[i][3] > len(score) >> 5:
            floor = max(floor, _floor(score, k))
    floor = max(floor, _floor(score, k))
    least = floor - SLACK - left[i]
    live = np.flatnonzero(score >= least if least > 0 else score)  # every part is positive
    value = score[live]
    score[:] = 0.0
    while i < len(lists) and len(live):  # the other lists are only looked up
        floor = max(floor, _kth(value, k))
        good = value + left[i] >= floor - SLACK
        live, value = live[good], value[good]
        _, term, weight, a, e = lists[i]
        row = rows.get(term)
        if row is None:
            at = doc[a:e]
            where = np.minimum(np.searchsorted(at, live.astype(at.dtype)), len(at) - 1)
            value += weight * np.where(at[where] == live, part[a:e][where], 0.0)
        else:
            value += weight * row[live]
        i += 1
    good = value >= _kth(value, k) - SLACK
    return live[good], value[good]


def _floor(score: np.ndarray, k: int) -> float:
    """At most the k-th largest: that of the greatest values of 32 places each, or itself where those are too few."""
    n = len(score) // 32
    return _kth(score[: 32 * n].reshape(32, n).max(axis=0), k) if n >= k else _kth(score, k)


def _kth(values: np.ndarray, k: int) -> float:
    """The k-th largest, 0 if there are fewer."""
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else 0.0


def norm_by_max(hits: DataFrame, score: str = "score", key: str = "query_id") -> DataFrame:
    """R5. Score over the query's maximum, 0 when the maximum is not positive."""
    top = F.max(score).over(Window.partitionBy(key))
    return hits.withColumn("normalized_score", F.when(top > 0, F.col(score) / top).otherwise(0.0))


def get_chunks(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """R23. Point lookup."""
    return chunks.join(ids, "chunk_id", "left_semi")


def index_stats(postings: DataFrame, vectors: DataFrame, documents: DataFrame) -> DataFrame:
    """R24. Chunks per store for every document and its status: indexed needs both stores."""
    lex = postings.where(F.col("term").startswith(ID_TERM)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("lexical_chunks"))
    vec = vectors.groupBy("doc_id").agg(F.count(F.lit(1)).alias("vector_chunks"))
    both = lex.join(vec, "doc_id", "full_outer")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return documents.select("doc_id").join(both, "doc_id", "left").select(
        "doc_id", zero("lexical_chunks"), zero("vector_chunks"),
        F.when((F.col("lexical_chunks") > 0) & (F.col("vector_chunks") > 0), "indexed").otherwise("pending").alias("status"),
    )
