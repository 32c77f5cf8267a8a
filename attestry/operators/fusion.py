"""Rank fusion, relevance filter, diversity and rerank fusion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions.similarity import keyword_parts, keyword_score, missing_keywords
from attestry.functions.tokens import char_ngrams, extract_keywords
from attestry.operators.fuzzyjoin import chunk_words, keyword_links, linked_keywords, posting_words, vocabulary
from attestry.operators.lexical import top_k
from attestry.params import Params
from attestry.scale import cut_lineage, spread


def rrf(lists: Sequence[DataFrame], weights: Sequence[float] = (Params.w_bm25, Params.w_vector), k: int = Params.rrf_k) -> DataFrame:
    """R9, U1, J1. Reciprocal-rank fusion of (query_id, chunk_id, doc_id, rank) lists.

    Union plus one grouping instead of a full outer join; the first list that has the chunk supplies its
    attributes.
    """
    tagged = None
    for i, (lst, w) in enumerate(zip(lists, weights)):
        part = lst.select(
            "query_id", "chunk_id", "doc_id", F.lit(i).alias("_list"), (F.lit(w) * (F.lit(1.0) / (F.lit(k) + F.col("rank")))).alias("_s")
        )
        tagged = part if tagged is None else tagged.unionByName(part)
    return tagged.groupBy("query_id", "chunk_id").agg(
        F.min_by("doc_id", "_list").alias("doc_id"), F.round(F.sum("_s"), 9).alias("rrf_score")
    )


def with_keyword_relevance(
    hits: DataFrame, queries: DataFrame, chunks: DataFrame, script: str = "any", postings: DataFrame | None = None, links: DataFrame | None = None
) -> DataFrame:
    """R13 for a hit table, with the partial matches of R14.

    Only chunks that some query hit are touched; their bigrams are computed once per chunk and shared by all queries
    that hit it.  Keywords a text does not hold go on without the text: ``links`` (``keyword_links`` of the keywords and
    the vocabulary; built here if not given) names the words that would do, ``postings`` tells which chunk has them.
    Only those of the chunks hit are read on: words that stand in no such chunk can settle nothing, and links to the
    vocabulary of the hits grow with the hits, not with the corpus."""
    kws = queries.select("query_id", extract_keywords(F.col("text"), script).alias("_kw"))
    touched = chunks.join(hits.select("chunk_id"), "chunk_id", "left_semi").select("chunk_id", "text")
    # The bigrams are CPU work on the candidates only; hashing them by chunk spreads it and serves the join.
    texts = spread(touched, "chunk_id").select("chunk_id", F.col("text").alias("_text"), char_ngrams(F.lower(F.col("text"))).alias("_grams"))
    measured = cut_lineage(hits.join(kws, "query_id").join(texts, "chunk_id").select(
        *hits.columns, keyword_parts(F.col("_kw"), F.col("_text"), F.col("_grams")).alias("_parts"),
        missing_keywords(F.col("_kw"), F.col("_text")).alias("_missing")))
    missing = measured.select("query_id", "chunk_id", F.explode("_missing").alias("keyword"))
    if postings is not None:
        postings = cut_lineage(postings.select("chunk_id", "term").join(measured.select("chunk_id").distinct(), "chunk_id", "left_semi"))
    if links is None:
        known = chunk_words(touched, script).select("word").distinct() if postings is None else vocabulary(postings, script)
        links = cut_lineage(keyword_links(kws.select(F.explode(F.transform("_kw", lambda k: F.lower(k))).alias("keyword")), known))
    words = cut_lineage(chunk_words(touched, script)) if postings is None else posting_words(postings, touched, links, script)
    found = missing.join(linked_keywords(missing, links, words), ["chunk_id", "keyword"]).groupBy("query_id", "chunk_id").agg(F.count(F.lit(1)).alias("_n"))
    share = F.coalesce(F.col("_n"), F.lit(0)) / F.greatest(F.col("_parts.n"), F.lit(1))
    out = measured.join(found, ["query_id", "chunk_id"], "left")
    return out.select(*hits.columns, F.round(keyword_score(F.col("_parts"), share), 6).alias("keyword_relevance"))


def _weighted(a: Column, wa: float, b: Column, wb: float) -> Column:
    """wa * a + wb * b in decimals: the inputs have at most nine digits, so nothing is rounded at a half."""
    exact = lambda c, w: c.cast("decimal(18,9)") * F.lit(w).cast("decimal(2,1)")
    return (exact(a, wa) + exact(b, wb)).cast("double")


def relevance_filter(hits: DataFrame, p: Params = Params()) -> DataFrame:
    """R17. Keep hits with both signals, or a strong keyword signal; a query left with none keeps its first
    ``fallback_rows`` by fused score.  Adds ``include_reason`` and ``relevance`` (.7 fused + .3 keyword)."""
    rrf_s, kw = F.col("rrf_score"), F.col("keyword_relevance")
    reason = F.when((rrf_s >= p.rrf_floor) & (kw >= p.kw_floor), "hybrid").when(kw >= p.kw_strong, "strong_keyword")
    by_query = Window.partitionBy("query_id")
    ranked = (
        hits.withColumn("_reason", reason)
        .withColumn("_any", F.max(F.col("_reason").isNotNull()).over(by_query))
        .withColumn("_rn", F.row_number().over(by_query.orderBy(rrf_s.desc(), F.col("chunk_id").asc())))
    )
    kept = ranked.where(F.col("_reason").isNotNull() | (~F.col("_any") & (F.col("_rn") <= p.fallback_rows)))
    return kept.withColumn("include_reason", F.coalesce("_reason", F.lit("emergency_fallback"))).withColumn(
        "relevance", _weighted(rrf_s, 0.7, kw, 0.3)
    ).drop("_reason", "_any", "_rn")


def diversify(hits: DataFrame, limit: int = 10, order: str = "doc_id") -> DataFrame:
    """R18. First the best hit of each document (in document order, or by score), then the rest by score.

    Both windows use the query partitioning, so they share one shuffle."""
    key = F.col("rrf_score") + F.col("keyword_relevance")
    best = Window.partitionBy("query_id", "doc_id").orderBy(F.round(key, 6).desc(), F.col("chunk_id").asc())
    first_key = F.col("doc_id") if order == "doc_id" else -F.round(key, 6)
    final = Window.partitionBy("query_id").orderBy(
        F.col("_pass"), F.when(F.col("_pass") == 0, first_key), F.round(key, 6).desc(), F.col("chunk_id").asc()
    )
    return (
        hits.withColumn("_pass", F.when(F.row_number().over(best) == 1, 0).otherwise(1))
        .withColumn("position", F.row_number().over(final).cast("bigint"))
        .where(F.col("position") <= limit).drop("_pass")
    )


def retrieve_filtered(hits: DataFrame, limit: int, doc_ids: DataFrame | None = None, types: Sequence[str] = ()) -> DataFrame:
    """R19. Cut to twice the limit, filter by documents and chunk types, cut to the limit."""
    out = hits.where(F.col("position") <= 2 * limit)
    if doc_ids is not None:
        out = out.join(doc_ids, "doc_id", "left_semi")
    if types:
        out = out.where(F.col("type").isin(*types))
    w = Window.partitionBy("query_id").orderBy("position")
    return out.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= limit)


def rerank_fuse(hits: DataFrame, score_col: str = "rerank_score", k: int = Params.topk_rerank, w: float = Params.w_rerank) -> DataFrame:
    """R21. Top k by rerank score; hybrid = (1-w) fused + w rerank."""
    out = top_k(hits, k, score=score_col)
    return out.withColumn("hybrid_score", F.round(F.col("rrf_score") * (1 - w) + F.col(score_col) * w, 6))


def retrieval_eval(hits: DataFrame, truth: DataFrame, queries: DataFrame, cutoffs: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """R25. hit@k and MRR over the queries that have a true document."""
    with_truth = truth.select("query_id").distinct()
    first = hits.join(truth.select("query_id", "doc_id"), ["query_id", "doc_id"]).groupBy("query_id").agg(F.min("rank").alias("_r"))
    per_query = with_truth.join(first, "query_id", "left")
    return per_query.agg(
        F.count(F.lit(1)).alias("n_queries"),
        *[F.round(F.avg(F.when(F.col("_r") <= c, 1.0).otherwise(0.0)), 6).alias(f"hit_at_{c}") for c in cutoffs],
        F.round(F.avg(F.coalesce(1.0 / F.col("_r"), F.lit(0.0))), 6).alias("mrr"),
    )
