"""Hybrid retrieval for a table of queries (R22): the flagship plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.functions.normalize import normalise_query
from attestry.functions.vectors import hashed_vectors
from attestry.operators.fusion import diversify, relevance_filter, rrf, with_keyword_relevance
from attestry.operators.lexical import ID_TERM, LexicalIndex, bm25_topk, build_lexical_index, index_of
from attestry.operators.vector import vector_topk
from attestry.params import Params
from attestry.scale import cut_lineage


@dataclass(frozen=True)
class Corpus:
    """Chunks with both indexes: chunks(chunk_id, doc_id, text), lexical, vectors(chunk_id, doc_id, embedding)."""

    chunks: DataFrame
    lexical: LexicalIndex
    vectors: DataFrame


def build_corpus(chunks: DataFrame, script: str = "any", materialise: bool = True) -> Corpus:
    """Index a chunk table.  Postings are the one expensive intermediate: cut once, then read by the term
    statistics, the scoring join and the default encoder."""
    built = build_lexical_index(chunks, script=script)
    lexical = index_of(built.postings, store=True) if materialise else built
    words = lexical.postings.where(~F.col("term").startswith(ID_TERM))
    vectors = hashed_vectors(words).join(chunks.select("chunk_id", "doc_id"), "chunk_id")
    return Corpus(chunks, lexical, vectors)


def encode_queries(queries: DataFrame, script: str = "any") -> DataFrame:
    """Default encoder over query texts: (query_id, embedding)."""
    as_chunks = queries.select(F.col("query_id").alias("chunk_id"), F.col("query_id").alias("doc_id"), "text")
    post = build_lexical_index(as_chunks, script=script).postings.where(~F.col("term").startswith(ID_TERM))
    return hashed_vectors(post).withColumnRenamed("chunk_id", "query_id")


def candidate_lists(queries: DataFrame, corpus: Corpus, p: Params = Params(), scope: DataFrame | None = None):
    """BM25 and vector lists of twice the configured depth (the query text is normalised for BM25 only)."""
    normal = queries.withColumn("text", normalise_query(F.col("text"), p.parity))
    lexical = bm25_topk(normal, corpus.lexical, 2 * p.topk_bm25, script=p.script, scope=scope)
    pair_scope = None
    if scope is not None:
        pair_scope = scope.join(corpus.chunks.select("chunk_id", "doc_id"), "doc_id").select("query_id", "chunk_id")
    n_chunks = corpus.lexical.corpus.first()["n"] if scope is None else None
    vec = vector_topk(encode_queries(queries, p.script), corpus.vectors, 2 * p.topk_vector, scope=pair_scope, n_vectors=n_chunks)
    vec = vec.join(corpus.chunks.select("chunk_id", "doc_id"), "chunk_id")
    return lexical, vec


def hybrid_retrieve(
    queries: DataFrame, corpus: Corpus, limit: int = 10, p: Params = Params(), scope: DataFrame | None = None
) -> DataFrame:
    """R22. queries(query_id, text) -> ranked hits with their scores and reasons."""
    lexical, vec = candidate_lists(queries, corpus, p, scope)
    # The fused list is small (at most four list depths per query) and is read twice below.
    fused = cut_lineage(rrf([lexical, vec], (p.w_bm25, p.w_vector), p.rrf_k))
    related = with_keyword_relevance(fused, queries, corpus.chunks, p.script, corpus.lexical.postings)
    return diversify(relevance_filter(related, p), limit)
