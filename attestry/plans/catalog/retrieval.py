"""Bindings of the retrieval rows: benchmark passages are the queries, documents the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.functions import similarity as S
from attestry.functions import tokens as T
from attestry.functions.vectors import hashed_vectors
from attestry.operators import cells, fusion, lexical, vector
from attestry.operators.containment import containing
from attestry.plans import hybrid
from attestry.plans.catalog import register
from attestry.plans.catalog import sql as Q
from attestry.scale import shared
from attestry.session import load_table


def queries_of(spark: SparkSession, sf: str) -> DataFrame:
    return load_table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def chunks_of(spark: SparkSession, sf: str) -> DataFrame:
    return load_table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "doc_id", "text")


def lexical_of(spark: SparkSession, sf: str) -> lexical.LexicalIndex:
    """The term index is built once per application and reused by every query that searches."""
    return shared(spark, ("lexical", sf), lambda: lexical.index_of(lexical.build_lexical_index(chunks_of(spark, sf)).postings, store=True), cut=False)


def corpus_of(spark: SparkSession, sf: str) -> hybrid.Corpus:
    idx = lexical_of(spark, sf)
    words = idx.postings.where(~F.col("term").startswith(lexical.ID_TERM))
    vectors = hashed_vectors(words).withColumn("doc_id", F.col("chunk_id"))
    return hybrid.Corpus(chunks_of(spark, sf), idx, vectors)


def hits_of(spark: SparkSession, sf: str, k: int = 60) -> DataFrame:
    return lexical.bm25_topk(queries_of(spark, sf), lexical_of(spark, sf), k)


def fuse(spark: SparkSession, sf: str) -> DataFrame:
    lex, vec = hybrid.candidate_lists(queries_of(spark, sf), corpus_of(spark, sf))
    return fusion.rrf([lex, vec])


def fused_of(spark: SparkSession, sf: str) -> DataFrame:
    return shared(spark, ("fused", sf), lambda: fuse(spark, sf))


def related_of(spark: SparkSession, sf: str) -> DataFrame:
    return shared(spark, ("related", sf), lambda: fusion.with_keyword_relevance(
        fused_of(spark, sf), queries_of(spark, sf), chunks_of(spark, sf), postings=lexical_of(spark, sf).postings))


WITH_Q = f"WITH {Q.BENCH_Q},"
LEX = WITH_Q + Q.bm25_ctes(60)
ALL = LEX + "," + Q.VECTOR_CTES + "," + Q.FUSED
REL = ALL + "," + Q.RELATED


@register("r1_tokenize", f"""
SELECT term AS token, count(*) AS n, count(DISTINCT doc_id) AS docs, min(length(term)) AS chars
FROM (SELECT doc_id, unnest({Q.tokens('text')}) AS term FROM documents) GROUP BY term""")
def r1(spark, sf):
    toks = lexical.tokenize(load_table(spark, sf, "documents").select("doc_id", "text"), "text").select("doc_id", "token")
    per_doc = toks.groupBy("token", "doc_id").agg(F.count(F.lit(1)).alias("c"))
    return per_doc.groupBy("token").agg(
        F.sum("c").alias("n"), F.count(F.lit(1)).alias("docs")
    ).withColumn("chars", F.length("token").cast("bigint"))


@register("r2_index_terms", f"""
WITH dtok AS (SELECT doc_id, {Q.tokens('text')} AS tk FROM documents),
post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(tk) AS term FROM dtok) GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(len(tk)) AS avgdl FROM dtok)
SELECT term, df, n, round(avgdl, 6) AS avgdl, total_tf FROM
 (SELECT term, count(*) AS df, sum(tf)::bigint AS total_tf FROM post GROUP BY term), st""")
def r2(spark, sf):
    idx = lexical.build_lexical_index(chunks_of(spark, sf))
    tf = idx.postings.where(~F.col("term").startswith(lexical.ID_TERM)).groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total_tf"))
    return tf.select("term", "df", idx.corpus.select("n").scalar().alias("n"),
                     F.round(idx.corpus.select("avgdl").scalar(), 6).alias("avgdl"), "total_tf")


@register("r3_bm25_topk", WITH_Q + Q.bm25_ctes(10) + " SELECT query_id, chunk_id, score, rank FROM hits")
def r3(spark, sf):
    return lexical.bm25_topk(queries_of(spark, sf), lexical_of(spark, sf), 10).select("query_id", "chunk_id", "score", "rank")


@register("r4_clean_query", f"SELECT item_id AS query_id, {Q.clean_query('text')} AS cleaned FROM benchmark")
def r4(spark, sf):
    return queries_of(spark, sf).select("query_id", T.clean_query(F.col("text")).alias("cleaned"))


@register("r5_norm_by_max", LEX + """
 SELECT query_id, chunk_id, round(CASE WHEN mx > 0 THEN score / mx ELSE 0 END, 6) AS normalized_score
 FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS mx FROM hits)""")
def r5(spark, sf):
    out = lexical.norm_by_max(hits_of(spark, sf))
    return out.select("query_id", "chunk_id", F.round("normalized_score", 6).alias("normalized_score"))


EMB_SQL = """
WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id,
  round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) AS score
  FROM embeddings a CROSS JOIN embeddings b {where})
SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
FROM s QUALIFY rank <= {k}"""


def _emb(spark, sf):
    v = load_table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return v.withColumnRenamed("chunk_id", "query_id"), v


@register("r6_vector_topk", EMB_SQL.format(where="", k=10))
def r6(spark, sf):
    q, v = _emb(spark, sf)
    return vector.vector_topk(q, v, 10)


@register("r6_pruned_topk", EMB_SQL.format(where="", k=10))
def r6c(spark, sf):
    q, v = _emb(spark, sf)
    return cells.pruned_topk(q, v, 10)


@register("r6_pruning_report")
def r6b(spark, sf):
    q, v = _emb(spark, sf)
    return cells.pruning_report(q, v, 10)


@register("r20_similar", EMB_SQL.format(where="WHERE a.vec_id <> b.vec_id", k=5))
def r20(spark, sf):
    q, v = _emb(spark, sf)
    return cells.pruned_topk(q, v, 5, exclude_self=True)


@register("r7_embed", f"""
WITH q AS (SELECT item_id AS query_id, text FROM benchmark), b AS (
 SELECT query_id, cast('0x' || substr(md5(term), 1, 8) AS ubigint) % 64 AS d, count(*)::double AS c
 FROM (SELECT query_id, unnest({Q.tokens('text')}) AS term FROM q) GROUP BY ALL)
SELECT query_id, d::bigint AS dim, round(c / sqrt(sum(c * c) OVER (PARTITION BY query_id)), 6) AS value FROM b""")
def r7(spark, sf):
    from attestry.functions.encoder import hashed_encoder

    v = vector.embed(queries_of(spark, sf), hashed_encoder)
    return v.select("query_id", F.posexplode("embedding").alias("dim", "value")).where("value > 0").select(
        "query_id", F.col("dim").cast("bigint").alias("dim"), F.round("value", 6).alias("value"))


SCOPE_SQL = """scope AS (SELECT DISTINCT b.item_id AS query_id, d2.doc_id FROM benchmark b
  JOIN documents d1 ON d1.doc_id = b.item_id JOIN documents d2 ON d2.source = d1.source),"""


def scope_of(spark, sf):
    """Each query may see the documents of one source: the source of the document with its number."""
    docs = load_table(spark, sf, "documents").select("doc_id", "source")
    own = queries_of(spark, sf).select("query_id").join(docs, F.col("query_id") == F.col("doc_id")).select("query_id", "source")
    return own.join(docs, "source").select("query_id", "doc_id")


@register("r8_scope_first", f"WITH {Q.BENCH_Q}," + SCOPE_SQL + Q.bm25_ctes(
    5, scope="SEMI JOIN scope ON scope.query_id = scored.query_id AND scope.doc_id = scored.chunk_id")
    + " SELECT query_id, chunk_id, score, rank FROM hits")
def r8(spark, sf):
    out = lexical.bm25_topk(queries_of(spark, sf), lexical_of(spark, sf), 5, scope=scope_of(spark, sf))
    return out.select("query_id", "chunk_id", "score", "rank")


@register("r8_scope_overfetch", f"WITH {Q.BENCH_Q}," + SCOPE_SQL + Q.bm25_ctes(90) + """
 SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
 FROM (SELECT query_id, chunk_id, score FROM hits SEMI JOIN scope ON scope.query_id = hits.query_id AND scope.doc_id = hits.chunk_id) QUALIFY rank <= 30""")
def r8b(spark, sf):
    out = lexical.bm25_topk(queries_of(spark, sf), lexical_of(spark, sf), 30, scope=scope_of(spark, sf), mode="overfetch")
    return out.select("query_id", "chunk_id", "score", "rank")


@register("r9_rrf", ALL + " SELECT query_id, chunk_id, rrf_score FROM fused")
def r9(spark, sf):
    return fuse(spark, sf).select("query_id", "chunk_id", "rrf_score")


@register("r10_keywords", f"SELECT DISTINCT query_id, k AS keyword FROM (SELECT item_id AS query_id, unnest({Q.KEYWORDS}) AS k FROM benchmark)")
def r10(spark, sf):
    return queries_of(spark, sf).select("query_id", F.explode(T.extract_keywords(F.col("text"))).alias("keyword"))


@register("r11_content_words")
def r11(spark, sf):
    """Content-word shares over the whole corpus vocabulary."""
    terms = lexical_of(spark, sf).terms
    return terms.withColumn("content", T.is_content_word(F.col("term"))).groupBy("content").agg(
        F.count(F.lit(1)).alias("terms"), F.sum("df").alias("postings"))


SUFFIXES = ("ation", "tion", "ing", "ed", "er", "en", "s")


@register("r12_strip_particles", f"""
WITH t AS (SELECT DISTINCT unnest({Q.tokens('text')}) AS term FROM documents)
SELECT term, regexp_replace(term, '^(.+?)(?:{"|".join(SUFFIXES)})$', '\\1') AS stem FROM t""")
def r12(spark, sf):
    return lexical_of(spark, sf).terms.select("term", T.strip_particles(F.col("term"), SUFFIXES).alias("stem"))


@register("r13_keyword_relevance", REL + " SELECT query_id, chunk_id, keyword_relevance FROM related")
def r13(spark, sf):
    rel = fusion.with_keyword_relevance(fused_of(spark, sf), queries_of(spark, sf), chunks_of(spark, sf), postings=lexical_of(spark, sf).postings)
    return rel.select("query_id", "chunk_id", "keyword_relevance")


@register("r15_ngram_jaccard", f"""
WITH p AS (SELECT b.item_id AS query_id, d.doc_id, {Q.grams('lower(b.text)')} AS a, {Q.grams('lower(d.text)')} AS b
  FROM benchmark b JOIN documents d ON d.doc_id = b.item_id)
SELECT query_id, doc_id, round({Q.jaccard('a', 'b')}, 6) AS similarity FROM p""")
def r15(spark, sf):
    q = queries_of(spark, sf).withColumnRenamed("text", "q_text")
    docs = load_table(spark, sf, "documents").select("doc_id", "text")
    j = q.join(docs, F.col("query_id") == F.col("doc_id"))
    return j.select("query_id", "doc_id", F.round(
        S.ngram_jaccard(F.lower("q_text"), F.lower("text")), 6).alias("similarity"))


@register("r16_number_match", rf"""
WITH c AS (SELECT conv_id, turn, role, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations),
k AS (SELECT *, [lower(x) for x in list_distinct({Q.KEYWORDS}) if regexp_matches(x, '\d')] AS nums FROM c WHERE nxt IS NOT NULL)
SELECT conv_id, turn, round(CASE WHEN len(nums) = 0 THEN 0e0 ELSE
  len([n for n in nums if contains(lower(nxt), n)])::double / len(nums) END, 6) AS score FROM k""")
def r16(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    c = load_table(spark, sf, "conversations").withColumn("nxt", F.lead("text").over(w)).where("nxt IS NOT NULL")
    score = S.number_match(T.extract_keywords(F.col("text")), F.col("nxt"))
    return c.select("conv_id", "turn", F.round(score, 6).alias("score"))


@register("r17_relevance_filter", REL + "," + Q.FILTERED
          + " SELECT query_id, chunk_id, keyword_relevance, include_reason, relevance FROM filtered")
def r17(spark, sf):
    return fusion.relevance_filter(related_of(spark, sf)).select(
        "query_id", "chunk_id", "keyword_relevance", "include_reason", "relevance")


@register("r18_diversify", REL + "," + Q.FILTERED + "," + Q.diverse(10, "score") + " SELECT query_id, chunk_id, position FROM diverse")
def r18(spark, sf):
    out = fusion.diversify(fusion.relevance_filter(related_of(spark, sf)), 10, order="score")
    return out.select("query_id", "chunk_id", "position")


@register("r19_retrieve_filtered", REL + "," + Q.FILTERED + "," + Q.diverse(20) + """
 SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY position) AS rank
 FROM diverse SEMI JOIN (SELECT doc_id FROM documents WHERE lang IN ('en', 'de')) t ON t.doc_id = diverse.chunk_id QUALIFY rank <= 10""")
def r19(spark, sf):
    hits = fusion.diversify(fusion.relevance_filter(related_of(spark, sf)), 20)
    docs = load_table(spark, sf, "documents").select("doc_id", F.col("lang").alias("type"))
    out = fusion.retrieve_filtered(hits.join(docs, "doc_id"), 10, types=("en", "de"))
    return out.select("query_id", "chunk_id", "rank")


@register("r21_rerank_fuse", ALL + """,
 sc AS (SELECT *, ((chunk_id * 31 + query_id * 17) % 101) / 100e0 AS rr FROM fused)
 SELECT query_id, chunk_id, rr AS rerank_score, round(rrf_score * 0.8e0 + rr * 0.2e0, 6) AS hybrid_score,
  row_number() OVER (PARTITION BY query_id ORDER BY rr DESC, chunk_id) AS rank FROM sc QUALIFY rank <= 10""")
def r21(spark, sf):
    scored = fused_of(spark, sf).withColumn("rerank_score", ((F.col("chunk_id") * 31 + F.col("query_id") * 17) % 101) / F.lit(100.0))
    return fusion.rerank_fuse(scored).select("query_id", "chunk_id", "rerank_score", "hybrid_score", "rank")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    corpus = hybrid.build_corpus(chunks_of(spark, sf))
    out = hybrid.hybrid_retrieve(queries_of(spark, sf), corpus, 10)
    return out.select("query_id", "chunk_id", "rrf_score", "keyword_relevance", "include_reason", "position")


register("r22_hybrid_retrieve", REL + "," + Q.FILTERED + "," + Q.diverse(10) + """
 SELECT query_id, chunk_id, rrf_score, keyword_relevance, include_reason, position FROM diverse""")(flagship)


@register("r23_get_chunks", """
SELECT doc_id AS chunk_id, length(text) AS chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def r23(spark, sf):
    ids = load_table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("chunk_id"))
    return lexical.get_chunks(chunks_of(spark, sf), ids).select("chunk_id", F.length("text").cast("bigint").alias("chars"))


@register("r24_index_stats", """
SELECT d.doc_id, 1::bigint AS lexical_chunks, (e.vec_id IS NOT NULL)::bigint AS vector_chunks,
  CASE WHEN e.vec_id IS NULL THEN 'pending' ELSE 'indexed' END AS status
FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id""")
def r24(spark, sf):
    vec = load_table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return lexical.index_stats(lexical_of(spark, sf).postings, vec, load_table(spark, sf, "documents"))


TRUTH = "truth AS (SELECT q.query_id, d.doc_id FROM q JOIN documents d ON contains(d.text, q.text))"


def truth_of(spark, sf) -> DataFrame:
    """Documents that contain a benchmark passage verbatim."""
    texts = load_table(spark, sf, "documents").select(F.col("doc_id").alias("text_id"), "text")
    found = containing(texts, queries_of(spark, sf).withColumnRenamed("query_id", "passage_id"))
    return found.select(F.col("passage_id").alias("query_id"), F.col("text_id").alias("doc_id"))


@register("r25_retrieval_eval", LEX + "," + TRUTH + """,
 first AS (SELECT t.query_id, min(rank) AS r FROM truth t LEFT JOIN hits h ON h.query_id = t.query_id AND h.chunk_id = t.doc_id GROUP BY ALL)
 SELECT count(*) AS n_queries, round(avg(CASE WHEN r <= 1 THEN 1e0 ELSE 0e0 END), 6) AS hit_at_1,
  round(avg(CASE WHEN r <= 5 THEN 1e0 ELSE 0e0 END), 6) AS hit_at_5, round(avg(CASE WHEN r <= 10 THEN 1e0 ELSE 0e0 END), 6) AS hit_at_10,
  round(avg(coalesce(1e0 / r, 0e0)), 6) AS mrr FROM first""")
def r25(spark, sf):
    return fusion.retrieval_eval(hits_of(spark, sf), truth_of(spark, sf), queries_of(spark, sf))
