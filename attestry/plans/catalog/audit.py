"""Bindings of the audit rows: an assistant turn answers the user turn before it; its evidence is that turn's
top five documents; line i of an answer carries the marker [(i - 1) % 5 + 1];
every sentence of an answer is a key fact.  An id of a turn is conv_id * 10**9 + turn."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions import similarity as S
from attestry.functions.normalize import norm_compare
from attestry.functions.tokens import extract_keywords, split_sentences, tokens
from attestry.operators import audit as A
from attestry.operators import citations as C
from attestry.operators import fuzzyjoin as Z
from attestry.operators import oplog as O
from attestry.plans.catalog import register
from attestry.plans.catalog import sql as Q
from attestry.plans.catalog.dialog import TH, turn_hits
from attestry.plans.catalog.retrieval import chunks_of, fused_of, lexical_of, queries_of
from attestry.scale import cut_lineage, shared, spread
from attestry.session import load_table

#: Parts of the responses that take their evidence along one after the other.
PARTS = 4


def base(spark, sf):
    c = load_table(spark, sf, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = c.withColumn("pr", F.lag("role").over(w)).withColumn("pt", F.lag("turn").over(w)).where("role = 'assistant' AND pr = 'user'")
    return c.select((F.col("conv_id") * 1_000_000_000 + F.col("turn")).alias("response_id"), (F.col("conv_id") * 1_000_000_000 + F.col("pt")).alias("query_id"), "text")


def marked(c):
    lines = F.split(c, "\n")
    return F.array_join(F.transform(lines, lambda l, i: F.concat(l, F.lit(" ["), ((i % 5) + 1).cast("string"), F.lit("]"))), "\n")


def responses(spark, sf):
    t = F.col("text")
    facts = split_sentences(t)
    return base(spark, sf).select("response_id", "query_id", t.alias("raw"), marked(t).alias("answer"), facts.alias("key_facts"), F.lit("").alias("details"))


def cited_documents(spark, sf):
    """(response_id, rank, doc_id, page, text): the top five documents of the turn that a response answers."""
    d = load_table(spark, sf, "documents").select("doc_id", "text")
    r = base(spark, sf).select("response_id", "query_id")
    h = turn_hits(spark, sf).where("rank <= 5").select("query_id", "doc_id", "rank")
    return r.join(h, "query_id").join(d, "doc_id").select("response_id", "rank", "doc_id", F.col("rank").alias("page"), "text")


def evidence(spark, sf):
    """The cited documents, stored once and shared.

    Sorted by document, so that a text that many responses share lies side by side and takes little room; the shuffle of
    all documents is gone before a query moves texts to the responses."""
    return shared(spark, ("evidence", sf), lambda: cited_documents(spark, sf).sortWithinPartitions("doc_id"))


def in_parts(spark, sf, measure):
    """``measure(responses, evidence)``, whose rows depend on one response each, over a part of the responses at a time.

    Each response takes five whole documents along, twice the corpus in all; of these only a part's stand in shuffle files
    at a time."""
    part = F.pmod(F.xxhash64("response_id"), F.lit(PARTS))
    r, e = responses(spark, sf), evidence(spark, sf)
    return reduce(DataFrame.unionByName, [cut_lineage(measure(r.where(part == i), e.where(part == i))) for i in range(PARTS)])


def citations(spark, sf):
    """Cited pages drift by up to two from the evidence page."""
    return _citations(cited_documents(spark, sf))


def _citations(evidence):
    return evidence.select("response_id", "doc_id", (F.col("page") + F.col("doc_id") % 3).alias("page"))


FACTS = r"""list_filter([regexp_replace(x, '^\s+|\s+$', '', 'g') for x in string_split_regex({c}, '[.!?。]\s*')], lambda x: x <> '')"""
R = TH + rf""",
b0 AS (SELECT conv_id * 1000000000 + turn AS response_id, conv_id * 1000000000 + lag(turn) OVER o AS query_id, text, role, lag(role) OVER o AS pr FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn)),
rs AS MATERIALIZED (SELECT response_id, query_id, text AS raw, array_to_string(list_transform(string_split(text, chr(10)), lambda l, i: l || ' [' || ((i - 1) % 5 + 1) || ']'), chr(10)) AS answer,
  {FACTS.format(c='text')} AS key_facts FROM b0 WHERE role = 'assistant' AND pr = 'user'),
ev AS MATERIALIZED (SELECT response_id, rank, th.doc_id, d.text FROM rs JOIN th USING (query_id) JOIN documents d ON d.doc_id = th.doc_id WHERE rank <= 5),
et AS MATERIALIZED (SELECT response_id, string_agg(text, ' ' ORDER BY rank) AS evidence_text, count(*) AS n FROM ev GROUP BY response_id),
ap AS MATERIALIZED (SELECT rs.*, coalesce(evidence_text, '') AS evidence_text, coalesce(n, 0) AS n, answer || ' ' || array_to_string(key_facts, ' ') || ' ' AS response_text FROM rs LEFT JOIN et USING (response_id))"""


@register("v1_audit_pairs", R + " SELECT response_id, md5(response_text) AS response, md5(evidence_text) AS evidence FROM ap")
def v1(spark, sf):
    return in_parts(spark, sf, lambda r, e: A.audit_pairs(r, e).select(
        "response_id", F.md5("response_text").alias("response"), F.md5("evidence_text").alias("evidence")))


JAC = f", jw AS MATERIALIZED (SELECT response_id, list_distinct({Q.words('response_text')}) AS a, list_distinct({Q.words('evidence_text')}) AS b FROM ap), jc AS (SELECT response_id, round({Q.jaccard('a', 'b')}, 6) AS j FROM jw)"


@register("v2_token_jaccard", R + JAC + " SELECT response_id, j AS jaccard_score FROM jc")
def v2(spark, sf):
    p = A.audit_pairs(responses(spark, sf), evidence(spark, sf))
    return p.select("response_id", F.round(S.token_jaccard(F.col("response_text"), F.col("evidence_text")), 6).alias("jaccard_score"))


COV = rf""", cv AS (SELECT response_id, round(CASE WHEN len(s) = 0 THEN 0e0 ELSE len([x for x in s if contains(e, lower(x))])::double / len(s) END, 6) AS sc,
 round(CASE WHEN len(key_facts) = 0 THEN 1e0 ELSE len([x for x in key_facts if contains(e, lower(x))])::double / len(key_facts) END, 6) AS fg
 FROM (SELECT response_id, key_facts, lower(evidence_text) AS e, {FACTS.format(c='response_text')} AS s FROM ap))"""


@register("v3_coverage_contains", R + COV + " SELECT response_id, sc AS sentence_coverage, fg AS fact_grounding FROM cv")
def v3(spark, sf):
    p = A.audit_pairs(responses(spark, sf), evidence(spark, sf))
    e = F.col("evidence_text")
    return p.select("response_id", F.round(A.sentence_coverage(split_sentences(F.col("response_text")), e, mode="contains"), 6).alias("sentence_coverage"),
                    F.round(A.fact_grounding(F.col("key_facts"), e, mode="contains"), 6).alias("fact_grounding"))


@register("v3_coverage_fuzzy")
def v3b(spark, sf):
    p = A.audit_pairs(responses(spark, sf), evidence(spark, sf))
    e = F.col("evidence_text")
    return p.select("response_id", F.round(A.sentence_coverage(split_sentences(F.col("response_text")), e), 6).alias("sentence_coverage"))


VAL = ", cvl AS (SELECT response_id, round(avg(CASE WHEN doc_id % 3 <= 1 THEN 1e0 ELSE 0e0 END), 6) AS v FROM ev GROUP BY response_id)"


@register("v4_citation_validity", R + VAL + " SELECT response_id, v AS citation_validity FROM cvl")
def v4(spark, sf):
    v = A.citation_validity(citations(spark, sf), evidence(spark, sf))
    return v.select("response_id", F.round("citation_validity", 6).alias("citation_validity"))


@register("v5_audit_responses", R + JAC + COV + VAL + """, z AS (SELECT response_id, j, sc, fg, coalesce(v, CASE WHEN n = 0 THEN 1e0 ELSE 0.5e0 END) AS v FROM ap JOIN jc USING (response_id) JOIN cv USING (response_id) LEFT JOIN cvl USING (response_id)),
 y AS (SELECT *, round((j + sc + fg + v) / 4, 6) AS c, j < 0.25e0 AS h FROM z)
 SELECT response_id, j AS jaccard_score, sc AS sentence_coverage, fg AS fact_grounding, v AS citation_accuracy, c AS confidence, h AS hallucination_detected, c >= 0.4e0 AND NOT h AS is_valid,
 CASE WHEN h OR c < 0.3e0 THEN 'low' WHEN c < 0.5e0 THEN 'medium' ELSE 'high' END AS quality_level FROM y""")
def v5(spark, sf):
    return A.audit_responses(responses(spark, sf), evidence(spark, sf), citations(spark, sf), mode="contains")


@register("v5_audit_responses_fuzzy")
def v5b(spark, sf):
    return A.audit_responses(responses(spark, sf), evidence(spark, sf), citations(spark, sf))


@register("v6_entity_variations")
def v6(spark, sf):
    return in_parts(spark, sf, A.entity_variations)


def with_note(spark, sf):
    """Answers that open with a word of their first evidence and an added explanation."""
    p = A.audit_pairs(responses(spark, sf), evidence(spark, sf))
    first = F.regexp_extract("evidence_text", r"\p{L}{3,}", 0)
    return p.withColumn("response_text", F.concat(first, F.lit(" (note) "), F.col("response_text")))


NOTE = r", nt AS (SELECT response_id, evidence_text, regexp_extract(evidence_text, '\p{L}{3,}') || ' (note) ' || response_text AS t FROM ap)"


@register("v7_added_parentheticals", R + NOTE + r""", f AS (SELECT response_id, evidence_text, unnest(regexp_extract_all(t, '([\p{L}]+[\p{L}\d]*)\s*\(([^)]+)\)')) AS "full",
 unnest(regexp_extract_all(t, '([\p{L}]+[\p{L}\d]*)\s*\(([^)]+)\)', 1)) AS entity FROM nt)
 SELECT response_id, "full", entity FROM f WHERE NOT contains(evidence_text, "full") AND contains(evidence_text, entity)""")
def v7(spark, sf):
    return A.added_parentheticals(with_note(spark, sf))


@register("v7_fix_parentheticals")
def v7b(spark, sf):
    return with_note(spark, sf).select("response_id", F.md5(A.fix_parentheticals(F.col("response_text"), F.col("evidence_text"))).alias("checksum"))


@register("v8_entity_corrections")
def v8(spark, sf):
    return in_parts(spark, sf, A.entity_corrections)


@register("v8_apply_corrections")
def v8b(spark, sf):
    return in_parts(spark, sf, lambda r, e: A.apply_corrections(r, A.entity_corrections(r, e)).select("response_id", F.md5("answer").alias("checksum")))


@register("v9_ungrounded_sentences", R + r""", s AS (SELECT response_id, evidence_text, unnest(ss) AS sentence, generate_subscripts(ss, 1) - 1 AS sentence_no FROM (SELECT response_id, evidence_text,
 list_filter([regexp_replace(x, '^\s+|\s+$', '', 'g') for x in string_split_regex(response_text, '[.!?]\s+')], lambda x: x <> '') AS ss FROM ap)),
 w AS (SELECT *, regexp_extract_all(sentence, '\p{L}{3,}') AS ws FROM s WHERE length(sentence) >= 10),
 c AS (SELECT *, round(len([x for x in ws if contains(evidence_text, x)])::double / len(ws), 6) AS coverage FROM w WHERE len(ws) > 0)
 SELECT response_id, sentence_no, md5(sentence) AS checksum, coverage FROM c WHERE coverage < 0.3e0""")
def v9(spark, sf):
    out = A.ungrounded_sentences(A.audit_pairs(responses(spark, sf), evidence(spark, sf)))
    return out.select("response_id", F.col("sentence_no").cast("bigint").alias("sentence_no"), F.md5("sentence").alias("checksum"), "coverage")


@register("v10_align_lines")
def v10(spark, sf):
    return in_parts(spark, sf, lambda r, e: A.align_lines(r, e).drop("line", "corrected"))


def sim_sql(a: str, b: str, wa: str, wb: str) -> str:
    longer = f"[x for x in {wa} if length(x) > 2]"
    j = Q.jaccard(f"list_distinct({wa})", f"list_distinct({wb})")
    return (f"CASE WHEN {a} = '' OR {b} = '' THEN 0e0 WHEN contains({b}, {a}) THEN 1e0 WHEN len({longer}) > 0 THEN 0.6e0 * ({j}) + 0.4e0 * "
            f"len([x for x in {longer} if contains({b}, x)])::double / len({longer}) ELSE {j} END")


EVN = f", en AS MATERIALIZED (SELECT response_id, rank, doc_id, {Q.norm_compare('text')} AS b, {Q.split_words(Q.norm_compare('text'))} AS wb FROM ev)"
_UNCITED = r"trim(regexp_replace(line, '\[[0-9]+\]', '', 'g'))"
MLINES = rf""", ml AS (SELECT response_id, unnest(string_split(answer, chr(10))) AS line, generate_subscripts(string_split(answer, chr(10)), 1) - 1 AS line_no FROM rs),
 mn AS MATERIALIZED (SELECT response_id, line_no, line, {Q.norm_compare(_UNCITED)} AS a FROM ml)"""


@register("v11_content_similarity", R + EVN + f""", p AS (SELECT ap.response_id, en.rank, {Q.norm_compare('raw')} AS a, {Q.split_words(Q.norm_compare('raw'))} AS wa, b, wb FROM ap JOIN en USING (response_id))
 SELECT response_id, rank, round({sim_sql('a', 'b', 'wa', 'wb')}, 6) AS similarity FROM p""")
def v11(spark, sf):
    whole = F.array(F.struct(norm_compare(F.col("raw")).alias("na")))
    return in_parts(spark, sf, lambda r, e: C.line_scores(r.select("response_id", whole.alias("lines")), e).select(
        "response_id", "rank", F.round("score", 6).alias("similarity")))


@register("v12_citation_map", R + EVN + MLINES + rf""", ct AS (SELECT DISTINCT response_id, line_no, a, {Q.split_words('a')} AS wa, unnest(regexp_extract_all(line, '\[(\d+)\]', 1))::bigint AS cite_no FROM mn WHERE a <> ''),
 sm AS (SELECT response_id, cite_no, rank, doc_id, round(avg({sim_sql('a', 'b', 'wa', 'wb')}), 6) AS score FROM ct JOIN en USING (response_id) GROUP BY ALL)
 SELECT response_id, cite_no, doc_id, rank, score FROM sm WHERE score > 0.2e0 QUALIFY row_number() OVER (PARTITION BY response_id, cite_no ORDER BY score DESC, rank) = 1""")
def v12(spark, sf):
    return in_parts(spark, sf, C.citation_map)


@register("v13_line_citations", R + EVN + rf""", l AS (SELECT response_id, unnest(string_split(raw, chr(10))) AS line, generate_subscripts(string_split(raw, chr(10)), 1) - 1 AS line_no FROM rs),
 n AS (SELECT response_id, line_no, {Q.norm_compare('line')} AS a, {Q.split_words(Q.norm_compare('line'))} AS wa FROM l WHERE trim(line) <> '' AND NOT regexp_matches(line, '\[\d+\]')),
 h AS MATERIALIZED (SELECT response_id, line_no, doc_id, rank, round({sim_sql('a', 'b', 'wa', 'wb')}, 6) AS score FROM n JOIN en USING (response_id)
   QUALIFY row_number() OVER (PARTITION BY response_id, line_no ORDER BY score DESC, rank) = 1),
 k AS (SELECT * FROM h WHERE score > 0.3e0), fm AS (SELECT response_id, rank, row_number() OVER (PARTITION BY response_id ORDER BY min(line_no)) AS cite_no FROM k GROUP BY response_id, rank)
 SELECT response_id, line_no, doc_id, score, cite_no FROM k JOIN fm USING (response_id, rank)""")
def v13(spark, sf):
    out = in_parts(spark, sf, lambda r, e: C.line_citations(r.withColumn("answer", F.col("raw")), e))
    return out.select("response_id", F.col("line_no").cast("bigint").alias("line_no"), "doc_id", "score", "cite_no")


@register("v13_insert_citations")
def v13b(spark, sf):
    return in_parts(spark, sf, lambda r, e: C.insert_citations(r.withColumn("answer", F.col("raw")), e).select("response_id", F.md5("answer").alias("checksum")))


@register("v13_enrich_sources", R + " SELECT response_id, doc_id, md5(text) AS snippet FROM ev WHERE doc_id % 3 = 0 UNION ALL SELECT response_id, doc_id, '-' FROM ev WHERE doc_id % 3 <> 0")
def v13c(spark, sf):
    return in_parts(spark, sf, lambda r, e: C.enrich_sources(_citations(e), e, ["text"]).select(
        "response_id", "doc_id", F.coalesce(F.md5("text"), F.lit("-")).alias("snippet")))


@register("v14_citation_accuracy", R + rf""", e2 AS (SELECT response_id, list({Q.norm_compare('text')}) AS evs FROM ev GROUP BY response_id),
 w AS (SELECT response_id, evs, list_distinct({Q.split_words(Q.norm_compare('raw'))}) AS a, list_distinct({Q.split_words(Q.norm_compare('evidence_text'))}) AS b,
  least(length(regexp_replace(raw, '^\s+|\s+$', '', 'g'))::double / greatest(length(regexp_replace(evidence_text, '^\s+|\s+$', '', 'g')), 1), 1e0) AS lr,
  [{Q.norm_compare('x')} for x in list_filter([regexp_replace(y, '^\s+|\s+$', '', 'g') for y in string_split_regex(regexp_replace(raw, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))], lambda z: z <> '')] AS s
  FROM ap LEFT JOIN e2 USING (response_id)),
 m AS (SELECT response_id, round({Q.jaccard('a', 'b')}, 6) AS j, CASE WHEN evs IS NULL THEN 0e0 ELSE round(lr, 6) END AS l, round(CASE WHEN len(s) = 0 OR evs IS NULL THEN 0e0 ELSE len([x for x in s if len([e for e in evs if contains(e, x)]) > 0])::double / len(s) END, 6) AS c FROM w)
 SELECT response_id, j AS jaccard_score, l AS length_ratio, c AS citation_coverage, round(j * 0.4e0 + l * 0.3e0 + c * 0.3e0, 6) AS overall_score, round(j * 0.4e0 + l * 0.3e0 + c * 0.3e0, 6) >= 0.7 AS is_valid FROM m""")
def v14(spark, sf):
    return in_parts(spark, sf, lambda r, e: A.citation_accuracy(A.audit_pairs(r, e, parts=True).withColumn("answer", F.col("raw")), mode="contains"))


@register("v14_citation_accuracy_fuzzy")
def v14b(spark, sf):
    return in_parts(spark, sf, lambda r, e: A.citation_accuracy(A.audit_pairs(r, e, parts=True).withColumn("answer", F.col("raw"))))


PHRASES = ("avec", "nicht", "from")


@register("v15_suppress_sources", R + f""" SELECT response_id, ({' OR '.join(f"contains(lower(answer), '{p}')" for p in PHRASES)}) AS is_generic,
 CASE WHEN ({' OR '.join(f"contains(lower(answer), '{p}')" for p in PHRASES)}) OR (response_id % 97) / 97e0 < 0.3e0 OR length(answer) > 1500 THEN 0 ELSE 2 END::bigint AS n_sources FROM rs""")
def v15(spark, sf):
    r = responses(spark, sf).withColumn("confidence", (F.col("response_id") % 97) / F.lit(97.0)).withColumn(
        "hallucination_detected", F.length("answer") > 1500).withColumn("sources", F.array(F.lit("a"), F.lit("b")))
    return A.suppress_sources(r, PHRASES).select("response_id", "is_generic", F.size("sources").cast("bigint").alias("n_sources"))


def mixed(r):
    """Short answers carry no markers, so content matching and the first-three rule are used too."""
    return r.withColumn("full_text", F.when(F.length("raw") % 2 == 0, F.col("raw")).otherwise(F.col("answer")))


@register("v16_mark_cited", R + r""", x AS (SELECT response_id, CASE WHEN length(raw) % 2 = 0 THEN raw ELSE answer END AS t FROM rs),
 n AS (SELECT response_id, t, [k::bigint for k in regexp_extract_all(t, '\[(\d+)\]', 1) || regexp_extract_all(t, '문서\s*(\d+)', 1)] AS ns FROM x),
 o AS (SELECT ev.response_id, rank, ns, list_distinct(regexp_extract_all(lower(t), '\p{L}{3,}')) AS a, list_distinct(regexp_extract_all(lower(text), '\p{L}{3,}')) AS b FROM ev JOIN n USING (response_id)),
 g AS (SELECT response_id, rank, CASE WHEN len(ns) > 0 THEN list_contains(ns, rank) WHEN least(len(a), len(b)) = 0 THEN false ELSE len(list_intersect(a, b))::double / least(len(a), len(b)) > 0.3e0 END AS c FROM o),
 h AS (SELECT *, max(c::int) OVER (PARTITION BY response_id) AS anyc FROM g)
 SELECT response_id, rank AS original_index, row_number() OVER (PARTITION BY response_id ORDER BY rank) AS display_index FROM h WHERE c OR (anyc = 0 AND rank <= 3)""")
def v16(spark, sf):
    return in_parts(spark, sf, lambda r, e: C.mark_cited(mixed(r), spread(e, "response_id").select("response_id", F.col("rank").alias("idx"), "text")))


@register("v16_mark_cited_simple", R + r""", n AS (SELECT response_id, [k::bigint for k in regexp_extract_all(answer, '\[(\d+)\]', 1)] AS ns FROM rs)
 SELECT ev.response_id, rank AS original_index, rank AS display_index FROM ev JOIN n USING (response_id) WHERE list_contains(ns, rank)""")
def v16b(spark, sf):
    src = cited_documents(spark, sf).select("response_id", F.col("rank").alias("idx"), "text")  # its text is not used
    return C.mark_cited(responses(spark, sf).withColumn("full_text", F.col("answer")), src, mode="simple")


@register("v17_content_matches", R + r""", o AS (SELECT ev.response_id, rank, list_distinct(regexp_extract_all(lower(raw), '\p{L}{3,}')) AS a, list_distinct(regexp_extract_all(lower(text), '\p{L}{3,}')) AS b FROM ev JOIN rs USING (response_id))
 SELECT response_id, rank, CASE WHEN least(len(a), len(b)) = 0 THEN false ELSE len(list_intersect(a, b))::double / least(len(a), len(b)) > 0.3e0 END AS matches FROM o""")
def v17(spark, sf):
    return in_parts(spark, sf, lambda r, e: r.select("response_id", "raw").join(spread(e, "response_id"), "response_id").select(
        "response_id", "rank", S.content_matches(F.col("raw"), F.col("text")).alias("matches")))


@register("v18_drop_invalid", R + r""" SELECT response_id, md5(trim(regexp_replace(regexp_replace(answer, '\[(2|4)\]', '', 'g'), '\s+', ' ', 'g'))) AS checksum FROM rs""")
def v18(spark, sf):
    valid = F.array(F.lit("1"), F.lit("3"), F.lit("5"))
    return responses(spark, sf).select("response_id", F.md5(C.drop_invalid_citations(F.col("answer"), valid)).alias("checksum"))


def reversed_marks(spark, sf):
    """Answers whose k-th line carries the marker of line n - k, so that renumbering has work to do."""
    lines = F.split("raw", "\n")
    t = F.array_join(F.transform(lines, lambda l, i: F.concat(l, F.lit(" ["), ((F.size(lines) - i) % 7 + 1).cast("string"), F.lit("]"))), "\n")
    return responses(spark, sf).withColumn("answer", t)


@register("w3_citation_map", R + r""", l AS (SELECT response_id, generate_subscripts(string_split(raw, chr(10)), 1) AS i, len(string_split(raw, chr(10))) AS n, unnest(string_split(raw, chr(10))) AS line FROM rs),
 mk AS (SELECT response_id, i * 2 AS o, ((n - (i - 1)) % 7 + 1)::bigint AS old_no FROM l UNION ALL
  SELECT response_id, i * 2 - 1, unnest(regexp_extract_all(line, '\[(\d+)\]', 1))::bigint FROM l),
 f AS (SELECT response_id, old_no, min(o) AS o FROM mk GROUP BY ALL) SELECT response_id, old_no, row_number() OVER (PARTITION BY response_id ORDER BY o) AS new_no FROM f""")
def w3(spark, sf):
    r = reversed_marks(spark, sf).withColumn("key_facts", F.array().cast("array<string>"))
    return C.citation_table(C.renumber_citations(r))


@register("w3_renumber_citations")
def w3b(spark, sf):
    return C.renumber_citations(reversed_marks(spark, sf)).select("response_id", F.md5("answer").alias("checksum"))


@register("a4_quality_metrics", R + """ SELECT response_id, (response_id % 97) / 97e0 AS confidence_score, n = 0 OR (response_id % 97) / 97e0 < 0.3e0 AS generic_response, n > 0 AS has_sources,
 n AS source_count, n AS evidence_count, length(answer) AS answer_length, len(key_facts) AS key_facts_count FROM ap""")
def a4(spark, sf):
    ev = cited_documents(spark, sf).groupBy("response_id").agg(F.sort_array(F.collect_list("doc_id")).alias("sources"))  # no text is used
    r = responses(spark, sf).join(ev, "response_id", "left").withColumn("n_evidence", F.coalesce(F.size("sources"), F.lit(0))).withColumn(
        "confidence", (F.col("response_id") % 97) / F.lit(97.0))
    return O.quality_metrics(r)


# ---- fuzzy joins ---------------------------------------------------------------------------------------

def vocabulary(spark, sf):
    """Left: distinct terms of the benchmark passages; right: the corpus vocabulary.  Terms of every length take part."""
    own = queries_of(spark, sf).select(F.explode(tokens(F.col("text"))).alias("text")).distinct()
    as_rows = lambda df: df.select("text", F.col("text").alias("id"))
    return as_rows(own), as_rows(lexical_of(spark, sf).terms.select(F.col("term").alias("text")))


@register("fz_fuzzy_join", f"""
WITH l AS (SELECT DISTINCT unnest({Q.tokens('text')}) AS x FROM benchmark), r AS (SELECT DISTINCT unnest({Q.tokens('text')}) AS x FROM documents)
SELECT a AS left_id, b AS right_id, r AS score FROM ({Q.close_pairs('l', 'r', '0.85e0')})
QUALIFY row_number() OVER (PARTITION BY a ORDER BY r DESC, b DESC) = 1""")
def fz(spark, sf):
    left, right = vocabulary(spark, sf)
    return Z.fuzzy_join(left, right, "ratio", 0.85)


@register("fz_candidate_report")
def fz2(spark, sf):
    left, right = vocabulary(spark, sf)
    return Z.candidate_report(left, right, "ratio", 0.85)


@register("r14_partial_match", f"""WITH {Q.BENCH_Q},{Q.bm25_ctes(60)},{Q.VECTOR_CTES},{Q.FUSED},{Q.RELATED}
SELECT query_id, chunk_id, count(DISTINCT k) AS partial_keywords FROM pmatch GROUP BY ALL""")
def r14(spark, sf):
    kw = queries_of(spark, sf).select("query_id", F.explode(extract_keywords(F.col("text"))).alias("keyword"))
    pairs = fused_of(spark, sf).select("query_id", "chunk_id").join(kw, "query_id")
    return Z.partial_matches(pairs, chunks_of(spark, sf)).groupBy("query_id", "chunk_id").agg(F.count(F.lit(1)).alias("partial_keywords"))


@register("k9_memory_facts", R + r""", l AS (SELECT response_id, trim(unnest(string_split(answer, chr(10)))) AS text FROM rs),
 c AS (SELECT DISTINCT response_id, text, unnest(regexp_extract_all(text, '\[(\d+)\]', 1))::bigint AS n FROM l WHERE text <> '')
 SELECT DISTINCT c.response_id, ev.doc_id, md5(c.text) AS checksum FROM c JOIN ev ON ev.response_id = c.response_id AND ev.rank = c.n""")
def k9(spark, sf):
    from attestry.operators.dialog import memory_facts

    r = responses(spark, sf).withColumn("session_id", F.expr("response_id div 1000000000")).withColumn("seq", F.col("response_id") % 1_000_000_000)
    src = cited_documents(spark, sf).select("response_id", F.col("rank").alias("display_index"), "doc_id")
    return memory_facts(r, src).select("response_id", "doc_id", F.md5("text").alias("checksum"))
