"""Bindings of the evaluation rows: an assistant turn is the prediction, the next one the reference."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from attestry.functions import similarity as S
from attestry.functions.tokens import split_sentences
from attestry.operators import evaluate as E
from attestry.plans.catalog import register
from attestry.plans.catalog import sql as Q
from attestry.plans.catalog.retrieval import queries_of, truth_of
from attestry.session import load_table


def pairs(spark, sf):
    c = load_table(spark, sf, "conversations").where("role = 'assistant'")
    nxt = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return c.select((F.col("conv_id") * 1_000_000_000 + F.col("turn")).alias("question_id"), F.col("text").alias("pred"), nxt.alias("ref"))


def both(spark, sf):
    return pairs(spark, sf).where("ref IS NOT NULL")


PAIRS = """a AS (SELECT conv_id * 1000000000 + turn AS question_id, text AS pred, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS ref
  FROM conversations WHERE role = 'assistant'), pr AS (SELECT * FROM a WHERE ref IS NOT NULL)"""


def f1_sql(p: str, r: str) -> str:
    """Multiset F1 of two word lists."""
    same = f"list_sum([least(len([x for x in {p} if x = w]), len([x for x in {r} if x = w])) for w in list_distinct({p})])"
    return (f"CASE WHEN len({p}) = 0 AND len({r}) = 0 THEN 1e0 WHEN len({p}) = 0 OR len({r}) = 0 THEN 0e0 "
            f"ELSE 2e0 * coalesce({same}, 0) / (len({p}) + len({r})) END")


# Token F1 through counted tokens: tf(question_id, f1).
F1 = f"""wp AS (SELECT question_id, w, count(*) AS n FROM (SELECT question_id, unnest({Q.split_words(Q.norm_compare('pred'))}) AS w FROM pr) GROUP BY ALL),
wr AS (SELECT question_id, w, count(*) AS n FROM (SELECT question_id, unnest({Q.split_words(Q.norm_compare('ref'))}) AS w FROM pr) GROUP BY ALL),
same AS (SELECT question_id, sum(least(wp.n, wr.n)) AS s FROM wp JOIN wr USING (question_id, w) GROUP BY question_id),
lp AS (SELECT question_id, sum(n) AS n FROM wp GROUP BY question_id), lr AS (SELECT question_id, sum(n) AS n FROM wr GROUP BY question_id),
tf AS (SELECT question_id, CASE WHEN lp.n IS NULL AND lr.n IS NULL THEN 1e0 WHEN lp.n IS NULL OR lr.n IS NULL THEN 0e0
   ELSE 2e0 * coalesce(s, 0) / (lp.n + lr.n) END AS f1 FROM pr LEFT JOIN lp USING (question_id) LEFT JOIN lr USING (question_id) LEFT JOIN same USING (question_id))"""


@register("e1_exact_match", f"WITH {PAIRS} SELECT question_id, CASE WHEN {Q.norm_compare('pred')} = {Q.norm_compare('ref')} THEN 1e0 ELSE 0e0 END AS exact_match FROM pr")
def e1(spark, sf):
    return both(spark, sf).select("question_id", S.exact_match(F.col("pred"), F.col("ref")).alias("exact_match"))


@register("e2_token_f1", f"WITH {PAIRS}, {F1} SELECT question_id, round(f1, 6) AS f1 FROM tf")
def e2(spark, sf):
    return both(spark, sf).select("question_id", F.round(S.token_f1(F.col("pred"), F.col("ref")), 6).alias("f1"))


@register("u3_multiset_overlap", f"WITH {PAIRS}, {F1} SELECT question_id AS id, s::bigint AS overlap FROM same")
def u3(spark, sf):
    p = both(spark, sf)
    return E.multiset_overlap(E.token_table(p, "question_id", "pred"), E.token_table(p, "question_id", "ref"))


def facts(c):
    return split_sentences(c)


FACTS = r"""list_filter([regexp_replace(x, '^\s+|\s+$', '', 'g') for x in string_split_regex({c}, '[.!?。]\s*')], lambda x: x <> '')"""
FF = f"""fp AS (SELECT question_id, {Q.split_words(Q.norm_compare('f'))} AS pw FROM (SELECT question_id, unnest({FACTS.format(c='pred')}) AS f FROM pr)),
fr AS (SELECT question_id, k, {Q.split_words(Q.norm_compare('f'))} AS rw FROM (
  SELECT question_id, unnest({FACTS.format(c='ref')}) AS f, generate_subscripts({FACTS.format(c='ref')}, 1) AS k FROM pr)),
fb AS (SELECT question_id, k, max(CASE WHEN pw IS NULL THEN 0e0 ELSE {f1_sql('pw', 'rw')} END) AS best FROM fr LEFT JOIN fp USING (question_id) GROUP BY ALL),
ff AS (SELECT question_id, avg(best) AS facts_f1 FROM fb GROUP BY question_id)"""


@register("e3_facts_f1", f"WITH {PAIRS}, {FF} SELECT question_id, round(coalesce(facts_f1, 0e0), 6) AS facts_f1 FROM pr LEFT JOIN ff USING (question_id)")
def e3(spark, sf):
    return both(spark, sf).select("question_id", F.round(E.facts_f1(facts(F.col("pred")), facts(F.col("ref"))), 6).alias("facts_f1"))


def spans(spark, sf):
    q = queries_of(spark, sf).withColumnRenamed("text", "passage")
    d = load_table(spark, sf, "documents").select("doc_id", "text")
    t = truth_of(spark, sf).join(q, "query_id").join(d, "doc_id")
    start = F.expr("instr(text, passage)")
    return t.select(F.col("query_id").alias("question_id"), "doc_id", start.alias("start"), (start + F.length("passage")).alias("end"))


@register("e4_citation_iou", """
WITH s AS (SELECT b.item_id AS question_id, d.doc_id, strpos(d.text, b.text) AS a, strpos(d.text, b.text) + length(b.text) AS e
 FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
i AS (SELECT question_id, CASE WHEN e > a + 10 THEN (e - (a + 10))::double / (e + 10 - a) ELSE 0e0 END AS iou FROM s)
SELECT question_id, round(avg(iou), 6) AS citation_iou FROM i GROUP BY question_id""")
def e4(spark, sf):
    ref = spans(spark, sf)
    pred = ref.withColumn("start", F.col("start") + 10).withColumn("end", F.col("end") + 10)
    return E.citation_iou_rows(pred, ref)


def details(spark, sf, sample=None):
    """Predictions against references; the last assistant turn of a conversation has no prediction pair, and
    a turn that starts with a vowel carries an error."""
    p = pairs(spark, sf)
    span = lambda c: F.array(F.struct(F.lit(1).alias("doc_id"), F.lit(0).alias("start"), F.length(c).alias("end")))
    ref = p.select("question_id", F.lit("q").alias("question"), F.coalesce("ref", F.col("pred")).alias("answer"), facts(F.coalesce("ref", F.col("pred"))).alias("key_facts"),
                   span(F.coalesce("ref", F.col("pred"))).alias("evidence_spans"))
    pred = p.where("ref IS NOT NULL").select(
        "question_id", F.col("pred").alias("answer"), facts(F.col("pred")).alias("key_facts"), span(F.col("pred")).alias("sources"),
        (F.length("pred") > 1000).alias("hallucination_detected"), F.when(F.col("pred").rlike("^[AEIOU]"), "failed").alias("error"))
    return E.evaluate(pred, ref, sample)


DET = f"""WITH {PAIRS}, {F1}, {FF},
det AS MATERIALIZED (SELECT a.question_id, CASE WHEN a.ref IS NULL THEN 'missing' WHEN regexp_matches(a.pred, '^[AEIOU]') THEN 'failed' END AS error, a.pred, a.ref, f1, facts_f1 FROM a
  LEFT JOIN tf USING (question_id) LEFT JOIN ff USING (question_id)),
d AS MATERIALIZED (SELECT question_id, error, CASE WHEN error IS NULL AND {Q.norm_compare('pred')} = {Q.norm_compare('ref')} THEN 1e0 ELSE 0e0 END AS exact_match,
  CASE WHEN error IS NULL THEN round(f1, 6) ELSE 0e0 END AS f1_score, CASE WHEN error IS NULL THEN round(coalesce(facts_f1, 0e0), 6) ELSE 0e0 END AS facts_f1,
  CASE WHEN error IS NULL AND least(length(pred), length(ref)) > 0 THEN round(least(length(pred), length(ref))::double / greatest(length(pred), length(ref)), 6) ELSE 0e0 END AS citation_accuracy,
  CASE WHEN error IS NULL THEN length(pred) > 1000 ELSE true END AS hallucination_detected,
  CASE WHEN ref IS NULL THEN '' ELSE pred END AS generated FROM det),
rs AS MATERIALIZED (SELECT *, CASE WHEN error IS NOT NULL THEN ['error'] ELSE list_filter([CASE WHEN generated = '' THEN 'no_answer' END, CASE WHEN exact_match < 0.95 THEN 'low_em' END,
  CASE WHEN f1_score < 0.99 THEN 'low_f1' END, CASE WHEN citation_accuracy < 0.995 THEN 'bad_citation' END, CASE WHEN hallucination_detected THEN 'hallucination' END], lambda x: x IS NOT NULL) END AS r FROM d),
rc AS (SELECT reason, count(*) AS failures FROM (SELECT unnest(r) AS reason FROM rs) GROUP BY reason)"""
COLS = "question_id, exact_match, f1_score, facts_f1, citation_accuracy, hallucination_detected"


@register("e5_evaluate", DET + f" SELECT {COLS}, coalesce(error, 'none') AS error FROM d")
def e5(spark, sf):
    return details(spark, sf).select(*COLS.split(", "), F.coalesce("error", F.lit("none")).alias("error"))


@register("e6_evaluate_sample", DET + f" SELECT {COLS} FROM d ORDER BY question_id LIMIT 10")
def e6(spark, sf):
    return details(spark, sf, 10).select(*COLS.split(", "))


@register("a7_evaluate_summary", DET + """ SELECT round(avg(exact_match), 6) AS average_exact_match, round(avg(f1_score), 6) AS average_f1_score, round(avg(facts_f1), 6) AS average_facts_f1,
 round(avg(citation_accuracy), 6) AS average_citation_accuracy, round(avg(hallucination_detected::int), 6) AS hallucination_rate, count(*) AS total_questions,
 avg(exact_match) >= 0.95 AND avg(f1_score) >= 0.99 AND avg(citation_accuracy) >= 0.995 AND max(hallucination_detected::int) = 0 AS passed FROM d""")
def a7(spark, sf):
    return E.evaluate_summary(details(spark, sf))


@register("a8_failure_counts", DET + " SELECT reason, failures FROM rc")
def a8(spark, sf):
    return E.failure_counts(details(spark, sf))


@register("a8_failure_analysis", DET + """ SELECT count(*) AS evaluated, count(*) FILTER (len(r) > 0) AS total_failures,
 round((count(*) FILTER (len(r) > 0))::double / count(*), 6) AS failure_rate, (SELECT reason FROM rc ORDER BY failures DESC, reason DESC LIMIT 1) AS most_common FROM rs""")
def a8b(spark, sf):
    return E.failure_analysis(details(spark, sf))


@register("a8_top_failures", DET + """ SELECT question_id, array_to_string(r, ',') AS reasons, exact_match, f1_score, citation_accuracy FROM rs WHERE len(r) > 0
 ORDER BY question_id LIMIT 10""")
def a8c(spark, sf):
    return E.top_failures(details(spark, sf))


@register("a9_prioritise", DET + """, n AS (SELECT count(*) FILTER (list_contains(r, 'error')) AS e, count(*) FILTER (list_contains(r, 'hallucination')) AS h,
 count(*) FILTER (list_contains(r, 'low_f1')) AS f, count(*) FILTER (list_contains(r, 'bad_citation')) AS b, (count(*) FILTER (len(r) > 0))::double / count(*) AS rate FROM rs)
 SELECT unnest(list_filter([CASE WHEN e > 0 THEN 'errors' END, CASE WHEN h > 0 THEN 'grounding' END,
  CASE WHEN f > 5 THEN 'retrieval' END, CASE WHEN b > 3 THEN 'citations' END,
  CASE WHEN rate > 0.1 THEN 'model' END], lambda x: x IS NOT NULL)) AS action FROM n""")
def a9(spark, sf):
    return E.prioritise(details(spark, sf))
