"""Offline evaluation and failure analysis."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry import params as P
from attestry.functions.normalize import norm_compare
from attestry.functions.patterns import find_all
from attestry.functions.similarity import exact_match, span_iou, token_f1


def multiset_overlap(left: DataFrame, right: DataFrame, key: str = "id", token: str = "token") -> DataFrame:
    """U3. Size of the multiset intersection per key, for token tables too long for one row."""
    a = left.groupBy(key, token).agg(F.count(F.lit(1)).alias("_a"))
    b = right.groupBy(key, token).agg(F.count(F.lit(1)).alias("_b"))
    return a.join(b, [key, token]).groupBy(key).agg(F.sum(F.least("_a", "_b")).alias("overlap"))


def token_table(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).alias("id"), F.explode(find_all(norm_compare(F.col(text)), r"\S+")).alias("token"))


def facts_f1(pred: Column, ref: Column) -> Column:
    """E3. Best F1 of each reference fact over the predicted facts, averaged; no reference facts gives 0."""
    best = F.transform(ref, lambda r: F.aggregate(
        F.transform(pred, lambda p: token_f1(p, r)), F.lit(0.0), lambda a, x: F.greatest(a, x)))
    total = F.aggregate(best, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.coalesce(F.size(ref), F.lit(0)) <= 0, 0.0).otherwise(total / F.size(ref))


def citation_iou(pred: Column, ref: Column) -> Column:
    """E4. Best span IoU of each predicted span in the same document, averaged; both empty 1, one empty 0."""
    best = F.transform(pred, lambda p: F.aggregate(
        F.transform(F.filter(ref, lambda r: r["doc_id"] == p["doc_id"]), lambda r: span_iou(p["start"], p["end"], r["start"], r["end"])),
        F.lit(0.0), lambda a, x: F.greatest(a, x)))
    total = F.aggregate(best, F.lit(0.0), lambda a, x: a + x)
    np_, nr = F.coalesce(F.size(pred), F.lit(0)), F.coalesce(F.size(ref), F.lit(0))
    return F.when((np_ <= 0) & (nr <= 0), 1.0).when((np_ <= 0) | (nr <= 0), 0.0).otherwise(total / np_)


def citation_iou_rows(pred: DataFrame, ref: DataFrame) -> DataFrame:
    """E4, J6 for span tables (question_id, doc_id, start, end): an equi join on question and document, reduced
    to the best value per predicted span before it is averaged."""
    p = pred.select("question_id", "doc_id", F.col("start").alias("ps"), F.col("end").alias("pe"))
    r = ref.select("question_id", "doc_id", F.col("start").alias("rs"), F.col("end").alias("re"))
    best = p.join(r, ["question_id", "doc_id"], "left").groupBy("question_id", "doc_id", "ps", "pe").agg(
        F.max(F.coalesce(span_iou(F.col("ps"), F.col("pe"), F.col("rs"), F.col("re")), F.lit(0.0))).alias("_iou"))
    return best.groupBy("question_id").agg(F.round(F.avg("_iou"), 6).alias("citation_iou"))


def evaluate(pred: DataFrame, ref: DataFrame, sample: int | None = None) -> DataFrame:
    """E5, J11. One row per reference question; a missing or failed prediction scores zero and counts as
    hallucinated.

    pred(question_id, answer, key_facts, sources, hallucination_detected, error),
    ref(question_id, question, answer, key_facts, evidence_spans).  E6: ``sample`` takes the first questions.
    """
    if sample is not None:
        ref = ref.orderBy("question_id").limit(sample)
    r = ref.select("question_id", "question", F.col("answer").alias("_ra"), F.col("key_facts").alias("_rf"), F.col("evidence_spans").alias("_rs"))
    j = r.join(pred.withColumn("_found", F.lit(True)), "question_id", "left")
    error = F.when(F.col("_found").isNull(), "missing").otherwise(F.col("error"))
    ok = error.isNull()
    score = lambda c: F.when(ok, F.round(c, 6)).otherwise(0.0)
    return j.select(
        "question_id", "question", F.col("answer").alias("generated_answer"), error.alias("error"),
        score(exact_match(F.col("answer"), F.col("_ra"))).alias("exact_match"),
        score(token_f1(F.col("answer"), F.col("_ra"))).alias("f1_score"),
        score(facts_f1(F.col("key_facts"), F.col("_rf"))).alias("facts_f1"),
        score(citation_iou(F.col("sources"), F.col("_rs"))).alias("citation_accuracy"),
        F.when(ok, F.coalesce("hallucination_detected", F.lit(False))).otherwise(True).alias("hallucination_detected"),
    )


def evaluate_summary(details: DataFrame, gates: Mapping[str, float] = P.GATES) -> DataFrame:
    """A7. Averages and the pass gate, one row."""
    s = details.agg(
        *[F.round(F.avg(c), 6).alias(f"average_{c}") for c in ("exact_match", "f1_score", "facts_f1", "citation_accuracy")],
        F.round(F.avg(F.col("hallucination_detected").cast("double")), 6).alias("hallucination_rate"),
        F.count(F.lit(1)).alias("total_questions"))
    passed = (
        (F.col("average_exact_match") >= gates["exact_match"]) & (F.col("average_f1_score") >= gates["f1_score"])
        & (F.col("average_citation_accuracy") >= gates["citation_accuracy"]) & (F.col("hallucination_rate") <= gates["hallucination_rate"]))
    return s.withColumn("passed", passed)


def failure_reasons(gates: Mapping[str, float] = P.GATES) -> Column:
    """A8. Reasons of one evaluated row; an error hides the others."""
    low = lambda c, name: F.when(F.coalesce(c, F.lit(0.0)) < gates[name[0]], name[1])
    usual = F.array_compact(F.array(
        F.when(F.coalesce("generated_answer", F.lit("")) == "", "no_answer"), low(F.col("exact_match"), ("exact_match", "low_em")),
        low(F.col("f1_score"), ("f1_score", "low_f1")), low(F.col("citation_accuracy"), ("citation_accuracy", "bad_citation")),
        F.when(F.col("hallucination_detected"), "hallucination")))
    return F.when(F.col("error").isNotNull(), F.array(F.lit("error"))).otherwise(usual)


def failure_counts(details: DataFrame) -> DataFrame:
    """A8. Rows per reason."""
    return details.select(F.explode(failure_reasons()).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("failures"))


def failure_analysis(details: DataFrame) -> DataFrame:
    """A8. Totals, rate and the most common reason, one row."""
    r = details.select(failure_reasons().alias("_r"))
    totals = r.agg(F.count(F.lit(1)).alias("evaluated"), F.count_if(F.size("_r") > 0).alias("total_failures"))
    common = failure_counts(details).agg(F.max_by("reason", F.struct("failures", "reason")).alias("m")).select("m").scalar()
    return totals.withColumn("failure_rate", F.round(F.col("total_failures") / F.col("evaluated"), 6)).withColumn("most_common", common)


def top_failures(details: DataFrame, n: int = 10) -> DataFrame:
    """A8. The first failing questions."""
    r = details.withColumn("reasons", F.array_join(failure_reasons(), ",")).where("reasons <> ''")
    return r.orderBy("question_id").limit(n).select("question_id", "reasons", "exact_match", "f1_score", "citation_accuracy")


def prioritise(details: DataFrame) -> DataFrame:
    """A9. Codes of what to work on, most urgent first, from the failure counts."""
    n = lambda reason: F.count_if(F.array_contains("_r", reason))
    s = details.select(failure_reasons().alias("_r")).agg(
        n("error").alias("error"), n("hallucination").alias("hallucination"), n("low_f1").alias("low_f1"), n("bad_citation").alias("bad_citation"),
        (F.count_if(F.size("_r") > 0) / F.count(F.lit(1))).alias("rate"))
    actions = F.array_compact(F.array(
        F.when(F.col("error") > 0, "errors"),
        F.when(F.col("hallucination") > 0, "grounding"),
        F.when(F.col("low_f1") > 5, "retrieval"), F.when(F.col("bad_citation") > 3, "citations"),
        F.when(F.col("rate") > 0.1, "model")))
    none = F.array(F.lit("none"))
    return s.select(F.explode(F.when(F.size(actions) > 0, actions).otherwise(none)).alias("action"))
