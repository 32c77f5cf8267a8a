"""Grounding of answers in their evidence.

responses(response_id, answer, key_facts, details), evidence(response_id, rank, doc_id, page, text).  Evidence
is the top-k of a retrieval, so the rows of one response are bounded by k.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry import params as P
from attestry.functions.fuzzy import best_units, corrections, fuzzy_score, share_matched, shares_matched, variations
from attestry.functions.normalize import collapse, let, norm_compare, replace, strip_citations
from attestry.functions.patterns import find_all
from attestry.functions.similarity import jaccard, share_contained, token_jaccard
from attestry.functions.tokens import WORD_CLASS, split_sentences
from attestry.operators.chunking import evidence_units
from attestry.params import Params
from attestry.scale import spread


def evidence_text(evidence: DataFrame) -> DataFrame:
    """V1. Evidence texts of a response in rank order, joined by a space."""
    return _evidence_parts(evidence).select("response_id", F.array_join("_parts", " ").alias("evidence_text"), "n_evidence")


def _evidence_parts(evidence: DataFrame) -> DataFrame:
    parts = F.sort_array(F.collect_list(F.struct("rank", "text")))
    return evidence.groupBy("response_id").agg(F.transform(parts, lambda p: p["text"]).alias("_parts"), F.count(F.lit(1)).alias("n_evidence"))


def audit_pairs(responses: DataFrame, evidence: DataFrame, parts: bool = False) -> DataFrame:
    """V1. Response text (answer, facts, details) beside its evidence text.

    ``parts`` adds the single texts (``evidence_parts``), so that a measure on them need not gather the evidence again."""
    facts = F.array_join(F.coalesce("key_facts", F.array().cast("array<string>")), " ")
    text = F.concat("answer", F.lit(" "), facts, F.lit(" "), F.coalesce("details", F.lit("")))
    # One partitioning by response for the join and for the CPU-bound measures that follow.
    j = spread(responses, "response_id").join(_evidence_parts(evidence), "response_id", "left")
    j = j.withColumn("response_text", text).withColumn("evidence_text", F.coalesce(F.array_join("_parts", " "), F.lit(""))).withColumn(
        "n_evidence", F.coalesce("n_evidence", F.lit(0)))
    return j.withColumn("evidence_parts", F.coalesce("_parts", F.array().cast("array<string>"))).drop("_parts") if parts else j.drop("_parts")


def sentence_coverage(sentences: Column, evidence: Column, threshold: float = Params.sentence_min, mode: str = "fuzzy") -> Column:
    """V3. Share of sentences grounded in the evidence: partial ratio, or plain containment."""
    low = F.transform(sentences, lambda s: F.lower(s))
    if mode == "contains":
        return share_contained(low, F.lower(evidence))
    return share_matched(threshold)(low, F.lower(evidence))


def fact_grounding(facts: Column, evidence: Column, threshold: float = Params.sentence_min, mode: str = "fuzzy") -> Column:
    """V3. As coverage; a response without facts is fully grounded."""
    none = F.coalesce(F.size(facts), F.lit(0)) <= 0
    return F.when(none, 1.0).otherwise(sentence_coverage(F.coalesce(facts, F.array().cast("array<string>")), evidence, threshold, mode))


def citation_validity(citations: DataFrame, evidence: DataFrame) -> DataFrame:
    """V4, J5. Share of citations whose document is in the evidence within one page.

    The tolerance becomes an equi join: each evidence page is offered at -1, 0 and +1."""
    near = evidence.select("response_id", "doc_id", F.explode(F.array(F.col("page") - 1, F.col("page"), F.col("page") + 1)).alias("page")).distinct()
    marked = citations.join(near.withColumn("_ok", F.lit(1.0)), ["response_id", "doc_id", "page"], "left")
    return marked.groupBy("response_id").agg(F.avg(F.coalesce("_ok", F.lit(0.0))).alias("citation_validity"))


def audit_responses(
    responses: DataFrame, evidence: DataFrame, citations: DataFrame, p: Params = Params(), mode: str = "fuzzy"
) -> DataFrame:
    """V5. The four measures, their mean, the hallucination flag, validity and the quality level."""
    pairs = audit_pairs(responses, evidence).join(citation_validity(citations, evidence), "response_id", "left")
    r, e = F.col("response_text"), F.col("evidence_text")
    covered, grounded = sentence_coverage(split_sentences(r), e, p.sentence_min, mode), fact_grounding(F.col("key_facts"), e, p.sentence_min, mode)
    if mode == "fuzzy":  # most facts are sentences too: both lists are searched at once
        facts = F.coalesce("key_facts", F.array().cast("array<string>"))
        lists = F.array(*[F.transform(x, lambda s: F.lower(s)) for x in (split_sentences(r), facts)])
        pairs = pairs.withColumn("_shares", shares_matched(p.sentence_min)(lists, F.lower(e)))
        covered, grounded = F.get("_shares", F.lit(0)), F.when(F.size(facts) == 0, 1.0).otherwise(F.get("_shares", F.lit(1)))
    m = pairs.select(
        "response_id", F.round(token_jaccard(r, e), 6).alias("jaccard_score"),
        F.round(covered, 6).alias("sentence_coverage"), F.round(grounded, 6).alias("fact_grounding"),
        F.round(F.coalesce("citation_validity", F.when(F.col("n_evidence") == 0, 1.0).otherwise(0.5)), 6).alias("citation_accuracy"))
    conf = F.round((F.col("jaccard_score") + F.col("sentence_coverage") + F.col("fact_grounding") + F.col("citation_accuracy")) / 4, 6)
    hall = F.col("jaccard_score") < p.jaccard_min
    out = m.withColumn("confidence", conf).withColumn("hallucination_detected", hall)
    level = F.when(hall | (F.col("confidence") < 0.3), "low").when(F.col("confidence") < 0.5, "medium").otherwise("high")
    return out.withColumn("is_valid", (F.col("confidence") >= p.confidence_min) & ~hall).withColumn("quality_level", level)


def _entity_lists(responses: DataFrame, evidence: DataFrame, pattern: str, min_chars: int) -> DataFrame:
    """(response_id, ours, theirs): distinct entities of a response and of its evidence, one row each.

    They are compared within the row, so that no pair of entities ever moves."""
    ours = F.filter(F.array_distinct(find_all(F.col("answer"), pattern)), lambda w: F.length(w) >= min_chars)
    theirs = spread(evidence.select("response_id", F.array_distinct(find_all(F.col("text"), pattern)).alias("_e")), "response_id")
    theirs = theirs.groupBy("response_id").agg(F.array_distinct(F.flatten(F.collect_list("_e"))).alias("theirs"))
    return responses.select("response_id", ours.alias("ours")).join(theirs, "response_id")


def entity_pattern(script: str) -> str:
    return r"[가-힣]{2,}[가-힣\d]*" if script == "hangul" else r"\p{L}{2,}[\p{L}\d]*"


def entity_variations(responses: DataFrame, evidence: DataFrame, script: str = "any") -> DataFrame:
    """V6. Response entities that look like a variation of an evidence entity: similarity in (.7, .95), at least
    four characters, a common prefix of two.  The similarity bound also bounds the lengths: 2 min/(m+n) > .7."""
    lists = _entity_lists(responses, evidence, entity_pattern(script), 4)
    best = lists.select("response_id", F.explode(variations("ours", "theirs")).alias("m"))
    return best.select("response_id", F.col("m.a").alias("entity"), F.col("m.b").alias("similar_to"), F.round("m.score", 6).alias("similarity"))


def parenthetical_pattern(script: str) -> str:
    cls = WORD_CLASS[script]
    return rf"([{cls}]+[{cls}\d]*)\s*\(([^)]+)\)"


def added_parentheticals(pairs: DataFrame, script: str = "any") -> DataFrame:
    """V7. Explanations in brackets that the evidence does not have although it has the entity."""
    p = parenthetical_pattern(script)
    r = F.col("response_text")
    found = F.arrays_zip(find_all(r, p).alias("full"), find_all(r, p, 1).alias("entity"))
    rows = pairs.select("response_id", "evidence_text", F.explode(found).alias("f")).select("response_id", "evidence_text", "f.full", "f.entity")
    return rows.where(~F.col("evidence_text").contains(F.col("full")) & F.col("evidence_text").contains(F.col("entity"))).select("response_id", "full", "entity")


def fix_parentheticals(text: Column, evidence: Column, script: str = "any") -> Column:
    """V7. The text with those explanations removed."""
    p = parenthetical_pattern(script)
    found = F.arrays_zip(find_all(text, p).alias("full"), find_all(text, p, 1).alias("entity"))
    start = F.struct(text.alias("t"), evidence.alias("e"))
    step = lambda acc, f: F.struct(
        F.when(~acc["e"].contains(f["full"]) & acc["e"].contains(f["entity"]), F.replace(acc["t"], f["full"], f["entity"])).otherwise(acc["t"]).alias("t"),
        acc["e"].alias("e"))
    return F.aggregate(found, start, step)["t"]


def entity_corrections(responses: DataFrame, evidence: DataFrame, script: str = "any", threshold: float = 0.85, min_chars: int = 3) -> DataFrame:
    """V8. Best evidence entity per unsupported response entity: .5 sequence + .3 bigram + .2 prefix, lengths at
    most three apart, both the blend and the sequence similarity above the threshold.

    The blend cannot pass .85 without a common first character, so only such words are compared."""
    cls = r"가-힣A-Za-z" if script == "hangul" else r"\p{L}"
    pattern = rf"[{cls}][{cls}\d]{{2,}}"
    lists = _entity_lists(responses, evidence, pattern, min_chars)
    best = lists.select("response_id", F.explode(corrections(threshold, min_chars)("ours", "theirs")).alias("m"))
    return best.select("response_id", F.col("m.a").alias("entity"), F.col("m.b").alias("replacement"), F.round("m.score", 6).alias("score"))


def apply_corrections(responses: DataFrame, corrections: DataFrame) -> DataFrame:
    """V8. Whole-word replacement of the corrected entities."""
    c = corrections.groupBy("response_id").agg(F.sort_array(F.collect_list(F.struct("entity", "replacement"))).alias("_c"))
    empty = F.array().cast("array<struct<entity:string,replacement:string>>")
    fixed = F.aggregate(F.coalesce("_c", empty), F.col("answer"), lambda t, x: F.regexp_replace(
        t, F.concat(F.lit(r"(?U)\b\Q"), x["entity"], F.lit(r"\E\b")), x["replacement"]))
    return responses.join(c, "response_id", "left").withColumn("answer", fixed).drop("_c")


def ungrounded_sentences(pairs: DataFrame, script: str = "any") -> DataFrame:
    """V9. Sentences of ten or more characters with under 30 % of their content words in the evidence."""
    s = pairs.select("response_id", "evidence_text", F.posexplode(split_sentences(F.col("response_text"), "spaced")).alias("sentence_no", "sentence"))
    if script == "hangul":
        words = F.filter(find_all(F.col("sentence"), "[가-힣]{2,}"), lambda w: (F.length(w) >= 3) | (F.substring(w, 1, 1) != F.substring(w, 2, 1)))
    else:
        words = find_all(F.col("sentence"), r"\p{L}{3,}")
    rated = s.where(F.length("sentence") >= 10).withColumn("_w", words).where(F.size("_w") > 0).withColumn(
        "coverage", F.round(share_contained(F.col("_w"), F.col("evidence_text")), 6))
    return rated.where("coverage < 0.3").select("response_id", "sentence_no", "sentence", "coverage")


def align_lines(responses: DataFrame, evidence: DataFrame, p: Params = Params()) -> DataFrame:
    """V10, J4. Best evidence unit per answer line; near-verbatim lines are snapped to the evidence wording and
    keep their citations.

    Lines and units of one response meet inside one row; only the best unit of each line leaves the task."""
    unit = F.transform(evidence_units(F.col("text")), lambda u: F.struct(F.col("doc_id").alias("doc_id"), F.col("page").alias("page"), u.alias("text")))
    # Texts move once: what is gathered of a response stays where it is for the join and the matching.
    own = spread(evidence.where(F.trim("text") != "").select("response_id", "rank", "doc_id", "page", "text"), "response_id")
    units = own.select("response_id", F.struct("rank", unit.alias("u")).alias("r")).groupBy("response_id").agg(
        F.flatten(F.transform(F.sort_array(F.collect_list("r")), lambda x: x["u"])).alias("units"))
    lines = F.filter(F.transform(F.split("answer", r"\r?\n"), lambda l: F.trim(l)), lambda l: l != "")
    j = responses.select("response_id", lines.alias("lines")).join(units, "response_id")
    clean = F.transform("lines", lambda l: F.trim(strip_citations(l)))
    matched = j.withColumn("_m", best_units(clean, F.transform("units", lambda u: u["text"])))
    # Each line takes its own unit along, not all of them.
    found = F.transform(F.arrays_zip(F.col("lines").alias("line"), F.col("_m").alias("m")), lambda x: F.struct(
        x["line"].alias("line"), x["m"]["score"].alias("score"), F.get("units", x["m"]["pos"]).alias("u")))
    rows = matched.select("response_id", F.posexplode(found).alias("line_no", "x"))
    hit = F.round(F.col("x.score") * 100, 6) >= p.align_match
    best = F.when(hit, F.col("x.u"))
    out = rows.select("response_id", "line_no", F.col("x.line").alias("line"), F.round("x.score", 6).alias("score"), best.alias("u"))
    body, cand = F.trim(strip_citations(F.col("line"))), F.trim("u.text")
    n_words = lambda c: F.size(find_all(c, r"\S+"))
    short = n_words(cand) < F.greatest(F.lit(2), F.floor(n_words(body) / 3).cast("int"))
    direct = fuzzy_score("ratio")(body, F.coalesce(cand, F.lit("")))
    out = out.withColumn("_direct", direct)
    snap = F.col("u").isNotNull() & (F.col("score") * 100 >= p.align_snap) & ~short & (F.col("_direct") < 0.96) & (body != "")
    cites = find_all(F.col("line"), r"\[\d+\]")
    fixed = F.concat(collapse(cand), F.when(F.size(cites) > 0, F.concat(F.lit(" "), F.array_join(cites, " "))).otherwise(""))
    return out.withColumn("corrected", F.when(snap, fixed).otherwise(F.col("line"))).select(
        "response_id", "line_no", "line", "score", F.col("u.doc_id").alias("doc_id"), F.col("u.page").alias("page"), "corrected",
        (F.col("corrected") != F.col("line")).alias("adjusted"))


def citation_accuracy(pairs: DataFrame, evidence: DataFrame | None = None, mode: str = "fuzzy", semantic: str | None = None) -> DataFrame:
    """V14. Word Jaccard, length ratio and sentence coverage, with or without a semantic score column.

    The single texts of the evidence are those of ``evidence``, or without it ``evidence_parts`` of the pairs (see
    ``audit_pairs``), which moves no text twice.  A response without evidence stays, with every score 0."""
    words = lambda c: F.array_distinct(find_all(norm_compare(c), r"\S+"))
    a, e = F.col("answer"), F.col("evidence_text")
    trimmed = lambda c: F.length(replace(c, r"^\s+|\s+$"))
    sent = F.transform(split_sentences(a, "lookback"), lambda s: norm_compare(s))
    if evidence is None:
        j = pairs.withColumn("_ev", F.transform("evidence_parts", norm_compare))
    else:
        ev = evidence.groupBy("response_id").agg(F.collect_list(norm_compare(F.col("text"))).alias("_ev"))
        j = spread(pairs.join(ev, "response_id", "left"), "response_id")
        j = j.withColumn("_ev", F.coalesce("_ev", F.array().cast("array<string>")))
    j = j.withColumn("_s", sent)
    seen = F.size("_ev") > 0
    if mode == "contains":
        covered = F.size(F.filter("_s", lambda s: F.exists("_ev", lambda t: t.contains(s))))
        coverage = F.when((F.size("_s") == 0) | ~seen, 0.0).otherwise(covered / F.size("_s"))
    else:
        coverage = F.when(seen, share_matched(0.8)(F.col("_s"), F.array_join("_ev", "\n"))).otherwise(0.0)
    jac = F.round(jaccard(words(a), words(e)), 6)
    length = F.when(seen, F.round(F.least(trimmed(a) / F.greatest(trimmed(e), F.lit(1)), F.lit(1.0)), 6)).otherwise(0.0)
    m = j.select("response_id", jac.alias("jaccard_score"), length.alias("length_ratio"), F.round(coverage, 6).alias("citation_coverage"),
                 *([F.col(semantic).alias("semantic_score")] if semantic else []))
    total = (
        F.col("jaccard_score") * 0.3 + F.col("semantic_score") * 0.3 + F.col("length_ratio") * 0.2 + F.col("citation_coverage") * 0.2
        if semantic else F.col("jaccard_score") * 0.4 + F.col("length_ratio") * 0.3 + F.col("citation_coverage") * 0.3)
    return m.withColumn("overall_score", F.round(total, 6)).withColumn("is_valid", F.col("overall_score") >= 0.7)


def suppress_sources(responses: DataFrame, phrases: Sequence[str] = P.GENERIC_PHRASES) -> DataFrame:
    """V15. Generic, low-confidence or hallucinated answers lose their sources."""
    generic = F.lit(False)
    for ph in phrases:
        generic = generic | F.lower("answer").contains(ph)
    drop = generic | (F.coalesce("confidence", F.lit(0.0)) < 0.3) | F.coalesce("hallucination_detected", F.lit(False))
    return responses.withColumn("is_generic", generic).withColumn("sources", F.when(drop, F.slice("sources", 1, 0)).otherwise(F.col("sources")))
