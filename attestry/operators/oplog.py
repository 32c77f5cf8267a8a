"""Query-log analytics.

Input is a flat log table: log_id, timestamp, log_date, session_id, query, query_type, total_time_ms,
search_time_ms, generation_time_ms, tokens, memory_mb, confidence, source_count, evidence_count,
hallucination, generic, has_error.  Group keys such as a day or an issue kind may hold most rows: every
aggregate here combines on the map side, and every top-n is group-limited before its shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry import params as P
from attestry.functions.normalize import query_hash
from attestry.params import Params


def flatten_logs(nested: DataFrame) -> DataFrame:
    """The flat table from nested log records."""
    ts = F.col("timestamp").cast("timestamp")
    return nested.select(
        F.xxhash64("timestamp", "session_id", "query").alias("log_id"), ts.alias("timestamp"), F.to_date(ts).alias("log_date"),
        "session_id", "query", F.coalesce("query_type", F.lit("normal")).alias("query_type"),
        *[F.col(f"performance_metrics.{c}").alias(c) for c in ("total_time_ms", "search_time_ms", "generation_time_ms")],
        F.col("performance_metrics.total_tokens").alias("tokens"), F.col("performance_metrics.memory_used_mb").alias("memory_mb"),
        F.col("quality_metrics.confidence_score").alias("confidence"), F.col("quality_metrics.source_count").alias("source_count"),
        F.col("quality_metrics.evidence_count").alias("evidence_count"), F.col("quality_metrics.hallucination_detected").alias("hallucination"),
        F.col("quality_metrics.generic_response").alias("generic"), F.col("error_info.has_error").alias("has_error"))


def log_statistics(logs: DataFrame, by: str = "log_date") -> DataFrame:
    """A1. Daily totals, averages and rates in one pass."""
    mean = lambda c: F.round(F.avg(F.coalesce(F.col(c), F.lit(0))), 6)
    rate = lambda cond: F.round(F.count_if(cond) / F.count(F.lit(1)), 6)
    return logs.groupBy(by).agg(
        F.count(F.lit(1)).alias("total_queries"),
        mean("total_time_ms").alias("avg_total_time_ms"), mean("search_time_ms").alias("avg_search_time_ms"),
        mean("generation_time_ms").alias("avg_generation_time_ms"), F.sum("tokens").alias("total_tokens"), mean("tokens").alias("avg_tokens"),
        mean("confidence").alias("avg_confidence"), rate(F.col("confidence") >= 0.7).alias("high_confidence_rate"),
        mean("source_count").alias("avg_sources"), mean("evidence_count").alias("avg_evidences"),
        rate(F.col("hallucination")).alias("hallucination_rate"), rate(F.col("generic")).alias("generic_rate"),
        F.count_if("has_error").alias("error_count"), rate(F.col("has_error")).alias("error_rate"))


def type_counts(logs: DataFrame, by: str = "log_date") -> DataFrame:
    """A1. Queries per type."""
    return logs.groupBy(by, "query_type").agg(F.count(F.lit(1)).alias("queries"))


def log_trends(logs: DataFrame, today: str, days: int = 7) -> DataFrame:
    """A2. Statistics of the last ``days`` days that have data, ascending."""
    end = F.lit(today).cast("date")
    recent = logs.where((F.col("log_date") <= end) & (F.col("log_date") > F.date_sub(end, days)))
    return log_statistics(recent).select(
        "log_date", "total_queries", "avg_confidence", F.col("avg_total_time_ms").alias("avg_response_time_ms"), "error_rate", "hallucination_rate"
    ).orderBy("log_date")


def retrieval_metrics(hits: DataFrame, scores: Sequence[str], key: str = "query_id") -> DataFrame:
    """A3. Hit count, and average and maximum of the positive scores of each kind."""
    positive = lambda c: F.when(F.col(c) > 0, F.col(c))
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return hits.groupBy(key).agg(
        F.count(F.lit(1)).alias("final_count"),
        *[zero(F.avg(positive(c))).alias(f"avg_{c}") for c in scores], *[zero(F.max(positive(c))).alias(f"top_{c}") for c in scores])


def quality_metrics(responses: DataFrame) -> DataFrame:
    """A4. Per response (response_id, answer, key_facts, sources, confidence, n_evidence)."""
    n = F.coalesce(F.size("sources"), F.lit(0))
    return responses.select(
        "response_id", F.col("confidence").alias("confidence_score"),
        ((n <= 0) | (F.coalesce("confidence", F.lit(0.0)) < 0.3)).alias("generic_response"), (n > 0).alias("has_sources"),
        F.greatest(n, F.lit(0)).cast("bigint").alias("source_count"), F.col("n_evidence").cast("bigint").alias("evidence_count"),
        F.length("answer").cast("bigint").alias("answer_length"), F.greatest(F.coalesce(F.size("key_facts"), F.lit(0)), F.lit(0)).cast("bigint").alias("key_facts_count"))


def _issues(logs: DataFrame, kinds: dict[str, tuple[Column, Column]]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(k).alias("issue"), c.alias("flag"), m.cast("double").alias("metric")) for k, (c, m) in kinds.items()])
    return logs.select("log_id", "timestamp", F.inline(rows)).where("flag").drop("flag")


def quality_issue_rows(logs: DataFrame) -> DataFrame:
    conf = F.coalesce("confidence", F.lit(0.0))
    return _issues(logs, {
        "low_confidence": (conf < 0.3, conf),
        "hallucinations": (F.col("hallucination"), conf),
        "generic_responses": (F.col("generic"), conf),
        "no_sources": ((F.coalesce("source_count", F.lit(0)) == 0) & (F.col("query_type") == "normal"), conf)})


def performance_issue_rows(logs: DataFrame, p: Params = Params()) -> DataFrame:
    return _issues(logs, {
        "slow_queries": (F.col("total_time_ms") > p.slow_ms, F.col("total_time_ms")),
        "high_memory": (F.col("memory_mb") > p.high_memory_mb, F.col("memory_mb")),
        "high_tokens": (F.col("tokens") > p.high_tokens, F.col("tokens"))})


def issue_counts(issues: DataFrame) -> DataFrame:
    """A5, A6. Rows per issue kind."""
    return issues.groupBy("issue").agg(F.count(F.lit(1)).alias("rows"))


def _top_issues(issues: DataFrame, n: int, *order: Column) -> DataFrame:
    w = Window.partitionBy("issue").orderBy(*order)
    return issues.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= n)


def quality_issues(logs: DataFrame, n: int = 20) -> DataFrame:
    """A5. The newest ``n`` rows of each quality issue."""
    return _top_issues(quality_issue_rows(logs), n, F.col("timestamp").desc(), F.col("log_id").desc())


def performance_issues(logs: DataFrame, p: Params = Params(), n: int = 20) -> DataFrame:
    """A6. The worst ``n`` rows of each performance issue."""
    return _top_issues(performance_issue_rows(logs, p), n, F.col("metric").desc(), F.col("log_id").desc())


def error_stats(errors: DataFrame, keep: int = 1000) -> DataFrame:
    """A10. Counts per type over the most recent ``keep`` errors (the log is a bounded ring)."""
    recent = errors.orderBy(F.col("timestamp").desc(), F.col("log_id").desc()).limit(keep)
    return recent.groupBy("error_type").agg(F.count(F.lit(1)).alias("errors"))


def recent_errors(errors: DataFrame, n: int = 10) -> DataFrame:
    """A10. The last ``n`` errors, messages cut to 100 characters."""
    return errors.orderBy(F.col("timestamp").desc(), F.col("log_id").desc()).limit(n).withColumn("message", F.substring("message", 1, 100))


def _clamped(score: Column) -> Column:
    s = F.when(score > 1, score / 100.0).otherwise(score)
    return F.greatest(F.lit(0.0), F.least(s, F.lit(1.0)))


def scope_score_metrics(hits: DataFrame, score: str = "score", key: str = "query_id") -> DataFrame:
    """A11. Count, average and maximum of the clamped score."""
    s = _clamped(F.col(score))
    return hits.groupBy(key).agg(F.count(F.lit(1)).alias("n_hits"), F.round(F.avg(s), 6).alias("avg_score"), F.round(F.max(s), 6).alias("max_score"))


def avg_evidence_score(hits: DataFrame, order: Sequence[str], percent: Sequence[str], key: str = "query_id") -> DataFrame:
    """A12. Average of the first present score of an ordered key list; the ``percent`` ones are /100 above 1."""
    def value(c: str) -> Column:
        return F.when(F.col(c) > 1, F.col(c) / 100.0).otherwise(F.col(c)) if c in percent else F.col(c)

    return hits.groupBy(key).agg(F.round(F.avg(F.coalesce(*[value(c) for c in order])), 6).alias("avg_score"))


def limiter_stats(requests: DataFrame, now: Column, window_seconds: int = 60, key: str = "session_id") -> DataFrame:
    """A13. Active identifiers and requests in the window that ends at ``now``."""
    live = requests.where((F.col("timestamp") > now - F.make_dt_interval(secs=F.lit(window_seconds))) & (F.col("timestamp") <= now))
    per_key = live.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.agg(F.count(F.lit(1)).alias("active_identifiers"), F.coalesce(F.sum("_n"), F.lit(0)).alias("requests_in_window"))


def mark_repeats(logs: DataFrame, ttl: int = 600) -> DataFrame:
    """A14. Flag a query asked again within ``ttl`` seconds of its previous occurrence.

    One popular query may hold a third of the log, so its rows are not ordered in one task: windows run per
    (key, ttl-wide time slot), and the first row of a slot looks at the previous slot's last time through a
    join with the pre-aggregated slots.
    """
    sec = F.unix_micros(F.col("timestamp").cast("timestamp"))
    rows = logs.select("log_id", query_hash(F.col("query")).alias("query_key"), sec.alias("_us")).withColumn(
        "_slot", F.floor(F.col("_us") / F.lit(ttl * 1_000_000)))
    ends = rows.groupBy("query_key", "_slot").agg(F.max("_us").alias("_end")).withColumn("_slot", F.col("_slot") + 1)
    w = Window.partitionBy("query_key", "_slot").orderBy("_us", "log_id")
    prev = F.coalesce(F.lag("_us").over(w), F.col("_end"))
    return rows.join(ends, ["query_key", "_slot"], "left").withColumn(
        "is_repeat", F.coalesce(F.col("_us") - prev <= ttl * 1_000_000, F.lit(False))).select("log_id", "query_key", "is_repeat")


def repeat_queries(logs: DataFrame, ttl: int = 600, n: int = 10) -> DataFrame:
    """A14. The most frequent query keys with their repeat ratio."""
    per = mark_repeats(logs, ttl).groupBy("query_key").agg(F.count(F.lit(1)).alias("n_asked"), F.count_if("is_repeat").alias("n_repeats"))
    return per.orderBy(F.desc("n_asked"), "query_key").limit(n).withColumn("hit_ratio", F.round(F.col("n_repeats") / F.col("n_asked"), 6))


def alerts(stats: DataFrame, rules=P.ALERT_RULES, by: str = "log_date") -> DataFrame:
    """A16. Statistics that break a rule."""
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(t).alias("threshold"),
                              (F.col(m) > t if op == ">" else F.col(m) < t).alias("broken")) for m, op, t in rules])
    return stats.select(by, F.inline(rows)).where("broken").drop("broken")


def search_logs(
    logs: DataFrame, text: str | None = None, min_confidence: float | None = None, has_error: bool | None = None, limit: int = 50,
    mode: str = "filter",
) -> DataFrame:
    """W8. Newest matching logs.  ``mode="preload"`` filters only the newest 2 x limit rows."""
    newest = (F.col("timestamp").desc(), F.col("log_id").desc())
    out = logs.orderBy(*newest).limit(2 * limit) if mode == "preload" else logs
    if text is not None:
        out = out.where(F.lower("query").contains(text.lower()))
    if min_confidence is not None:
        out = out.where(F.coalesce("confidence", F.lit(0.0)) >= min_confidence)
    if has_error is not None:
        out = out.where(F.coalesce("has_error", F.lit(False)) == has_error)
    return out.orderBy(*newest).limit(limit)
