"""Bindings of the log rows: events are the query log (value -> latency, event type -> query type)."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry.operators import oplog as O
from attestry.params import Params
from attestry.plans.catalog import register
from attestry.plans.catalog.retrieval import LEX, hits_of
from attestry.session import load_table
from attestry.sources import records as SR


def logs(spark, sf):
    return project_logs(load_table(spark, sf, "events"))


def project_logs(e):
    k = F.from_json("props", "k bigint")["k"]
    conf = (F.col("event_id") % 100) / F.lit(100.0)
    return e.select(
        F.col("event_id").alias("log_id"), F.col("ts").alias("timestamp"), F.to_date("ts").alias("log_date"), F.col("user_id").alias("session_id"),
        F.concat_ws(" ", F.col("event_type"), k.cast("string")).alias("query"), F.when(F.col("event_type") == "view", "normal").otherwise(F.col("event_type")).alias("query_type"),
        (F.col("value") * 100).alias("total_time_ms"), (F.col("value") * 30).alias("search_time_ms"), (F.col("value") * 60).alias("generation_time_ms"),
        (k * 30).alias("tokens"), (F.col("value") * 10).alias("memory_mb"), conf.alias("confidence"), (k % 5).alias("source_count"), (k % 7).alias("evidence_count"),
        (F.col("event_id") % 97 == 0).alias("hallucination"), ((k % 5 == 0) | (conf < 0.3)).alias("generic"), (F.col("event_type") == "error").alias("has_error"))


LOG = r"""k AS (SELECT *, regexp_extract(props, '"k": (\d+)', 1)::bigint AS k FROM events),
lg AS MATERIALIZED (SELECT event_id AS log_id, ts AS timestamp, ts::date AS log_date, user_id AS session_id, event_type || ' ' || k AS query,
 CASE WHEN event_type = 'view' THEN 'normal' ELSE event_type END AS query_type, value * 100 AS total_time_ms, value * 30 AS search_time_ms, value * 60 AS generation_time_ms,
 k * 30 AS tokens, value * 10 AS memory_mb, (event_id % 100) / 100e0 AS confidence, k % 5 AS source_count, k % 7 AS evidence_count,
 event_id % 97 = 0 AS hallucination, (k % 5 = 0 OR (event_id % 100) / 100e0 < 0.3e0) AS generic, event_type = 'error' AS has_error FROM k)"""
STATS = """st AS (SELECT log_date, count(*) AS total_queries, round(avg(total_time_ms), 6) AS avg_total_time_ms, round(avg(search_time_ms), 6) AS avg_search_time_ms,
 round(avg(generation_time_ms), 6) AS avg_generation_time_ms, sum(tokens)::bigint AS total_tokens, round(avg(tokens), 6) AS avg_tokens, round(avg(confidence), 6) AS avg_confidence,
 round(count(*) FILTER (confidence >= 0.7e0)::double / count(*), 6) AS high_confidence_rate, round(avg(source_count), 6) AS avg_sources, round(avg(evidence_count), 6) AS avg_evidences,
 round(count(*) FILTER (hallucination)::double / count(*), 6) AS hallucination_rate, round(count(*) FILTER (generic)::double / count(*), 6) AS generic_rate,
 count(*) FILTER (has_error) AS error_count, round(count(*) FILTER (has_error)::double / count(*), 6) AS error_rate FROM lg GROUP BY log_date)"""


def day(df):
    return df.withColumn("log_date", F.col("log_date").cast("string"))


@register("a1_log_statistics", f"WITH {LOG}, {STATS} SELECT * REPLACE (log_date::varchar AS log_date) FROM st")
def a1(spark, sf):
    return day(O.log_statistics(logs(spark, sf)))


@register("a1_type_counts", f"WITH {LOG} SELECT log_date::varchar AS log_date, query_type, count(*) AS queries FROM lg GROUP BY ALL")
def a1b(spark, sf):
    return day(O.type_counts(logs(spark, sf)))


@register("a2_log_trends", f"""WITH {LOG}, {STATS} SELECT log_date::varchar AS log_date, total_queries, avg_confidence, avg_total_time_ms AS avg_response_time_ms, error_rate, hallucination_rate
 FROM st WHERE log_date <= DATE '2024-01-20' AND log_date > DATE '2024-01-13'""")
def a2(spark, sf):
    return day(O.log_trends(logs(spark, sf), "2024-01-20"))


@register("a3_retrieval_metrics", LEX + " SELECT query_id, count(*) AS final_count, round(avg(score) FILTER (score > 0), 6) AS avg_score, round(max(score), 6) AS top_score FROM hits GROUP BY query_id")
def a3(spark, sf):
    return O.retrieval_metrics(hits_of(spark, sf), ["score"])


QI = """qi AS (SELECT log_id, timestamp, confidence AS metric, unnest(list_filter([CASE WHEN confidence < 0.3e0 THEN 'low_confidence' END, CASE WHEN hallucination THEN 'hallucinations' END,
 CASE WHEN generic THEN 'generic_responses' END, CASE WHEN source_count = 0 AND query_type = 'normal' THEN 'no_sources' END], lambda x: x IS NOT NULL)) AS issue FROM lg)"""
PI = """pi AS (SELECT log_id, total_time_ms AS metric, 'slow_queries' AS issue FROM lg WHERE total_time_ms > 5000 UNION ALL
 SELECT log_id, memory_mb, 'high_memory' FROM lg WHERE memory_mb > 500 UNION ALL SELECT log_id, tokens, 'high_tokens' FROM lg WHERE tokens > 2000)"""


@register("a5_issue_counts", f"WITH {LOG}, {QI} SELECT issue, count(*) AS rows FROM qi GROUP BY issue")
def a5(spark, sf):
    return O.issue_counts(O.quality_issue_rows(logs(spark, sf)))


@register("a5_quality_issues", f"""WITH {LOG}, {QI} SELECT issue, log_id, metric, row_number() OVER (PARTITION BY issue ORDER BY timestamp DESC, log_id DESC) AS rank FROM qi QUALIFY rank <= 20""")
def a5b(spark, sf):
    return O.quality_issues(logs(spark, sf)).select("issue", "log_id", "metric", "rank")


@register("a5_reviewed_issues", f"""
SELECT d.source, count(*) AS docs, count(*) FILTER (l.doc_id IS NOT NULL) AS reviewed, count(*) FILTER (quality = 0) AS low_quality, count(*) FILTER (toxic = 1) AS toxic
FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.source""")
def a5c(spark, sf):
    """Review outcomes joined to the documents, per source."""
    d = load_table(spark, sf, "documents").select("doc_id", "source")
    l = load_table(spark, sf, "labels").withColumn("seen", F.lit(True))
    return d.join(l, "doc_id", "left").groupBy("source").agg(
        F.count(F.lit(1)).alias("docs"), F.count_if("seen").alias("reviewed"), F.count_if(F.col("quality") == 0).alias("low_quality"), F.count_if(F.col("toxic") == 1).alias("toxic"))


@register("a6_performance_counts", f"WITH {LOG}, {PI} SELECT issue, count(*) AS rows FROM pi GROUP BY issue")
def a6(spark, sf):
    return O.issue_counts(O.performance_issue_rows(logs(spark, sf)))


@register("a6_performance_issues", f"WITH {LOG}, {PI} SELECT issue, log_id, metric, row_number() OVER (PARTITION BY issue ORDER BY metric DESC, log_id DESC) AS rank FROM pi QUALIFY rank <= 20")
def a6b(spark, sf):
    return O.performance_issues(logs(spark, sf)).select("issue", "log_id", "metric", "rank")


def errors(spark, sf):
    return logs(spark, sf).where("has_error").withColumn("error_type", F.concat(F.lit("E"), F.col("source_count").cast("string"))).withColumn("message", F.col("query"))


@register("a10_error_stats", f"""WITH {LOG} SELECT error_type, count(*) AS errors FROM (SELECT 'E' || source_count AS error_type FROM lg WHERE has_error ORDER BY timestamp DESC, log_id DESC LIMIT 1000)
 GROUP BY error_type""")
def a10(spark, sf):
    return O.error_stats(errors(spark, sf))


@register("a10_recent_errors", f"WITH {LOG} SELECT log_id, query AS message FROM lg WHERE has_error ORDER BY timestamp DESC, log_id DESC LIMIT 10")
def a10b(spark, sf):
    return O.recent_errors(errors(spark, sf)).select("log_id", "message")


CLAMP = "greatest(0e0, least(CASE WHEN score > 1 THEN score / 100e0 ELSE score END, 1e0))"


@register("a11_scope_score_metrics", LEX + f" SELECT query_id, count(*) AS n_hits, round(avg({CLAMP}), 6) AS avg_score, round(max({CLAMP}), 6) AS max_score FROM hits GROUP BY query_id")
def a11(spark, sf):
    return O.scope_score_metrics(hits_of(spark, sf))


@register("a12_avg_evidence_score", LEX + """ SELECT query_id, round(avg(coalesce(CASE WHEN s1 > 1 THEN s1 / 100e0 ELSE s1 END, rank / 100e0)), 6) AS avg_score
 FROM (SELECT *, CASE WHEN rank <= 30 THEN score END AS s1 FROM hits) GROUP BY query_id""")
def a12(spark, sf):
    h = hits_of(spark, sf).withColumn("score", F.when(F.col("rank") <= 30, F.col("score"))).withColumn("normalized_score", F.col("rank") / F.lit(100.0))
    return O.avg_evidence_score(h, ["score", "normalized_score"], ["score"])


@register("a13_limiter_stats", f"""WITH {LOG} SELECT count(DISTINCT session_id) AS active_identifiers, count(*) AS requests_in_window FROM lg
 WHERE timestamp > TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 6 HOUR AND timestamp <= TIMESTAMP '2024-01-15 12:00:00'""")
def a13(spark, sf):
    return O.limiter_stats(logs(spark, sf), F.lit("2024-01-15 12:00:00").cast("timestamp_ntz"), 6 * 3600)


REPEAT = """rp AS (SELECT log_id, md5(lower(trim(query))) AS query_key, epoch_us(timestamp) AS us FROM lg),
mk AS (SELECT *, coalesce(us - lag(us) OVER (PARTITION BY query_key ORDER BY us, log_id) <= 36000000000, false) AS is_repeat FROM rp)"""


@register("a14_mark_repeats", f"WITH {LOG}, {REPEAT} SELECT log_id, query_key, is_repeat FROM mk")
def a14(spark, sf):
    return O.mark_repeats(logs(spark, sf), 36000)


@register("a14_repeat_queries", f"""WITH {LOG}, {REPEAT} SELECT query_key, n_asked, n_repeats, round(n_repeats::double / n_asked, 6) AS hit_ratio FROM (
 SELECT query_key, count(*) AS n_asked, count(*) FILTER (is_repeat) AS n_repeats FROM mk GROUP BY query_key) ORDER BY n_asked DESC, query_key LIMIT 10""")
def a14b(spark, sf):
    return O.repeat_queries(logs(spark, sf), 36000)


RULES = (("error_rate", ">", 0.05), ("hallucination_rate", ">", 0.01), ("avg_total_time_ms", ">", 3000.0), ("avg_confidence", "<", 0.7))


@register("a16_alerts", f"WITH {LOG}, {STATS} " + " UNION ALL ".join(
    f"SELECT log_date::varchar AS log_date, '{m}' AS metric, {m}::double AS value, {t}::double AS threshold FROM st WHERE {m} {op} {t}" for m, op, t in RULES))
def a16(spark, sf):
    return day(O.alerts(O.log_statistics(logs(spark, sf))))


@register("s7_load_logs", f"WITH {LOG} SELECT log_id, session_id, query FROM lg WHERE log_date = DATE '2024-01-10' AND query_type = 'click' ORDER BY timestamp DESC, log_id DESC LIMIT 50")
def s7(spark, sf):
    return SR.load_logs(logs(spark, sf), "2024-01-10", "click", 50).select("log_id", "session_id", "query")


@register("w8_search_logs", f"""WITH {LOG} SELECT log_id, query FROM lg WHERE contains(lower(query), 'click') AND confidence >= 0.5e0 AND NOT has_error ORDER BY timestamp DESC, log_id DESC LIMIT 50""")
def w8(spark, sf):
    return O.search_logs(logs(spark, sf), "click", 0.5, False).select("log_id", "query")


@register("w8_search_logs_preload", f"""WITH {LOG} SELECT log_id, query FROM (SELECT * FROM lg ORDER BY timestamp DESC, log_id DESC LIMIT 100) WHERE contains(lower(query), 'click')
 AND confidence >= 0.5e0 ORDER BY timestamp DESC, log_id DESC LIMIT 50""")
def w8b(spark, sf):
    return O.search_logs(logs(spark, sf), "click", 0.5, mode="preload").select("log_id", "query")


@register("s11_audit_counts", r"""SELECT upper(event_type) AS action, user_id::varchar AS user_id, count(*) AS events FROM events GROUP BY ALL""")
def s11(spark, sf):
    e = load_table(spark, sf, "events")
    line = F.concat_ws("|", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("INFO"), F.upper("event_type"), F.col("user_id").cast("string"), F.lit("a|b"), F.col("value").cast("string"))
    return SR.audit_counts(SR.parse_audit(e.select(line.alias("value"))))
