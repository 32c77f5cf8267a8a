"""Bindings of the streaming rows over events: batch twins, and one query run as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from attestry.plans.catalog import register
from attestry.plans.catalog.oplog import LOG, STATS, day, logs
from attestry.scale import checkpoint_folder
from attestry.session import load_table
from attestry.streaming import streams as X


def events(spark, sf):
    return load_table(spark, sf, "events")


RECENT = "list_filter(f.acc, lambda a: a > o.us - 5400000000)"


@register("x1_rate_limit", f"""WITH RECURSIVE o AS MATERIALIZED (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f(user_id, event_id, i, acc, ok) AS (SELECT user_id, event_id, i, [us], true FROM o WHERE i = 1
 UNION ALL SELECT o.user_id, o.event_id, o.i, CASE WHEN len({RECENT}) < 2 THEN list_append({RECENT}, o.us) ELSE {RECENT} END, len({RECENT}) < 2
 FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1)
SELECT user_id AS key, event_id AS request_id, ok AS accepted FROM f""")
def x1(spark, sf):
    """Two requests per user and 90 minutes."""
    return X.rate_limit_batch(events(spark, sf), "user_id", "event_id", "ts", 2, 5400)


@register("x3_log_statistics", f"WITH {LOG}, {STATS} SELECT * REPLACE (log_date::varchar AS log_date) FROM st")
def x3(spark, sf):
    """The events file read as a stream until it is exhausted; the final state of the daily aggregate."""
    schema = events(spark, sf).schema
    root = f"{checkpoint_folder(spark)}/x3-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    stats = X.log_statistics_stream(logs_from(stream))
    q = (stats.writeStream.outputMode("complete").option("checkpointLocation", f"{root}/state")
         .foreachBatch(lambda b, _i: b.write.mode("overwrite").parquet(f"{root}/out")).trigger(availableNow=True).start())
    q.awaitTermination()
    return day(spark.read.parquet(f"{root}/out"))


def logs_from(e):
    from attestry.plans.catalog.oplog import project_logs

    return project_logs(e)


GAPS = """g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER o + INTERVAL 1 HOUR OR lag(ts) OVER o IS NULL THEN 1 ELSE 0 END AS n FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sno FROM g)"""


@register("x4_sessionize", f"WITH {GAPS} SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 3600000000 AS end_us, count(*) AS events FROM s GROUP BY user_id, sno")
def x4(spark, sf):
    s = X.sessionize(events(spark, sf), "user_id", "ts")
    return s.select("user_id", F.unix_micros("session_start").alias("start_us"), F.unix_micros("session_end").alias("end_us"), "events")


@register("x5_dedupe_ttl", """WITH RECURSIVE e AS (SELECT event_id, concat_ws('|', event_type, props) AS key, epoch_us(ts) AS us FROM events),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY key ORDER BY us, event_id) AS i FROM e),
f(key, event_id, i, stored, kept) AS (SELECT key, event_id, i, us, true FROM o WHERE i = 1
 UNION ALL SELECT o.key, o.event_id, o.i, CASE WHEN o.us - f.stored >= 36000000000 THEN o.us ELSE f.stored END, o.us - f.stored >= 36000000000
 FROM f JOIN o ON o.key = f.key AND o.i = f.i + 1)
SELECT event_id AS request_id, kept FROM f""")
def x5(spark, sf):
    e = events(spark, sf).withColumn("key", F.concat_ws("|", "event_type", "props"))
    return X.dedupe_ttl_batch(e, "key", "event_id", "ts", 36000)


@register("x6_expire", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 10 DAY")
def x6(spark, sf):
    return X.expire(events(spark, sf), "ts", F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"), 10).select("event_id")
