"""Structured Streaming forms of the time-based behaviours and their batch twins.

Event time is a UTC timestamp; late rows are bounded by ``LATE`` (one hour).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from attestry.operators.chunking import chunk_documents, ordered_fold
from attestry.operators.oplog import log_statistics
from attestry.scale import cut_lineage
from attestry.sources.snapshots import upsert_by_doc

LATE = "1 hour"


def event_time(c: Column) -> Column:
    """Zone-less timestamps are UTC."""
    return c.cast("timestamp")


# ---- X1: sliding rate limit ----------------------------------------------------------------------------

def _decide(times: list[int], accepted: list[int], limit: int, window_us: int) -> tuple[list[bool], list[int]]:
    """Accept while fewer than ``limit`` accepted requests lie within the window; rejected ones never count."""
    out = []
    for t in times:
        accepted = [a for a in accepted if a > t - window_us]
        ok = len(accepted) < limit
        if ok:
            accepted.append(t)
        out.append(ok)
    return out, accepted


class _Limiter:
    def __init__(self, limit: int, window_us: int):
        self.limit, self.window_us, self.accepted = limit, window_us, []

    def push(self, row) -> list[dict]:
        (ok,), self.accepted = _decide([row.us], self.accepted, self.limit, self.window_us)
        return [{"key": row.key, "request_id": row.request_id, "accepted": ok}]

    def flush(self) -> list[dict]:
        return []


def _requests(df: DataFrame, key: str, request_id: str, ts: str) -> DataFrame:
    return df.select(F.col(key).alias("key"), F.col(request_id).alias("request_id"), F.unix_micros(event_time(F.col(ts))).alias("us"))


def rate_limit_batch(df: DataFrame, key: str, request_id: str, ts: str, limit: int = 30, window_seconds: int = 60) -> DataFrame:
    """X1, batch twin: (key, request_id, accepted).  Decisions depend on earlier decisions, so it is a fold over
    each key's sorted rows; the state is at most ``limit`` times, also for a key with most of the rows."""
    rows = _requests(df, key, request_id, ts)
    t = lambda c: rows.schema[c].dataType.simpleString()
    schema = f"key {t('key')}, request_id {t('request_id')}, accepted boolean"
    return ordered_fold(rows, ["key"], ["us", "request_id"], lambda: _Limiter(limit, window_seconds * 1_000_000), schema)


def rate_limit(stream: DataFrame, key: str, request_id: str, ts: str, limit: int = 30, window_seconds: int = 60) -> DataFrame:
    """X1, stream: the accepted times of a key are its state; idle keys time out with the watermark."""
    window_us = window_seconds * 1_000_000
    rows = stream.select(F.col(key).alias("key"), F.col(request_id).alias("request_id"), event_time(F.col(ts)).alias("event_ts")).withWatermark("event_ts", LATE)
    t = lambda c: rows.schema[c].dataType.simpleString()

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        accepted = list(state.get[0]) if state.exists else []
        pdf = pd.concat(list(batches)).sort_values(["event_ts", "request_id"])
        us = pdf["event_ts"].astype("datetime64[us]").astype("int64").tolist()
        ok, accepted = _decide(us, accepted, limit, window_us)
        state.update((accepted,))
        if us:
            state.setTimeoutTimestamp(max(max(us) // 1000, state.getCurrentWatermarkMs()) + window_seconds * 1000 + 1)
        yield pd.DataFrame({"key": k[0], "request_id": pdf["request_id"].to_numpy(), "accepted": ok})

    return rows.groupBy("key").applyInPandasWithState(
        step, f"key {t('key')}, request_id {t('request_id')}, accepted boolean", "accepted array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)


# ---- X2: incremental ingest ----------------------------------------------------------------------------

def merge_buckets(spark: SparkSession, incoming: DataFrame, target: str, buckets: int = 256) -> None:
    """Replace the incoming documents' chunks.  Chunks are stored by document hash, so a batch reads and rewrites
    the buckets of its own documents only (dynamic partition overwrite)."""
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")
    new = chunk_documents(incoming).withColumn("bucket", bucket)
    try:
        current = spark.read.schema(new.schema).parquet(target)
    except Exception as e:  # the first batch finds no target yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        current = None
    if current is not None:
        touched = incoming.select(bucket.alias("bucket")).distinct()
        ids = incoming.select("doc_id").distinct()
        kept = current.join(touched, "bucket", "left_semi").join(ids, "doc_id", "left_anti")
        new = kept.select(new.columns).unionByName(new)
    merged = cut_lineage(new)
    merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(target)


def ingest_stream(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str = "doc_id bigint, text string", buckets: int = 256):
    """X2. New document files are chunked and replace their documents in the chunk store; of two versions in one
    batch the one from the newer file counts.  A replayed batch gives
    the same result, because replacement is by key."""
    docs = spark.readStream.schema(schema).parquet(source).select("*", F.col("_metadata.file_modification_time").alias("_at"))

    def apply(batch: DataFrame, _id: int) -> None:
        latest = batch.groupBy("doc_id").agg(F.max_by("text", F.struct("_at", "text")).alias("text"))
        merge_buckets(batch.sparkSession, latest, target, buckets)

    return docs.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# ---- X3-X6 ---------------------------------------------------------------------------------------------

def log_statistics_stream(logs: DataFrame, late: str = LATE) -> DataFrame:
    """X3. Daily statistics (A1) over a stream of logs."""
    rows = logs.withColumn("timestamp", event_time(F.col("timestamp"))).withWatermark("timestamp", late)
    out = log_statistics(rows.withColumn("day", F.window("timestamp", "1 day")), by="day")
    return out.withColumn("log_date", F.to_date("day.start")).drop("day")


def sessionize(events: DataFrame, key: str, ts: str, gap: str = "1 hour", streaming: bool = False) -> DataFrame:
    """X4. Activity sessions per key, closed after ``gap`` without events; the same plan in batch and stream."""
    rows = events.withColumn("_t", event_time(F.col(ts)))
    if streaming:
        rows = rows.withWatermark("_t", LATE)
    return rows.groupBy(F.col(key), F.session_window("_t", gap).alias("s")).agg(F.count(F.lit(1)).alias("events")).select(
        key, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "events")


class _Ttl:
    def __init__(self, ttl_us: int):
        self.ttl_us, self.stored = ttl_us, None

    def push(self, row) -> list[dict]:
        fresh = self.stored is None or row.us - self.stored >= self.ttl_us
        if fresh:
            self.stored = row.us
        return [{"request_id": row.request_id, "kept": fresh}]

    def flush(self) -> list[dict]:
        return []


def dedupe_ttl_batch(df: DataFrame, key: str, request_id: str, ts: str, ttl_seconds: int = 600) -> DataFrame:
    """X5, batch twin: a repeat is dropped while the stored one is younger than the TTL, counted from its store."""
    rows = _requests(df, key, request_id, ts)
    schema = f"request_id {rows.schema['request_id'].dataType.simpleString()}, kept boolean"
    return ordered_fold(rows, ["key"], ["us", "request_id"], lambda: _Ttl(ttl_seconds * 1_000_000), schema)


def dedupe_ttl(stream: DataFrame, key: str, ts: str, ttl: str = "10 minutes") -> DataFrame:
    """X5, stream."""
    return stream.withColumn("event_ts", event_time(F.col(ts))).withWatermark("event_ts", ttl).dropDuplicatesWithinWatermark([key])


def expire(df: DataFrame, ts: str, now: Column, days: int = 90) -> DataFrame:
    """X6. Rows still inside the retention period; a date-partitioned table is pruned by the same predicate."""
    return df.where(F.col(ts) >= now - F.make_dt_interval(days=F.lit(days)))
