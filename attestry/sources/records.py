"""Record sources and sinks: directives, query logs, golden questions, evaluations, sessions, audit lines
(S3, S6-S11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIRECTIVE_SCHEMA = (
    "source_file string, page int, index int, category string, title string, body string, deadline string, "
    "departments array<string>, lang string, doc_type string, directive string"
)
LOG_SCHEMA = (
    "timestamp string, session_id string, query string, query_type string, extracted_keywords array<string>, "
    "retrieval_metrics struct<bm25_count:int,vector_count:int,rrf_count:int,filtered_count:int,final_count:int,"
    "avg_bm25_score:double,avg_vector_score:double,avg_rrf_score:double,top_bm25_score:double,top_vector_score:double,top_rrf_score:double>, "
    "search_results array<struct<chunk_id:string,doc_id:string,page:int,text_preview:string,rrf_score:double,keyword_relevance:double,"
    "bm25_score:double,vector_score:double,include_reason:string>>, model_name string, model_response string, "
    "quality_metrics struct<confidence_score:double,evidence_jaccard:double,citation_coverage:double,hallucination_detected:boolean,"
    "generic_response:boolean,has_sources:boolean,source_count:int,evidence_count:int,answer_length:int,key_facts_count:int>, "
    "performance_metrics struct<search_time_ms:double,rerank_time_ms:double,generation_time_ms:double,total_time_ms:double,"
    "prompt_tokens:int,completion_tokens:int,total_tokens:int,memory_used_mb:double>, "
    "error_info struct<has_error:boolean,error_type:string,error_message:string,retry_count:int>, user_rating int"
)
GOLDEN_SCHEMA = (
    "questions array<struct<id:string,question:string,answer:string,key_facts:array<string>,documents:array<string>,"
    "evidence_spans:array<struct<doc:string,page:int,start:int,end:int>>>>"
)


def write_directives(df: DataFrame, path: str) -> None:
    """S3. JSON lines."""
    df.write.mode("overwrite").json(path)


def read_directives(spark: SparkSession, path: str) -> DataFrame:
    """S3. JSON lines with a fixed schema; blank lines carry no record."""
    text = spark.read.text(path).where(F.trim("value") != "")
    return text.select(F.from_json("value", DIRECTIVE_SCHEMA).alias("r")).select("r.*")


def write_query_log(df: DataFrame, path: str) -> None:
    """S6. Nested JSON, one folder per day."""
    day = F.to_date(F.col("timestamp").cast("timestamp"))
    df.withColumn("log_date", day).write.mode("append").partitionBy("log_date").json(path)


def read_query_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG_SCHEMA + ", log_date date").json(path)


def load_logs(logs: DataFrame, date: str, query_type: str | None = None, limit: int | None = None) -> DataFrame:
    """S7. One day, optional type, newest first, optional limit.  The date filter prunes partitions; with a
    limit the order is a distributed top-n (TakeOrderedAndProject)."""
    out = logs.where(F.col("log_date") == F.lit(date).cast("date"))
    if query_type is not None:
        out = out.where(F.col("query_type") == query_type)
    out = out.orderBy(F.col("timestamp").desc(), F.col("log_id").desc())
    return out if limit is None else out.limit(limit)


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """S8. One row per question; spans renamed to the keys the citation metric compares."""
    raw = spark.read.schema(GOLDEN_SCHEMA).option("multiLine", True).json(path)
    q = raw.select(F.explode("questions").alias("q")).select("q.*")
    spans = F.transform("evidence_spans", lambda s: F.struct(
        s["doc"].alias("doc_id"), s["page"].alias("page"), s["start"].alias("start"), s["end"].alias("end")))
    return q.withColumn("evidence_spans", spans)


def golden_spans(golden: DataFrame) -> DataFrame:
    """S8. One row per evidence span."""
    return golden.select("id", F.posexplode("evidence_spans").alias("span_no", "s")).select("id", "span_no", "s.*")


def write_eval(summary: DataFrame, details: DataFrame, path: str, run_id: str) -> None:
    """S9. Summary and details of one evaluation run."""
    for name, df in (("summary", summary), ("details", details)):
        df.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(f"{path}/{name}")


def nest_sessions(messages: DataFrame, segment: int = 1000) -> DataFrame:
    """S10. Messages (session_id, seq, role, content) to one nested row per session and segment.

    A session row holds at most ``segment`` consecutive messages, so one very long session becomes several
    bounded rows instead of one unbounded array."""
    seg = F.floor(F.col("seq") / F.lit(segment)).cast("bigint")
    parts = F.sort_array(F.collect_list(F.struct("seq", "role", "content")))
    return messages.groupBy("session_id", seg.alias("segment")).agg(parts.alias("messages"), F.count(F.lit(1)).alias("message_count"))


def unnest_sessions(sessions: DataFrame) -> DataFrame:
    """S10. Back to one row per message."""
    return sessions.select("session_id", F.inline("messages"))


def parse_audit(lines: DataFrame, col: str = "value") -> DataFrame:
    """S11. ``time|level|ACTION|user|detail...`` to columns; the detail keeps its own separators."""
    p = F.split(F.col(col), r"\|", 5)
    at = lambda i: F.get(p, F.lit(i))
    return lines.select(
        at(0).alias("time"), at(1).alias("level"), at(2).alias("action"), at(3).alias("user_id"), at(4).alias("detail"))


def audit_counts(parsed: DataFrame) -> DataFrame:
    """S11. Events per action and user."""
    return parsed.groupBy("action", "user_id").agg(F.count(F.lit(1)).alias("events"))
