"""Session windows, listing, search and titles.

Messages are (session_id, seq, role, content, ts).  Ranking filters are pushed below the shuffle, so a very
long session sends only the rows it keeps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry import params as P
from attestry.functions.patterns import find_all, snippet


def session_context(messages: DataFrame, n: int = 10) -> DataFrame:
    """W1. The last ``n`` messages of each session."""
    w = Window.partitionBy("session_id").orderBy(F.col("seq").desc())
    return messages.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def anchor_sources(messages: DataFrame) -> DataFrame:
    """W2. The sources that anchor follow-ups: first assistant message that has some, else the latest one."""
    usable = F.size(F.coalesce("sources", F.array().cast(messages.schema["sources"].dataType))) > 0
    assistant = messages.where(F.col("role") == "assistant")
    return assistant.groupBy("session_id").agg(
        F.coalesce(F.min(F.when(usable, F.col("seq"))), F.max("seq")).alias("anchor_seq"),
        F.coalesce(F.min_by("sources", F.when(usable, F.col("seq"))), F.max_by("sources", "seq")).alias("sources"))


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """W4. First row per key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def bounded_facts(facts: DataFrame, n: int = 50) -> DataFrame:
    """W5. Unique (doc_id, text) facts of a session, the last ``n`` kept."""
    uniq = facts.where(F.col("doc_id").isNotNull() & (F.coalesce("text", F.lit("")) != "")).groupBy("session_id", "doc_id", "text").agg(F.min("seq").alias("seq"))
    w = Window.partitionBy("session_id").orderBy(F.col("seq").desc(), F.col("doc_id").desc(), F.col("text").desc())
    return uniq.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def session_table(messages: DataFrame) -> DataFrame:
    """One row per session: first user text, message count, last update."""
    return messages.groupBy("session_id").agg(
        F.min_by("content", F.when(F.col("role") == "user", F.col("seq"))).alias("first_user"),
        F.count(F.lit(1)).alias("message_count"), F.max("ts").alias("updated_at"))


def list_sessions(sessions: DataFrame, page: int = 1, page_size: int = 20, after: tuple | None = None) -> DataFrame:
    """W6. Newest first: an offset page, or the page after a cursor (updated_at, session_id)."""
    order = (F.col("updated_at").desc(), F.col("session_id").asc())
    if after is not None:
        ts, sid = after
        rows = sessions.where((F.col("updated_at") < F.lit(ts)) | ((F.col("updated_at") == F.lit(ts)) & (F.col("session_id") > F.lit(sid))))
        return rows.orderBy(*order).limit(page_size)
    return sessions.orderBy(*order).offset((page - 1) * page_size).limit(page_size)


def search_sessions(messages: DataFrame, titles: DataFrame, query: str, n: int = 20) -> DataFrame:
    """W7. Title hit 10 points, each message hit 1, best first, with a preview of the first hit."""
    q = query.lower()
    hit = F.lower("content").contains(q)
    per = messages.where(hit).groupBy("session_id").agg(F.count(F.lit(1)).alias("_m"), F.min_by("content", "seq").alias("_first"))
    score = F.when(F.lower("title").contains(q), 10).otherwise(0) + F.coalesce("_m", F.lit(0))
    found = titles.join(per, "session_id", "left").withColumn("score", score.cast("bigint")).where("score > 0")
    return found.orderBy(F.desc("score"), "session_id").limit(n).select(
        "session_id", "title", "score", F.coalesce(snippet(F.col("_first"), F.lit(q)), F.lit("")).alias("preview"))


def expired_sessions(sessions: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """W9. Sessions not updated since the cutoff."""
    return sessions.where(F.col("updated_at") < now - F.make_dt_interval(days=F.lit(days)))


def session_titles(messages: DataFrame, limit: int = 30) -> DataFrame:
    """W10. First user text cut to ``limit`` characters."""
    first = messages.where(F.col("role") == "user").groupBy("session_id").agg(F.min_by("content", "seq").alias("_t"))
    title = F.concat(F.substring("_t", 1, limit), F.when(F.length("_t") > limit, "...").otherwise(""))
    return first.select("session_id", title.alias("title"))


def keyword_title(c: Column, limit: int = 20, letters: str = "가-힣") -> Column:
    """W10, keyword form: the two longest title nouns (else the two longest words of 3+), else the first words."""
    nouns = find_all(c, f"[{letters}]{{2,}}(?:{'|'.join(P.TITLE_NOUN_ENDINGS)})")
    plain = find_all(c, f"[{letters}]{{3,}}")
    picked = F.array_distinct(F.when(F.size(nouns) > 0, nouns).otherwise(plain))
    ranked = F.transform(F.array_sort(F.transform(picked, lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w")))), lambda s: s["w"])
    joined = F.array_join(F.slice(ranked, 1, 2), " ")
    head = F.trim(F.substring(F.array_join(F.slice(find_all(c, r"\S+"), 1, 5), " "), 1, limit))
    fallback = F.concat(F.when(F.length(head) < 5, F.trim(F.substring(c, 1, limit))).otherwise(head), F.when(F.length(c) > limit, "...").otherwise(""))
    title = F.when(F.size(picked) > 0, joined).otherwise(fallback)
    title = F.when(F.length(title) < 3, F.trim(F.substring(c, 1, limit))).otherwise(title)
    return F.when(F.length(c) < 5, "새 대화").otherwise(F.substring(title, 1, limit))
