"""Registered queries: each key starts with its inventory row and pairs a Spark job with ANSI SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)``; without ``sql`` the query is checked by a brute-force unit test."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return wrap


def load_all() -> None:
    from importlib import import_module

    for module in ("retrieval", "corpus", "layout", "evaluation", "oplog", "dialog", "audit", "streams"):
        import_module(f"attestry.plans.catalog.{module}")
