"""Registered queries of the library's own operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: adds f(spark, sf_dir) under name, with the DuckDB SQL for the same rows."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; its zoneless timestamps become instants of the session's zone (UTC)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*[F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in df.dtypes])


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.plans import evidence_plans

    return evidence_plans.chronology(spark, sf_dir)


def _load() -> None:
    from tessera.plans import attribution_plans, audit_plans, detail_plans, evidence_plans, function_plans, media_plans, metric_plans, profile_plans, record_plans, series_plans, stream_plans  # noqa: F401


_load()
