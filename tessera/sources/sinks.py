"""Writing results; Spark's committers make each write appear whole or not at all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F


def write_csv(df: DataFrame, path: str, fields: Sequence[str] | None = None, partition: str | None = None) -> None:
    """CSV with a header; with fields, exactly those columns must be there."""
    if fields is not None:
        if set(df.columns) != set(fields):
            raise ValueError(f"columns differ from the schema: {sorted(set(df.columns) ^ set(fields))}")
        df = df.select(*fields)
    w = df.write.mode("overwrite").option("header", True).option("escape", '"')
    (w.partitionBy(partition) if partition else w).csv(path)


def write_json(df: DataFrame, path: str, append: bool = False) -> None:
    """JSON lines with keys in order; rows with a non-finite number are an error."""
    odd = [F.isnan(F.col(c)) | (F.abs(F.col(c)) == float("inf")) for c, t in df.dtypes if t in ("double", "float")]
    if odd:
        bad = odd[0]
        for o in odd[1:]:
            bad = bad | o
        if df.where(bad).limit(1).count():
            raise ValueError("a number is not finite")
    df.select(*sorted(df.columns)).write.mode("append" if append else "overwrite").option("ignoreNullFields", False).json(path)


def content_digest(df: DataFrame, order: Sequence[str]) -> str:
    """A digest of all rows whatever their partitioning: the sha256 of the sums of row hashes and of the count."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    part = lambda k: F.sum(F.conv(F.substring(row, 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)")).alias(f"p{k}")
    total = df.agg(F.count("*").alias("n"), *[part(k) for k in range(5)])
    return total.select(F.sha2(F.concat_ws(":", *[F.col(c).cast("string") for c in total.columns]), 256)).first()[0]


def write_valid(df: DataFrame, path: str, reason: str) -> DataFrame:
    """Writes the rows without a reason as Parquet; returns the others."""
    df.where(F.col(reason).isNull()).drop(reason).write.mode("overwrite").parquet(path)
    return df.where(F.col(reason).isNotNull())


def upsert(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """existing with the rows of new put over those of the same key; of several new rows the last by _ord counts."""
    a = existing.withColumn("_new", F.lit(0)).withColumn("_ord", F.lit(0).cast("long"))
    b = new.withColumn("_new", F.lit(1))
    r = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_new"), F.desc("_ord")))
    return a.unionByName(b, allowMissingColumns=True).withColumn("_r", r).where("_r = 1").drop("_r", "_new", "_ord")
