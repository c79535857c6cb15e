"""Running totals over a total order without one task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.session import materialise


def running_totals(df: DataFrame, order: Sequence[Column | str], totals: dict[str, str], by: Sequence[str] = ()) -> DataFrame:
    """df with, for each name: column of totals, the sum of column over the rows up to and including this one.

    Rows are range-partitioned by (by, order); sums of whole partitions (one row
    each) give every partition's start, windows inside partitions the rest.
    order must be total within by for repeatable results.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = df.repartitionByRange(*[F.col(b) for b in by], *order).withColumn("_part", F.spark_partition_id())
    ranged = materialise(ranged, "ranged")
    part = ranged.groupBy(*by, "_part").agg(*[F.sum(c).alias(f"_p_{n}") for n, c in totals.items()])
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = part.select(*by, "_part", *[F.coalesce(F.sum(f"_p_{n}").over(before), F.lit(0)).alias(f"_s_{n}") for n in totals])
    inside = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    starts = starts.select(F.col("_part").alias("_at"), *[F.col(b).alias(f"_b{i}") for i, b in enumerate(by)], *[f"_s_{n}" for n in totals])
    same = F.col("_part") == F.col("_at")
    for i, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"_b{i}"))
    out = ranged.join(starts, same)
    return out.select(*df.columns, *[(F.col(f"_s_{n}") + F.sum(c).over(inside)).alias(n) for n, c in totals.items()])


def numbered(df: DataFrame, order: Sequence[Column | str], name: str = "row", by: Sequence[str] = ()) -> DataFrame:
    """df with the 1-based place of every row in the order (within by)."""
    return running_totals(df.withColumn("_one", F.lit(1).cast("long")), order, {name: "_one"}, by).drop("_one")


def group_quantile(df: DataFrame, by: Sequence[str], value: str, q: float, name: str) -> DataFrame:
    """(by, name): the exact quantile of a group's values, interpolated between the two nearest ranks; groups without values are absent.

    Values are ranked over a range partition, so no task or buffer holds a large group's values.
    """
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    ranked = numbered(rows, ["_v"], "_no", by)
    sizes = rows.groupBy(*by).agg(F.count("*").alias("_n")).select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], "_n")
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    at = q * (F.col("_n") - 1)
    near = ranked.join(sizes, same).withColumn("_at", at).where((F.col("_no") == F.floor("_at") + 1) | (F.col("_no") == F.ceil("_at") + 1))
    return near.groupBy(*by).agg((F.min("_v") + (F.max("_at") - F.floor(F.max("_at"))) * (F.max("_v") - F.min("_v"))).alias(name))
