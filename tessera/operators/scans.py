"""Scans along the rows of a key that split the key over tasks: sums, minima, the last value, the row before.

Rows are range-partitioned by key and order, so a key with a third of all rows lies in
as many partitions as any other third. A key's rows in one partition are reduced to one carry;
carries of earlier partitions are combined by a window over them, and only keys that go
on from one partition into the next have any: at most one a partition. Inside partitions
plain windows do the rest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.session import materialise


def dealt(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """df, written in ranges of (by, order), with the range of each row as _part. order must be total within by."""
    return materialise(df.repartitionByRange(*[F.col(c) for c in (*by, *order)]).withColumn("_part", F.spark_partition_id()), "dealt")


def scan(df: DataFrame, by: Sequence[str], order: Sequence[str], found: dict[str, tuple[str, Column | str]]) -> DataFrame:
    """df (from `dealt`) with a column a name of found, each a kind and what it runs over, within by and along order.

    Kinds: sum, min and max of the rows up to this one (nulls aside; the sum of none is 0), min_before of
    the rows before it, last and last_before: the last value up to or before this row that is not null, lag: the value of the
    row before, null or not.
    """
    cols = {n: (kind, F.col(c) if isinstance(c, str) else c) for n, (kind, c) in found.items()}
    place = F.struct(*order)
    reduce_ = {
        "sum": F.sum, "min": F.min, "min_before": F.min, "max": F.max,
        **dict.fromkeys(("last", "last_before"), lambda c: F.max_by(c, F.when(c.isNotNull(), place))), "lag": lambda c: F.max_by(F.struct(c.alias("v")), place),
    }
    parts = df.groupBy(*by, "_part").agg(*[reduce_[kind](c).alias(f"_c_{n}") for n, (kind, c) in cols.items()])
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    combine = {"sum": F.sum, "min": F.min, "min_before": F.min, "max": F.max, **dict.fromkeys(("last", "last_before"), lambda c: F.last(c, ignorenulls=True)), "lag": F.last}
    carries = parts.select(
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col("_part").alias("_at"), F.count("*").over(earlier).alias("_e"), *[combine[kind](f"_c_{n}").over(earlier).alias(f"_c_{n}") for n, (kind, _) in cols.items()]
    ).where("_e > 0").drop("_e")
    same = F.col("_part") == F.col("_at")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    own = Window.partitionBy(*by, "_part").orderBy(*order)
    upto, before = own.rowsBetween(Window.unboundedPreceding, 0), own.rowsBetween(Window.unboundedPreceding, -1)

    def value(n: str, kind: str, c: Column) -> Column:
        carry = F.col(f"_c_{n}")
        if kind == "sum":
            return F.coalesce(carry + F.coalesce(F.sum(c).over(upto), carry * 0), F.sum(c).over(upto), F.lit(0))
        if kind == "max":
            return F.greatest(carry, F.max(c).over(upto))
        if kind in ("min", "min_before"):
            return F.least(carry, F.min(c).over(upto if kind == "min" else before))
        if kind in ("last", "last_before"):
            return F.coalesce(F.last(c, ignorenulls=True).over(upto if kind == "last" else before), carry)
        return F.when(F.row_number().over(own) == 1, carry["v"]).otherwise(F.lag(c).over(own))

    out = df.join(carries, same, "left")
    return out.select(*df.columns, *[value(n, kind, c).alias(n) for n, (kind, c) in cols.items()])
