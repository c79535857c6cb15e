"""Points inside intervals of any length, as an equi-join on dyadic blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Blocks of 2**0 to 2**MOST cells.
MOST = 62


def _blocks(first: Column, last: Column, cell: float) -> Column:
    """Array of (level, block): the one or two blocks of 2**level cells that hold the cells of [first, last), for the lowest level at which these fit into one block."""
    low, high = F.floor(first / cell), F.ceil(last / cell)
    # a logarithm that is off by one costs a block more, no cell
    level = F.least(F.lit(MOST), F.ceil(F.log2((high - low).cast("double"))).cast("int"))
    at = F.sequence(F.call_function("shiftright", low, level), F.call_function("shiftright", high - 1, level))
    return F.when(low < high, F.transform(at, lambda block: F.struct(level.alias("level"), block.alias("block"))))


def interval_join(windows: DataFrame, points: DataFrame, by: str, start: str = "start_sec", end: str = "end_sec", ts: str = "ts", cell: float = 1.0) -> DataFrame:
    """windows joined with the points (all columns but by) of the same key with start <= ts < end.

    A window goes to the one or two blocks of about its length that it touches, in cells of `cell`; a point is looked up once
    for each such length in use, so windows may overlap and differ in length at will, and what is shuffled does
    not grow with their length. Blocks are less than twice as long as the window (or one cell), so about four times as many pairs
    meet before the exact test as pass it, where points lie evenly. `cell` should be about the shortest
    window: a larger one lets more pairs meet. Windows that end before they start, and nulls, join nothing.
    """
    cut = windows.withColumn("_blocks", F.explode(_blocks(F.col(start).cast("double"), F.col(end).cast("double"), cell)))
    cut = cut.select(*windows.columns, F.col("_blocks.level").alias("_level"), F.col("_blocks.block").alias("_block"))
    used = cut.agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_level")))).first()[0] or 0
    levels = F.array(*[F.lit(k) for k in range(MOST + 1) if used >> k & 1]).cast("array<int>")
    index = F.floor(F.col(ts).cast("double") / cell)
    p = points.withColumnRenamed(by, "_by").withColumn("_l", F.explode(levels)).withColumn("_b", F.call_function("shiftright", index, F.col("_l")))
    hit = cut.join(p, (F.col(by) == F.col("_by")) & (F.col("_level") == F.col("_l")) & (F.col("_block") == F.col("_b")))
    return hit.where((F.col(ts) >= F.col(start)) & (F.col(ts) < F.col(end))).drop("_by", "_level", "_block", "_l", "_b")
