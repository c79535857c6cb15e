"""Streaming forms of the stateful operators, over (key, ts, ...) streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def sessions(stream: DataFrame, key: str, ts: str, gap: str, delay: str) -> DataFrame:
    """(key, start, end, n): runs of rows at most gap apart; closed once the watermark has passed them."""
    s = stream.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return s.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def windows(stream: DataFrame, key: str, ts: str, value: str, width: str, slide: str | None, delay: str) -> DataFrame:
    """(key, start, n, total, first_value) of tumbling or sliding windows."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    a = stream.withWatermark(ts, delay).groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.min_by(value, ts).alias("first_value"))
    return a.select(key, F.col("w.start").alias("start"), "n", "total", "first_value")


def first_seen(stream: DataFrame, keys: list[str], ts: str, delay: str) -> DataFrame:
    """The first row of every key within the watermark's reach."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def chained(stream: DataFrame, key: str, order: str, body: Column) -> DataFrame:
    """(key, sequence, previous_hash, entry_hash): a hash chain a key whose last hash is kept as state between batches.

    Entries of one key in one batch are chained by order, so a task holds that
    much: what a trigger admits bounds it.
    """
    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(order).cast("long").alias("o"), body.alias("body"))

    def link(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        import hashlib

        n, prev = state.get if state.exists else (0, None)
        out = []
        for r in pd.concat(list(frames)).sort_values("o").itertuples():
            own = hashlib.sha256(f"{r.body}|{prev or ''}".encode()).hexdigest()
            n += 1
            out.append((k[0], n, prev, own))
            prev = own
        state.update((n, prev))
        yield pd.DataFrame(out, columns=["key", "sequence", "previous_hash", "entry_hash"])

    return rows.groupBy("key").applyInPandasWithState(link, "key string, sequence long, previous_hash string, entry_hash string", "n long, prev string", "append", "NoTimeout")


def run_available(df: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Processes what is there and stops; a later run with the same checkpoint takes only new files."""
    q = df.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).option("path", sink).trigger(availableNow=True).start()
    q.awaitTermination()
