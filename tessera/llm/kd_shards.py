"""Sharding by a k-d tree with distributed weighted medians.

Rows of equal text form a group that stays in one shard. A group has a weight
(its bytes) and metadata coordinates in 0 to 1: size on a log scale, language,
source and first doc_id. A node that is to become k shards is cut along the
dimension in which its groups spread widest, at the weighted quantile
(k // 2) / k, until every leaf is one shard, whose target is 1/k of all bytes.

Quantiles of all nodes of a level are found together: one histogram of weights
along each node's dimension finds the bin that holds the cut, further ones
refine inside that bin along a hash of the group, so that ties never stop a
cut. Only histograms of BINS numbers a node reach the driver.

A group above `heavy` times a shard's target cannot stay whole if shards are to
be near equal; it is dealt out by hash in parts of a quarter of the target.

Cases: a null text has size 8 and counts as empty; null or missing lang or source
and null doc_id take the coordinate 0; an empty table gives no rows; repeated rows
are separate rows of one group; with fewer groups than shards some shards stay
empty; a text larger than a shard's target is a shard beyond it; slots follow
doc_id, then the text's checksum, size and hash, so only equal rows tie; extra
columns are ignored, also ones named like the output's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.session import materialise

BINS, REFINE = 1024, 2
DIMENSIONS = ("d_size", "d_lang", "d_source", "d_id")


@dataclass
class Node:
    """Shards first .. first + k - 1, and the cut that divides them once it is known."""

    name: int
    first: int
    k: int
    dim: str = ""
    low: float = 0.0
    high: float = 1.0
    weight: float = 0.0
    before: float = 0.0


def _unit_hash(c: Column) -> Column:
    return F.when(c.isNull(), F.lit(0.0)).otherwise(F.pmod(F.xxhash64(c), F.lit(1 << 40)) / float(1 << 40))


def sized_rows(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, the group's key (g1, g2) and the metadata that coordinates come from."""
    text = F.coalesce("text", F.lit(""))
    meta = [(F.col(c) if c in docs.columns else F.lit(None)).cast("string").alias(c) for c in ("lang", "source")]
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("g1"), F.xxhash64(F.lit(1), text).alias("g2"), *meta,
    )


def group_points(rows: DataFrame, shards: int, heavy: float) -> DataFrame:
    """One row a group (or part of a heavy one): its key, weight, coordinates and tie-breaking hash."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    target = max(1.0, total / shards)
    groups = rows.groupBy("g1", "g2").agg(F.sum("size").alias("w"), F.min("size").alias("size"), F.min(F.struct("doc_id", "lang", "source")).alias("m"), F.max("doc_id").alias("last"))
    groups = groups.withColumn("parts", F.when(F.col("w") > heavy * target, F.ceil(F.col("w") * 4 / target)).otherwise(F.lit(1)).cast("int"))
    ends = groups.agg(F.min("m.doc_id"), F.max("m.doc_id"), F.max("size")).first()
    low, span = float(ends[0] or 0), float((ends[1] or 0) - (ends[0] or 0)) or 1.0
    points = groups.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return points.select(
        "g1", "g2", "part", "parts", (F.col("w") / F.col("parts")).alias("w"),
        (F.log2(F.col("size").cast("double")) / max(1.0, np.log2(float(ends[2] or 2)))).alias("d_size"),
        _unit_hash(F.col("m.lang")).alias("d_lang"), _unit_hash(F.col("m.source")).alias("d_source"),
        F.coalesce((F.col("m.doc_id") - F.lit(low)) / span, F.lit(0.0)).alias("d_id"),
        (F.pmod(F.xxhash64("g1", "g2", "part"), F.lit(1 << 52)) / float(1 << 52)).alias("tie"),
    )


def _choose(nodes: dict[int, Node], f) -> Column:
    """f(node) by the node column, as a balanced set of cases."""
    out = None
    for n in nodes.values():
        out = F.when(F.col("node") == n.name, f(n)) if out is None else out.when(F.col("node") == n.name, f(n))
    return out


def _bin(value: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(F.floor((value - low) / F.greatest(high - low, F.lit(1e-300)) * BINS), F.lit(0)), F.lit(BINS - 1)).cast("int")


def _cut(points: DataFrame, nodes: dict[int, Node]) -> DataFrame:
    """points with the nodes halved; nodes is replaced by their children."""
    stats = points.groupBy("node").agg(F.sum("w").alias("w"), *[f(d).alias(f"{d}_{n}") for d in DIMENSIONS for n, f in (("lo", F.min), ("hi", F.max))]).collect()
    splits = {}
    for r in stats:
        n = nodes[r["node"]]
        if n.k > 1:
            n.dim = max(DIMENSIONS, key=lambda d: r[f"{d}_hi"] - r[f"{d}_lo"])
            n.low, n.high, n.weight = r[f"{n.dim}_lo"], r[f"{n.dim}_hi"], r["w"]
            splits[n.name] = n
    if not splits:
        return points
    value = _choose(splits, lambda n: F.col(n.dim))
    edges = lambda s: (_choose(s, lambda n: F.lit(n.low)), _choose(s, lambda n: F.lit(n.high)))
    #: of a cut node: the bin along its dimension, then ever finer ranges of the tie-breaking hash inside that bin
    coarse = _bin(value, *edges(splits))
    inside, at, tie = F.col("node").isin(list(splits)), {}, {name: (0.0, 1.0) for name in splits}
    for turn in range(1 + REFINE):
        if turn == 0:
            key = coarse
        else:
            lo, hi = (_choose(splits, lambda n, i=i: F.lit(tie[n.name][i])) for i in (0, 1))
            key = _bin(F.col("tie"), lo, hi)
        hist = points.where(inside).groupBy("node", key.alias("b")).agg(F.sum("w").alias("w")).collect()
        for name, n in splits.items():
            w = np.zeros(BINS)
            for r in hist:
                if r["node"] == name:
                    w[r["b"]] = r["w"]
            goal = n.weight * (n.k // 2) / n.k - n.before
            upto = np.cumsum(w)
            b = min(int(np.searchsorted(upto, goal)), BINS - 1)
            n.before += upto[b] - w[b]
            if turn == 0:
                at[name] = b
            else:
                lo, hi = tie[name]
                tie[name] = (lo + (hi - lo) * b / BINS, lo + (hi - lo) * (b + 1) / BINS)
                if turn == REFINE and goal - (upto[b] - w[b]) > w[b] / 2:
                    tie[name] = (tie[name][1], tie[name][1])
        inside = inside & (coarse == _choose(splits, lambda n: F.lit(at[n.name]))) if turn == 0 else inside & (F.col("tie") >= _choose(splits, lambda n: F.lit(tie[n.name][0]))) & (F.col("tie") < _choose(splits, lambda n: F.lit(tie[n.name][1])))
    edge_bin, edge_tie = _choose(splits, lambda n: F.lit(at[n.name])), _choose(splits, lambda n: F.lit(tie[n.name][0]))
    left = (coarse < edge_bin) | ((coarse == edge_bin) & (F.col("tie") < edge_tie))
    cut = F.col("node").isin(list(splits))
    child = F.when(cut, F.col("node") * 2 + F.when(left, 0).otherwise(1)).otherwise(F.col("node") * 2)
    made: dict[int, Node] = {}
    for n in nodes.values():
        half = n.k // 2 if n.name in splits else n.k
        made[2 * n.name] = Node(2 * n.name, n.first, half)
        if n.name in splits:
            made[2 * n.name + 1] = Node(2 * n.name + 1, n.first + half, n.k - half)
    nodes.clear()
    nodes.update(made)
    return materialise(points.withColumn("node", child.cast("long")), "points")


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard get their place among the partition's rows of that shard."""
    shard, at = None, 0
    for b in batches:
        s = b.column("shard").to_numpy()
        first = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, bool)
        start = np.maximum.accumulate(np.where(first, np.arange(len(s)), 0))
        place = np.arange(len(s)) - start
        if len(s) and s[0] == shard:
            place[start == 0] += at
        if len(s):
            shard, at = s[-1], int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(place.astype(np.int64))], names=[*b.schema.names, "place"])


def kd_shards(docs: DataFrame, shards: int = 24, heavy: float = 1.25) -> DataFrame:
    """doc_id, size, text_crc32, law ("bytes"), shard, slot, grown_shard (null) of every row of docs."""
    rows = materialise(sized_rows(docs), "sized")
    nodes = {1: Node(1, 0, shards)}
    points = materialise(group_points(rows, shards, heavy).withColumn("node", F.lit(1).cast("long")), "points")
    while any(n.k > 1 for n in nodes.values()):
        before = set(nodes)
        points = _cut(points, nodes)
        if set(nodes) == before:  # no rows
            break
    # one row a group: the shard of each of its parts (4 * shards parts and a few at most); the join with the rows is split where a group has many
    shard = F.struct("part", _choose(nodes, lambda n: F.lit(n.first)).cast("int").alias("shard"))
    groups = materialise(points.groupBy("g1", "g2").agg(F.array_sort(F.collect_list(shard)).alias("to")), "groups")
    part = F.pmod(F.xxhash64("doc_id", "g1"), F.size("to")).cast("int")
    placed = rows.join(groups, ["g1", "g2"]).withColumn("shard", F.get("to", part)["shard"])
    order = ["shard", "doc_id", "text_crc32", "size", "g1"]
    ordered = placed.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).drop("g1").withColumn("task", F.spark_partition_id())
    schema = "shard int, doc_id long, text_crc32 long, size long, task int, place long"
    done = materialise(ordered.mapInArrow(_numbered, schema), "placed")
    # a row a shard and task
    sizes = done.groupBy("shard", "task").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("shard").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before_ = sizes.select("shard", "task", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    return done.join(before_, ["shard", "task"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("place")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
