"""Best-first lineage search and hash-chained ledgers."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tessera.operators import folds
from tessera.session import materialise, release


def best_first(nodes: DataFrame, edges: DataFrame, root, iterations: int = 12, max_depth: int = 3, goal: str | None = None) -> DataFrame:
    """(node, parent, depth, f, step): nodes in the order they are popped, least f first, ties by when they were found.

    nodes: node, f; edges: src, dst. A node is expanded once. Only the popped
    row of each iteration reaches the driver; the frontier is a table an
    expanded node, so a hub's neighbours stay on the executors: every step is an
    edge join, an anti-join with what was reached before, and a limit 1. goal is
    a predicate on nodes that ends the search.
    """
    spark = nodes.sparkSession
    schema = "node string, parent string, depth int, f double, found int"
    n = nodes.select(F.col("node").cast("string").alias("node"), F.col("f").cast("double").alias("f"), *([F.expr(goal).alias("_goal")] if goal else [F.lit(False).alias("_goal")]))
    e = edges.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))
    reached, tables = spark.createDataFrame([(str(root), None, 0, 0.0, 0)], schema), []
    popped: list[tuple] = []
    for step in range(iterations):
        done = [p[0] for p in popped]
        top = reached.where(~F.col("node").isin(done)).orderBy("f", "found", "node").limit(1).collect()
        if not top:
            break
        cur = top[0]
        popped.append((cur["node"], cur["parent"], cur["depth"], cur["f"], step))
        if n.where((F.col("node") == cur["node"]) & F.col("_goal")).limit(1).count():
            break
        if cur["depth"] >= max_depth:
            continue
        new = e.where(F.col("src") == cur["node"]).select(F.col("dst").alias("node")).distinct().join(reached.select("node"), "node", "left_anti").join(n, "node")
        found = new.select("node", F.lit(cur["node"]).alias("parent"), F.lit(cur["depth"] + 1).alias("depth"), "f", F.lit(step + 1).alias("found"))
        tables.append(materialise(found, "frontier"))
        reached = reached.unionByName(tables[-1])
    release(*tables)
    return spark.createDataFrame(popped, "node string, parent string, depth int, f double, step int")


def best_first_many(nodes: DataFrame, edges: DataFrame, roots: DataFrame, iterations: int = 12, max_depth: int = 3, goal: str | None = None) -> DataFrame:
    """(case, node, parent, depth, f, step): the search of `best_first` for every case at once; roots: case, node.

    One frontier keyed by case: a round pops the least row of every case by a grouped minimum, joins all popped
    rows with the edges, and puts down what their cases had not reached. The number of rounds is that of
    one search, whatever the number of cases, and the driver sees one count a round: sides grow with the cases, so none
    is broadcast, which would take it through the driver in every round. A case ends when its
    frontier is empty or it pops a goal.
    """
    n = nodes.select(F.col("node").cast("string").alias("node"), F.col("f").cast("double").alias("f"), (F.coalesce(F.expr(goal), F.lit(False)) if goal else F.lit(False)).alias("_goal"))
    e = edges.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")).distinct()
    start = roots.select("case", F.col("node").cast("string").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"), F.lit(0.0).alias("f"), F.lit(0).alias("found")).distinct()
    n, e = materialise(n, "nodes"), materialise(e, "edges")  # every round reads them
    reached, popped, tables = materialise(start, "frontier"), None, []
    tables.append(reached)
    goals = n.where("_goal").select("node")
    for step in range(iterations):
        left = reached
        if popped is not None:
            left = left.join(popped.select("case", "node").hint("merge"), ["case", "node"], "left_anti").join(popped.where("_goal").select("case").hint("merge"), "case", "left_anti")
        least = left.groupBy("case").agg(F.min(F.struct("f", "found", "node", "parent", "depth")).alias("m"))
        cur = least.select("case", "m.node", "m.parent", "m.depth", "m.f", F.lit(step).alias("step")).join(goals.withColumn("_goal", F.lit(True)).hint("merge"), "node", "left").withColumn("_goal", F.coalesce("_goal", F.lit(False)))
        cur = materialise(cur.select("case", "node", "parent", "depth", "f", "step", "_goal"), "popped")
        tables.append(cur)
        if not cur.limit(1).count():
            break
        popped = cur if popped is None else popped.unionByName(cur)
        grown = cur.where(~F.col("_goal") & (F.col("depth") < max_depth)).select("case", F.col("node").alias("src"), F.col("depth").alias("_d")).join(e.hint("merge"), "src")
        new = grown.select("case", F.col("dst").alias("node"), F.col("src").alias("parent"), (F.col("_d") + 1).alias("depth")).join(reached.select("case", "node").hint("merge"), ["case", "node"], "left_anti")
        tables.append(materialise(new.join(n.hint("merge"), "node").select("case", "node", "parent", "depth", "f", F.lit(step + 1).alias("found")), "frontier"))
        reached = reached.unionByName(tables[-1])
    out = materialise(tables[1].limit(0).drop("_goal") if popped is None else popped.drop("_goal"), "searches")
    release(*tables, n, e)
    return out


def path_to_root(tree: DataFrame, node: str, depth: int = 3) -> DataFrame:
    """(position, node) from a node up to the root of a (node, parent) table, at most depth + 1 steps."""
    return tree.sparkSession.sql(
        """WITH RECURSIVE up(position, node, parent) AS (
        SELECT 0, node, parent FROM {tree} WHERE node = :node
        UNION ALL SELECT position + 1, t.node, t.parent FROM up JOIN {tree} t ON t.node = up.parent WHERE position < :last)
        SELECT position, node FROM up""",
        args={"node": node, "last": depth + 1}, tree=tree,
    )


GENESIS = "0" * 64


def chain(entries: DataFrame, by: str, order: Sequence[str], body: Sequence[str], genesis: str | None = None) -> DataFrame:
    """entries with sequence, previous_hash and entry_hash = sha256 of the JSON body with the previous hash, chained within by.

    Rows are partitioned by `by` and sorted in their partition; one walk over
    Arrow batches carries only the last hash, so a chain of any length needs the
    memory of a batch. A chain is one task's work, as each hash needs the one before.
    """
    payload = F.to_json(F.struct(*sorted(body)), {"ignoreNullFields": "false"})
    rows = entries.withColumn("_body", payload).withColumn("sequence", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    names = rows.columns
    schema = T.StructType([*rows.schema.fields, T.StructField("previous_hash", T.StringType()), T.StructField("entry_hash", T.StringType())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prev = genesis
        for b in batches:
            before, own = [], []
            for body, place in zip(b.column("_body").to_pylist(), b.column("sequence").to_pylist()):
                prev = genesis if place == 1 else prev
                before.append(prev)
                prev = hashlib.sha256(f"{body}|{prev or ''}".encode()).hexdigest()
                own.append(prev)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(before, pa.string()), pa.array(own, pa.string())], names=[*names, "previous_hash", "entry_hash"])

    ordered = rows.repartition(by).sortWithinPartitions(by, "sequence")
    return ordered.mapInArrow(fold, schema).drop("_body")


def verify_chain(ledger: DataFrame, by: str) -> DataFrame:
    """(by, entries, broken): entries whose previous hash is not the hash of the entry before."""
    w = Window.partitionBy(by).orderBy("sequence")
    bad = ~F.col("previous_hash").eqNullSafe(F.lag("entry_hash").over(w)) & (F.col("sequence") > 1)
    return ledger.withColumn("_b", bad).groupBy(by).agg(F.count("*").alias("entries"), F.count_if("_b").alias("broken"))


def overall_status(modules: DataFrame, by: str) -> DataFrame:
    """(by, status): failed if no module completed, partial if one failed or timed out, else completed."""
    s = F.col("status")
    return modules.groupBy(by).agg(
        F.when(F.count_if(s == "completed") == 0, "failed").when(F.count_if(s.isin("failed", "timeout")) > 0, "partial").otherwise("completed").alias("status")
    )


def tolerant_best(candidates: DataFrame, by: str, order: str) -> DataFrame:
    """(by, key): a fold in input order; a later candidate wins by confidence, then by an hour or more of age, else by area and by f.

    The comparison is not transitive, so it cannot be an ORDER BY; a task holds the best of one
    search so far. A null number loses every comparison. candidates: by, order, key, conf, ts, area, f.
    """

    def better(r: tuple, best: tuple) -> bool:
        (_, conf, ts, area, f), (_, conf_, ts_, area_, f_) = (tuple(math.nan if x is None and k != 2 else x for k, x in enumerate(row)) for row in (r, best))
        if conf != conf_:
            return conf > conf_
        if ts is not None and ts_ is not None and abs((ts - ts_).total_seconds()) >= 3600:
            return ts < ts_
        return area > area_ or (area == area_ and f < f_)

    return folds.reduced(candidates, by, [order], ["key", "conf", "ts", "area", "f"], better, "key")


def two_key_dedup(df: DataFrame, by: str, order: str, keys: tuple[str, str]) -> DataFrame:
    """Rows whose first and second key were both not seen before in the group, in input order; empty keys never match. A task holds the keys taken in one group."""

    def start():
        seen = (set(), set())

        def step(*values) -> bool:
            used = [(s, v) for s, v in zip(seen, values) if isinstance(v, str) and v]
            new = not any(v in s for s, v in used)
            if new:
                for s, v in used:
                    s.add(v)
            return new

        return step

    return folds.filtered(df, by, [order], keys, start)
