"""Searches of many cases against one search each, and the weighted bootstrap against plain sums."""

import hashlib
import heapq
import math
import random

import numpy as np
import pytest

from tessera.operators import lineage, metrics


def plain_search(f, edges, root, iterations, max_depth, goals):
    heap, reached, out = [(0.0, 0, root, None, 0)], {root}, []
    for step in range(iterations):
        if not heap:
            break
        cost, _, node, parent, depth = heapq.heappop(heap)
        out.append((node, parent, depth, cost, step))
        if node in goals:
            break
        if depth < max_depth:
            for dst in set(edges.get(node, ())) - reached:
                if dst in f:
                    reached.add(dst)
                    heapq.heappush(heap, (f[dst], step + 1, dst, node, depth + 1))
    return out


def test_cases_at_once(spark):
    """A thousand roots over a graph with a hub, cycles, unknown nodes and goals."""
    rng = random.Random(3)
    f = {f"n{i}": float(rng.randrange(40)) for i in range(400)}
    edges = {}
    for _ in range(1500):
        edges.setdefault(f"n{min(rng.randrange(400), rng.randrange(400))}", []).append(f"n{rng.randrange(405)}")
    edges["n0"] = [f"n{i}" for i in range(300)]
    goals = {f"n{i}" for i in range(100, 120)}
    roots = [(i, f"n{i % 399}") for i in range(1000)] + [(2000, "nowhere"), (5, "n5")]
    nodes = spark.createDataFrame(list(f.items()), "node string, f double")
    pairs = spark.createDataFrame([(a, b) for a, bs in edges.items() for b in bs], "src string, dst string")
    goal = f"node in ({', '.join(map(repr, sorted(goals)))})"
    got = {}
    for r in lineage.best_first_many(nodes, pairs, spark.createDataFrame(roots, "case long, node string"), 6, 3, goal).collect():
        got.setdefault(r.case, []).append(tuple(r)[1:])
    for case, root in roots:
        assert sorted(got[case], key=lambda r: r[4]) == plain_search(f, edges, root, 6, 3, goals)
    one = lineage.best_first(nodes, pairs, "n7", 6, 3, goal).collect()
    assert sorted(got[7], key=lambda r: r[4]) == [tuple(r) for r in one]
    assert lineage.best_first_many(nodes, pairs, spark.createDataFrame([], "case long, node string")).count() == 0


def test_weighted_bootstrap(spark):
    rng = random.Random(1)
    rows = [(i, rng.gauss(3, 1)) for i in range(150)] + [(None, 1e9), (200, None)]
    keys = np.array([int.from_bytes(hashlib.sha256(f"42:{i}".encode()).digest()[:8], "big") for i in range(150)], np.uint64)
    w = metrics.poisson_weights(keys, 500)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.05 and w.min() == 0 and w.max() < 12
    m = (np.array([v for _, v in rows[:150]]) @ w) / w.sum(0)
    df = spark.createDataFrame(rows, "c long, v double")
    for parts in (1, 9):
        got = metrics.weighted_bootstrap(df.repartition(parts), "c", "v", reps=500).first()
        assert got.n_clusters == 150 and (got.low, got.mid, got.high) == pytest.approx(tuple(np.quantile(m, [0.025, 0.5, 0.975])))
    plain = metrics.clustered_bootstrap(df.where("c is not null and v is not null"), "c", "v", reps=500).first()
    assert got.mid == pytest.approx(plain.mid, abs=0.05) and got.high - got.low == pytest.approx(plain.high - plain.low, rel=0.25)
    none = metrics.weighted_bootstrap(df.limit(0), "c", "v", reps=10).first()
    assert none.n_clusters == 0 and none.mid is None and math.isclose(metrics.POISSON[-1], 1.0)


def test_rounds_broadcast_nothing(spark, monkeypatch):
    """Nodes, edges and what was reached grow with the cases; broadcast, they went through the driver in each round."""
    from tessera.operators import lineage

    plans, write = [], lineage.materialise
    monkeypatch.setattr(lineage, "materialise", lambda d, *a: (plans.append(d._jdf.queryExecution().executedPlan().toString()), write(d, *a))[1])
    nodes = spark.createDataFrame([(str(i), float(i)) for i in range(12)], "node string, f double")
    edges = spark.createDataFrame([(str(i // 3), str(i)) for i in range(1, 12)], "src string, dst string")
    found = lineage.best_first_many(nodes, edges, spark.createDataFrame([(1, "0"), (2, "1")], "case long, node string"), iterations=3)
    assert sorted((r.case, r.step, r.node) for r in found.collect()) == [(1, 0, "0"), (1, 1, "1"), (1, 2, "2"), (2, 0, "1"), (2, 1, "3"), (2, 2, "4")]
    assert len(plans) > 6 and not any("Broadcast" in p for p in plans)
