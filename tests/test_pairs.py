"""Hamming pairs and blocked products against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import pairs, vectors


@pytest.fixture(scope="module")
def hashes():
    """Families of near hashes, a hash that a third of all rows share, far ones, malformed ones."""
    rng = random.Random(1)
    out, base = [], [rng.getrandbits(256) for _ in range(12)]
    for i in range(260):
        flips = rng.sample(range(256), rng.randrange(0, 62))
        out.append((i, f"{base[i % 12] ^ sum(1 << b for b in flips):064x}"))
    out += [(1000 + i, f"{base[0]:064X}") for i in range(140)]
    # all differences inside one band, and spread one a band
    out += [(2000, f"{0:064x}"), (2001, f"{(1 << 16) - 1:064x}"), (2002, f"{sum(1 << 16 * k for k in range(16)):064x}"), (2003, f"{sum(3 << 16 * k for k in range(16)):064x}")]
    return out + [(3000, None), (3001, "xyz"), (3002, "0" * 63), (None, f"{5:064x}")]


@pytest.mark.parametrize(("radius", "bands"), [(0, 16), (7, 16), (30, 16), (42, 16), (55, 16), (30, 32), (20, 8)])
def test_pairs_within_a_radius(spark, hashes, radius, bands):
    classes, members = pairs.hash_classes(spark.createDataFrame(hashes, "id long, h string").repartition(5), "id", "h")
    found = pairs.hamming_pairs(classes, radius, bands)
    by = {}
    for i, h in hashes:
        if i is not None and h and len(h) == 64:
            by.setdefault(int(h, 16), []).append(i)
    own = sorted((min(ids), h, len(ids)) for h, ids in by.items())
    wanted = [(a, b, (g ^ h).bit_count(), n, m) for k, (a, g, n) in enumerate(own) for b, h, m in own[k + 1 :] if (g ^ h).bit_count() <= radius]
    assert sorted(map(tuple, found.collect())) == wanted and (wanted or radius == 0)
    assert sorted(map(tuple, members.collect())) == sorted((i, min(ids)) for ids in by.values() for i in ids)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.fixture(scope="module")
def store(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).round(2).tolist(), int(rng.integers(4))) for i in range(120)]
    rows += [(200 + i, rows[3][1], 9) for i in range(60)] + [(300, [0.0] * 6, 1), (301, [1.0, 2.0], 2), (302, None, 1), (None, [1.0] * 6, 1), (303, [-x for x in rows[3][1]], 7), (304, [], 7), (305, [5.0] * 6, None)]
    return spark.createDataFrame(rows, "id long, v array<double>, g long").repartition(3)


def plain_best(rows, k):
    for q in rows:
        s = []
        for r in rows:
            a, b = np.array(q[1]), np.array(r[1])
            c = 0.5 if len(a) != len(b) else float(np.clip(a @ b / ((np.linalg.norm(a) or 1) * (np.linalg.norm(b) or 1)), 0, 1))
            s.append((-(np.floor(c * 1000 + 0.5) / 1000), r[0], r[2]))
        yield q[0], sorted(s, key=lambda x: x[:2])


@pytest.mark.parametrize("block", [16, 64, 4096])
def test_top_cosine(spark, store, block, monkeypatch):
    """As many queries as rows, ties of sixty copies, in one block or many."""
    monkeypatch.setattr(pairs.top_cosine, "__defaults__", (None, block))
    got, grouped = {}, {}
    for r in vectors.nearest(store, store, "id", "v", 5).collect():
        got.setdefault(r.query, []).append((r.rank, r.id, r.similarity))
    s = pairs.top_cosine(store, store, "id", "v", 4, group="g")
    for r in vectors.diverse_top(s, "query", "g", "similarity", "id", 4).collect():
        grouped.setdefault(r.query, set()).add(r.id)
    rows = [tuple(r) for r in store.collect() if r.id is not None and r.v is not None]
    assert len(got) == len(rows)
    for q, s in plain_best(rows, 5):
        assert sorted(got[q]) == [(i + 1, key, pytest.approx(-c)) for i, (c, key, _) in enumerate(s[:5])]
        firsts = [x for i, x in enumerate(s) if all(y[2] != x[2] for y in s[:i])]
        assert grouped[q] == {x[1] for x in (firsts + [x for x in s if x not in firsts])[:4]}


def test_correlations(spark, store):
    got = {(r.query, r.id): r.r for r in pairs.correlations(store, store, "id", "v", block=50).collect()}
    rows = [tuple(r) for r in store.collect() if r.id is not None and r.v is not None]
    same = [(a, b) for a in rows for b in rows if len(a[1]) == len(b[1])]
    assert len(got) == len(same)
    for a, b in same:
        flat = len(a[1]) < 2 or np.std(a[1]) == 0 or np.std(b[1]) == 0
        assert got[a[0], b[0]] == pytest.approx(0 if flat else np.corrcoef(a[1], b[1])[0, 1], abs=1e-9)


def test_blocks_are_bounded(spark):
    df = spark.range(1000).select("id", F.array(F.col("id").cast("double")).alias("v"))
    import pyarrow as pa

    sizes = pairs.against_all(df, df, "id", lambda a, b: pa.table({"q": [a.num_rows], "r": [b.num_rows]}), "q long, r long", block=100).collect()
    assert len(sizes) == 100 and max(max(s.q, s.r) for s in sizes) < 150 and sum(s.q * s.r for s in sizes) == 10**6


def test_files_of_correlations_hold_little_but_the_figure(spark, tmp_path):
    """A row for every query and vector: their keys took more than a byte a row beside the figure's eight."""
    import pyarrow.parquet as pq

    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(8 if i % 97 else 5).tolist()) for i in range(1907)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    pairs.correlations(df.where("id % 19 = 0"), df, "id", "v").coalesce(1).write.parquet(f"{tmp_path}/r")
    groups = [m.row_group(g) for f in tmp_path.glob("r/*.parquet") for m in [pq.ParquetFile(f).metadata] for g in range(m.num_row_groups)]
    keys = sum(g.column(c).total_compressed_size for g in groups for c in (0, 1))
    got = {(r.query, r.id): r.r for r in spark.read.parquet(f"{tmp_path}/r").collect()}
    assert sorted(got) == [(q, i) for q, a in rows if q % 19 == 0 for i, b in rows if len(a) == len(b)]
    assert keys < 0.25 * len(got), keys / len(got)
    vector = dict(rows)
    assert all(abs(got[k] - np.corrcoef(vector[k[0]], vector[k[1]])[0, 1]) < 1e-9 for k in list(got)[::500])


def test_hamming_sides_are_never_broadcast(spark, hashes):
    """A side is many times its table, which the optimiser's estimate does not see: 1.5 GB were broadcast for 120,000 hashes."""
    classes, _ = pairs.hash_classes(spark.createDataFrame(hashes, "id long, h string"), "id", "h")
    found = pairs.hamming_pairs(classes, 22)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    # a pair that agrees in fifteen bands is one row
    assert found.count() == found.select("left", "right").distinct().count() > 0
