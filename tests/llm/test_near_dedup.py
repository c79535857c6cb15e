import random

import numpy as np
import pytest

from tessera.llm import near_dedup as nd


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, percent=80):
    sets = [(i, shingles(t, k)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return sorted(((i, len(s), find(i) if i is not None else None, i is None or find(i) == i) for i, s in sets), key=str)


def test_hot_group_of_near_copies_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(nd, "SMALL", 2)
    monkeypatch.setattr(nd, "BLOCK", 16)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.choice([0, 1, 3, 5, 7, 8, 9, 12])):
            w[rng.randrange(80)] = f"x{rng.random()}"
        rows.append((rng.randrange(10**6), " ".join(w)))
    rows += [(7, None), (8, ""), (9, " \t"), (10, "one"), (11, "ONE"), (None, " ".join(base)), (12, "one two"), (12, "one two"), (13, "é É")]
    df = spark.createDataFrame([(i, t, "x", 5) for i, t in rows], "doc_id long, text string, component_id string, n_shingles int")
    got = sorted(map(tuple, nd.near_duplicates(df, 2).collect()), key=str)
    assert got == brute(rows, 2)
    kept = {r.doc_id for r in nd.keep_first(df, 2).collect()}
    assert kept == {x[0] for x in got if x[3]}


def test_documents_match_brute_force(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for k in (2, 5):
        assert sorted(map(tuple, nd.near_duplicates(docs, k).collect()), key=str) == brute(rows, k)


def test_empty_table(spark):
    assert nd.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sketch_merges_and_estimates():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 2**63, 400).astype(np.uint64) for _ in range(2))
    x, y, both = nd.setsketch([a, b, np.concatenate([a, b])], 200)
    # registers count up as minima fall, so a union has the larger one
    assert (np.maximum(x, y) == both).all()
    one = nd.setsketch([a, np.concatenate([a[:380], b[:20]])], 200)
    assert abs((one[0] == one[1]).mean() - 380 / 420) < 0.1
    n = np.array([400.0])
    assert nd.keeps_candidate(one[:1], one[1:], n, n, 0.8)[0]
    assert not nd.keeps_candidate(x[None], y[None], n, n, 0.8)[0]


def test_bands_differ():
    k = nd.band_keys(np.full((1, 200), 7, np.uint16), 40, 5)
    assert len(set(k[0].tolist())) == 40
    with pytest.raises(ValueError):
        nd.band_keys(np.zeros((1, 10), np.uint16), 40, 5)
