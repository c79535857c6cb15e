"""Scans and interval joins on hot keys, and redaction of nested payloads, against plain versions."""

import json
import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tessera.functions import payloads
from tessera.operators import attribution, intervals, running, scans, series


@pytest.fixture(scope="module")
def hot(spark):
    """One key with more than a third of the rows, some small ones and a null one; equal times, ordered by no."""
    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", "hot", None, *"abcd"]), float(rng.randrange(200)), i, rng.choice([None, 1.0, 2.0, -3.0])) for i in range(1500)]
    return rows, spark.createDataFrame(rows, "k string, t double, no long, v double")


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


def parted(spark, n):
    spark.conf.set("spark.sql.shuffle.partitions", n)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", n == 1)


@pytest.fixture(params=[1, 13])
def dealt_over(spark, request):
    parted(spark, request.param)
    yield request.param
    parted(spark, 4)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_scan_kinds(spark, hot, dealt_over):
    rows, df = hot
    kinds = {"s": "sum", "lo": "min", "lo_before": "min_before", "hi": "max", "seen": "last", "seen_before": "last_before", "b": "lag"}
    d = scans.dealt(df, ["k"], ["t", "no"])
    if dealt_over > 1:
        assert d.where("k = 'hot'").select("_part").distinct().count() >= 4  # the hot key is in many tasks
    got = {r.no: tuple(r)[5:] for r in scans.scan(d, ["k"], ["t", "no"], {n: (kind, "v") for n, kind in kinds.items()}).select("k", "t", "no", "v", "_part", *kinds).collect()}
    none = lambda f, v: f(v) if v else None
    for own in by_key(rows).values():
        for i, r in enumerate(own):
            upto, before = [x[3] for x in own[: i + 1] if x[3] is not None], [x[3] for x in own[:i] if x[3] is not None]
            assert got[r[2]] == (sum(upto), none(min, upto), none(min, before), none(max, upto), upto[-1] if upto else None, before[-1] if before else None, own[i - 1][3] if i else None)


def test_series_of_hot_keys(spark, hot, dealt_over):
    rows, df = hot
    runs = {r.no: (r.run, r.pos, r.run_pos) for r in series.gap_runs(df, ["k"], "t", 0.0, "no").collect()}
    taken = {r.no for r in attribution.tick_sampler(df, ["k"], "t", 0.1, "no").collect()}
    speed = {r.no: r.velocity for r in series.velocity(df, ["k"], "t", "v", "no").collect()}
    kept = {r.no for r in series.collapse_repeats(df, ["k"], ["t", "no"], "v").collect()}
    for own in by_key(rows).values():
        run = run_pos = -1
        tick, last, seen = 0, None, None
        for pos, (_, t, no, v) in enumerate(own):
            run, run_pos = (run + 1, 0) if not pos or t > own[pos - 1][1] else (run, run_pos + 1)
            assert runs[no] == (run, pos, run_pos)
            assert (no in taken) == (t + 1e-9 >= tick * 10)
            tick += no in taken
            assert (no in kept) == (v is not None and (not pos or own[pos - 1][3] is None or own[pos - 1][3] != v) or v is None and (not pos or own[pos - 1][3] is None))
            if v is not None:
                assert speed[no] == pytest.approx((v - last[1]) / (t - last[0]) if last and t > last[0] else 0)
                last = (t, v)


def test_quantiles_of_hot_keys(spark, hot, dealt_over):
    import numpy as np

    rows, df = hot
    for q in (0.0, 0.35, 0.9, 1.0):
        got = {r.k: r.x for r in running.group_quantile(df, ["k"], "t", q, "x").collect()}
        assert got == {k: pytest.approx(np.quantile([r[1] for r in own], q)) for k, own in by_key(rows).items()}
    cv = {r.k: r for r in series.intervals_cv(df, ["k"], "t", "no").collect()}
    for k, own in by_key(rows).items():
        d = np.diff([r[1] for r in own])
        assert (cv[k].n, cv[k].cv, cv[k].ratio90) == (len(d), pytest.approx(d.std() / d.mean()), pytest.approx(np.quantile(d, 0.9) / d.mean()))
    assert running.group_quantile(df.limit(0), ["k"], "t", 0.5, "x").count() == 0


def test_asof_of_hot_keys(spark, hot, dealt_over):
    rows, df = hot
    left, right = df.where("no % 2 = 0"), df.where("no % 2 = 1").withColumnRenamed("v", "w")
    got = {r.no: r.w for r in attribution.asof_join(left, right, ["k"], "t", "no", "w").collect()}
    for k, own in by_key(rows).items():
        for _, t, no, _ in own:
            if no % 2 == 0:
                seen = [r[3] for r in own if r[2] % 2 and r[1] <= t and r[3] is not None]
                assert got[no] == (seen[-1] if seen else None)


def test_windows_of_any_length(spark):
    """0.1 to 1,000 seconds, a hot sample, empty and backward windows."""
    rng = random.Random(6)
    points = [(rng.choice("hhhhab"), rng.uniform(-50, 1500), float(i)) for i in range(600)] + [("h", 5.0, 1e9), ("h", None, 7.0)]
    windows = [(rng.choice("hhab"), s := rng.uniform(-60, 900), s + 10 ** rng.uniform(-1, 3)) for _ in range(150)] + [("h", 5.0, 5.0), ("h", 9.0, 5.0), ("a", None, 5.0), ("a", 5.0, 5.1), ("h", 0.0, 4096.0)]
    w, p = spark.createDataFrame(windows, "k string, start_sec double, end_sec double"), spark.createDataFrame(points, "k string, ts double, value double")
    plain = sorted((k, s, e, v) for k, s, e in windows if s is not None for q, t, v in points if t is not None and k == q and s <= t < e)
    for cell in (0.1, 1.0, 300.0):
        assert sorted(map(tuple, intervals.interval_join(w, p, "k", cell=cell).select("k", "start_sec", "end_sec", "value").collect())) == plain
    got = {(r.k, r.start_sec, r.end_sec): (r.n, r["mean"], r.motion) for r in series.interval_align(w, p, "k", 0.1).collect()}
    for k, s, e in set(windows) - {("a", None, 5.0)}:
        inside = [v for t, v in sorted((t, v) for q, t, v in points if q == k and t is not None and s <= t < e)]
        if len(inside) < 2:
            assert (k, s, e) not in got
        else:
            assert got[k, s, e] == (len(inside), pytest.approx(sum(inside) / len(inside)), pytest.approx(sum(abs(a - b) for a, b in zip(inside[1:], inside)) / (len(inside) - 1)))


def test_few_blocks_a_window(spark):
    w = spark.createDataFrame([(0.0, 0.1), (3.0, 1003.0), (0.0, 2.0**40)], "a double, b double")
    assert [r.n for r in w.select(F.size(intervals._blocks(F.col("a"), F.col("b"), 1.0)).alias("n")).collect()] == [1, 15, 1]


def test_wide_windows_are_not_lost(spark):
    w, f = spark.createDataFrame([("x", 0.0, 5.0)], "k string, start_sec double, end_sec double"), spark.createDataFrame([("x", float(i), 1.0) for i in range(5)], "k string, ts double, value double")
    assert series.interval_align(w, f, "k", 1.0).first().n == 5


# --- payloads


def run(spark, column, text, digest="d1"):
    return spark.createDataFrame([(text, digest)], "p string, s string").select(column.alias("x")).first().x


def test_public_payload(spark):
    public = lambda text, digest="d1": run(spark, payloads.public_payload(F.col("p"), F.col("s"), {"/out/a.png": "/api/a"}), text, digest)
    got = public(r'{"note":"see \"file:///x\" here","media_path":"/a\"b/c.mp4"}')
    assert got == r'{"note":"see \"REDACTED_INTERNAL_PATH\" here","media_path":"evidence://sha256/d1"}'
    assert json.loads(public(json.dumps({"log_paths": [["/a/b", "rel", 3, None], {"deep": "/kept"}], "a": {"IMAGE_folder": "runs/1", "cacheDirectory": "data/x"}, "u": "file:///q\\\"r", "plots": ["/out/a.png", "file:///out/a.png"]}))) == {
        "log_paths": [["REDACTED_INTERNAL_PATH", "rel", 3, None], {"deep": "/kept"}], "a": {"IMAGE_folder": "evidence://sha256/d1", "cacheDirectory": "REDACTED_INTERNAL_PATH"}, "u": "REDACTED_INTERNAL_PATH", "plots": ["/api/a", "/api/a"]}
    assert public('{ "n" : 1.50, "n": 1e5, "é": "\\u00e9" }') == '{ "n" : 1.50, "n": 1e5, "é": "\\u00e9" }'  # nothing else moves
    assert public('{"path": "\\u002fetc\\u002fx"}', None) == '{"path": "REDACTED_INTERNAL_PATH"}'  # escaped slashes are read
    for odd in (None, "", "{", '{"path": "/x"', "[1,]", '{"path" "/x"}', "[" * 100_000 + "]" * 100_000):
        assert public(odd) is None
    assert public('"file:///x"') == '"REDACTED_INTERNAL_PATH"' and public("3") == "3"


def test_redacted_payload(spark):
    redacted = lambda text: run(spark, payloads.redacted_payload(F.col("p"), ["key", "key-long", "", 'q"t']), text)
    assert json.loads(redacted(json.dumps({"a key-long b": [["x key", {"key": 'a q"t'}]], "n": 5}))) == {"a [REDACTED] b": [["x [REDACTED]", {"[REDACTED]": "a [REDACTED]"}]], "n": 5}
    assert redacted('{"a": "k\\u0065y"}') == '{"a": "[REDACTED]"}' and redacted("{key}") is None


LEAVES = st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text()
TREES = st.recursive(LEAVES, lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=6) | st.sampled_from(["path", "folder"]), x, max_size=4), max_leaves=20)


@settings(max_examples=150, deadline=None)
@given(TREES)
def test_walk_equals_recursion(tree):
    def walk(x, key=""):
        if isinstance(x, dict):
            return {k: walk(v, k) for k, v in x.items()}
        return [walk(v, key) for v in x] if isinstance(x, list) else f"<{key}>" + x if isinstance(x, str) else x

    for ascii_ in (True, False):
        assert json.loads(payloads.rewritten(json.dumps(tree, ensure_ascii=ascii_), lambda k, s: f"<{k}>" + s)) == walk(tree)


def test_payload_queries_bound_their_batches(spark, tmp_path):
    """10,000 whole texts a batch stood several times over in a Python worker."""
    from tessera.plans import registry

    spark.createDataFrame([(1, "the nation")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "10000")
    try:
        assert registry.queries()["function_redacted_payload"](spark, str(tmp_path)).first()["key"] == "o[REDACTED]r"
        assert int(spark.conf.get(key)) <= 500
    finally:
        spark.conf.set(key, before)
