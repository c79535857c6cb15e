"""Stateful streams over several triggers, with a restart between them, against plain folds."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.streaming import events as st, ordered

SCHEMA = "k string, ts timestamp, no long, url string, pair string"


@pytest.fixture(scope="module")
def rows():
    """A hot key, times out of order by up to 50 seconds."""
    rng = random.Random(9)
    return [(rng.choice("hhhab"), 1000 + i * 10 + rng.randrange(-50, 50), i, rng.choice([None, "", *"uvwxyz"]) and f"u{rng.randrange(40)}", rng.choice([None, f"d:{rng.randrange(25)}"])) for i in range(300)]


def fed(spark, folder, rows):
    d = spark.createDataFrame(rows, "k string, s long, no long, url string, pair string")
    d.select("k", F.col("s").cast("timestamp").alias("ts"), "no", "url", "pair").coalesce(1).write.mode("append").parquet(folder)


def run(spark, tmp_path, make, rows, cuts=(100, 220)):
    """make(stream) over the rows, fed in stretches with a run and a restart after each; then a late row closes the rest."""
    at = f"{tmp_path}/in"
    parts = [rows[a:b] for a, b in zip((0, *cuts), (*cuts, len(rows)))]
    for own in [*parts, [("end", 10**6, -1, None, None)], [("end", 10**6 + 1, -2, None, None)]]:
        fed(spark, at, own)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(at)
        st.run_available(make(stream), f"{tmp_path}/out", f"{tmp_path}/state")
    return sorted(r.order for r in spark.read.parquet(f"{tmp_path}/out").collect() if r.order >= 0)


def in_order(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out.values()


def plain_closed_set(rows):
    kept = []
    for own in in_order(rows):
        urls, pairs = set(), set()
        for _, _, no, url, pair in own:
            if not (url and url in urls or pair and pair in pairs):
                kept.append(no)
                urls.add(url)
                pairs.add(pair)
    return sorted(kept)


def test_closed_set(spark, tmp_path, rows):
    got = run(spark, tmp_path, lambda s: ordered.closed_set(s, "k", "ts", "no", F.col("url"), F.col("pair"), "200 seconds"), rows)
    assert got == plain_closed_set(rows) and 20 < len(got) < 200


def test_closed_set_forgets(spark, tmp_path):
    """The key's last row is at 40; the set goes once the watermark is 100 seconds beyond, which a row at 500 sees."""
    rows = [("a", 10, 0, "u", "p"), ("a", 40, 1, "u", "q"), ("b", 300, 2, "x", None), ("b", 302, 3, "x", "y"), ("a", 500, 4, "u", "p"), ("a", 501, 5, "w", "p")]
    make = lambda idle: lambda s: ordered.closed_set(s, "k", "ts", "no", F.col("url"), F.col("pair"), "1 seconds", idle)
    assert run(spark, tmp_path / "idle", make(100), rows, cuts=(2, 3, 4)) == [0, 2, 4]
    assert run(spark, tmp_path / "kept", make(None), rows, cuts=(2, 3, 4)) == [0, 2]


def test_tick_sampler(spark, tmp_path, rows):
    got = run(spark, tmp_path, lambda s: ordered.tick_sampler(s, "k", "ts", "no", 1_100_000_000, 60_000_000, "200 seconds"), rows)
    wanted = []
    for own in in_order(rows):
        n = 0
        for _, s, no, _, _ in own:
            if s >= 1100 + 60 * n:
                wanted.append(no)
                n += 1
    assert got == sorted(wanted)


def test_triggers_do_not_grow_with_files(spark, tmp_path):
    """Twenty files a stretch are read in about a trigger a stretch, not four files a trigger."""
    from pyspark.sql import functions as F

    from tessera.plans import stream_plans
    from tessera.streaming import events

    e = spark.range(400).select(F.col("id").alias("event_id"), (F.col("id") % 7).alias("user_id"), F.timestamp_seconds(F.col("id") * 977 % 400 * 60).alias("ts"), F.lit("a").alias("event_type"), F.lit(1.0).alias("value"))
    e.repartition(20).write.parquet(f"{tmp_path}/events.parquet")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", before)
    try:
        stream = stream_plans._stream(spark, str(tmp_path))[0]
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    events.run_available(stream, f"{tmp_path}/out", f"{tmp_path}/state")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 401
    assert len([p for p in (tmp_path / "state" / "commits").iterdir() if p.name.isdigit()]) <= 6


def test_keys_share_states(spark, tmp_path):
    """3,000 keys, null among them: a bucket has one list of waiting rows, one memory and one timer, whatever its keys and rows."""
    rng = random.Random(4)
    rows = [(f"k{k}" if k else None, 1000 + rng.randrange(500), 3 * k + i, rng.choice([None, "", "u", "v"]), rng.choice([None, "p", "q"])) for k in range(3000) for i in range(3)]
    at = f"{tmp_path}/in"
    fed(spark, at, rows[:6000])
    fed(spark, at, rows[6000:])
    fed(spark, at, [("end", 10**6, -1, None, None)])
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(at)
    found = ordered.closed_set(stream, "k", "ts", "no", F.col("url"), F.col("pair"), "600 seconds")
    q = found.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.order for r in spark.read.parquet(f"{tmp_path}/out").collect() if r.order >= 0) == plain_closed_set(rows)
    # a bucket has a row for each of two inputs, its memory and the next time to wake
    assert max(o.numRowsTotal for p in q.recentProgress for o in p.stateOperators) <= 4 * 1024


def test_keys_of_a_bucket_stay_apart(spark, tmp_path, rows):
    """All keys in one bucket; a key is forgotten alone."""
    got = run(spark, tmp_path / "set", lambda s: ordered.closed_set(s, "k", "ts", "no", F.col("url"), F.col("pair"), "200 seconds", buckets=1), rows)
    assert got == plain_closed_set(rows)
    few = [("a", 10, 0, "u", "p"), ("a", 40, 1, "u", "q"), ("b", 90, 2, "u", "p"), ("c", 160, 3, None, None), ("b", 170, 4, "u", None), ("a", 180, 5, "u", None)]
    make = lambda s: ordered.closed_set(s, "k", "ts", "no", F.col("url"), F.col("pair"), "1 seconds", 100, buckets=1)
    assert run(spark, tmp_path / "idle", make, few, cuts=(3, 4, 5)) == [0, 2, 3, 5]


class Handle:
    """States and timers in memory, of one bucket."""

    class State(list):
        def get(self):
            return iter(self)

        def appendValue(self, row):
            self.append(row)

    class Value:
        row = None

        def get(self):
            return self.row

        def update(self, row):
            self.row = row

        def clear(self):
            self.row = None

    def __init__(self):
        self.lists, self.timers = {}, []
        self.deleteTimer, self.registerTimer = self.timers.remove, self.timers.append

    def getListState(self, name, schema):
        return self.lists.setdefault(name, self.State())

    def getValueState(self, name, schema):
        return self.Value()


def test_entries_are_written_anew(rows, monkeypatch):
    """Entries of at most forty rows; memory's entries, one a visit or more, become few again, and there is one timer."""
    import pandas as pd

    monkeypatch.setattr(ordered, "ENTRY", 40)
    monkeypatch.setattr(ordered, "ENTRIES", 4)
    at, handle = ordered._ClosedSet(None), Handle()
    at.init(handle)
    got, sizes = [], []
    for n in range(0, 310, 10):
        own = [(k, s * 10**6, no, url, pair) for k, s, no, url, pair in rows[n : n + 10]]
        if own:
            list(at.handleInputRows(None, iter([pd.DataFrame(own[:5], columns=[*"kutvw"]), pd.DataFrame(own[5:], columns=[*"kutvw"])]), None))
        now = (1000 + n * 10 - 60) * 1000 if own else 10**9
        clock = type("Clock", (), {"getCurrentWatermarkInMs": lambda self: now})()
        for t in [t for t in handle.timers if t <= now]:
            for out in at.handleExpiredTimer(None, clock, None):
                got += out["o"].tolist()
            handle.timers.remove(t)
        assert len(handle.timers) <= 1 and len(handle.lists["waiting"]) <= 6
        sizes.append(len(handle.lists["memory"]))
    assert sorted(got) == plain_closed_set(rows) and not handle.timers and not handle.lists["waiting"]
    assert 4 <= max(sizes) < 12 and any(b < a for a, b in zip(sizes, sizes[1:])), sizes
