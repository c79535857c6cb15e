"""Atomic versions, bucketed upserts, ordered digests and write-once ingest."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from tessera.sources import ingest as ing, versioned as vs


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("kind", ["parquet", "csv", "json"])
def test_versions(spark, tmp_path, kind):
    root, opt = f"{tmp_path}/t", {"header": "true"} if kind == "csv" else {}
    first = spark.createDataFrame([(1, "a, \"b\"", 1.5), (2, None, None)], "id long, s string, x double")
    assert vs.write(first, root, kind, ["id", "s", "x"], **opt) == 0
    more = spark.range(5000).select("id", F.lit("z").alias("s"), F.when(F.col("id") == 4999, F.lit(float("inf"))).otherwise(1.0).alias("x")).repartition(7)
    with pytest.raises(Exception, match="not finite"):
        vs.write(more, root, kind, **opt)
    assert vs.versions(spark, root) == [0] and rows(vs.read(spark, root)) == rows(first)
    with pytest.raises(ValueError, match="differ"):
        vs.write(first, root, kind, ["id", "s"], **opt)
    reader = vs.read(spark, root)  # of the old version
    assert vs.write(more.where("id < 3"), root, kind, **opt) == 1
    assert rows(reader) == rows(first) == rows(vs.read(spark, root, 0)) and vs.read(spark, root).count() == 3
    assert vs.write(first, root, kind, append=True, **opt) == 2
    assert vs.read(spark, root).count() == 5 and vs.versions(spark, root) == [0, 1, 2]
    assert vs.write(first.limit(0), root, kind, **opt) == 3 and vs.read(spark, root).count() == 0


def test_two_writers(spark, tmp_path, monkeypatch):
    root, df = f"{tmp_path}/t", spark.range(3)
    vs.write(df, root)
    own = vs.versions
    monkeypatch.setattr(vs, "versions", lambda s, r: own(s, r)[:-1])  # the other's commit came meanwhile
    with pytest.raises(FileExistsError):
        vs.write(df, root)
    monkeypatch.undo()
    assert vs.versions(spark, root) == [0] and vs.read(spark, root).count() == 3


def test_upsert_rewrites_touched_buckets_alone(spark, tmp_path):
    root = f"{tmp_path}/u"
    new = lambda *x: spark.createDataFrame([*x], "k string, v string, o long")
    vs.upsert(new(*[(f"k{i}", "a", 0) for i in range(200)], (None, "n", 0)), root, "k", "o", buckets=8)
    before = vs._manifest(spark, root, None)["by_bucket"]
    assert len(before) == 8
    vs.upsert(new(("k7", "first", 1), ("k7", "last", 5), ("k7", "middle", 3)), root, "k", "o", buckets=8)
    after = vs._manifest(spark, root, None)["by_bucket"]
    assert sum(before[b] != after[b] for b in before) == 1
    vs.upsert(new((None, "m", 0), ("new", "x", 0)), root, "k", "o", buckets=8)
    want = {f"k{i}": "a" for i in range(200)} | {"k7": "last", None: "m", "new": "x"}
    assert {r.k: r.v for r in vs.read(spark, root).collect()} == want and vs.read(spark, root).count() == 202
    assert vs.read(spark, root, 0).where("v = 'a'").count() == 200
    vs.upsert(new(), root, "k", "o", buckets=8)
    assert vs.read(spark, root).count() == 202
    with pytest.raises(ValueError, match="buckets"):
        vs.upsert(new(), root, "k", "o", buckets=4)


def plain_digest(texts, leaf):
    level = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
    while len(level) > 1:
        level = [hashlib.sha256("".join(level[i : i + leaf]).encode()).hexdigest() for i in range(0, len(level), leaf)]
    return hashlib.sha256(f"{level[0] if level else ''}:{len(texts)}".encode()).hexdigest()


@pytest.mark.parametrize("n", [0, 1, 4, 5, 333])
def test_digest_knows_the_order_alone(spark, n):
    df = spark.range(n).select("id", F.concat(F.lit("t"), (F.col("id") * 7 % 5).cast("string")).alias("t"))
    wanted = plain_digest([f"t{i * 7 % 5}" for i in range(n)], 4)
    for parts in (1, 4, 50):
        assert tuple(vs.ordered_digest(df.repartition(parts), ["id"], F.col("t"), leaf=4).first()) == (wanted, n)
    if n > 4:
        swapped = df.withColumn("id", F.when(F.col("id") == 0, 1).when(F.col("id") == 1, 0).otherwise(F.col("id")))
        assert vs.ordered_digest(swapped, ["id"], F.col("t"), leaf=4).first().digest != wanted


def webp(n):
    return b"RIFF0000WEBP" + bytes([n]) * 50


def test_ingest(spark, tmp_path, monkeypatch):
    files, root = tmp_path / "in", f"{tmp_path}/out"

    def put(name, data):
        (files / name).parent.mkdir(parents=True, exist_ok=True)
        (files / name).write_bytes(data)

    put("a/one.webp", webp(1))
    put("a/same.webp", webp(1))
    put("two.webp", webp(2))
    put("wrong.png", webp(3))
    put("empty.webp", b"")
    put("large.webp", webp(4) * 100)
    run = lambda: {os.path.basename(r.path): (r.status, r.batch) for r in ing.ingest(spark, str(files), root, most_bytes=1000).collect()}
    assert run() == {"one.webp": ("stored", 0), "same.webp": ("known", 0), "two.webp": ("stored", 0), "wrong.png": ("unsupported", 0), "large.webp": ("too large", 0)}
    assert run() == {}
    # a repeated content under a new name, a changed file, and a new one
    put("again.webp", webp(2))
    put("two.webp", webp(5) + b"changed")
    put("three.webp", webp(6))
    assert run() == {"again.webp": ("known", 2), "two.webp": ("stored", 2), "three.webp": ("stored", 2)}
    # a call that fails between its two commits is repeated
    put("four.webp", webp(7))
    own = vs.write
    monkeypatch.setattr(vs, "write", lambda df, at, **k: own(df, at, **k) if "contents" in at else (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        run()
    monkeypatch.undo()
    assert run() == {"four.webp": ("known", 3)}
    contents = vs.read(spark, f"{root}/contents").collect()
    assert len(contents) == 5 == len({r.sha256 for r in contents})
    assert all(hashlib.sha256(r.content).hexdigest() == r.sha256 for r in contents)
