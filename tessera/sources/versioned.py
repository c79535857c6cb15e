"""Tables whose writes appear whole or not at all: data files, and one manifest a version.

A write puts its files into a folder of its own; the version appears when its manifest (the list of all
files that form it) is renamed into `_commits` under the next number. Readers take the newest
manifest, so they see the old version or the new one; what a failed write leaves behind no
manifest names. A rename onto a number that is taken fails, so of two writers at once one is told.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tessera.session import _file_system

BUCKET = "_bucket"


def _list(spark: SparkSession, path: str) -> list[str]:
    """Paths below a folder, relative to it; none if it is not there."""
    fs, at = _file_system(spark, path)
    if not fs.exists(at):
        return []
    base, out = fs.makeQualified(at).toUri().getPath(), []
    files = fs.listFiles(at, True)
    while files.hasNext():
        out.append(files.next().getPath().toUri().getPath()[len(base) + 1 :])
    return sorted(out)


def versions(spark: SparkSession, root: str) -> list[int]:
    return [int(f.removesuffix(".json")) for f in _list(spark, f"{root}/_commits") if f.endswith(".json")]


def _manifest(spark: SparkSession, root: str, version: int | None) -> dict | None:
    there = versions(spark, root)
    if not there:
        return None
    fs, at = _file_system(spark, f"{root}/_commits/{max(there) if version is None else version:020d}.json")
    stream = fs.open(at)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def _commit(spark: SparkSession, root: str, manifest: dict) -> int:
    number = max(versions(spark, root), default=-1) + 1
    fs, staged = _file_system(spark, f"{root}/_staged/{uuid.uuid4().hex}.json")
    stream = fs.create(staged, False)
    try:
        stream.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
    finally:
        stream.close()
    _, to = _file_system(spark, f"{root}/_commits/{number:020d}.json")
    fs.mkdirs(to.getParent())
    if fs.exists(to) or not fs.rename(staged, to):
        raise FileExistsError(f"version {number} of {root} was written meanwhile")
    return number


def _written(df: DataFrame, root: str, kind: str, split: bool, options: dict) -> list[str]:
    """Files of df, in a folder of their own."""
    name = f"data/{uuid.uuid4().hex}"
    w = df.write.format(kind).options(**options)
    (w.partitionBy(BUCKET) if split else w).save(f"{root}/{name}")
    return [f"{name}/{f}" for f in _list(df.sparkSession, f"{root}/{name}") if not f.rpartition("/")[2].startswith(("_", "."))]


def checked(df: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """df with exactly these columns; a non-finite number makes the write fail."""
    if fields is not None:
        if set(df.columns) != set(fields):
            raise ValueError(f"columns differ from the schema: {sorted(set(df.columns) ^ set(fields))}")
        df = df.select(*fields)
    odd = [F.isnan(c) | (F.abs(F.col(c)) == float("inf")) for c, t in df.dtypes if t in ("double", "float")]
    if not odd:
        return df
    bad = odd[0]
    for o in odd[1:]:
        bad = bad | o
    first = next(c for c, t in df.dtypes if t in ("double", "float"))
    return df.withColumn(first, F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit("a number is not finite")).cast(df.schema[first].dataType)).otherwise(F.col(first)))


def write(df: DataFrame, root: str, kind: str = "parquet", fields: list[str] | None = None, append: bool = False, **options) -> int:
    """Writes df as the next version (with append, put to the files of the last) and returns its number. kind: parquet, json (keys in order, nulls kept) or csv; finite numbers only."""
    spark, df = df.sparkSession, checked(df, fields)
    if kind == "json":
        df, options = df.select(*sorted(df.columns)), {"ignoreNullFields": "false"} | options
    old = _manifest(spark, root, None) if append else None
    files = _written(df, root, kind, False, options)
    return _commit(spark, root, {"kind": kind, "options": options, "schema": json.loads(df.schema.json()), "files": (old["files"] if old else []) + files})


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The newest version, or the one of this number."""
    m = _manifest(spark, root, version)
    if m is None:
        raise FileNotFoundError(f"no version in {root}")
    schema = T.StructType.fromJson(m["schema"])
    if not m["files"]:
        return spark.createDataFrame([], schema)
    return spark.read.format(m["kind"]).options(**m["options"]).schema(schema).load([f"{root}/{f}" for f in m["files"]])


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def upsert(new: DataFrame, root: str, key: str, order: str, buckets: int = 64) -> int:
    """The next version: the last one's rows, with those of new in place of rows of the same key; of several new ones the last by order. Returns its number.

    Rows lie in buckets by a hash of the key, and only the files of buckets that new touches are read and
    written; the others go on into the new version as they are. new has the table's columns and
    order, which is not kept. Null keys are one key.
    """
    spark = new.sparkSession
    m = _manifest(spark, root, None)
    if m and m.get("buckets") != buckets:
        raise ValueError(f"{root} is not in {buckets} buckets")
    latest = new.groupBy(key).agg(F.max_by(F.struct(*[c for c in new.columns if c != order]), order).alias("_row")).select("_row.*").withColumn(BUCKET, _bucket(key, buckets))
    touched = {r[0] for r in latest.select(BUCKET).distinct().collect()}  # a number a bucket at most
    old = (m or {}).get("by_bucket", {})
    own = [f for b in touched for f in old.get(str(b), [])]
    schema = T.StructType([f for f in latest.schema if f.name != BUCKET])
    rows = latest
    if own:
        kept = spark.read.schema(schema).parquet(*[f"{root}/{f}" for f in own]).join(latest.select(F.col(key).alias("_key"), F.lit(True).alias("_new")), F.col(key).eqNullSafe(F.col("_key")), "left_anti")
        rows = kept.withColumn(BUCKET, _bucket(key, buckets)).unionByName(latest)
    written: dict[str, list[str]] = {}
    # rebalanced: small buckets share a task, and adaptive execution splits large ones
    for f in _written(rows.hint("rebalance", BUCKET), root, "parquet", True, {}):
        written.setdefault(f.split(f"{BUCKET}=")[1].split("/")[0], []).append(f)
    by = {b: fs for b, fs in old.items() if int(b) not in touched} | written
    return _commit(spark, root, {"kind": "parquet", "options": {}, "schema": json.loads(schema.json()), "buckets": buckets, "by_bucket": by, "files": [f for fs in by.values() for f in fs]})


def ordered_digest(df: DataFrame, order: list[str], row: Column | None = None, leaf: int = 1024) -> DataFrame:
    """One row (digest, n): a digest of the rows in their order, whatever their partitioning; order must be total.

    A Merkle tree over row numbers: `leaf` hashes of rows in a row are hashed to one of the next level, as often as it takes, so
    no task holds more than that many; the last hash and the number of rows are hashed once more. row: the
    text of a row, its JSON by default.
    """
    from tessera.operators.running import numbered

    row = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}) if row is None else row
    level = numbered(df.select(*order, F.sha2(row, 256).alias("h")), order, "_no").select((F.col("_no") - 1).alias("no"), "h")
    n = df.count()
    width = n
    while width > 1:
        level = level.groupBy(F.floor(F.col("no") / leaf).alias("no")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "h"))), lambda x: x["h"]), ""), 256).alias("h"))
        width = -(-width // leaf)
    # one row, or none
    return level.agg(F.sha2(F.concat_ws(":", F.coalesce(F.max("h"), F.lit("")), F.lit(n)), 256).alias("digest")).select("digest", F.lit(n).cast("long").alias("n"))
