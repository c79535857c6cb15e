"""Reading manifests, records and media files with stated schemas."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from tessera.functions.ids import finite, fraction, media_type, path_identity, sample_id
from tessera.functions.labels import folder_platform, folder_split
from tessera.functions.urls import meaningful_filename
from tessera.operators.protocol import require


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A typed CSV with a header; the schema is stated, never inferred."""
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)


def read_text_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV whose columns all stay text."""
    return spark.read.option("header", True).option("inferSchema", False).option("escape", '"').csv(path)


def read_manifest(spark: SparkSession, path: str, required: Sequence[str], unique: str = "sample_id", split: str | None = None) -> DataFrame:
    """A text CSV with the required columns, unique ids and, if asked for, one split only."""
    df = require(read_text_csv(spark, path), required, unique)
    if split is not None and df.where(~F.col("split").eqNullSafe(F.lit(split))).limit(1).count():
        raise ValueError(f"rows outside split {split}")
    return df


def aliased(df: DataFrame, names: dict[str, Sequence[str]]) -> DataFrame:
    """One column a name: the first of its aliases that is present and not empty in the row; null if none is."""
    def pick(aliases: Sequence[str]):
        found = [F.nullif(F.trim(F.col(a).cast("string")), F.lit("")) for a in aliases if a in df.columns]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    return df.select(*[pick(a).alias(n) for n, a in names.items()])


def read_json_array(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One record a line; blank lines are skipped, malformed ones are rows of nulls."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def bucketed_by_type(df: DataFrame, column: str, known: Sequence[str], fallback: str = "real") -> DataFrame:
    """df with bucket: the type in lower case if known, else the fallback."""
    t = F.lower(F.trim(F.col(column)))
    return df.withColumn("bucket", F.when(t.isin(*known), t).otherwise(fallback))


def media_files(spark: SparkSession, root: str, glob: str = "*", most_bytes: int | None = None) -> DataFrame:
    """(path, length, modified, sample_id, class_folder, identity, sha256, media): files below root, typed by their bytes.

    Files above most_bytes are left out before their content is hashed.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    if most_bytes is not None:
        raw = raw.where(F.col("length") <= most_bytes)
    rel = F.regexp_replace("path", r"^.*?" + root.rstrip("/").replace(".", r"\.") + "/", "")
    suffix = F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)
    return raw.select(
        "path", "length", F.col("modificationTime").alias("modified"), sample_id(rel).alias("sample_id"), F.split(rel, "/")[0].alias("class_folder"), path_identity(rel).alias("identity"),
        F.sha2("content", 256).alias("sha256"), media_type(F.col("content"), suffix).alias("media"),
    )


#: Endings of images, and what marks a row of a list as a reference.
IMAGE_ENDINGS, TRUE_WORDS = ("jpg", "jpeg", "png", "bmp", "tif", "tiff", "webp", "heic", "dng"), ("1", "true", "yes", "y")


def labelled_images(spark: SparkSession, root: str) -> DataFrame:
    """(path, device, platform, split) of the images below root, path relative to it: by the list labels.csv if it is there, else by folders.

    Of a list's columns the first of several names counts that is filled; rows whose image is not there are left out. A folder
    of root is a device; images right in it are originals to train with, those deeper get platform and split from
    the name of the folder below the device. Only names are read, never images.
    """
    root = root.rstrip("/")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace("path", "^.*?" + re.escape(root.removeprefix("file://")) + "/", "")
    images = listed.select(path.alias("path")).where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*IMAGE_ENDINGS))
    parts = F.split("path", "/")
    if listed.where(path == "labels.csv").limit(1).count():
        names = {"path": ("file_path", "path", "relative_path"), "device": ("device_id", "device"), "platform": ("platform", "platform_path"), "split": ("split",), "reference": ("is_reference",)}
        rows = aliased(read_text_csv(spark, f"{root}/labels.csv"), names).where("path is not null").join(images, "path", "left_semi")
        parent = F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit(root.rpartition("/")[2]))
        platform = folder_platform(F.coalesce("platform", parent))
        split = F.coalesce("split", F.when(F.lower("reference").isin(*TRUE_WORDS), "reference"), folder_split(parent, platform))
        return rows.select("path", F.coalesce("device", F.try_element_at(parts, F.lit(-3))).alias("device"), platform.alias("platform"), split.alias("split"))
    deep, bucket = F.size(parts) > 2, F.get(parts, F.lit(1))
    platform = F.when(deep, folder_platform(bucket)).otherwise("original")
    return images.where(F.size(parts) > 1).select("path", parts[0].alias("device"), platform.alias("platform"), F.when(deep, folder_split(bucket, platform)).otherwise("train").alias("split"))


def fixture_rows(spark: SparkSession, n: int, platform: str) -> DataFrame:
    """n labelled synthetic candidates of a platform, for tests and demonstrations."""
    i = F.col("id")
    return spark.range(n).select(
        i.alias("_ord"), F.lit(platform).alias("platform"), F.concat(F.lit("fixture_"), i.cast("string")).alias("account"), F.concat(F.lit("https://fixture.invalid/"), F.lit(platform), F.lit("/"), i.cast("string")).alias("post_url"),
        F.lit(True).alias("is_synthetic"), F.lit("fixture").alias("evidence_status"),
    )


def usable(manifest: DataFrame, artifacts: DataFrame, key: str = "sample_id", reason: str = "MISSING_ARTIFACT") -> DataFrame:
    """manifest with exclusion_reason: null where an artifact is there."""
    have = artifacts.select(key).distinct().withColumn("_have", F.lit(True))
    return manifest.join(have, key, "left").withColumn("exclusion_reason", F.when(F.col("_have").isNull(), reason)).drop("_have")


def frame_times(frames: DataFrame, by: Sequence[str], order: str, per_second: float) -> DataFrame:
    """frames with frame, the 0-based place in order, and ts_sec = frame / per_second."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1
    return frames.withColumn("frame", n).withColumn("ts_sec", F.col("frame") / per_second)


def keyframes(frames: DataFrame, per_second: float, every: float = 1.0, most: int = 30) -> DataFrame:
    """Frames (with frame, from frame_times) one each `every` seconds, the first `most`."""
    step = max(1, int(per_second * every))
    return frames.where((F.col("frame") % step == 0) & (F.col("frame") < step * most))


PROBE = "streams array<struct<codec_name: string, width: int, height: int, avg_frame_rate: string>>, frames array<struct<pkt_size: string, key_frame: int, best_effort_timestamp_time: string, pict_type: string>>"


def probe_frames(df: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, place, ts, packet, key, kind, codec, width, height, fps): one row a frame of a media probe's JSON; payloads without a stream give none."""
    p = df.select(F.col(key), F.from_json(payload, PROBE).alias("p")).where(F.size("p.streams") > 0)
    rows = p.select(F.col(key), F.get("p.streams", F.lit(0)).alias("s"), F.posexplode("p.frames").alias("place", "f"))
    return rows.select(
        F.col(key), "place", finite(F.col("f.best_effort_timestamp_time"), None).alias("ts"), finite(F.col("f.pkt_size")).alias("packet"), (F.col("f.key_frame") == 1).alias("key"), F.upper("f.pict_type").alias("kind"),
        F.col("s.codec_name").alias("codec"), F.col("s.width").alias("width"), F.col("s.height").alias("height"), fraction(F.col("s.avg_frame_rate")).alias("fps"),
    )


def real_sources(df: DataFrame, sample: str, roots: dict[str, str], most: int | None = None) -> DataFrame:
    """Rows of class REAL in order of their id, the first `most`, with a path a root."""
    d = df.where(F.col("semantic_class") == "REAL").withColumns({n: F.concat(F.lit(root + "/"), F.col(sample).cast("string"), F.lit(".npz")) for n, root in roots.items()})
    return d if most is None else d.orderBy(sample).limit(most)


def local_facts(name: str, tags: Sequence[str]) -> Column:
    """Array of what a file itself tells: its name if it means something, and its filled metadata fields."""
    named = F.when(meaningful_filename(F.col(name)), F.concat(F.lit("filename: "), F.col(name)))
    fields = [F.when(F.trim(F.col(t)) != "", F.concat(F.lit(t + ": "), F.trim(F.col(t)))) for t in tags]
    return F.array_compact(F.array(named, *fields))
