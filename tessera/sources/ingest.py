"""Write-once ingest of files by content address."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.functions.ids import media_type, safe_filename
from tessera.operators.audits import first_of
from tessera.session import materialise, release
from tessera.sources import versioned


def ingest(spark: SparkSession, folder: str, root: str, most_bytes: int = 200 << 20, glob: str = "*") -> DataFrame:
    """Takes up the files below folder that are new or changed since the last call, and returns the ledger of this call.

    Ledger: path, name, length, modified, sha256, media, status, batch. status: stored (the content is new and was
    written), known (its content is there already, from this call or an earlier one), or why it was refused: too large,
    unsupported (the bytes are of no known medium, or not of the suffix's). Empty files are passed over by Spark's readers. Two tables lie in root, each
    written whole or not at all: `contents` (sha256, content), each content once, and `ledger`. Contents are committed
    first; a call that fails between the two finds them known by their address when it is repeated, and writes nothing
    twice. Files whose path, time and length are in the ledger are not read again, and contents of files that are too large never.
    """
    seen = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    seen = seen.withColumnRenamed("modificationTime", "modified")
    old = versioned.read(spark, f"{root}/ledger") if versioned.versions(spark, f"{root}/ledger") else None
    if old is not None:
        seen = seen.join(old.select("path", "modified", "length"), ["path", "modified", "length"], "left_anti")
    batch = len(versioned.versions(spark, f"{root}/ledger"))
    small = F.when(F.col("length") <= most_bytes, F.col("content"))
    kind = media_type(small, F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    facts = seen.select("path", safe_filename(F.col("path")).alias("name"), "length", "modified", F.sha2(small, 256).alias("sha256"), kind.alias("media"))
    facts = materialise(facts.withColumn("refused", F.when(F.col("length") > most_bytes, "too large").when(F.col("media").isNull(), "unsupported")), "files")
    fresh = first_of(facts.where("refused is null"), ["sha256"], ["path"], 1).select("sha256", F.col("path").alias("_path"))
    have = versioned.read(spark, f"{root}/contents").select("sha256") if versioned.versions(spark, f"{root}/contents") else None
    if have is not None:
        fresh = fresh.join(have, "sha256", "left_anti")
    fresh = materialise(fresh, "fresh")
    stored = seen.select("path", "content").join(fresh, F.col("path") == F.col("_path")).select("sha256", "content")
    versioned.write(stored, f"{root}/contents", append=True)
    done = facts.join(fresh.withColumnRenamed("sha256", "_sha"), F.col("path") == F.col("_path"), "left")
    status = F.coalesce("refused", F.when(F.col("_path").isNotNull(), "stored").otherwise("known"))
    ledger = done.select("path", "name", "length", "modified", F.when(F.col("refused").isNull(), F.col("sha256")).alias("sha256"), "media", status.alias("status"), F.lit(batch).alias("batch"))
    versioned.write(ledger, f"{root}/ledger", append=True)
    release(facts, fresh)
    return versioned.read(spark, f"{root}/ledger").where(F.col("batch") == batch)
