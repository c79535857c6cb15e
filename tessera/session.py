"""Session construction and durable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tessera", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings that the library's plans assume (UTC, adaptive execution).

    Cluster settings (master, memory, checkpoint folder) are left to spark-submit
    unless they are given here.
    """
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Where it is unset, a temporary folder is made for a local master (tests);
    on a cluster that would be a machine-local folder, so it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="spark-tessera-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def materialise(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    Cuts the lineage: what follows survives the loss of any executor without
    recomputing df, and reads only the columns it needs. The table goes when
    the driver ends, or earlier by `release`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, at = _file_system(spark, path)
    fs.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out.materialised_at = path
    return out


def bounded_batches(spark: SparkSession, rows: int = 500, size: int = 8 << 20) -> None:
    """Sees to it that Arrow batches to Python hold `rows` rows and about `size` bytes at most: a function over whole texts holds a batch several times over.

    Spark reads both limits when a plan runs, so they are lowered in the session and stay so; lower ones are kept.
    """
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def spread(df: DataFrame) -> DataFrame:
    """df dealt over four tasks a core, for costly expressions over a table whose few large row groups would leave most cores idle.

    A stated number, which adaptive execution does not merge again.
    """
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def release(*tables: DataFrame) -> None:
    """Delete tables that `materialise` returned. Only for those that no DataFrame still to be run reads."""
    for t in tables:
        fs, at = _file_system(t.sparkSession, t.materialised_at)
        fs.delete(at, True)
