"""Batch runs of the streaming operators: events are read as a stream, processed once and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from tessera.plans.registry import register, table
from tessera.session import materialise, shared_dir
from tessera.streaming import events as st, ordered as od


#: Stretches of time in which the events arrive, one after the other; inside one, rows come in any order.
ARRIVALS = 4


def _stream(spark, sf_dir) -> tuple[DataFrame, str]:
    """The events as a stream, and the delay that covers rows out of order: the length of a stretch.

    A stretch is written by all tasks as many files. A trigger reads about one stretch's number of files, so that the
    triggers, each of which meets most keys again, do not grow in number with the input.
    """
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    first, last = ev.agg(F.min("ts").cast("long"), F.max("ts").cast("long")).first()
    first, last = first or 0, last or 0
    width = (last - first) // ARRIVALS + 1
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    second = F.col("ts").cast("long")
    for k in range(ARRIVALS):
        ev.where((second >= first + k * width) & (second < first + (k + 1) * width)).write.mode("append").parquet(folder)
    files = len(spark.read.schema(ev.schema).parquet(folder).inputFiles())
    # a later closing row moves the watermark past all sessions and windows
    end = spark.createDataFrame([(-1, -1, last + 60 * 86400 + 2 * width, "end", 0.0)], "event_id long, user_id long, ts long, event_type string, value double")
    end.withColumn("ts", F.col("ts").cast("timestamp")).write.mode("append").parquet(folder)
    return spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", max(4, -(-files // ARRIVALS))).parquet(folder), f"{width} seconds"


def _buckets(spark, sf_dir) -> int:
    """Buckets of users, about 32,768 events each, so that what a task holds does not grow with the input."""
    return max(od.BUCKETS, table(spark, sf_dir, "events").count() >> 15)


def _run(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    st.run_available(df, base + "/out", base + "/state")
    return spark.read.schema(df.schema).parquet(base + "/out")


@register("stream_sessions", """
WITH e AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) > 43200000000 THEN 1 ELSE 0 END AS b FROM events), r AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM e)
SELECT user_id, count(*) AS n, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 43200000000 AS end_us FROM r GROUP BY user_id, run""")
def sessions(spark, sf_dir):
    stream, delay = _stream(spark, sf_dir)
    d = _run(st.sessions(stream, "user_id", "ts", "12 hours", delay))
    return d.where("user_id >= 0").select("user_id", "n", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"))


@register("stream_windows", """
SELECT event_type, epoch_us(time_bucket(INTERVAL 6 HOURS, ts)) AS start_us, count(*) AS n, round(sum(value), 6) AS total, arg_min(value, ts) AS first_value FROM events GROUP BY 1, 2""")
def windows(spark, sf_dir):
    stream, delay = _stream(spark, sf_dir)
    d = _run(st.windows(stream, "event_type", "ts", "value", "6 hours", None, delay))
    return d.where("event_type <> 'end'").select("event_type", F.unix_micros("start").alias("start_us"), "n", F.round("total", 6).alias("total"), "first_value")


@register("stream_first_seen", "SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY ALL")
def first_seen(spark, sf_dir):
    d = _run(st.first_seen(_stream(spark, sf_dir)[0], ["user_id", "event_type"], "ts", "90 days"))
    return d.where("user_id >= 0").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@register("stream_chained", "SELECT CAST(user_id AS VARCHAR) AS key, count(*) AS entries, 0::BIGINT AS broken FROM events GROUP BY 1")
def chained(spark, sf_dir):
    from tessera.operators.lineage import verify_chain

    d = _run(st.chained(_stream(spark, sf_dir)[0], "user_id", "event_id", F.col("event_type")))
    return verify_chain(materialise(d.where("key <> '-1'"), "chain"), "key")


@register("stream_sliding_windows", """
WITH h AS (SELECT event_type, ts, value, unnest(generate_series(0, 2)) AS k FROM events), w AS (SELECT event_type, value, ts, epoch_us(time_bucket(INTERVAL 2 HOURS, ts)) - k * 7200000000 AS start_us FROM h)
SELECT event_type, start_us, count(*) AS n, round(sum(value), 6) AS total, arg_min(value, ts) AS first_value FROM w GROUP BY 1, 2""")
def sliding_windows(spark, sf_dir):
    """Windows of six hours every two, so that each event is in three."""
    stream, delay = _stream(spark, sf_dir)
    d = _run(st.windows(stream, "event_type", "ts", "value", "6 hours", "2 hours", delay))
    return d.where("event_type <> 'end'").select("event_type", F.unix_micros("start").alias("start_us"), "n", F.round("total", 6).alias("total"), "first_value")


@register("stream_tick_sampler", """WITH RECURSIVE f AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, CAST(floor((epoch_us(ts) - 1704067200000000) / 43200000000) AS BIGINT) + 1 AS c FROM events),
r AS (SELECT user_id, event_id, i, CASE WHEN c > 0 THEN 1 ELSE 0 END AS n, c > 0 AS taken FROM f WHERE i = 1 UNION ALL SELECT f.user_id, f.event_id, f.i, r.n + CASE WHEN f.c > r.n THEN 1 ELSE 0 END, f.c > r.n FROM r JOIN f ON f.user_id = r.user_id AND f.i = r.i + 1)
SELECT event_id FROM r WHERE taken""")
def tick_sampler(spark, sf_dir):
    """The rows of series_tick_sampler, from a stream."""
    stream, delay = _stream(spark, sf_dir)
    d = _run(od.tick_sampler(stream, "user_id", "ts", "event_id", 1704067200_000_000, 43200_000_000, delay, buckets=_buckets(spark, sf_dir)))
    return d.where("order >= 0").select(F.col("order").alias("event_id"))


@register("stream_closed_set", """
WITH RECURSIVE k AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, event_type || (event_id % 8) AS u, CASE WHEN event_id % 4 > 0 THEN event_type || ':' || (event_id % 11) END AS p FROM events),
r AS (SELECT user_id, event_id, i, [u] AS us, CASE WHEN p IS NULL THEN []::VARCHAR[] ELSE [p] END AS ps, true AS kept FROM k WHERE i = 1
UNION ALL SELECT k.user_id, k.event_id, k.i, CASE WHEN list_contains(us, u) OR coalesce(list_contains(ps, p), false) THEN us ELSE list_append(us, u) END, CASE WHEN p IS NULL OR list_contains(us, u) OR list_contains(ps, p) THEN ps ELSE list_append(ps, p) END,
NOT (list_contains(us, u) OR coalesce(list_contains(ps, p), false)) FROM r JOIN k ON k.user_id = r.user_id AND k.i = r.i + 1)
SELECT event_id FROM r WHERE kept""")
def closed_set(spark, sf_dir):
    """Per user, events whose url and whose (domain, hash) are both new; every fourth has no hash."""
    stream, delay = _stream(spark, sf_dir)
    kind, no = F.col("event_type"), F.col("event_id")
    url, pair = F.concat(kind, (no % 8).cast("string")), F.when(no % 4 > 0, F.concat(kind, F.lit(":"), (no % 11).cast("string")))
    return _run(od.closed_set(stream, "user_id", "ts", "event_id", url, pair, delay, buckets=_buckets(spark, sf_dir))).where("order >= 0").select(F.col("order").alias("event_id"))
