"""Time series keyed by sample: runs, segments, interval joins and shifted pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.operators.intervals import interval_join
from tessera.operators.running import group_quantile
from tessera.operators.scans import dealt, scan


def gap_runs(df: DataFrame, by: Sequence[str], ts: str, gap: float, tie: str) -> DataFrame:
    """df with run (0-based, within by), pos (0-based, within by) and run_pos; a step of more than gap starts a run.

    A key's rows are spread over tasks (`scans`), however many it has.
    """
    order = [ts, tie]
    d = scan(dealt(df, by, order), by, order, {"_b": ("lag", F.col(ts).cast("double"))})
    d = d.withColumn("_new", F.coalesce((F.col(ts).cast("double") - F.col("_b") > gap).cast("long"), F.lit(0).cast("long")))
    d = scan(d, by, order, {"run": ("sum", "_new"), "_n": ("sum", F.lit(1).cast("long"))}).withColumn("pos", F.col("_n") - 1)
    d = scan(d, by, order, {"_first": ("last", F.when((F.col("_new") == 1) | (F.col("pos") == 0), F.col("pos")))})
    return d.select(*df.columns, "run", "pos", (F.col("pos") - F.col("_first")).alias("run_pos"))


def run_table(runs: DataFrame, by: Sequence[str], ts: str) -> DataFrame:
    """(by, run, first, last, n, start, end) of every run; last is exclusive."""
    return runs.groupBy(*by, "run").agg(F.min("pos").alias("first"), (F.max("pos") + 1).alias("last"), F.count("*").alias("n"), F.min(ts).alias("start"), F.max(ts).alias("end"))


def segments(runs: DataFrame, by: Sequence[str], ts: str, value: str, length: int, stride: int) -> DataFrame:
    """Segments of `length` rows, every `stride`, whole inside a run: (by, run, run_pos, start, end, centre, mean)."""
    ahead = Window.partitionBy(*by, "run").orderBy("run_pos").rowsBetween(0, length - 1)
    seen = F.count("*").over(ahead)
    df = runs.select(*by, "run", "run_pos", F.col(ts).alias("start"), F.max(ts).over(ahead).alias("end"), F.avg(value).over(ahead).alias("mean"), seen.alias("_n"))
    df = df.where((F.col("run_pos") % stride == 0) & (F.col("_n") == length)).drop("_n")
    return df.withColumn("centre", (F.col("start").cast("double") + F.col("end").cast("double")) / 2)


def velocity(df: DataFrame, by: Sequence[str], ts: str, value: str, tie: str) -> DataFrame:
    """df with the change of value per second since the previous row that has a value; 0 for the first."""
    order = [ts, tie]
    d = scan(dealt(df.where(F.col(value).isNotNull()), by, order), by, order, {"_t": ("lag", F.col(ts).cast("double")), "_v": ("lag", value)})
    dt = F.col(ts).cast("double") - F.col("_t")
    return d.select(*df.columns, F.coalesce(F.try_divide(F.col(value) - F.col("_v"), F.when(dt > 0, dt)), F.lit(0.0)).alias("velocity"))


def collapse_repeats(df: DataFrame, by: Sequence[str], order: Sequence[str], label: str) -> DataFrame:
    """Rows whose label differs from the one before."""
    d = scan(dealt(df, by, order), by, order, {"_b": ("lag", label)})
    return d.where(F.col("_b").isNull() | (F.col("_b") != F.col(label))).select(*df.columns)


def first_per_tick(df: DataFrame, by: Sequence[str], ts: str, per_second: float, tie: str) -> DataFrame:
    """The first row of every tick. Equals a sampler that advances tick by tick if the source has a row in each."""
    tick = F.floor((F.col(ts).cast("double") + 1e-9) * per_second).alias("tick")
    return df.groupBy(*by, tick).agg(F.min_by(tie, F.struct(ts, tie)).alias(tie), F.min(ts).alias(ts))


def interval_align(windows: DataFrame, frames: DataFrame, by: str, cell: float, least: int = 2) -> DataFrame:
    """(by, start_sec, end_sec, n, mean, motion) of the distinct half-open windows [start_sec, end_sec) with `least` frames or more.

    windows: by, start_sec, end_sec, of any lengths, overlapping or not; frames: by, ts, value; cell: about
    the shortest window (see `interval_join`). motion is the mean absolute change from frame to frame
    inside the window. As a window's frames follow each other, the frame before one is in the window
    if its time is, so each frame takes that time and value along and windows are plain sums.
    """
    order = ["ts", "value"]
    f = scan(dealt(frames.select(by, "ts", "value").where("ts is not null"), [by], order), [by], order, {"_t": ("lag", "ts"), "_v": ("lag", "value")})
    hit = interval_join(windows.select(by, "start_sec", "end_sec").distinct(), f.select(by, "ts", "value", "_t", "_v"), by, cell=cell)
    change = F.when(F.col("_t") >= F.col("start_sec"), F.abs(F.col("value") - F.col("_v")))
    return hit.groupBy(by, "start_sec", "end_sec").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.avg(change).alias("motion")).where(F.col("n") >= least)


def shifted_pairs(runs: DataFrame, by: Sequence[str], left: str, right: str, offsets: Sequence[int]) -> DataFrame:
    """(by, run, run_pos, offset, left, right): each row's left with the right of the row `offset` places on in its run."""
    a = runs.select(*by, "run", "run_pos", F.col(left).alias("left_value"), F.explode(F.array(*map(F.lit, offsets))).alias("offset")).withColumn("_at", F.col("run_pos") + F.col("offset"))
    b = runs.select(*by, "run", F.col("run_pos").alias("_at"), F.col(right).alias("right_value"))
    return a.join(b, [*by, "run", "_at"]).drop("_at")


def circular_negatives(rows: DataFrame, by: str, pos: str, value: str, shift: Column) -> DataFrame:
    """(by, pos, label, value, other): each row with itself (1) and with the row shift places on, around the end (0). shift may use n, the rows of by."""
    n = rows.groupBy(by).agg(F.count("*").alias("n"))
    a = rows.join(n, by).withColumn("_at", (F.col(pos) + shift) % F.col("n"))
    b = rows.select(by, F.col(pos).alias("_at"), F.col(value).alias("other"))
    neg = a.join(b, [by, "_at"]).where(F.col("n") > 1).select(by, pos, F.lit(0).alias("label"), value, "other")
    return rows.select(by, pos, F.lit(1).alias("label"), value, F.col(value).alias("other")).unionByName(neg)


def fixed_windows(df: DataFrame, by: str, n_samples: str, width: int, hop: int, rate: float) -> DataFrame:
    """(by, window, start_sec, end_sec) over n_samples; the last windows end with the samples."""
    starts = F.sequence(F.lit(0).cast("long"), F.col(n_samples) - 1, F.lit(hop).cast("long"))
    w = df.where(F.col(n_samples) > 0).select(by, n_samples, F.posexplode(starts).alias("window", "_s"))
    return w.select(by, "window", (F.col("_s") / rate).alias("start_sec"), (F.least(F.col("_s") + width, F.col(n_samples)) / rate).alias("end_sec"))


def window_values(df: DataFrame, by: str, samples: str, width: int, hop: int | None = None) -> DataFrame:
    """(by, window, start, valid, values) of windows of `width` samples of an array, every `hop` (the width by default).

    valid counts the window's own samples; a shorter last window is filled by repeating them from its start.
    """
    hop, n = hop or width, F.size(samples)
    w = df.where(n > 0).select(by, samples, F.posexplode(F.sequence(F.lit(0), n - 1, F.lit(hop))).alias("window", "start"))
    own = F.slice(samples, F.col("start") + 1, width)
    w = w.select(by, "window", "start", F.size(own).alias("valid"), own.alias("_own"))
    tiled = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.get("_own", i % F.col("valid")))
    return w.select(by, "window", "start", "valid", F.when(F.col("valid") == width, F.col("_own")).otherwise(tiled).alias("values"))


def attach_aligned(records: DataFrame, order: str) -> DataFrame:
    """records with aligned_score and aligned_logit: those of the row of the same cohort whose anchor the row is paired with; null without one.

    records: cohort, label, anchor_id, paired_anchor_id, score, logit. Aligned rows are those of label 1 in
    cohorts whose name begins with matched; of several of one anchor the last by order counts.
    """
    aligned = records.where(F.col("cohort").startswith("matched") & (F.col("label") == 1)).groupBy("cohort", F.col("anchor_id").alias("paired_anchor_id"))
    last = aligned.agg(F.max_by(F.struct("score", "logit"), order).alias("_a"))
    return records.join(last, ["cohort", "paired_anchor_id"], "left").select(*records.columns, F.col("_a.score").alias("aligned_score"), F.col("_a.logit").alias("aligned_logit"))


def context_padding(centre: Column, n: Column, width: int) -> tuple[Column, Column, Column]:
    """Samples of a centred context that lie before, after and inside a signal of n samples."""
    start = centre - width // 2
    left = F.greatest(F.lit(0), -start)
    right = F.greatest(F.lit(0), start + width - n)
    return left, right, F.greatest(F.lit(0), width - left - right)


def _joined(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """left with right's columns, one row a key or none; null keys meet."""
    named = right.select(*[F.col(c).alias(f"_j{i}") for i, c in enumerate(by)], *[c for c in right.columns if c not in by])
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_j{i}"))
    return left.join(named, same, "left").drop(*[f"_j{i}" for i in range(len(by))])


def intervals_cv(df: DataFrame, by: Sequence[str], ts: str, tie: str) -> DataFrame:
    """(by, n, cv, ratio90): variation of the steps between rows, and their 90th percentile over the mean."""
    order = [ts, tie]
    d = scan(dealt(df.select(*by, *order), by, order), by, order, {"_t": ("lag", F.col(ts).cast("double"))})
    steps = d.select(*by, (F.col(ts).cast("double") - F.col("_t")).alias("d")).where("d is not null")
    means = steps.groupBy(*by).agg(F.count("*").alias("n"), F.try_divide(F.stddev_pop("d"), F.avg("d")).alias("cv"), F.avg("d").alias("_m"))
    return _joined(means, group_quantile(steps, by, "d", 0.9, "_q"), by).select(*by, "n", "cv", F.try_divide("_q", "_m").alias("ratio90"))


def vector_deltas(runs: DataFrame, by: Sequence[str], vector: str) -> DataFrame:
    """runs with delta: the change of a vector since the row before, zeros where a run starts."""
    before = F.lag(vector).over(Window.partitionBy(*by, "run").orderBy("run_pos"))
    zeros = F.transform(vector, lambda x: F.lit(0.0))
    return runs.withColumn("_b", before).withColumn("delta", F.when(F.col("_b").isNull(), zeros).otherwise(F.zip_with(vector, "_b", lambda x, y: (x - y).cast("double")))).drop("_b")


def anchors(runs: DataFrame, by: Sequence[str], ts: str, segment: int, stride: int, step: float, tolerance: float, offsets: Sequence[int] = (-4, -2, 0, 2, 4), observed: str | None = None) -> DataFrame:
    """(by, run, run_pos) of rows from which a segment and all its shifted copies lie in the run at even steps.

    Each step and each displacement must be within tolerance of its nominal
    length. With observed, a boolean column, also the row before the earliest
    copy must exist and all rows of all copies be observed.
    """
    run = Window.partitionBy(*by, "run").orderBy("run_pos")
    low, high = min(offsets), max(offsets)
    t = F.col(ts).cast("double")
    even = F.abs(t - F.lag(t).over(run) - step) <= tolerance
    moved = F.lit(True)
    for o in offsets:
        moved = moved & F.coalesce(F.abs(F.lead(t, o).over(run) - t - o * step) <= tolerance, F.lit(False)) if o else moved
    d = runs.withColumn("_even", F.coalesce(even, F.lit(True)).cast("int")).withColumn("_moved", moved.cast("int")).withColumn("_seen", F.col(observed).cast("int") if observed else F.lit(1))
    whole, own = run.rowsBetween(low + 1, high + segment - 1), run.rowsBetween(0, segment - 1)
    spread = run.rowsBetween(low, high + segment - 1)
    d = d.withColumn("_ok", (F.min("_even").over(whole) == 1) & (F.min("_moved").over(own) == 1) & (F.count("*").over(own) == segment) & (F.min("_seen").over(spread) == 1))
    first = F.col("run_pos") + low > 0 if observed else F.col("run_pos") + low >= 0
    return d.where(F.col("_ok") & first & (F.col("run_pos") % stride == 0)).select(*by, "run", "run_pos")


def probe_statistics(frames: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """Statistics of frames (ts, packet, key, kind) in order, per sample.

    Shares of key frames and kinds, distances between key frames in frames (one
    distance of the whole length if there are fewer than two), variation of packet
    sizes and positive steps, and the 90th percentile of packets over their mean.
    """
    d = scan(dealt(frames, by, [order]), by, [order], {"_no": ("sum", F.lit(1).cast("long")), "_t": ("lag", F.col("ts").cast("double"))})
    d = d.withColumn("_dt", F.col("ts").cast("double") - F.col("_t")).withColumn("_k", F.when(F.col("key"), F.col("_no")))
    d = scan(d, by, [order], {"_before": ("last_before", "_k")}).withColumn("_gop", F.when(F.col("key"), F.col("_no") - F.col("_before")))
    packet, dt, kind = F.when(F.col("packet") > 0, F.col("packet")), F.when(F.col("_dt") > 0, F.col("_dt")), F.upper("kind")
    cv = lambda c: F.coalesce(F.try_divide(F.stddev_pop(c), F.avg(c)), F.lit(0.0))
    n = F.count("*")
    found = d.groupBy(*by).agg(
        n.alias("frames"), (F.count_if("key") / n).alias("key_share"), F.coalesce(F.avg("_gop"), n.cast("double")).alias("gop_mean"), F.coalesce(F.stddev_pop("_gop"), F.lit(0.0)).alias("gop_std"),
        F.coalesce(F.max("_gop"), n).cast("double").alias("gop_max"), cv(packet).alias("packet_cv"), F.avg(packet).alias("_m"), cv(dt).alias("step_cv"), *[(F.count_if(kind == k) / n).alias(f"{k.lower()}_share") for k in ("I", "P", "B")],
    )
    found = _joined(found, group_quantile(frames.where(F.col("packet") > 0), by, "packet", 0.9, "_q"), by)
    ratio = F.coalesce(F.try_divide("_q", "_m"), F.lit(1.0)).alias("packet_p90")
    return found.select(*by, "frames", "key_share", "gop_mean", "gop_std", "gop_max", "packet_cv", ratio, "step_cv", "i_share", "p_share", "b_share")


def frame_statistics(frames: DataFrame, by: Sequence[str], order: str, measures: Sequence[str], change: str, duplicate: float = 0.0025) -> DataFrame:
    """Per sample the mean, deviation and variation of each measure, and of the change from frame to frame its mean, variation and the share of near duplicates."""
    d = scan(dealt(frames, by, [order]), by, [order], {"_b": ("lag", change)}).withColumn("_d", F.abs(F.col(change) - F.col("_b")))
    cv = lambda c: F.coalesce(F.try_divide(F.stddev_pop(c), F.avg(c)), F.lit(0.0))
    out = [f(m).alias(f"{m}_{n}") for m in measures for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("cv", cv))]
    return d.groupBy(*by).agg(F.count("*").alias("frames"), *out, F.coalesce(F.avg((F.col("_d") <= duplicate).cast("double")), F.lit(0.0)).alias("near_duplicates"), F.coalesce(F.avg("_d"), F.lit(0.0)).alias("change_mean"), cv("_d").alias("change_cv"))


def inside_waveform(df: DataFrame, ts: str, n_samples: str, rate: float) -> DataFrame:
    """Rows whose time lies inside a signal of n_samples."""
    return df.where((F.col(ts) >= 0) & (F.col(ts) < F.col(n_samples) / rate + 1e-6))
