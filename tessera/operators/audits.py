"""Counts, censuses, leakage between manifests, and small orderings that audits report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.operators.running import numbered


def row_batches(df: DataFrame, order: Sequence[str], size: int) -> DataFrame:
    """df with batch: consecutive rows of the order in batches of `size`, numbered over a range partition."""
    return numbered(df, order, "_no").withColumn("batch", F.floor((F.col("_no") - 1) / size).cast("long")).drop("_no")


def unique_keys(df: DataFrame, desired: str, order: Sequence[str]) -> DataFrame:
    """df with key: the desired key, and from its second row on with _2, _3, ... behind it."""
    n = F.row_number().over(Window.partitionBy(desired).orderBy(*order))
    return df.withColumn("_n", n).withColumn("key", F.when(F.col("_n") == 1, F.col(desired)).otherwise(F.concat_ws("_", desired, F.col("_n").cast("string")))).drop("_n")


def first_of(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], most: int) -> DataFrame:
    """The first `most` rows of every group in the order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= most).drop("_r")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n), the most frequent first; nulls are left out."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def component_classes(df: DataFrame, members: DataFrame, key: str, component: str, label: str, classes: Sequence[str]) -> DataFrame:
    """(component, videos, one count a class): rows of df by the component of their key."""
    joined = df.join(members, key)
    return joined.groupBy(component).agg(F.count("*").alias("videos"), *[F.count_if(F.col(label) == c).alias(c) for c in classes])


def retention(df: DataFrame, cohort: str, source: str, identity: str) -> DataFrame:
    """(cohort, records, sources, identities)."""
    return df.groupBy(cohort).agg(F.count("*").alias("records"), F.count_distinct(source).alias("sources"), F.count_distinct(identity).alias("identities"))


def earliest_valid(df: DataFrame, by: Sequence[str], ts: str, match: Column, years: tuple[int, int] = (2000, 2027)) -> DataFrame:
    """(by, earliest): the least time of matching rows whose year can be true."""
    ok = F.coalesce(match & F.year(ts).between(*years), F.lit(False))
    return df.groupBy(*by).agg(F.min(F.when(ok, F.col(ts))).alias("earliest"))


def extraction_summary(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts by status (COMPLETED, SKIPPED_VALID_OUTPUT, FAILED), and of completed rows the coverage (aligned / windows) and mean bytes; null where nothing is divided by."""
    s = F.col("status")
    done = lambda c: F.sum(F.when(s == "COMPLETED", F.col(c)))
    n = F.count_if(s == "COMPLETED")
    return df.groupBy(*by).agg(
        F.count("*").alias("selected"), n.alias("completed"), F.count_if(s == "SKIPPED_VALID_OUTPUT").alias("skipped"), F.count_if(s == "FAILED").alias("failed"),
        (F.count_if(s == "FAILED") / F.count("*")).alias("failure_rate"), F.try_divide(done("aligned"), done("windows")).alias("coverage"), F.try_divide(done("bytes"), n).alias("mean_bytes"),
    )


def census(df: DataFrame, offsets: Sequence[int]) -> DataFrame:
    """(label, n, one count an offset, padded, mean_padding, mean_position) of constructed records."""
    name = lambda o: f"offset_{o}" if o >= 0 else f"offset_m{-o}"
    return df.groupBy("label").agg(
        F.count("*").alias("n"), *[F.count_if(F.col("offset") == o).alias(name(o)) for o in offsets],
        F.count_if(F.col("padding") > 0).alias("padded"), F.avg("padding").alias("mean_padding"), F.avg("position").alias("mean_position"),
    )


def total_join(left: DataFrame, right: DataFrame, sample: str, index: str, tolerance: float = 1e-5) -> DataFrame:
    """(sample, rows, reason): whether all of a sample's rows find their index on the right, at the same time.

    left and right: sample, index, ts. One missing index or one time that is off
    rejects the whole sample; reason is null where the join is total.
    """
    r = right.select(F.col(sample).alias("_s"), F.col(index).alias("_i"), F.col("ts").alias("_ts"))
    both = left.join(r, (F.col(sample) == F.col("_s")) & (F.col(index) == F.col("_i")), "left")
    found = both.groupBy(sample).agg(F.count("*").alias("rows"), F.bool_and(F.col("_i").isNotNull()).alias("all"), F.max(F.abs(F.col("ts") - F.col("_ts"))).alias("off"))
    reason = F.when(~F.col("all"), "index_missing").when(F.col("off") > tolerance, "timestamp_mismatch")
    return found.select(sample, "rows", reason.alias("reason"))


def link_leakage(rows: DataFrame, sample: str, identity: str, links: str, split: str) -> DataFrame:
    """(sample, linked_identity, linked_split): related identities of another split, or of none (an unknown identity).

    links is an array; the identity itself counts as related.
    """
    known = rows.select(F.col(identity).alias("linked_identity"), F.col(split).alias("linked_split")).distinct()
    each = rows.select(sample, split, F.explode(F.array_distinct(F.concat(F.array(identity), F.coalesce(links, F.array().cast("array<string>"))))).alias("linked_identity"))
    return each.join(known, "linked_identity", "left").where(F.col("linked_split").isNull() | (F.col("linked_split") != F.col(split))).select(sample, "linked_identity", "linked_split")


def manifest_overlaps(train: DataFrame, held: DataFrame, examples: int = 20) -> DataFrame:
    """(kind, n, examples) of the six ways in which two manifests (sample_id, identity, component_id, links) can share; kinds without a shared value are left out.

    Examples are the first values in order, at most `examples`.
    """
    value = lambda d, c: d.select(F.col(c).cast("string").alias("v")).where("v is not null").distinct()
    linked = lambda d: d.select(F.explode("links").alias("v")).where("v is not null").distinct()
    kinds = {
        "sample_id": (value(train, "sample_id"), value(held, "sample_id")), "identity": (value(train, "identity"), value(held, "identity")),
        "component_id": (value(train, "component_id"), value(held, "component_id")), "linked_identity": (linked(train), linked(held)),
        "train_identity_in_held_links": (value(train, "identity"), linked(held)), "held_identity_in_train_links": (value(held, "identity"), linked(train)),
    }
    out = None
    for kind, (a, b) in kinds.items():
        one = a.join(b, "v").select(F.lit(kind).alias("kind"), "v")
        out = one if out is None else out.unionByName(one)
    ranked = out.withColumn("r", F.row_number().over(Window.partitionBy("kind").orderBy("v")))
    few = ranked.where(F.col("r") <= examples).groupBy("kind").agg(F.sort_array(F.collect_list("v")).alias("examples"))
    return out.groupBy("kind").agg(F.count("*").alias("n")).join(few, "kind")


def dissemination_edges(instances: DataFrame, order: Sequence[str]) -> DataFrame:
    """(src, dst, elapsed): every instance to the next one in time; elapsed is the later one's.

    instances: id, ts, elapsed. Missing times come first, as empty ones do.
    """
    placed = numbered(instances.withColumn("ts", F.coalesce("ts", F.lit(""))), order, "_n")
    after = placed.select((F.col("_n") - 1).alias("_n"), F.col("id").alias("dst"), "elapsed")
    return placed.select("_n", F.col("id").alias("src")).join(after, "_n").select("src", "dst", "elapsed")


def pivot_sift(candidates: DataFrame, order: str) -> DataFrame:
    """Candidates that are a partial crop, have 15 inliers at a ratio of 0.15, or a hash distance of 55 at most; the first of each hash."""
    partial = F.col("crop_type").isin("target_is_crop_of_candidate", "candidate_is_crop_of_target")
    close = partial | ((F.col("inlier_count") >= 15) & (F.col("inlier_ratio") >= 0.15)) | (F.col("distance") <= 55)
    return first_of(candidates.where(F.coalesce(close, F.lit(False)) & F.col("hash").isNotNull()), ["hash"], [order], 1)


def ratio_matches(distances: DataFrame, query: str, target: str, distance: str, ratio: float = 0.75) -> DataFrame:
    """(query, target, distance): the nearest target of each query that is nearer than `ratio` times the second; queries with one target have no match."""
    w = Window.partitionBy(query).orderBy(distance, target)
    two = distances.withColumn("_r", F.row_number().over(w)).where("_r <= 2")
    best = two.groupBy(query).agg(F.min_by(target, "_r").alias(target), F.min_by(distance, "_r").alias(distance), F.max_by(distance, "_r").alias("_second"), F.max("_r").alias("_n"))
    return best.where((F.col("_n") == 2) & (F.col(distance) < ratio * F.col("_second"))).select(query, target, distance)


def match_decision() -> Column:
    """{crop_type, is_match} of columns about a planar fit: spans, insides, coverages, boxes, scale, inliers and hash distance.

    Wants: src_x, src_y, dst_x, dst_y (spans as shares), target_inside, candidate_inside,
    scale_ok, coverage_t, coverage_c, box_t, box_c ({w, h}), area_t, area_c,
    distance, inliers, ratio.
    """
    # fixed values: the thresholds of spans, coverages, boxes and inliers
    wide = lambda x, y, area, longest, shortest: (x * y >= area) & (F.greatest(x, y) >= longest) & (F.least(x, y) >= shortest)
    src, dst = (F.col("src_x"), F.col("src_y")), (F.col("dst_x"), F.col("dst_y"))
    big = lambda box, area: (F.col(box)["w"] >= 80) & (F.col(box)["h"] >= 80) & (F.col(box)["w"] * F.col(box)["h"] >= 0.04 * F.col(area))
    inside_c = F.col("target_inside") & F.col("scale_ok") & wide(*src, 0.025, 0.18, 0.08) & (~F.col("candidate_inside") | (F.col("coverage_t") < 0.90)) & big("box_t", "area_c")
    inside_t = F.col("candidate_inside") & F.col("scale_ok") & wide(*dst, 0.025, 0.18, 0.08) & (~F.col("target_inside") | (F.col("coverage_c") < 0.90)) & big("box_c", "area_t")
    whole = wide(*src, 0.04, 0.22, 0.0) & wide(*dst, 0.04, 0.22, 0.0) & ((F.col("distance") <= 42) | ((F.col("inliers") >= 35) & (F.col("ratio") >= 0.40)))
    crop = F.when(inside_c, "target_is_crop_of_candidate").when(inside_t, "candidate_is_crop_of_target").when(whole, "exact").otherwise("none")
    return F.struct(crop.alias("crop_type"), (crop != "none").alias("is_match"))


def fingerprint_ranking(matches: DataFrame, query: str, preferred: str | Column | None) -> DataFrame:
    """(query, device, score, correlation, template, confidence, rank, trusted): the best template of each device.

    matches: query, device, template ("reference", "original" or a platform),
    correlation. References weigh 1, original templates 0.96, others 0.9; the
    preferred platform's get 0.015 more. Confidence is the share of what lies
    above the least score; a query is trusted if its best correlation is 0.03
    and its lead 0.01 at least.
    """
    # fixed values: weights, bonus and the least correlation and lead
    t = F.col("template")
    bonus = F.when(t == F.lit(preferred), 0.015).otherwise(0.0)
    score = F.when(t == "reference", F.col("correlation")).otherwise(F.col("correlation") * F.when(t == "original", 0.96).otherwise(0.9) + bonus)
    best = first_of(matches.withColumn("score", score), [query, "device"], [F.desc("score"), "template"], 1)
    all_ = Window.partitionBy(query)
    best = best.withColumn("_low", F.col("score") - F.min("score").over(all_)).withColumn("_sum", F.sum("_low").over(all_))
    best = best.withColumn("confidence", F.when(F.col("_sum") > 1e-9, F.col("_low") / F.col("_sum")).otherwise(1 / F.count("*").over(all_)))
    order = Window.partitionBy(query).orderBy(F.desc("confidence"), F.desc("score"), F.desc("correlation"), "device")
    best = best.withColumn("rank", F.row_number().over(order)).withColumn("_next", F.coalesce(F.lead("score").over(order), F.lit(-1.0)))
    trust = F.when(F.col("rank") == 1, (F.col("correlation") >= 0.03) & (F.col("score") - F.col("_next") >= 0.01))
    return best.withColumn("trusted", F.max(trust).over(all_)).select(query, "device", "score", "correlation", "template", "confidence", "rank", "trusted")
