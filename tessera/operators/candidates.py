"""Search candidates: gates, first-wins dedup, chronology, graphs and scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tessera.operators import folds

from tessera.functions.urls import public_url
from tessera.operators.running import numbered

#: Media verification results and timestamp types that count.
VERIFIED = ("exact", "near_duplicate")
USABLE_TIMES = ("published", "platform_decoded", "archive_observed")


def is_verified(reserved: Sequence[str] = ()) -> Column:
    """Public URL, not synthetic, verified status and a verified medium."""
    return F.coalesce(public_url(F.col("post_url"), reserved, ()) & ~F.coalesce("is_synthetic", F.lit(False)) & (F.col("evidence_status") == "verified") & F.col("media_verification").isin(*VERIFIED), F.lit(False))


def has_usable_time() -> Column:
    return F.coalesce(F.col("timestamp_type").isin(*USABLE_TIMES) & F.col("published_at").isNotNull(), F.lit(False))


def first_wins(df: DataFrame, keys: Sequence[Column | str], order: Sequence[str]) -> DataFrame:
    """The first row of every key in the given order."""
    r = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_r", r).where("_r = 1").drop("_r")


def dedup_key() -> Column:
    """The URL, else platform, account and the first 30 characters of the title."""
    return F.when(F.coalesce("post_url", F.lit("")) != "", F.col("post_url")).otherwise(F.concat_ws(":", "platform", "account", F.substring(F.coalesce("title", F.lit("")), 1, 30)))


def elapsed_text(seconds: Column) -> Column:
    """+0m up to a minute, +Nm below an hour, +Hh MMm beyond."""
    s = F.floor(seconds).cast("long")
    h, m = F.floor(s / 3600).cast("long"), F.floor(F.pmod(s, F.lit(3600)) / 60).cast("long")
    return F.when(s <= 60, "+0m").when(h < 1, F.format_string("+%dm", m)).otherwise(F.format_string("+%dh %02dm", h, m))


def chronology(cands: DataFrame, min_similarity: float = 0.3, floor_date: Column | None = None, reserved: Sequence[str] = ()) -> DataFrame:
    """Verified publications in order: rank, role, platform, account, post_url, ts, elapsed_sec, elapsed, similarity, confidence.

    Gates come first, then first-wins dedup in input order (_ord), so an earlier
    row shadows a later one even if it is then dropped for its similarity or
    for lying before the floor date.
    """
    rows = cands.where(is_verified(reserved) & has_usable_time())
    rows = first_wins(rows, [dedup_key()], ["_ord"])
    sim = F.coalesce("similarity", F.lit(0.5))
    rows = rows.where((sim >= min_similarity) | F.col("media_verification").isin(*VERIFIED))
    if floor_date is not None:
        rows = rows.where(F.col("published_at") >= floor_date)
    # places come from a range partition and its running total, the first time from an aggregate of one row
    rows = numbered(rows, ["published_at", "_ord"], "rank").withColumn("rank", F.col("rank").cast("int"))
    first = rows.agg(F.min("published_at").alias("_first"))
    rows = rows.crossJoin(F.broadcast(first)).withColumn("elapsed_sec", F.col("published_at").cast("double") - F.col("_first").cast("double"))
    hours = F.col("elapsed_sec") / 3600
    role = F.when(F.col("rank") == 1, "primary_origin").when(hours <= 2, "early_reporting").when(hours <= 24, "viral_spread").otherwise("current_circulation")
    sure = F.when((F.col("media_verification") == "exact") & F.col("timestamp_type").isin(*USABLE_TIMES), "high").otherwise("moderate")
    return rows.select("rank", role.alias("role"), "platform", "account", "post_url", F.col("published_at").alias("ts"), "elapsed_sec", elapsed_text(F.col("elapsed_sec")).alias("elapsed"), sim.alias("similarity"), sure.alias("confidence"))


def circulation(publications: DataFrame, listed: int = 50) -> DataFrame:
    """One row: tracked, span_hours (0.1 at least), velocity, platforms among the first `listed`."""
    span = F.greatest(F.lit(0.1), (F.max("ts").cast("double") - F.min("ts").cast("double")) / 3600)
    return publications.agg(
        F.count("*").alias("tracked"), span.alias("span_hours"), (F.count("*") / span).alias("velocity"),
        F.count_distinct(F.when(F.col("rank") <= listed, F.col("platform"))).alias("listed_platforms"), F.count_if(F.col("rank") <= listed).alias("listed"),
    )


def account_graph(rows: DataFrame, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Vertices (account, last attributes win) and edges from each account to the next one in the order, distinct, without loops."""
    last = Window.partitionBy("account").orderBy(*[F.desc(c) for c in order])
    vertices = rows.withColumn("_r", F.row_number().over(last)).where("_r = 1").select("account", "platform", "ts")
    placed = numbered(rows.select("account", *order), order, "_n")
    after = placed.select((F.col("_n") - 1).alias("_n"), F.col("account").alias("dst"))
    edges = placed.select("_n", F.col("account").alias("src")).join(after, "_n").where("src <> dst").select("src", "dst").distinct()
    return vertices, edges


def temporal_weights(earliest: Column, now: Column) -> Column:
    """(kind, publication weight, relevance weight): 48 hours and older count recency less."""
    old = (now.cast("double") - earliest.cast("double")) / 3600 >= 48
    return F.struct(F.when(old, "older").otherwise("new").alias("kind"), F.when(old, 0.3).otherwise(0.7).alias("internal"), F.when(old, 0.7).otherwise(0.3).alias("external"))


def anchor_score(event: Column, image: Column, text: Column, has_media: Column) -> Column:
    """Calibrated anchors fused by what is there; rounded, with a boost for media."""
    cal = lambda v, lo, hi: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - lo) / (hi - lo)))
    e, i, t = cal(event, 0.45, 0.75), cal(image, 0.16, 0.32), cal(text, 0.55, 0.90)
    raw = (
        F.when(event.isNotNull() & image.isNotNull(), 0.15 + 0.80 * (0.65 * e + 0.35 * i)).when(event.isNotNull(), 0.15 + 0.80 * e)
        .when(image.isNotNull(), 0.15 + 0.80 * i).when(text.isNotNull(), 0.15 + 0.80 * t).otherwise(F.lit(0.15))
    )
    base = F.bround(F.least(F.lit(0.98), F.greatest(F.lit(0.05), raw)), 3)
    return F.when(has_media, F.bround(F.least(F.lit(0.98), base + 0.05), 3)).otherwise(base)


#: Parts of host names that earn the larger and the smaller bonus.
WIRES = ("apnews", "reuters", "getty", "afp", "pti", "nyt", "nytimes", "ap.org", "bloomberg", "bwbx", "abcnews", "politico", "wsj", "washingtonpost")
OUTLETS = ("bbc", "thehindu", "indianexpress", "tribuneindia", "firstpost", "cnn")


def _any_in(text: Column, parts: Sequence[str]) -> Column:
    return F.exists(F.array(*map(F.lit, parts)), lambda w: F.contains(text, w))


def path_cost(depth: Column) -> Column:
    """Cost of a match by crop type and hash distance."""
    d, ratio = F.col("pdq_distance"), F.col("inlier_ratio")
    return (
        F.when((F.col("crop_type") == "exact") | (d <= 30), d / 10 + depth * 0.5)
        .when(F.col("crop_type") == "target_is_crop_of_candidate", 5 + (1 - F.least(F.lit(1.0), ratio)) * 5 + depth * 0.5)
        .when(F.col("crop_type") == "candidate_is_crop_of_target", 45 + depth * 2.0)
        .when(F.col("is_match"), 12 + d / 20 + depth * 1.0)
        .otherwise(150 + F.least(F.lit(50.0), d.cast("double")))
    )


def origin_distance(target_ts: Column, target_area: Column) -> Column:
    """Heuristic distance to the origin: earlier, larger and authoritative candidates are nearer; never below 0."""
    ts, area = F.col("ts"), (F.col("width") * F.col("height")).cast("double")
    days = (target_ts.cast("double") - ts.cast("double")) / 86400
    log2 = lambda x: F.log2(F.greatest(F.lit(1.0), x))
    temporal = (
        F.when(ts.isNull(), 0.0).when(target_ts.isNull(), -F.least(F.lit(10.0), F.greatest(F.lit(0.0), 2026.0 - F.year(ts)) * 1.5))
        .when(days > 0, -F.least(F.lit(12.0), 3 + log2(days))).when(days < 0, F.least(F.lit(15.0), 3 + F.abs(days) / 60 * 1.5)).otherwise(0.0)
    )
    age = (F.lit(1767225600.0) - ts.cast("double")) / 86400
    senior = F.when(ts.isNull(), 0.0).otherwise(-F.least(F.lit(8.0), age / 365 * 1.5))
    size = (
        F.when((area > target_area) & (target_area > 0), -F.least(F.lit(12.0), 4 * log2(area / target_area)))
        .when((area < target_area) & (area > 0), F.least(F.lit(10.0), 3 * log2(target_area / area))).otherwise(0.0)
    )
    d = F.lower("domain")
    wire = F.when(F.col("is_wire") | _any_in(d, WIRES), -18.0).when(_any_in(d, OUTLETS), -8.0).otherwise(0.0)
    return F.greatest(F.lit(0.0), 45 + temporal + senior + size + wire)


def origin_confidence(target_ts: Column, target_area: Column, earliest: Column) -> Column:
    """Additive evidence that a candidate is the origin, 0.05 to 0.99; 0 without a match."""
    d, n, ts = F.col("pdq_distance"), F.col("inlier_count"), F.col("ts")
    area = (F.col("width") * F.col("height")).cast("double")
    crop = (
        F.when(F.col("crop_type") == "target_is_crop_of_candidate", 0.35).when((F.col("crop_type") == "exact") | (d <= 30), 0.20)
        .when(F.col("is_match") & (n >= 18), 0.15).when(F.col("crop_type") == "candidate_is_crop_of_target", -0.20).otherwise(0.0)
    )
    inliers = F.when(n >= 1000, 0.10).when(n >= 100, 0.05).when((n < 20) & (d > 30), -0.10).otherwise(0.0)
    size = F.when(area >= 3.5 * target_area, 0.20).when(area >= 1.8 * target_area, 0.12).when(area > target_area, 0.06).when((area < 0.5 * target_area) & (d > 10), -0.10).otherwise(0.0)
    wire = F.when(F.col("is_wire") | _any_in(F.lower("domain"), (*WIRES, "bbc")), 0.25).otherwise(0.0)
    early = F.coalesce(F.year(ts) <= 2021, F.lit(False))
    senior = F.when(F.coalesce(ts < target_ts, F.lit(False)), 0.10 + F.when(early, 0.05).otherwise(0.0)).when(early, 0.05).otherwise(0.0)
    late = ts.cast("double") - earliest.cast("double")
    penalty = F.when(F.coalesce(late > 43200, F.lit(False)), F.least(F.lit(0.30), 0.15 + 0.05 * F.log2(F.greatest(F.lit(1.0), late / 86400)))).otherwise(0.0)
    score = crop + inliers + size + wire + senior - penalty
    return F.when(~F.col("is_match") & (d > 30), 0.0).otherwise(F.bround(F.least(F.lit(0.99), F.greatest(F.lit(0.05), score)), 4))


def capped_union(df: DataFrame, query: str, bucket: str, order: Sequence[str], priority: Sequence[str], caps: dict[str, int], most: int) -> DataFrame:
    """Rows bucket by bucket in priority order, each up to its cap, `most` in all, with place."""
    rank = F.row_number().over(Window.partitionBy(query, bucket).orderBy(*order))
    cap = None
    for b, c in caps.items():
        cap = F.when(F.col(bucket) == b, c) if cap is None else cap.when(F.col(bucket) == b, c)
    pri = F.array_position(F.array(*map(F.lit, priority)), F.col(bucket))
    rows = df.withColumn("_r", rank).where((F.col("_r") <= cap) if cap is not None and set(caps) == set(priority) else (cap.isNull() | (F.col("_r") <= cap)))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(query).orderBy(pri, *order))).where(F.col("place") <= most).drop("_r")


def best_per_key(df: DataFrame, key: str, score: str, tie: str) -> DataFrame:
    """The row of the highest score of every key; the first by tie among equals."""
    r = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), tie))
    return df.withColumn("_r", r).where("_r = 1").drop("_r")


#: Parts of links and labels that tell an agency or a large outlet.
WIRE_PARTS = ("bloomberg", "bwbx", "reuters", "apnews", "ap.org", "getty", "afp", "pti", "nyt", "nytimes", "washingtonpost", "wsj", "bbc", "politico", "abcnews", "cnn", "businessinsider", "epa.eu", "upi")


def lens_hits(items: DataFrame, query: str, order: str, most: int = 35, matches: int = 20, articles: int = 15) -> DataFrame:
    """Hits of a reverse image search, in the order in which they count, with place.

    items: query, order, bucket (exact-match, visual-match or any other, which
    counts as "all"), link, label, thumbnail. First agencies of all buckets come,
    all of them; then up to `matches` exact and visual matches, then up to `articles`
    others, until there are `most`. A hit goes if its link or its thumbnail was
    taken before. That rule needs the hits taken so far: each row stands once in the turn of agencies, if
    it is one, and once in that of its bucket, and a walk in that order holds what one search has taken.
    """
    link, label = F.coalesce("link", F.lit("")), F.coalesce("label", F.lit(""))
    own = F.coalesce(F.col("bucket").isin("exact-match", "visual-match"), F.lit(False))
    wire = _any_in(F.lower(F.concat_ws(" ", link, label)), WIRE_PARTS)
    among = F.when(own, F.when(F.col("bucket") == "exact-match", 1).otherwise(2)).otherwise(0)  # of agencies, the other buckets come first
    places = F.array_compact(F.array(F.when(wire, F.struct(F.lit(0).alias("turn"), among.alias("within"))), F.struct(F.when(own, 1).otherwise(2).alias("turn"), among.alias("within"))))
    d = items.where(link != "").withColumn("_p", F.explode(places)).withColumn("_turn", F.col("_p.turn")).withColumn("_within", F.col("_p.within")).drop("_p")
    caps = {1: matches, 2: articles}

    def start():
        seen: set[str] = set()
        tried, taken = {1: 0, 2: 0}, 0

        def step(turn: int, url: str, thumb: str | None) -> int | None:
            nonlocal taken
            if turn:
                if tried[turn] >= caps[turn] or taken >= most or url in seen:
                    return None
                tried[turn] += 1
            keys = {url, thumb} if thumb else {url}
            if keys & seen:
                return None
            seen.update(keys)
            taken += 1
            return taken

        return step

    return folds.filtered(d, query, ["_turn", "_within", order], ["_turn", "link", "thumbnail"], start, drop=("_turn", "_within"), added=T.StructField("place", T.IntegerType()))
