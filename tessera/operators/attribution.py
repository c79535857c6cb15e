"""Lookups, as-of joins, fingerprints, trails, harvests and registries of media attribution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions.pages import bound
from tessera.operators.audits import first_of
from tessera.operators.scans import dealt, scan


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], ts: str, order: str, value: str) -> DataFrame:
    """left with `value`: that of the last right row of the same key at or before its time; null if there is none.

    Both sides are put in one sequence a key, right rows first at equal times, and scanned for the last
    value (`scans`), so there is no join on a range and a key's rows spread over tasks.
    """
    a = left.select(*by, ts, order, F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    b = right.select(*by, ts, order, F.lit(0).alias("_side"), F.col(value).alias("_v"))
    along = [ts, "_side", order]
    return scan(dealt(a.unionByName(b), by, along), by, along, {value: ("last", "_v")}).where("_side = 1").select(*by, ts, order, value)


def tick_sampler(frames: DataFrame, by: Sequence[str], ts: str, per_second: float, order: str) -> DataFrame:
    """Frames that a sampler takes whose next tick moves on by one period a frame taken, never more (so it catches up after a gap).

    Of the ticks due by frame j (c_j), one a frame can be taken, so up to frame i
    min(0, min over j <= i of (c_j - j)) + i are; frame i is taken where that number grows, which
    is where c_i - i is not below the minimum so far.
    """
    along = [ts, order]
    d = scan(dealt(frames, by, along), by, along, {"_i": ("sum", F.lit(1).cast("long"))})
    d = d.withColumn("_d", F.floor((F.col(ts).cast("double") + 1e-9) * per_second) + 1 - F.col("_i"))
    d = scan(d, by, along, {"_m": ("min_before", "_d")})
    return d.where(F.col("_d") >= F.least(F.coalesce("_m", F.lit(0).cast("long")), F.lit(0).cast("long"))).select(*frames.columns)


def known_similarity(by_key: Column, by_url: Column, own: Column) -> Column:
    """The similarity found by normalised key (0 counts as none), else by URL, else the row's own, else 0.5."""
    return F.coalesce(F.nullif(by_key, F.lit(0.0)), by_url, own, F.lit(0.5))


def once(value: Column, body) -> Column:
    """body(value) with the value computed once a row, also where a lambda uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalized(v: Column) -> Column:
    """An array with mean 0 and, unless it is flat, population deviation 1."""
    d = v.cast("array<double>")
    mean = F.aggregate(d, F.lit(0.0), lambda s, x: s + x) / F.size(d)
    centred = once(mean, lambda m: F.transform(d, lambda x: x - m))

    def scaled(c: Column) -> Column:
        std = F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x) / F.size(c))
        return once(F.when(std > 1e-8, std).otherwise(1.0), lambda k: F.transform(c, lambda x: x / k))

    return once(centred, scaled)


def mean_fingerprints(df: DataFrame, by: Sequence[str], vector: str, least: int = 1) -> DataFrame:
    """(by, n, fingerprint): the mean of the vectors, brought to mean 0 and deviation 1, of groups of `least` or more.

    Sums a position meet before the shuffle; no task holds a group's vectors.
    """
    d = df.where(F.col(vector).isNotNull())
    means = d.select(*by, F.posexplode(vector).alias("pos", "x")).groupBy(*by, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("_n"))
    lists = means.groupBy(*by).agg(F.max("_n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("m"))
    return lists.where(F.col("n") >= least).select(*by, "n", normalized(F.col("m")).alias("fingerprint"))


def array_fingerprint(*arrays: str) -> Column:
    """One hash of arrays by content and length; equal arrays, equal hashes."""
    return F.sha2(F.to_json(F.struct(*arrays), {"ignoreNullFields": "false"}), 256)


def event_profile(texts: DataFrame, by: str, text: str, description: str, patterns: dict[str, Sequence[str]], corpus_hits: int = 3, description_hits: int = 2) -> DataFrame:
    """(by, event, hits): of the known events, that with the most keywords in a group's texts; the first named wins ties.

    It needs corpus_hits keywords over all texts, or description_hits in the description.
    """
    marks = [F.max(F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(k))).alias(f"{s}_{e}_{i}") for e, (_, ks) in enumerate(patterns.items()) for i, k in enumerate(ks) for s, c in (("t", text), ("d", description))]
    found = texts.groupBy(by).agg(*marks)
    rows = []
    for e, (name, ks) in enumerate(patterns.items()):
        n = lambda f: sum((f(i).cast("int") for i in range(len(ks))), F.lit(0))  # noqa: E731, B023
        said = n(lambda i: F.col(f"d_{e}_{i}"))  # noqa: B023
        whole = n(lambda i: F.col(f"t_{e}_{i}") | F.col(f"d_{e}_{i}"))  # noqa: B023
        rows.append(F.when((whole >= corpus_hits) | (said >= description_hits), F.struct(whole.alias("hits"), F.lit(-e).alias("o"), F.lit(name).alias("event"))))
    best = F.array_max(F.array_compact(F.array(*rows)))
    return found.select(by, best.alias("b")).where("b is not null").select(by, "b.event", "b.hits")


def platform_trail(items: DataFrame, case: str, order: str) -> DataFrame:
    """(case, trail, last, confidence, basis) of a case's files (date, platform, confidence): platforms in the order of their dates, repeats joined.

    With fewer than two dates the input order counts. A case is the files of one upload.
    """
    dated = F.count("date").over(Window.partitionBy(case)) >= 2
    d = items.withColumn("_dated", dated).withColumn("_key", F.when(F.col("_dated"), F.struct(F.col("date").isNull().alias("n"), F.coalesce("date", F.lit("")).alias("d"), F.col(order).cast("long").alias("o"))).otherwise(F.struct(F.lit(False).alias("n"), F.lit("").alias("d"), F.col(order).cast("long").alias("o"))))
    w = Window.partitionBy(case).orderBy("_key")
    label = F.coalesce("platform", F.lit("unknown"))
    d = d.withColumn("_new", F.coalesce(F.lag(label).over(w) != label, F.lit(True)))
    steps = F.transform(F.array_sort(F.collect_list(F.when(F.col("_new"), F.struct("_key", label.alias("l"))))), lambda x: x["l"])
    return d.groupBy(case).agg(
        F.array_join(steps, " -> ").alias("trail"), F.max_by("platform", "_key").alias("last"), F.coalesce(F.avg(F.when(F.col("platform").isNotNull(), F.col("confidence"))), F.lit(0.0)).alias("confidence"),
        F.when(F.first("_dated"), "timestamp").otherwise("upload_order").alias("basis"),
    )


#: What names and software of each platform's downloads look like.
PLATFORM_PATTERNS = {
    "whatsapp": r"\bwhatsapp\b|\bimg-\d{8}-wa\d+\b|\bwa\d{4,}\b|whatsapp[ _-]image", "instagram": r"\binstagram\b|instagram[_-]|\binsta\b|\big[_-]|\binstagram[ _-]image\b",
    "facebook": r"\bfacebook\b|facebook[_-]|\bfb_img\b|\bmessenger\b|\bfbstaging\b", "reddit": r"\breddit\b|reddit[_-]|\brdt[_-]|\bi\.redd\.it\b|\bredditsave\b",
    "telegram": r"\btelegram\b|\bphoto_\d{4}-\d{2}-\d{2}\b", "x": r"\btwitter\b|\btweet\b|\bx\.com\b",
}


def platform_hints(name: Column, software: Column) -> Column:
    """Array of {label, score}: platforms whose patterns a name or software matches; more if the software does."""
    s, both = F.lower(F.coalesce(software, F.lit(""))), F.lower(F.concat_ws(" ", name, software))
    hint = lambda k, p: F.when(both.rlike(p), F.struct(F.lit(k).alias("label"), (F.lit(0.78 if k in ("whatsapp", "facebook") else 0.72) + F.when(s.rlike(p), 0.08).otherwise(0.0)).alias("score")))
    return F.array_compact(F.array(*[hint(k, p) for k, p in PLATFORM_PATTERNS.items()]))


def harvested(images: DataFrame, query: str, order: str, least_side: int = 150, most: int = 50) -> DataFrame:
    """Images of least_side pixels or more, the first of each content hash a query, the first `most` of a query."""
    large = images.where((F.col("width") >= least_side) & (F.col("height") >= least_side) & F.col("sha256").isNotNull())
    return first_of(first_of(large, [query, "sha256"], [order], 1), [query], [order], most)


def neighbours(frontier: DataFrame, edges: DataFrame, reached: DataFrame, most: int) -> DataFrame:
    """(node, parent, url, domain, hash) of pages that the frontier links to: not reached, the first of each (domain, hash), at most `most` a parent.

    frontier: node; edges: src, dst, url, domain, hash, priority; reached: node.
    """
    new = frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), F.col("src").alias("parent"), "url", "domain", "hash", "priority").join(reached.select("node"), "node", "left_anti")
    capped = first_of(first_of(new, ["node"], ["priority", "parent"], 1), ["domain", "hash"], ["priority", "node"], 1)
    return first_of(capped, ["parent"], ["priority", "node"], most).drop("priority")


def contained(path: Column, root: Column) -> Column:
    """Whether a path lies below a folder, without steps upwards."""
    return F.coalesce(F.startswith(path, F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"))) & ~path.rlike(r"(^|/)\.\.(/|$)"), F.lit(False))


def artifact_registry(files: DataFrame, root: str) -> DataFrame:
    """(case, key, url, media_type, sha256) of files (case, key, path, sha256) with a proper key inside their case's folder; the last by path wins a key."""
    ok = F.col("key").rlike("^[a-z0-9][a-z0-9_.-]*$") & contained(F.col("path"), F.concat(F.lit(root.rstrip("/") + "/"), F.col("case")))
    kinds = {"png": "image/png", "jpg": "image/jpeg", "json": "application/json", "csv": "text/csv", "mp4": "video/mp4"}
    end, kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)), F.lit("application/octet-stream")
    for e, k in kinds.items():
        kind = F.when(end == e, k).otherwise(kind)
    good = first_of(files.where(F.coalesce(ok, F.lit(False))), ["case", "key"], [F.desc("path")], 1)
    return good.select("case", "key", F.concat_ws("/", F.lit("/api/v1/investigations"), "case", F.lit("artifacts"), "key").alias("url"), kind.alias("media_type"), "sha256")


def retrain_recommended(auc: Column, detection: Column, false_positives: Column) -> Column:
    """By the first figure there is: an AUC below 0.85, a detection rate below 0.5, or a false-positive rate above 0.3."""
    # fixed values
    return F.when(auc.isNotNull(), auc < 0.85).when(detection.isNotNull(), detection < 0.5).when(false_positives.isNotNull(), false_positives > 0.3).otherwise(F.lit(False))


def detection_summary(frames: DataFrame, sample: str) -> DataFrame:
    """(sample, frames, detected, detection_rate, mean_ear, mean_mouth) of per-frame rows (detected, ear, mouth)."""
    hit = F.coalesce(F.col("detected"), F.lit(False))
    return frames.groupBy(sample).agg(
        F.count("*").alias("frames"), F.count_if(hit).alias("found"), (F.count_if(hit) / F.count("*")).alias("detection_rate"), F.avg(F.when(hit, F.col("ear"))).alias("mean_ear"), F.avg(F.when(hit, F.col("mouth"))).alias("mean_mouth"),
    )


def file_vector(size: Column, width: Column, height: Column, exif: Column, tags: Column, tables: Column, places: int = 128) -> Column:
    """Eleven numbers of a file and its quantisation tables, then the first `places` table values over 255, zeros behind them."""
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    w, h = zero(width), zero(height)
    mean = lambda a, of=lambda v: v: F.coalesce(F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, x: s + of(x)), F.size(a)), F.lit(0.0))
    upper = lambda some: F.when(F.size(some) > 32, F.slice(some, 33, 1 << 20)).otherwise(some)
    spread = lambda some, m: F.sqrt(F.greatest(F.lit(0.0), mean(some, lambda v: v * v) - m * m))
    megapixels = F.greatest(F.lit(1.0), w * h) / 1e6
    own = F.array(F.log1p(zero(size)) / 16, w / 8000, h / 8000, F.coalesce(F.try_divide(w, h), F.lit(0.0)), F.log1p(zero(size) / megapixels) / 16, F.coalesce(exif, F.lit(False)).cast("double"), zero(tags) / 80)
    count = lambda tables: F.array(F.size(F.coalesce(tables, F.array().cast("array<array<int>>"))) / 4.0)
    flat = lambda tables: F.coalesce(F.flatten(F.transform(tables, lambda t: F.slice(t, 1, 64))), F.array().cast("array<int>")).cast("array<double>")
    # means of tables, each array worked out once
    means = lambda flat: bound(F.filter(flat, lambda v: v > 0), lambda some: bound(mean(some), lambda m: F.array(m / 255, spread(some, m) / 255, bound(upper(some), lambda high: mean(high)) / 255)))
    shares = lambda flat: F.slice(F.concat(F.transform(F.slice(flat, 1, places), lambda v: v / 255), F.array_repeat(F.lit(0.0), places)), 1, places)
    return bound(tables, lambda tables: bound(flat(tables), lambda flat: F.concat(own, count(tables), means(flat), shares(flat))))


def reverse_hits(pages: DataFrame, key: str, html: str, own: Sequence[str] = ("yandex.com", "yandex.ru")) -> DataFrame:
    """(key, place, post_url, title, platform, tags) of a reverse image search's result page: items whose first link leaves the engine's own hosts.

    Items are elements with a class of result sites; tags are the page's first five labels.
    """
    # fixed values: the class names of results and tags, and the hosts of platforms; an item ends at the first closing tag of its kind
    item = r"""(?is)<(?:li|div)[^>]*class=["'][^"']*(?:CbirSites|CbirItem|SerpItem)[^"']*["'][^>]*>(.*?)</(?:li|div)>"""
    tag = r"""(?is)<[a-z]+[^>]*class=["'][^"']*Tags-Item[^"']*["'][^>]*>([^<]*)<"""
    labels = F.slice(F.filter(F.transform(F.regexp_extract_all(html, F.lit(tag), 1), lambda t: F.trim(t)), lambda t: t != ""), 1, 5)
    rows = pages.select(key, labels.alias("tags"), F.posexplode(F.regexp_extract_all(html, F.lit(item), 1)).alias("place", "item"))
    href = F.regexp_extract("item", r"""(?is)<a[^>]*href=["']([^"']+)["']""", 1)
    title = F.trim(F.regexp_replace(F.regexp_extract("item", r"""(?is)<a[^>]*>(.*?)</a>""", 1), r"<[^>]*>", " "))
    d = rows.withColumn("post_url", href).where(F.col("post_url").startswith("http"))
    for host in own:
        d = d.where(~F.contains("post_url", F.lit(host)))
    kinds = {"instagram.com": "instagram", "twitter.com": "x", "x.com": "x", "reddit.com": "reddit", "vk.com": "vk", "youtube.com": "youtube", "youtu.be": "youtube"}
    platform = F.lit("web")
    for part, name in reversed(kinds.items()):
        platform = F.when(F.contains("post_url", F.lit(part)), name).otherwise(platform)
    return d.select(key, "place", "post_url", F.coalesce(F.nullif(F.substring(title, 1, 140), F.lit("")), F.lit("Visual Match on Web")).alias("title"), platform.alias("platform"), "tags")
