"""Queries of audits between manifests, reverse-search hits, matches, pages and search responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import pages as pg
from tessera.operators import audits as au, candidates as c, lineage, pairs
from tessera.plans.evidence_plans import nodes, NODES
from tessera.plans.metric_plans import r6
from tessera.plans.record_plans import made, sql
from tessera.plans.registry import register, table
from tessera.session import spread
from tessera.sources import connectors as cn

C = F.col

FRAMES = {"o_custkey": "o_custkey", "i": "o_orderkey", "ts": "CAST(o_orderkey AS DOUBLE) / 4"}
OTHER = {"o_custkey": "o_custkey", "i": "CASE WHEN o_orderkey % 91 = 7 THEN -o_orderkey ELSE o_orderkey END", "ts": "CAST(o_orderkey AS DOUBLE) / 4 + CASE WHEN o_orderkey % 83 = 5 THEN 0.01 ELSE 0 END"}


@register("join_total", f"""WITH l AS (SELECT {', '.join(f'{e} AS {n}' for n, e in FRAMES.items())} FROM orders), {sql('orders', OTHER)}, b AS (SELECT l.o_custkey, l.i, l.ts, r.i AS ri, r.ts AS rts FROM l LEFT JOIN r ON l.o_custkey = r.o_custkey AND l.i = r.i)
SELECT o_custkey, count(*) AS rows, CASE WHEN NOT bool_and(ri IS NOT NULL) THEN 'index_missing' WHEN max(abs(ts - rts)) > 1e-5 THEN 'timestamp_mismatch' END AS reason FROM b GROUP BY o_custkey""")
def total(spark, sf_dir):
    return au.total_join(made(spark, sf_dir, "orders", FRAMES), made(spark, sf_dir, "orders", OTHER), "o_custkey", "i")


LINKED = {"event_id": "event_id", "identity": "'id' || CAST(user_id AS STRING)", "other": "CASE WHEN event_id % 9 = 0 THEN 'id' || CAST(user_id + 1 AS STRING) WHEN event_id % 31 = 3 THEN 'idx' END", "split": "CASE WHEN user_id % 4 = 0 THEN 'dev' ELSE 'train' END"}


@register("audit_link_leakage", f"""WITH {sql('events', LINKED)}, k AS (SELECT DISTINCT identity, split FROM r), e AS (SELECT DISTINCT event_id, split, unnest([identity, other]) AS linked_identity FROM r)
SELECT event_id, linked_identity, k.split AS linked_split FROM e LEFT JOIN k ON k.identity = linked_identity WHERE linked_identity IS NOT NULL AND (k.split IS NULL OR k.split <> e.split)""")
def link_leakage(spark, sf_dir):
    return au.link_leakage(made(spark, sf_dir, "events", LINKED), "event_id", "identity", F.array_compact(F.array("other")), "split")


MANIFESTS = {"side": "CASE WHEN event_id % 3 = 0 THEN 'held' ELSE 'train' END", "sample_id": "CAST(event_id AS STRING)", "identity": "'id' || CAST(user_id * 2 + CASE WHEN event_id % 3 = 0 AND user_id % 7 > 0 THEN 1 ELSE 0 END AS STRING)", "component_id": "'c' || CAST(user_id % 5 AS STRING)", "link": "'id' || CAST(user_id * 2 + CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS STRING)"}


@register("audit_manifest_overlaps", f"""WITH {sql('events', MANIFESTS)}, t AS (SELECT * FROM r WHERE side = 'train'), h AS (SELECT * FROM r WHERE side = 'held'),
x AS (""" + " UNION ALL ".join(f"SELECT '{k}' AS kind, v FROM (SELECT DISTINCT {a} AS v FROM t INTERSECT SELECT DISTINCT {b} FROM h)" for k, a, b in [("sample_id", "sample_id", "sample_id"), ("identity", "identity", "identity"), ("component_id", "component_id", "component_id"), ("linked_identity", "link", "link"), ("train_identity_in_held_links", "identity", "link"), ("held_identity_in_train_links", "link", "identity")]) + """)
SELECT kind, count(*) AS n, array_to_string(list_sort(list(v))[1:20], ',') AS examples FROM x GROUP BY kind""")
def overlaps(spark, sf_dir):
    d = made(spark, sf_dir, "events", MANIFESTS).withColumn("links", F.array("link"))
    return au.manifest_overlaps(d.where("side = 'train'"), d.where("side = 'held'")).select("kind", "n", F.array_join("examples", ",").alias("examples"))


@register("graph_dissemination", """WITH i AS (SELECT '#' || event_id AS id, CASE WHEN event_id % 11 = 0 THEN '' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS t, event_type AS elapsed FROM events UNION ALL SELECT 'ext_' || o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S'), '+0m' FROM orders)
SELECT src, dst, elapsed FROM (SELECT id AS src, lead(id) OVER w AS dst, lead(elapsed) OVER w AS elapsed FROM i WINDOW w AS (ORDER BY t, id)) WHERE dst IS NOT NULL""")
def dissemination(spark, sf_dir):
    at = lambda x: F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss")
    a = table(spark, sf_dir, "events").select(F.concat(F.lit("#"), C("event_id").cast("string")).alias("id"), F.when(C("event_id") % 11 != 0, at("ts")).alias("ts"), C("event_type").alias("elapsed"))
    b = table(spark, sf_dir, "orders").select(F.concat(F.lit("ext_"), C("o_orderkey").cast("string")).alias("id"), at("o_orderdate").alias("ts"), F.lit("+0m").alias("elapsed"))
    return au.dissemination_edges(a.unionByName(b), ["ts", "id"])


@register("search_pivot_sift", f"""WITH {NODES}, k AS (SELECT p_partkey, 'h' || (p_partkey % 60) AS hash FROM n WHERE ct LIKE '%crop%' OR (n >= 15 AND ir >= 0.15) OR d <= 55) SELECT min(p_partkey) AS p_partkey, hash FROM k GROUP BY hash""")
def pivot(spark, sf_dir):
    d = nodes(spark, sf_dir).select("p_partkey", "crop_type", "inlier_count", "inlier_ratio", C("pdq_distance").alias("distance"), F.concat(F.lit("h"), (C("p_partkey") % 60).cast("string")).alias("hash"))
    return au.pivot_sift(d, "p_partkey").select("p_partkey", "hash")


@register("search_ratio_matches", """WITH d AS (SELECT q.vec_id AS query, t.vec_id AS target, round(list_distance(q.embedding::DOUBLE[], t.embedding::DOUBLE[]), 6) AS distance FROM embeddings q, embeddings t WHERE q.vec_id % 50 = 0 AND q.vec_id <> t.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, target) AS r FROM d) SELECT a.query, a.target, a.distance FROM r a JOIN r b ON a.query = b.query AND a.r = 1 AND b.r = 2 WHERE a.distance < 0.99 * b.distance""")
def ratio(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    # of every two blocks the three nearest, one of which may be the query itself
    near = pairs.distances(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", k=3)
    d = near.where("query <> vec_id").select("query", C("vec_id").alias("target"), F.round("distance", 6).alias("distance"))
    return au.ratio_matches(d, "query", "target", "distance", 0.99)


FIT = {
    "p_partkey": "p_partkey", "src_x": "CAST(p_partkey * 7 % 50 AS DOUBLE) / 50", "src_y": "CAST(p_partkey * 11 % 40 AS DOUBLE) / 40", "dst_x": "CAST(p_partkey * 13 % 30 AS DOUBLE) / 30", "dst_y": "CAST(p_partkey * 17 % 45 AS DOUBLE) / 45",
    "target_inside": "p_partkey % 3 = 0", "candidate_inside": "p_partkey % 4 < 2", "scale_ok": "p_partkey % 7 > 0", "coverage_t": "CAST(p_partkey % 10 AS DOUBLE) / 9", "coverage_c": "CAST(p_partkey % 8 AS DOUBLE) / 7",
    "w_t": "40 + p_partkey * 3 % 200", "h_t": "60 + p_partkey * 5 % 200", "w_c": "50 + p_partkey * 9 % 200", "h_c": "70 + p_partkey * 4 % 200", "area_t": "300000", "area_c": "400000",
    "distance": "p_partkey * 37 % 256", "inliers": "p_partkey * 7 % 120", "ratio": "CAST(p_partkey % 11 AS DOUBLE) / 10",
}


def _wide(x: str, y: str, area: float, longest: float, shortest: float) -> str:
    return f"({x} * {y} >= {area} AND greatest({x}, {y}) >= {longest} AND least({x}, {y}) >= {shortest})"


@register("search_match_decision", f"""WITH {sql('part', FIT)}, k AS (SELECT p_partkey, CASE WHEN target_inside AND scale_ok AND {_wide('src_x', 'src_y', 0.025, 0.18, 0.08)} AND (NOT candidate_inside OR coverage_t < 0.9) AND w_t >= 80 AND h_t >= 80 AND w_t * h_t >= 0.04 * area_c THEN 'target_is_crop_of_candidate'
WHEN candidate_inside AND scale_ok AND {_wide('dst_x', 'dst_y', 0.025, 0.18, 0.08)} AND (NOT target_inside OR coverage_c < 0.9) AND w_c >= 80 AND h_c >= 80 AND w_c * h_c >= 0.04 * area_t THEN 'candidate_is_crop_of_target'
WHEN {_wide('src_x', 'src_y', 0.04, 0.22, 0)} AND {_wide('dst_x', 'dst_y', 0.04, 0.22, 0)} AND (distance <= 42 OR (inliers >= 35 AND ratio >= 0.4)) THEN 'exact' ELSE 'none' END AS crop_type FROM r) SELECT p_partkey, crop_type, crop_type <> 'none' AS is_match FROM k""")
def decision(spark, sf_dir):
    d = made(spark, sf_dir, "part", FIT)
    box = lambda w, h: F.struct(C(w).alias("w"), C(h).alias("h"))
    d = d.withColumn("box_t", box("w_t", "h_t")).withColumn("box_c", box("w_c", "h_c"))
    return d.select("p_partkey", au.match_decision().alias("x")).select("p_partkey", "x.*")


PRINTS = {"user_id": "user_id", "device": "'d' || CAST(event_id % 6 AS STRING)", "template": "CASE event_type WHEN 'click' THEN 'reference' WHEN 'view' THEN 'original' WHEN 'error' THEN 'whatsapp' ELSE 'reddit' END", "correlation": "value / 1000"}


@register("vector_fingerprint_ranking", f"""WITH {sql('events', PRINTS)}, s AS (SELECT *, CASE template WHEN 'reference' THEN correlation WHEN 'original' THEN correlation * 0.96 WHEN 'reddit' THEN correlation * 0.9 + 0.015 ELSE correlation * 0.9 END AS score FROM r),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, device ORDER BY score DESC, template) AS r FROM s) WHERE r = 1), m AS (SELECT *, score - min(score) OVER (PARTITION BY user_id) AS low, count(*) OVER (PARTITION BY user_id) AS k FROM b),
f AS (SELECT *, CASE WHEN sum(low) OVER (PARTITION BY user_id) > 1e-9 THEN low / sum(low) OVER (PARTITION BY user_id) ELSE 1.0 / k END AS confidence FROM m),
o AS (SELECT *, row_number() OVER w AS rank, coalesce(lead(score) OVER w, -1) AS nxt FROM f WINDOW w AS (PARTITION BY user_id ORDER BY confidence DESC, score DESC, correlation DESC, device))
SELECT user_id, device, round(score, 6) AS score, round(correlation, 6) AS correlation, template, round(confidence, 6) AS confidence, CAST(rank AS INT) AS rank, bool_or(rank = 1 AND correlation >= 0.03 AND score - nxt >= 0.01) OVER (PARTITION BY user_id) AS trusted FROM o""")
def prints(spark, sf_dir):
    return r6(au.fingerprint_ranking(made(spark, sf_dir, "events", PRINTS), "user_id", "reddit"))


LENS = {
    "user_id": "user_id", "event_id": "event_id", "bucket": "CASE event_type WHEN 'click' THEN 'exact-match' WHEN 'view' THEN 'visual-match' ELSE 'all' END",
    "link": "CASE WHEN event_id % 37 = 0 THEN '' ELSE 'https://site' || CAST(event_id % 9 AS STRING) || '.org/' || CAST(user_id AS STRING) END", "label": "CASE event_id % 9 WHEN 0 THEN 'Reuters' WHEN 1 THEN 'Blog' END", "thumbnail": "'t' || CAST(event_id % 9 AS STRING)",
}


@register("search_lens_hits", f"""WITH {sql('events', LENS)}, k AS (SELECT *, event_id % 9 = 0 AS wire FROM r WHERE link <> ''),
w AS (SELECT user_id, link, arg_min(event_id, (CASE bucket WHEN 'all' THEN 0 WHEN 'exact-match' THEN 1 ELSE 2 END, event_id)) AS event_id FROM k WHERE wire GROUP BY ALL), nw AS (SELECT user_id, count(*) AS n FROM w GROUP BY 1),
v0 AS (SELECT user_id, link, min((bucket, event_id)) AS o FROM k WHERE bucket <> 'all' AND (user_id, link) NOT IN (SELECT (user_id, link) FROM w) GROUP BY ALL), v1 AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY o) AS r FROM v0),
v AS (SELECT v1.user_id, link, o[2] AS event_id FROM v1 LEFT JOIN nw ON nw.user_id = v1.user_id WHERE r <= least(4, 6 - coalesce(n, 0))), nv AS (SELECT user_id, count(*) AS n FROM (SELECT user_id FROM w UNION ALL SELECT user_id FROM v) GROUP BY 1),
a0 AS (SELECT user_id, link, min(event_id) AS event_id FROM k WHERE bucket = 'all' AND (user_id, link) NOT IN (SELECT (user_id, link) FROM w UNION ALL SELECT (user_id, link) FROM v) GROUP BY ALL), a1 AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM a0),
a AS (SELECT a1.user_id, a1.event_id FROM a1 LEFT JOIN nv ON nv.user_id = a1.user_id WHERE r <= least(3, 6 - coalesce(n, 0))) SELECT user_id, event_id FROM w UNION ALL SELECT user_id, event_id FROM v UNION ALL SELECT user_id, event_id FROM a""")
def lens(spark, sf_dir):
    return c.lens_hits(made(spark, sf_dir, "events", LENS), "user_id", "event_id", 6, 4, 3).select("user_id", "event_id")


@register("search_closed_set", "WITH k AS (SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN 's' || (event_id % 5) ELSE event_type || (event_id % 8) END AS key FROM events) SELECT user_id, min(event_id) AS event_id FROM k GROUP BY user_id, key")
def closed(spark, sf_dir):
    """Rows whose URL or whose (domain, hash) was not met before; a URL tells its hash, so that either key comes to the same."""
    e, third = C("event_id"), C("event_id") % 3 == 0
    five = (e % 5).cast("string")
    url = F.when(third, F.concat(F.lit("https://a.org/x"), five)).otherwise(F.concat(F.lit("https://b.org/"), C("event_type"), (e % 8).cast("string")))
    return lineage.two_key_dedup(table(spark, sf_dir, "events").select("user_id", "event_id", url.alias("u"), F.when(third, F.concat(F.lit("a.org:s"), five)).alias("h")), "user_id", "event_id", ("u", "h")).select("user_id", "event_id")


@register("search_tolerant_best", "SELECT user_id, arg_min(event_id, (-CAST(event_id % 4 AS BIGINT), -event_id)) AS event_id FROM events GROUP BY 1")
def tolerant(spark, sf_dir):
    """Times two hours apart, the later event earlier, so that the tolerance decides nothing and an order exists."""
    e = C("event_id")
    ts = F.timestamp_seconds(F.lit(1_700_000_000) - e * 7200)
    d = table(spark, sf_dir, "events").select("user_id", "event_id", e.alias("key"), (e % 4).alias("conf"), ts.alias("ts"), F.lit(1.0).alias("area"), F.lit(0.0).alias("f"))
    return lineage.tolerant_best(d, "user_id", "event_id").select("user_id", C("key").alias("event_id"))


@register("graph_path_to_root", "WITH RECURSIVE u(position, node) AS (SELECT 0, max(c_custkey) FROM customer UNION ALL SELECT position + 1, node // 3 FROM u WHERE position < 4 AND node > 0) SELECT position, CAST(node AS VARCHAR) AS node FROM u")
def root(spark, sf_dir):
    cu = table(spark, sf_dir, "customer").select(C("c_custkey").alias("k")).unionByName(spark.range(1).select(C("id").alias("k")))
    tree = cu.select(C("k").cast("string").alias("node"), F.when(C("k") > 0, F.floor(C("k") / 3).cast("long").cast("string")).alias("parent"))
    last = str(cu.agg(F.max("k")).first()[0])
    return lineage.path_to_root(tree, last)


HTML = {
    "p_partkey": "p_partkey", "url": "'https://a.org/news/' || CAST(p_partkey AS STRING) || '?x=1'",
    "html": """'<html><meta property="og:image" content="/og' || CAST(p_partkey AS STRING) || '.jpg"><img class="site-logo" src="/logo.png"><img width="80" src="small.png"><img src="data:xx" data-src="pic' || CAST(p_partkey % 3 AS STRING) || '.jpg?w=300"><source srcset="//cdn.org/a.webp 1x, https://b.org/b.webp 2x"><a href="big.PNG">x</a><a href="page.html">y</a><a href="https://twitter.com/user' || CAST(p_partkey AS STRING) || '/status/1234">t</a></html>'""",
}


@register("page_images", """WITH u AS (SELECT p_partkey, unnest(['https://a.org/news/pic' || (p_partkey % 3) || '.jpg?w=300', 'https://cdn.org/a.webp', 'https://b.org/b.webp', 'https://a.org/og' || p_partkey || '.jpg', 'https://a.org/news/big.PNG', 'https://a.org/news/pic' || (p_partkey % 3) || '.jpg']) AS image FROM part) SELECT * FROM u""")
def images(spark, sf_dir):
    return made(spark, sf_dir, "part", HTML, spread).select("p_partkey", F.explode_outer(pg.page_images(C("html"), C("url"))).alias("image")).where("image is not null")


@register("page_embedded_post", "SELECT p_partkey, 'https://a.org/og' || p_partkey || '.jpg' AS image, 'https://x.com/user' || p_partkey || '/status/1234' AS post, '@user' || p_partkey AS account FROM part")
def embedded(spark, sf_dir):
    d = made(spark, sf_dir, "part", HTML, spread)
    return d.select("p_partkey", pg.lead_image(C("html"), C("url")).alias("image"), pg.embedded_post(C("html")).alias("x")).select("p_partkey", "image", C("x.url").alias("post"), "x.account")


def _payload(spark, sf_dir, shape):
    """One JSON response a user, of that user's events in order."""
    ev = table(spark, sf_dir, "events").withColumn("e", C("event_id").cast("string"))
    lists = ev.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", shape.alias("s")))), lambda x: x["s"]).alias("l"))
    return lists


@register("source_reddit_posts", "SELECT user_id, 'u/a' || event_id AS account, 'https://www.reddit.com/r/x/' || event_id AS post_url, event_type AS title, 1700000000 + event_id AS published, CASE WHEN event_id % 2 = 0 THEN 'https://i.redd.it/' || event_id END AS media_url FROM events")
def reddit(spark, sf_dir):
    e = C("e")
    media = F.when(C("event_id") % 2 == 0, F.concat(F.lit("https://i.redd.it/"), e)).otherwise("https://self")
    post = F.struct(F.struct(F.concat(F.lit("a"), e).alias("author"), F.concat(F.lit("/r/x/"), e).alias("permalink"), C("event_type").alias("title"), (C("event_id") + 1700000000).cast("double").alias("created_utc"), media.alias("url")).alias("data"))
    d = _payload(spark, sf_dir, post).select("user_id", F.to_json(F.struct(F.struct(C("l").alias("children")).alias("data"))).alias("payload"))
    return cn.reddit_posts(d, "user_id", "payload").select("user_id", "account", "post_url", "title", F.unix_seconds("published_at").alias("published"), "media_url")


@register("source_x_posts", "SELECT user_id, CASE WHEN event_id % 5 = 0 THEN '@n' || user_id ELSE '@' || user_id END AS account, event_type AS title, (event_id * 4194304000 // 4194304) + 1288834974657 AS published_ms FROM events")
def x_posts(spark, sf_dir):
    author = F.when(C("event_id") % 5 == 0, F.concat(F.lit("n"), C("user_id").cast("string"))).otherwise(C("user_id").cast("string"))
    post = F.struct((C("event_id") * 4194304000).cast("string").alias("id"), C("event_type").alias("text"), F.concat(F.lit("id_"), author).alias("author_id"))
    names = F.array_distinct(F.transform("l", lambda p: F.struct(p["author_id"].alias("id"), F.replace(p["author_id"], F.lit("id_"), F.lit("")).alias("username"))))
    d = _payload(spark, sf_dir, post).select("user_id", F.to_json(F.struct(C("l").alias("data"), F.struct(names.alias("users")).alias("includes"))).alias("payload"))
    return cn.x_posts(d, "user_id", "payload").select("user_id", "account", "title", F.unix_millis("published_at").alias("published_ms"))


@register("source_youtube_videos", "SELECT user_id, event_type AS account, 'https://www.youtube.com/watch?v=v' || event_id AS post_url, CAST(floor(epoch(ts)) AS BIGINT) AS published, 'https://img.youtube.com/vi/v' || event_id || '/hqdefault.jpg' AS media_url FROM events WHERE event_id % 7 <> 0")
def youtube(spark, sf_dir):
    video = F.struct(F.struct(F.when(C("event_id") % 7 != 0, F.concat(F.lit("v"), C("e"))).alias("videoId")).alias("id"), F.struct(F.lit("t").alias("title"), C("event_type").alias("channelTitle"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("publishedAt")).alias("snippet"))
    d = _payload(spark, sf_dir, video).select("user_id", F.to_json(F.struct(C("l").alias("items"))).alias("payload"))
    return cn.youtube_videos(d, "user_id", "payload").select("user_id", "account", "post_url", F.unix_seconds("published_at").alias("published"), "media_url")


@register("source_web_pages", "SELECT user_id, event_id AS n, CASE event_id % 3 WHEN 0 THEN 'reddit' ELSE 'web' END AS platform, CASE event_id % 3 WHEN 0 THEN 'someone' WHEN 1 THEN '@poster (via b.org)' ELSE 'c.org' END AS account FROM events")
def web(spark, sf_dir):
    k = C("event_id") % 3
    href = F.concat(F.when(k == 0, "https://www.reddit.com/u/someone/").when(k == 1, "https://www.b.org/?n=").otherwise("https://c.org/?n="), C("e"))
    d = _payload(spark, sf_dir, F.struct(C("e").alias("title"), href.alias("href"), F.when(k == 1, "tweet by @poster").otherwise("text").alias("body"))).select("user_id", F.to_json(F.struct(C("l").alias("results"))).alias("payload"))
    return cn.web_pages(d, "user_id", "payload").select("user_id", C("title").cast("long").alias("n"), "platform", "account")


@register("source_image_hits", "SELECT user_id, 'https://s.org/' || event_id AS post_url, 'i' || event_id AS media_url FROM events WHERE value / 300 >= 0.3")
def image_hits(spark, sf_dir):
    hit = F.struct(F.concat(F.lit("https://s.org/"), C("e")).alias("url"), F.concat(F.lit("i"), C("e")).alias("image"), F.lit("t").alias("title"), (C("value") / 300).alias("score"))
    d = _payload(spark, sf_dir, hit).select("user_id", F.to_json(F.struct(C("l").alias("hits"))).alias("payload"))
    return cn.image_hits(d, "user_id", "payload", 0.3).select("user_id", "post_url", "media_url")
