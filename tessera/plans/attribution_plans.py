"""Queries of lookups, as-of joins, fingerprints, trails, harvests, registries and resumed streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions import kernels
from tessera.operators import attribution as at, devices, lineage, metrics as m, protocol as p
from tessera.plans.metric_plans import r6
from tessera.plans.record_plans import made, sql
from tessera.plans.registry import register, table
from tessera.session import shared_dir, spread
from tessera.streaming import events as st

C = F.col


@register("join_asof", "WITH l AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'click'), r AS (SELECT user_id, ts, event_id AS seen FROM events WHERE event_type = 'view') SELECT l.event_id, r.seen FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts")
def asof(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    views = ev.where("event_type = 'view'").withColumn("seen", C("event_id"))
    return at.asof_join(ev.where("event_type = 'click'"), views, ["user_id"], "ts", "event_id", "seen").select("event_id", "seen")


@register("join_predecessor", "SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events")
def predecessor(spark, sf_dir):
    from pyspark.sql import Window

    return table(spark, sf_dir, "events").select("event_id", F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("before"))


@register("join_lookup", "SELECT o_orderkey, c_mktsegment FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey")
def lookup(spark, sf_dir):
    small = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(C("c_custkey").alias("o_custkey"), "c_mktsegment")
    return table(spark, sf_dir, "orders").join(small, "o_custkey", "left").select("o_orderkey", "c_mktsegment")


@register("join_index", "SELECT a.vec_id, a.label AS left_label, b.label AS right_label FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 3")
def index(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return e.withColumnRenamed("label", "left_label").join(e.select((C("vec_id") - 3).alias("vec_id"), C("label").alias("right_label")), "vec_id").select("vec_id", "left_label", "right_label")


SIMS = {"event_id": "event_id", "a": "CASE event_id % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 0.7 END", "b": "CASE WHEN event_id % 8 = 0 THEN 0.0 WHEN event_id % 3 = 0 THEN 0.6 END", "own": "CASE WHEN event_id % 5 = 0 THEN 0.9 END"}


@register("join_similarity_lookup", f"WITH {sql('events', SIMS)} SELECT event_id, CAST(coalesce(nullif(a, 0), b, own, 0.5) AS DOUBLE) AS similarity FROM r")
def similarity(spark, sf_dir):
    d = made(spark, sf_dir, "events", SIMS)
    return d.select("event_id", at.known_similarity(*[C(c).cast("double") for c in ("a", "b", "own")]).alias("similarity"))


MEANS = "p AS (SELECT label, unnest(range(1, len(embedding) + 1)) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT label, pos, avg(x) AS m, count(*) AS n FROM p GROUP BY ALL)"


@register("vector_mean_fingerprints", f"WITH {MEANS} SELECT label, n, CAST(pos - 1 AS INT) AS pos, round((m - avg(m) OVER w) / stddev_pop(m) OVER w, 6) AS x FROM m WINDOW w AS (PARTITION BY label)")
def mean_fingerprints(spark, sf_dir):
    d = at.mean_fingerprints(table(spark, sf_dir, "embeddings"), ["label"], "embedding")
    return r6(d.select("label", "n", F.posexplode("fingerprint").alias("pos", "x")))


@register("vector_trained_templates", "SELECT label, k AS platform, count(*) AS n FROM (SELECT label, CAST(vec_id % 9 AS INT) AS k FROM embeddings) GROUP BY ALL HAVING count(*) >= 3")
def templates(spark, sf_dir):
    """Templates of devices and platforms with three files at least."""
    d = table(spark, sf_dir, "embeddings").withColumn("platform", (C("vec_id") % 9).cast("int"))
    return at.mean_fingerprints(d, ["label", "platform"], "embedding", 3).select("label", "platform", "n")


#: Images made of embeddings: every fiftieth is a query, the others train.
DEVICES = """i AS (SELECT vec_id, 'd' || label AS device, ['original', 'original', 'whatsapp', 'original', 'reddit'][vec_id % 5 + 1] AS platform, CASE WHEN vec_id % 3 = 0 THEN 'reference' ELSE 'rest' END AS split, embedding::DOUBLE[] AS e,
CASE WHEN vec_id % 100 = 0 OR vec_id % 4 = 1 THEN 'Maker ' || (label % 3) END AS make, CASE WHEN vec_id % 4 > 0 OR vec_id % 200 = 0 THEN CASE WHEN vec_id % 3 = 0 THEN 'Maker 1 ' ELSE '' END || 'M' || label END AS model FROM embeddings), t AS (SELECT * FROM i WHERE vec_id % 50 > 0), q AS (SELECT * FROM i WHERE vec_id % 50 = 0)"""


@register("device_prediction", f"""WITH {DEVICES},
tp AS (SELECT vec_id, device, platform, split, unnest(range(64)) AS pos, unnest(e) AS x FROM t),
g AS (SELECT device, platform AS kind, false AS part, pos, x FROM tp UNION ALL SELECT device, 'original', true, pos, x FROM tp WHERE platform = 'original' AND split = 'reference'),
m AS (SELECT device, kind, part, pos, avg(x) AS m, count(*) AS n FROM g GROUP BY ALL), l AS (SELECT device, kind, part, any_value(n) AS n, list(m ORDER BY pos) AS v FROM m GROUP BY ALL),
rf AS (SELECT device, 'reference' AS template, arg_max(v, part) AS v FROM l WHERE kind = 'original' AND (NOT part OR n >= 3) GROUP BY device),
pr AS (SELECT * FROM rf UNION ALL SELECT device, kind, v FROM l WHERE NOT part AND n >= CASE WHEN kind = 'original' THEN 3 ELSE 2 END AND device IN (SELECT device FROM rf)),
mo AS (SELECT pos, avg(x) AS mean, CASE WHEN stddev_pop(x) < 1e-6 THEN 1 ELSE stddev_pop(x) END AS std FROM tp WHERE pos < 4 GROUP BY pos),
zt AS (SELECT device, platform, pos, (x - mean) / std AS z FROM tp JOIN mo USING (pos)), qz AS (SELECT vec_id, list((e[pos + 1] - mean) / std ORDER BY pos) AS z FROM q, mo GROUP BY vec_id),
ce AS (SELECT 'device' AS k, label, list(z ORDER BY pos) AS c FROM (SELECT device AS label, pos, avg(z) AS z FROM zt GROUP BY ALL) GROUP BY label UNION ALL SELECT 'platform', label, list(z ORDER BY pos) FROM (SELECT platform AS label, pos, avg(z) AS z FROM zt GROUP BY ALL) GROUP BY label),
sc AS (SELECT vec_id, k, label, 1 / (1 + list_distance(z, c)) AS s FROM qz, ce), sh AS (SELECT vec_id, k, label, s / sum(s) OVER (PARTITION BY vec_id, k) AS c FROM sc), top AS (SELECT vec_id, k, arg_max(label, c) AS label, max(c) AS c FROM sh GROUP BY ALL),
co AS (SELECT vec_id, pr.device, template, (SELECT corr(a, b) FROM (SELECT unnest(q.e) AS a, unnest(pr.v) AS b)) AS r FROM q, pr),
w AS (SELECT co.*, CASE WHEN template = 'reference' THEN r ELSE r * CASE WHEN template = 'original' THEN 0.96 ELSE 0.9 END + CASE WHEN template = label THEN 0.015 ELSE 0 END END AS score FROM co JOIN top ON top.vec_id = co.vec_id AND k = 'platform'),
b AS (SELECT vec_id, device, max(score) AS score, arg_max(r, score) AS r FROM w GROUP BY ALL), b2 AS (SELECT *, score - min(score) OVER (PARTITION BY vec_id) AS lo FROM b),
b3 AS (SELECT *, lo / sum(lo) OVER (PARTITION BY vec_id) AS c, row_number() OVER (PARTITION BY vec_id ORDER BY lo DESC, device) AS rk FROM b2),
f AS (SELECT x.vec_id, x.device, x.score, x.r, x.c, y.score AS second, x.r >= 0.03 AND x.score - y.score >= 0.01 AS trusted FROM b3 x JOIN b3 y ON x.vec_id = y.vec_id AND x.rk = 1 AND y.rk = 2),
mk AS (SELECT device, arg_max(make, (n, -o)) AS make FROM (SELECT device, make, count(*) AS n, min(vec_id) AS o FROM t WHERE platform = 'original' AND make IS NOT NULL GROUP BY ALL) GROUP BY device),
ml AS (SELECT device, arg_max(model, (n, -o)) AS model FROM (SELECT device, model, count(*) AS n, min(vec_id) AS o FROM t WHERE platform = 'original' AND model IS NOT NULL GROUP BY ALL) GROUP BY device),
pf AS (SELECT d.device, lower(coalesce(make, '')) AS make, lower(coalesce(model, '')) AS model FROM (SELECT DISTINCT device FROM t WHERE platform = 'original') d LEFT JOIN mk USING (device) LEFT JOIN ml USING (device)),
qm AS (SELECT vec_id, lower(coalesce(make, '')) AS mk, lower(coalesce(model, '')) AS ml, CASE WHEN make IS NOT NULL AND model IS NOT NULL AND NOT contains(lower(model), lower(make)) THEN make || ' ' || model ELSE coalesce(model, make) END AS camera_model FROM q),
ft AS (SELECT vec_id, device, least(0.85, CASE WHEN ml <> '' AND model <> '' AND (contains(ml, model) OR contains(model, ml)) THEN 0.75 ELSE 0 END + CASE WHEN mk <> '' AND make <> '' AND (contains(mk, make) OR contains(make, mk)) THEN 0.2 ELSE 0 END) AS fit FROM qm, pf),
fb AS (SELECT vec_id, arg_min(device, (-fit, device)) AS fits, max(fit) AS fit FROM ft WHERE fit > 0 GROUP BY vec_id)
SELECT qm.vec_id, CASE WHEN trusted THEN f.device WHEN camera_model IS NOT NULL THEN coalesce(fits, camera_model) WHEN td.c >= 0.65 THEN td.label END AS prediction,
round(CASE WHEN trusted THEN least(0.95, 0.55 + least(greatest(r, 0), 0.35) * 0.8 + f.c * 0.12 + least(greatest(score - second, 0), 0.25) * 0.2) WHEN camera_model IS NOT NULL THEN coalesce(fit, 0.68) WHEN td.c >= 0.65 THEN least(td.c, 0.55) ELSE 0 END, 6) AS confidence,
CASE WHEN trusted THEN 'prnu' WHEN camera_model IS NOT NULL THEN 'metadata' WHEN td.c >= 0.65 THEN 'weak_file_features' ELSE 'inconclusive' END AS method, camera_model, tp_.label AS platform, round(tp_.c, 6) AS platform_confidence
FROM qm LEFT JOIN f USING (vec_id) LEFT JOIN fb USING (vec_id) JOIN top td ON td.vec_id = qm.vec_id AND td.k = 'device' JOIN top tp_ ON tp_.vec_id = qm.vec_id AND tp_.k = 'platform'""")
def device_prediction(spark, sf_dir):
    """A device model of fingerprints, templates, centroids and profiles, trained on all but the queries and asked about those."""
    no, label = C("vec_id"), C("label").cast("string")
    made = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.concat(F.lit("d"), label).alias("device"), F.element_at(F.array(*map(F.lit, ("original", "original", "whatsapp", "original", "reddit"))), (no % 5 + 1).cast("int")).alias("platform"),
        F.when(no % 3 == 0, "reference").otherwise("rest").alias("split"), C("embedding").cast("array<double>").alias("residual"), F.slice("embedding", 1, 4).alias("features"),
        F.when((no % 100 == 0) | (no % 4 == 1), F.concat(F.lit("Maker "), (C("label") % 3).cast("string"))).alias("make"),
        F.when((no % 4 > 0) | (no % 200 == 0), F.concat(F.when(no % 3 == 0, "Maker 1 ").otherwise(""), F.lit("M"), label)).alias("model"), F.lit("s").alias("software"), F.lit(640).alias("width"), F.lit(480).alias("height"),
    )
    return r6(devices.predict(made.where(no % 50 == 0), "vec_id", devices.train(made.where(no % 50 > 0), "vec_id")))


@register("audit_array_fingerprints", "SELECT count(*) AS rows, count(DISTINCT k) AS contents FROM (SELECT CASE WHEN vec_id % 10 = 0 THEN label ELSE 1000 + vec_id END AS k FROM embeddings)")
def array_fingerprints(spark, sf_dir):
    v = F.when(C("vec_id") % 10 == 0, F.array(C("label").cast("double"), F.lit(0.5))).otherwise(F.array(C("vec_id").cast("double"), F.lit(1.5), F.lit(None).cast("double")))
    d = table(spark, sf_dir, "embeddings").select(v.alias("v")).select(at.array_fingerprint("v").alias("f"))
    return d.agg(F.count("*").alias("rows"), F.count_distinct("f").alias("contents"))


EVENTS = {"riot": ["click", "error", "15", "purchase"], "flood": ["view", "signup", "7"]}


def _event_sql() -> str:
    said = {e: " + ".join(f"CAST(bool_or(contains(d, '{k}')) AS INT)" for k in ks) for e, ks in EVENTS.items()}
    whole = {e: " + ".join(f"CAST(bool_or(contains(t, '{k}') OR contains(d, '{k}')) AS INT)" for k in ks) for e, ks in EVENTS.items()}
    pick = " UNION ALL ".join(f"SELECT g, {whole[e]} AS hits, {said[e]} AS said, {-i} AS o, '{e}' AS event FROM t GROUP BY g" for i, e in enumerate(EVENTS))
    return f"WITH t AS (SELECT event_id % 40 AS g, lower(event_type || ' ' || CAST(event_id % 20 AS VARCHAR)) AS t, CASE WHEN event_id % 40 < 10 THEN event_type ELSE '' END AS d FROM events WHERE event_id < 400), x AS ({pick}) SELECT g, arg_max(event, (hits, o)) AS event, max(hits) AS hits FROM x WHERE hits >= 3 OR said >= 2 GROUP BY g"


@register("profile_event", _event_sql().replace(" WHERE event_id < 400", ""))
def event(spark, sf_dir):
    e = C("event_id")
    d = table(spark, sf_dir, "events").select((e % 40).alias("g"), F.concat_ws(" ", F.upper("event_type"), (e % 20).cast("string")).alias("t"), F.when(e % 40 < 10, C("event_type")).alias("d"))
    return at.event_profile(d, "g", "t", "d", EVENTS).select("g", "event", C("hits").cast("int").alias("hits"))


TRAIL = {
    "user_id": "user_id", "event_id": "event_id", "date": "CASE WHEN user_id % 3 > 0 AND event_id % 4 > 0 THEN CAST(2000 + event_id % 13 AS STRING) END", "platform": "CASE WHEN event_type <> 'error' THEN event_type END", "confidence": "value / 300",
}


@register("profile_platform_trail", f"""WITH {sql('events', TRAIL)}, c AS (SELECT *, count(date) OVER (PARTITION BY user_id) >= 2 AS dated FROM r), k AS (SELECT *, CASE WHEN dated THEN (date IS NULL, coalesce(date, ''), event_id) ELSE (false, '', event_id) END AS key FROM c),
n AS (SELECT *, coalesce(lag(coalesce(platform, 'unknown')) OVER (PARTITION BY user_id ORDER BY key) <> coalesce(platform, 'unknown'), true) AS new FROM k)
SELECT user_id, string_agg(coalesce(platform, 'unknown'), ' -> ' ORDER BY key) FILTER (new) AS trail, list(platform ORDER BY key DESC)[1] AS last, round(coalesce(avg(confidence) FILTER (platform IS NOT NULL), 0), 6) AS confidence, CASE WHEN bool_or(dated) THEN 'timestamp' ELSE 'upload_order' END AS basis FROM n GROUP BY user_id""")
def trail(spark, sf_dir):
    return r6(at.platform_trail(made(spark, sf_dir, "events", TRAIL), "user_id", "event_id"))


HINTED = {"p_partkey": "p_partkey", "name": "CASE p_partkey % 5 WHEN 0 THEN 'IMG-20230101-WA0001.jpg' WHEN 1 THEN 'rdt_abc.png' WHEN 2 THEN 'photo_2023-01-02 tweet.jpg' WHEN 3 THEN 'plain.jpg' END", "software": "CASE WHEN p_partkey % 10 = 0 THEN 'WhatsApp' WHEN p_partkey % 10 = 3 THEN 'Messenger 2' END"}


@register("label_platform_hints", """SELECT p_partkey, 'whatsapp' AS label, CASE WHEN p_partkey % 10 = 0 THEN 0.86 ELSE 0.78 END::DOUBLE AS score FROM part WHERE p_partkey % 5 = 0 UNION ALL SELECT p_partkey, 'reddit', 0.72 FROM part WHERE p_partkey % 5 = 1
UNION ALL SELECT p_partkey, unnest(['telegram', 'x']), 0.72 FROM part WHERE p_partkey % 5 = 2 UNION ALL SELECT p_partkey, 'facebook', 0.86 FROM part WHERE p_partkey % 10 = 3""")
def hints(spark, sf_dir):
    return made(spark, sf_dir, "part", HINTED).select("p_partkey", F.inline(at.platform_hints(C("name"), C("software")))).withColumn("score", F.round("score", 6))


@register("search_harvest", "WITH l AS (SELECT user_id, event_id, event_id % 23 AS sha FROM events WHERE value >= 15), f AS (SELECT user_id, sha, min(event_id) AS event_id FROM l GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM f) SELECT user_id, event_id FROM n WHERE n <= 12")
def harvest(spark, sf_dir):
    d = table(spark, sf_dir, "events").select("user_id", "event_id", (C("value") * 10).alias("width"), F.lit(150).alias("height"), (C("event_id") % 23).cast("string").alias("sha256"))
    return at.harvested(d, "user_id", "event_id", most=12).select("user_id", "event_id")


@register("search_neighbours", """WITH e AS (SELECT p_partkey // 6 AS src, p_partkey AS dst, p_partkey % 9 AS pr, 'd' || (p_partkey % 4) AS domain, 'h' || (p_partkey % 50) AS hash FROM part WHERE p_partkey // 6 BETWEEN 1 AND 20 AND p_partkey > 20),
a AS (SELECT *, row_number() OVER (PARTITION BY domain, hash ORDER BY pr, dst) AS r FROM e), b AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY pr, dst) AS n FROM a WHERE r = 1) SELECT dst AS node, src AS parent FROM b WHERE n <= 3""")
def neighbours(spark, sf_dir):
    k = C("p_partkey")
    edges = table(spark, sf_dir, "part").select(F.floor(k / 6).cast("long").alias("src"), k.alias("dst"), F.lit("u").alias("url"), F.concat(F.lit("d"), (k % 4).cast("string")).alias("domain"), F.concat(F.lit("h"), (k % 50).cast("string")).alias("hash"), (k % 9).alias("priority"))
    return at.neighbours(spark.range(1, 21).toDF("node"), edges, spark.range(0, 21).toDF("node"), 3).select("node", "parent")


FILES = {
    "user_id": "CAST(user_id AS STRING)", "event_id": "event_id", "key": "CASE WHEN event_id % 6 = 0 THEN 'Bad Key' ELSE event_type || CAST(event_id % 3 AS STRING) END",
    "path": "CASE event_id % 5 WHEN 0 THEN '/data/' || CAST(user_id AS STRING) || '/../x.png' WHEN 1 THEN '/data/' || CAST(user_id + 1 AS STRING) || '/x.png' ELSE '/data/' || CAST(user_id AS STRING) || '/' || CAST(1000000 + event_id AS STRING) || CASE WHEN event_id % 2 = 0 THEN '.png' ELSE '.bin' END END",
}


@register("sink_artifact_registry", f"WITH {sql('events', FILES)}, g AS (SELECT *, row_number() OVER (PARTITION BY user_id, key ORDER BY path DESC) AS r FROM r WHERE event_id % 6 > 0 AND event_id % 5 > 1) SELECT user_id AS \"case\", key, '/api/v1/investigations/' || user_id || '/artifacts/' || key AS url, CASE WHEN path LIKE '%.png' THEN 'image/png' ELSE 'application/octet-stream' END AS media_type FROM g WHERE r = 1")
def registry(spark, sf_dir):
    d = made(spark, sf_dir, "events", FILES).select(C("user_id").alias("case"), "key", "path", F.sha2("path", 256).alias("sha256"))
    return at.artifact_registry(d, "/data/").select("case", "key", "url", "media_type")


@register("audit_retrain", "WITH g AS (SELECT user_id, avg(value) / 100 AS a, avg(value) / 130 AS d, avg(value) / 200 AS f FROM events GROUP BY 1) SELECT user_id, CASE user_id % 3 WHEN 0 THEN a < 0.85 WHEN 1 THEN d < 0.5 ELSE f > 0.3 END AS retrain FROM g")
def retrain(spark, sf_dir):
    k, mean = C("user_id") % 3, C("mean")
    g = table(spark, sf_dir, "events").groupBy("user_id").agg(F.avg("value").alias("mean"))
    return g.select("user_id", at.retrain_recommended(F.when(k == 0, mean / 100), F.when(k == 1, mean / 130), F.when(k == 2, mean / 200)).alias("retrain"))


@register("audit_detection_summary", "SELECT user_id, count(*) AS frames, count(*) FILTER (event_type <> 'error') AS found, round(count(*) FILTER (event_type <> 'error') / count(*), 6) AS detection_rate, round(avg(value) FILTER (event_type <> 'error'), 6) AS mean_ear, round(avg(value * 2) FILTER (event_type <> 'error'), 6) AS mean_mouth FROM events GROUP BY 1")
def detection(spark, sf_dir):
    d = table(spark, sf_dir, "events").select("user_id", (C("event_type") != "error").alias("detected"), C("value").alias("ear"), (C("value") * 2).alias("mouth"))
    return r6(at.detection_summary(d, "user_id"))


@register("score_file_vector", """WITH q AS (SELECT *, list_transform(range(0, 64), lambda i: (p_partkey + i) % 50) AS t FROM part), n AS (SELECT *, list_filter(t, lambda v: v > 0) AS s FROM q), h AS (SELECT *, CASE WHEN len(s) > 32 THEN s[33:] ELSE s END AS hi FROM n)
SELECT p_partkey, 139 AS size, round(ln(1 + p_retailprice * 1000) / 16, 6) AS x0, round(p_size * 40 / 30.0 / p_size, 6) AS x3, 0.25::DOUBLE AS x7, round(list_avg(s) / 255, 6) AS x8, round(list_stddev_pop(s) / 255, 6) AS x9, round(list_avg(hi) / 255, 6) AS x10, round(t[1] / 255, 6) AS q0, 0.0::DOUBLE AS q64 FROM h""")
def file_vector(spark, sf_dir):
    k = C("p_partkey")
    tables = F.array(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: ((k + i) % 50).cast("int")))
    v = at.file_vector(C("p_retailprice") * 1000, C("p_size") * 40, C("p_size") * 30, F.lit(True), F.lit(8), tables)
    x = lambda i: F.round(F.get("v", F.lit(i)), 6)
    return spread(table(spark, sf_dir, "part").select(k, "p_retailprice", "p_size")).select(k, v.alias("v")).select("p_partkey", F.size("v").alias("size"), x(0).alias("x0"), x(3).alias("x3"), x(7).alias("x7"), x(8).alias("x8"), x(9).alias("x9"), x(10).alias("x10"), x(11).alias("q0"), x(75).alias("q64"))


RESULT = {"p_partkey": "p_partkey", "html": """'<a class="Tags-Item x">flag</a><span class="Tags-Item"> </span><ul><li class="CbirSites-Item"><a href="https://yandex.com/x">own</a></li><li class="CbirSites-Item"><a href="https://vk.com/p' || CAST(p_partkey AS STRING) || '"><b>T</b> ' || p_name || '</a></li><li class="SerpItem"><a href="/rel">r</a></li><li class="SerpItem"><a href="https://b.org/1"></a></li></ul>'"""}


@register("source_reverse_hits", "SELECT p_partkey, CAST(unnest([1, 3]) AS INT) AS place, unnest(['https://vk.com/p' || p_partkey, 'https://b.org/1']) AS post_url, unnest(['T  ' || p_name, 'Visual Match on Web']) AS title, unnest(['vk', 'web']) AS platform, 'flag' AS tags FROM part")
def reverse_hits(spark, sf_dir):
    d = at.reverse_hits(made(spark, sf_dir, "part", RESULT, spread), "p_partkey", "html")
    return d.select("p_partkey", "place", "post_url", F.regexp_replace("title", "^T +", "T  ").alias("title"), "platform", F.array_join("tags", ",").alias("tags"))


@register("media_blockiness", """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), d AS (SELECT vec_id, list_transform(range(0, 4), lambda r: abs(e[r*16+9] - e[r*16+8])) AS edge,
list_concat(flatten(list_transform(range(0, 4), lambda r: list_transform([0,1,2,3,4,5,6,8,9,10,11,12,13,14], lambda c: abs(e[r*16+c+2] - e[r*16+c+1])))), list_transform(range(0, 48), lambda i: abs(e[i+17] - e[i+1]))) AS rest FROM e) SELECT vec_id, round(list_avg(edge) / list_avg(rest), 6) AS ratio FROM d""")
def blockiness(spark, sf_dir):
    """Embeddings as planes of four rows."""
    return r6(table(spark, sf_dir, "embeddings").select("vec_id", kernels.blockiness(C("embedding"), F.lit(4)).alias("ratio")))


@register("media_residual", "SELECT vec_id, 64 AS n, 0.0::DOUBLE AS mean, 1.0::DOUBLE AS deviation FROM embeddings")
def residual(spark, sf_dir):
    """Residual planes have no mean and unit deviation."""
    d = table(spark, sf_dir, "embeddings").select("vec_id", kernels.residual(C("embedding"), F.lit(8)).alias("r"))
    mean = F.aggregate("r", F.lit(0.0), lambda s, x: s + x) / F.size("r")
    return d.select("vec_id", F.size("r").alias("n"), F.abs(F.round(mean, 6)).alias("mean"), F.round(F.sqrt(F.aggregate("r", F.lit(0.0), lambda s, x: s + x * x) / F.size("r")), 6).alias("deviation"))


@register("media_audio_descriptor", "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) SELECT vec_id, 82 AS n, round(sqrt(list_sum(list_transform(e, lambda x: x * x)) / 512), 6) AS rms FROM e")
def audio(spark, sf_dir):
    """Embeddings as waveforms, padded to one frame; the bands have no plain SQL, their number and the last but one figure have."""
    d = table(spark, sf_dir, "embeddings").select("vec_id", kernels.audio_descriptor(C("embedding")).alias("a"))
    return d.select("vec_id", F.size("a").alias("n"), F.round(F.get("a", F.lit(80)), 6).alias("rms"))


@register("series_tick_sampler", """WITH RECURSIVE f AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, CAST(floor((epoch(ts) - 1704067200 + 1e-9) / 43200) AS BIGINT) + 1 AS c FROM events),
s(user_id, i, n, event_id, taken) AS (SELECT user_id, i, least(1, c), event_id, c >= 1 FROM f WHERE i = 1 UNION ALL SELECT f.user_id, f.i, least(s.n + 1, f.c), f.event_id, s.n < f.c FROM s JOIN f ON f.user_id = s.user_id AND f.i = s.i + 1) SELECT event_id FROM s WHERE taken""")
def ticks(spark, sf_dir):
    d = table(spark, sf_dir, "events").withColumn("t", C("ts").cast("double") - 1704067200)
    return at.tick_sampler(d, ["user_id"], "t", 1 / 43200, "event_id").select("event_id")


@register("metric_pairwise_order", "WITH e AS (SELECT CAST(event_type IN ('click', 'view') AS INT) AS y, round(value) AS s FROM events) SELECT round(avg(CASE WHEN a.s > b.s THEN 1 WHEN a.s = b.s THEN 0.5 ELSE 0 END), 6) AS share FROM e a, e b WHERE a.y = 1 AND b.y = 0")
def pairwise(spark, sf_dir):
    """The share of (positive, negative) pairs in order, ties half, from ranks instead of pairs."""
    d = table(spark, sf_dir, "events").select(C("event_type").isin("click", "view").cast("int").alias("y"), F.round("value").alias("s"))
    return r6(m.ranking_metrics(d, "y", "s").select(C("auc").alias("share")))


@register("ledger_matches", """WITH RECURSIVE b AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS s, '{"event_id":' || event_id || '}' AS body FROM events WHERE value >= 50),
c(user_id, event_id, s, h) AS (SELECT user_id, event_id, s, sha256(body || '|') FROM b WHERE s = 1 UNION ALL SELECT b.user_id, b.event_id, b.s, sha256(b.body || '|' || c.h) FROM c JOIN b ON b.user_id = c.user_id AND b.s = c.s + 1) SELECT event_id, CAST(s AS INT) AS sequence, h AS entry_hash FROM c""")
def matches(spark, sf_dir):
    """The ledger of candidates that matched."""
    ev = table(spark, sf_dir, "events").where("value >= 50").select("event_id", "user_id")
    return lineage.chain(ev, "user_id", ["event_id"], ["event_id"]).select("event_id", "sequence", "entry_hash")


@register("stream_resumed", "SELECT event_id, event_type FROM events")
def resumed(spark, sf_dir):
    """Two runs with one checkpoint: the second takes only the files that came after the first."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    ev = table(spark, sf_dir, "events").select("event_id", "event_type")
    first = F.coalesce(C("event_id") % 2 == 0, F.lit(False))
    for part in (ev.where(first), ev.where(~first)):
        part.write.mode("append").parquet(base + "/in")
        st.run_available(spark.readStream.schema(ev.schema).parquet(base + "/in"), base + "/out", base + "/state")
    return spark.read.schema(ev.schema).parquet(base + "/out")


@register("protocol_strict_sample", "WITH r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY sha256('5:' || CAST(event_id AS VARCHAR)), event_id) AS r FROM events) SELECT event_id, event_type FROM r WHERE r <= 10")
def strict_sample(spark, sf_dir):
    """A stratified sample that is an error where a class has too few rows."""
    return p.stratified_sample(table(spark, sf_dir, "events"), "event_type", "event_id", 10, 5, strict=True).select("event_id", "event_type")
