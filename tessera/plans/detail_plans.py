"""Whole vectors, windows with values, paired scores, projections and exports over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions import pages as pg, records as rc, scores as sc
from tessera.operators import lineage, protocol as p, series as s, vectors as v
from tessera.plans.evidence_plans import ledger
from tessera.plans.metric_plans import r6, signed_round
from tessera.plans.registry import register, table
from tessera.session import materialise, shared_dir
from tessera.sources import versioned

C = F.col
FEATURES = "b.bits, p.key_share, p.gop_mean / 25, p.gop_std / 25, p.gop_max / 25, p.packet_cv, p.packet_p90, p.step_cv, p.i_share, p.p_share, p.b_share, f.bm, f.bs, ln(1 + f.lm), f.ls / f.lm, f.rm, f.rs / f.rm, f.near, f.cm, f.cs / f.cm"


@register("score_compression_features", f"""
WITH e AS (SELECT user_id, event_id, epoch(ts) AS t, value, event_type, event_id % 50 + 1 AS lap, (event_id * 7 % 40 + 1) / 40.0 AS res FROM events),
g AS (SELECT *, row_number() OVER w AS no, t - lag(t) OVER w AS dt, abs(value - lag(value) OVER w) AS d FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
h AS (SELECT user_id, no - lag(no) OVER (PARTITION BY user_id ORDER BY no) AS gop FROM g WHERE event_type = 'click'), q AS (SELECT user_id, avg(gop) AS gm, stddev_pop(gop) AS gs, max(gop) AS gx FROM h GROUP BY 1),
p AS (SELECT g.user_id, count(*) FILTER (event_type = 'click') / count(*) AS key_share, coalesce(any_value(gm), count(*)) AS gop_mean, coalesce(any_value(gs), 0) AS gop_std, coalesce(any_value(gx), count(*)) AS gop_max,
coalesce(stddev_pop(value) FILTER (value > 0) / avg(value) FILTER (value > 0), 0) AS packet_cv, coalesce(quantile_cont(value, 0.9) FILTER (value > 0) / avg(value) FILTER (value > 0), 1) AS packet_p90, coalesce(stddev_pop(dt) FILTER (dt > 0) / avg(dt) FILTER (dt > 0), 0) AS step_cv,
count(*) FILTER (event_type = 'click') / count(*) AS i_share, count(*) FILTER (event_type = 'view') / count(*) AS p_share, count(*) FILTER (event_type NOT IN ('click', 'view')) / count(*) AS b_share FROM g LEFT JOIN q USING (user_id) GROUP BY g.user_id),
f AS (SELECT user_id, avg(value) AS bm, stddev_pop(value) AS bs, avg(lap) AS lm, stddev_pop(lap) AS ls, avg(res) AS rm, stddev_pop(res) AS rs, coalesce(avg(CAST(d <= 0.0025 AS INT)), 0) AS near, coalesce(avg(d), 0) AS cm, coalesce(stddev_pop(d), 0) AS cs FROM g GROUP BY 1),
b AS (SELECT user_id, ln(1 + sum(value) * 8000 / (640 * 480 * 25)) AS bits FROM e GROUP BY 1)
SELECT user_id, CAST(unnest(range(20)) AS INT) AS pos, round(unnest([{FEATURES}]), 5) AS x FROM b JOIN p USING (user_id) JOIN f USING (user_id) WHERE f.cm > 0""")
def compression_features(spark, sf_dir):
    """All twenty numbers of each user's events, read as the frames of a video."""
    kind, no = C("event_type"), C("event_id")
    frames = table(spark, sf_dir, "events").select(
        "user_id", "event_id", "ts", C("value").alias("packet"), (kind == "click").alias("key"), F.when(kind == "click", "I").when(kind == "view", "P").otherwise("B").alias("kind"),
        C("value").alias("blockiness"), (no % 50 + 1).cast("double").alias("laplacian"), ((no * 7 % 40 + 1) / 40).alias("residual"),
    )
    probe = s.probe_statistics(frames, ["user_id"], "event_id").drop("frames")
    own = s.frame_statistics(frames, ["user_id"], "event_id", ["blockiness", "laplacian", "residual"], "blockiness")
    rate = frames.groupBy("user_id").agg((F.sum("packet") * 8000).alias("bitrate"), F.lit(640).alias("width"), F.lit(480).alias("height"), F.lit(25.0).alias("fps"))
    d = sc.compression_features(probe.join(own, "user_id").join(rate, "user_id")).where("change_mean > 0")
    return d.select("user_id", F.posexplode("features").alias("pos", "x")).select("user_id", "pos", F.round("x", 5).alias("x"))


@register("series_window_values", """
WITH e AS (SELECT vec_id, embedding[1:1 + vec_id % 64] AS e FROM embeddings), w AS (SELECT vec_id, e, unnest(range(0, len(e), 10)) AS s FROM e)
SELECT vec_id, CAST(s // 10 AS INT) AS "window", CAST(s AS INT) AS start, CAST(least(len(e) - s, 16) AS INT) AS valid, [round(e[s + 1 + i % least(len(e) - s, 16)]::DOUBLE, 6) FOR i IN range(16)] AS "values" FROM w""")
def window_values(spark, sf_dir):
    d = table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, (C("vec_id") % 64).cast("int") + 1).alias("e"))
    return s.window_values(d, "vec_id", "e", 16, 10).withColumn("values", F.transform("values", lambda x: signed_round(x.cast("double"))))


@register("metric_attached_scores", """
WITH r AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'legacy' ELSE 'matched_' || event_type END AS cohort, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS label, user_id % 40 AS anchor_id, user_id % 55 AS paired, value AS score FROM events),
a AS (SELECT cohort, anchor_id, arg_max(score, event_id) AS score FROM r WHERE cohort LIKE 'matched%' AND label = 1 GROUP BY ALL)
SELECT event_id, round(a.score, 6) AS aligned_score, round(-a.score, 6) AS aligned_logit FROM r LEFT JOIN a ON a.cohort = r.cohort AND a.anchor_id = r.paired""")
def attached_scores(spark, sf_dir):
    no, user = C("event_id"), C("user_id")
    r = table(spark, sf_dir, "events").select(
        "event_id", F.when(no % 5 == 0, "legacy").otherwise(F.concat(F.lit("matched_"), "event_type")).alias("cohort"), (no % 3 == 0).cast("int").alias("label"), (user % 40).alias("anchor_id"), (user % 55).alias("paired_anchor_id"),
        C("value").alias("score"), (-C("value")).alias("logit"),
    )
    return r6(s.attach_aligned(r, "event_id").select("event_id", "aligned_score", "aligned_logit"))


@register("protocol_dev_fraction", """
WITH g AS (SELECT DISTINCT user_id FROM events), n AS (SELECT user_id, row_number() OVER (ORDER BY sha256('7:' || user_id)) AS r, count(*) OVER () AS n FROM g)
SELECT event_id, CASE WHEN r <= greatest(1, round_even(n * 0.2, 0)) THEN 'dev' ELSE 'train' END AS role FROM events JOIN n USING (user_id)""")
def dev_fraction(spark, sf_dir):
    return p.dev_fraction(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), "user_id", "event_type", 7).select("event_id", "role")


STOP = ("the", "and", "of", "to")


@register("vector_text_fallback", f"""
WITH d AS (SELECT source, doc_id, text, doc_id = min(doc_id) OVER (PARTITION BY source) AS ref FROM documents), w AS (SELECT source, doc_id, ref, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS w FROM d),
f AS (SELECT source, doc_id, ref, w, count(*) AS n FROM w WHERE w NOT IN {STOP} GROUP BY ALL), k AS (SELECT source, count(*) AS docs FROM d GROUP BY 1), i AS (SELECT source, w, ln((1.0 + any_value(docs)) / (1 + count(*))) + 1 AS idf FROM f JOIN k USING (source) GROUP BY ALL),
x AS (SELECT source, doc_id, ref, w, n * idf AS x FROM f JOIN i USING (source, w)), r AS (SELECT source, w, x AS y, sqrt(sum(x * x) OVER (PARTITION BY source)) AS ny FROM x WHERE ref),
c AS (SELECT x.source, x.doc_id, coalesce(sum(x * y), 0) / (sqrt(sum(x * x)) * max(max(ny)) OVER (PARTITION BY x.source)) AS s FROM x LEFT JOIN r ON x.source = r.source AND x.w = r.w WHERE NOT ref GROUP BY x.source, x.doc_id)
SELECT d.source, d.doc_id, CAST(round(1000 * least(0.95, greatest(0.15, coalesce(s, 0) * 0.85 + 0.10))) AS BIGINT) AS permille FROM d LEFT JOIN c USING (source, doc_id) WHERE NOT d.ref""")
def text_fallback(spark, sf_dir):
    """Of each source the first document is the reference, the others are its candidates."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", "text")
    ref = materialise(d.groupBy("source").agg(F.min("doc_id").alias("doc_id")), "references")
    found = v.text_fallback(d.join(ref, ["source", "doc_id"], "left_anti"), "source", "doc_id", "text", d.join(ref, ["source", "doc_id"]).select("source", "text"), STOP)
    return found.select("source", "doc_id", F.round(C("score") * 1000).cast("long").alias("permille"))


LEADS = """l AS (SELECT page_id, CASE WHEN page_id % 3 > 0 THEN url ELSE '' END AS post_url, url, CASE WHEN page_id % 4 > 0 THEN substr(html, 1, page_id % 7) END AS title, CASE WHEN page_id % 2 = 0 THEN substr(html, 1, 20) END AS text, substr(html, 21, 20) AS snippet,
CASE WHEN page_id % 5 > 0 THEN page_id % 5 = 1 END AS has_media, CASE WHEN page_id % 3 = 1 THEN 'web' WHEN page_id % 3 = 2 THEN '' END AS source_connector, CASE WHEN page_id % 7 > 0 THEN 'p' || (page_id % 7) END AS platform, CASE WHEN page_id % 11 = 0 THEN 'published' END AS timestamp_type FROM pages)"""


def _leads(spark, sf_dir):
    no, html = C("page_id"), C("html")
    return table(spark, sf_dir, "pages").select(
        "page_id", F.when(no % 3 > 0, C("url")).otherwise("").alias("post_url"), "url", F.when(no % 4 > 0, F.substring(html, F.lit(1), (no % 7).cast("int"))).alias("title"), F.when(no % 2 == 0, F.substring(html, 1, 20)).alias("text"), F.substring(html, 21, 20).alias("snippet"),
        F.when(no % 5 > 0, no % 5 == 1).alias("has_media"), F.when(no % 3 == 1, "web").when(no % 3 == 2, "").alias("source_connector"), F.when(no % 7 > 0, F.concat(F.lit("p"), (no % 7).cast("string"))).alias("platform"), F.when(no % 11 == 0, "published").alias("timestamp_type"),
        *[F.lit(None).cast("string").alias(c) for c in ("account", "retrieved_at", "published_at", "media_verification", "evidence_status", "failure_reason")], F.lit(None).cast("boolean").alias("is_synthetic"),
    )


@register("record_lead_view", f"WITH {LEADS} SELECT page_id, url, nullif(title, '') AS title, coalesce(nullif(text, ''), nullif(snippet, '')) AS text, coalesce(has_media, false) AS has_media, coalesce(timestamp_type, 'unknown') AS timestamp_type, 'unverified_text' AS media_verification, 'unverified' AS evidence_status, false AS is_synthetic FROM l")
def lead_view(spark, sf_dir):
    d = _leads(spark, sf_dir).select("page_id", rc.lead_view().alias("v"))
    return d.select("page_id", *[C(f"v.{c}").alias(c) for c in ("url", "title", "text", "has_media", "timestamp_type", "media_verification", "evidence_status", "is_synthetic")])


@register("record_external_match", f"WITH {LEADS} SELECT page_id, url, coalesce(nullif(source_connector, ''), platform, 'unknown') AS source, nullif(title, '') AS page_title FROM l")
def external_match(spark, sf_dir):
    return _leads(spark, sf_dir).select("page_id", rc.external_match().alias("m")).select("page_id", "m.url", "m.source", "m.page_title")


@register("record_cohort_compact", "SELECT event_type AS cohort, user_id AS source, event_id AS anchor_id, CAST(event_id % 2 AS INT) AS label, round(value, 6) AS score FROM events")
def cohort_compact(spark, sf_dir):
    d = table(spark, sf_dir, "events").select(F.round("value", 6).alias("score"), "props", (C("event_id") % 2).cast("int").alias("label"), C("event_id").alias("anchor_id"), C("user_id").alias("source"), C("event_type").alias("cohort"), "ts")
    return rc.compact_records(d)


@register("sink_ledger_csv", """SELECT CAST(event_id AS VARCHAR) AS "Event_ID", CAST(user_id AS VARCHAR) AS "Case", event_type AS "Category", props || ', "quoted"' AS "Operation", sha256(props) AS "Entry_Hash" FROM events""")
def ledger_csv(spark, sf_dir):
    """The ledger's columns under their export names, written as one version and read back as text; quotes are doubled."""
    root = f"{shared_dir(spark)}/tessera-ledger-{uuid.uuid4().hex}"
    names = ["Event_ID", "Case", "Category", "Operation", "Entry_Hash"]
    d = table(spark, sf_dir, "events").select(C("event_id").cast("string"), C("user_id").cast("string"), "event_type", F.concat("props", F.lit(', "quoted"')), F.sha2("props", 256)).toDF(*names)
    versioned.write(d, root, "csv", names, header="true", quoteAll="true", escape='"')
    return versioned.read(spark, root)


@register("ledger_verify_tampered", "SELECT user_id, count(*) AS entries, (count(*) - 1) // 5 AS broken FROM events GROUP BY user_id")
def verify_tampered(spark, sf_dir):
    """Every fifth entry's hash is forged, so the entry after it does not follow."""
    forged = F.when(C("sequence") % 5 == 0, F.sha2("entry_hash", 256)).otherwise(C("entry_hash"))
    return lineage.verify_chain(ledger(spark, sf_dir).withColumn("entry_hash", forged), "user_id")


@register("protocol_validate_faults", """
WITH a AS (SELECT event_id, user_id, CASE WHEN user_id % 4 = 0 THEN ['train', 'dev'][event_id % 2 + 1] ELSE 'train' END AS role FROM events),
d AS (SELECT * FROM a UNION ALL SELECT * FROM a WHERE event_id % 10 = 0)
SELECT 3 - (SELECT count(DISTINCT role) FROM d) AS missing_roles, (SELECT count(*) FROM a WHERE event_id % 10 = 0) AS duplicate_samples, (SELECT count(*) FROM (SELECT user_id FROM d GROUP BY 1 HAVING count(DISTINCT role) > 1)) AS crossing_groups""")
def validate_faults(spark, sf_dir):
    """No holdout, every tenth sample twice, groups in two roles."""
    role = F.when((C("user_id") % 4 == 0) & (C("event_id") % 2 == 1), "dev").otherwise("train")
    a = table(spark, sf_dir, "events").select("event_id", "user_id", role.alias("role"))
    return p.validate_assignment(a.unionByName(a.where("event_id % 10 = 0")), "event_id", ["user_id"], "role", ["train", "dev", "holdout"])


SITE = r"regexp_extract(url, '^(https?://[^/?#]+)', 1)"


def _illustrated(spark, sf_dir):
    """The pages with pictures, a lead picture and a quoted post put into them."""
    no = C("page_id").cast("string")
    lead = F.concat(F.lit('<head><meta property="og:image" content="/og'), no, F.lit('.jpg">'))
    body = F.concat(F.lit('<article><img src="/pic'), no, F.lit('.jpg?w=300"><img src="data:x"><a href="https://twitter.com/user'), no, F.lit('/status/77">t</a>'))
    return table(spark, sf_dir, "pages").select("page_id", "url", F.replace(F.replace("html", F.lit("<head>"), lead), F.lit("<article>"), body).alias("html"))


@register("page_images_in_pages", f"SELECT page_id, unnest([{SITE} || '/pic' || page_id || '.jpg?w=300', {SITE} || '/pic' || page_id || '.jpg', {SITE} || '/og' || page_id || '.jpg']) AS image FROM pages")
def page_images(spark, sf_dir):
    return _illustrated(spark, sf_dir).select("page_id", F.explode_outer(pg.page_images(C("html"), C("url"))).alias("image")).where("image is not null")


@register("page_posts_in_pages", f"SELECT page_id, {SITE} || '/og' || page_id || '.jpg' AS image, 'https://x.com/user' || page_id || '/status/77' AS post, '@user' || page_id AS account FROM pages")
def page_posts(spark, sf_dir):
    d = _illustrated(spark, sf_dir).select("page_id", pg.lead_image(C("html"), C("url")).alias("image"), pg.embedded_post(C("html")).alias("x"))
    return d.select("page_id", "image", C("x.url").alias("post"), "x.account")
