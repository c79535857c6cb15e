"""Queries of the scalar functions, over pages, documents, events and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import ids, pages as pg, scores as sc, urls as u
from tessera.operators.metrics import hash_choice
from tessera.plans.metric_plans import r6
from tessera.plans.registry import register, table

HOST = "regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)', 2)), '^.*@', ''), ':[0-9]*$', ''), '[.]+$', '')"


@register("function_stable_ids", "SELECT page_id, 'fac_' || substr(sha1(url), 1, 12) AS fac, substr(md5(url), 1, 10) AS short, 'raw_' || substr(sha256(url), 1, 16) AS raw FROM pages")
def stable_ids(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", ids.sample_id(url).alias("fac"), ids.short_md5(url, 10).alias("short"), ids.raw_id(url).alias("raw"))


@register("function_hash_choice", "SELECT page_id, CAST(CAST('0x' || substr(sha256('5:' || url), 1, 16) AS UBIGINT) % 13 AS BIGINT) AS choice FROM pages")
def choice(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", hash_choice(F.concat(F.lit("5:"), F.col("url")), 13).alias("choice"))


@register("function_linked_ids", "SELECT o_orderkey, list_filter(list_transform(string_split(' a' || (o_custkey % 5) || ' ; ;b' || o_orderstatus || ';', ';'), lambda x: trim(x)), lambda x: x <> '') AS ids FROM orders")
def linked(spark, sf_dir):
    raw = F.concat(F.lit(" a"), (F.col("o_custkey") % 5).cast("string"), F.lit(" ; ;b"), F.col("o_orderstatus"), F.lit(";"))
    return table(spark, sf_dir, "orders").select("o_orderkey", ids.linked_ids(raw).alias("ids"))


@register("function_path_identity", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'id' || user_id END AS identity FROM events")
def path_identity(spark, sf_dir):
    e, who = F.col("event_id"), F.col("user_id").cast("string")
    path = F.when(e % 4 == 0, F.concat(F.lit("root/idx/"), who)).otherwise(F.concat(F.lit("root/id"), who, F.lit("/id9999999/clip.mp4")))
    return table(spark, sf_dir, "events").select("event_id", ids.path_identity(path).alias("identity"))


@register("function_group_key", "SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'identity' WHEN user_id % 3 = 1 THEN 'original_id' ELSE 'sample_id_fallback' END AS kind, CASE WHEN user_id % 3 = 0 THEN 'u' || user_id WHEN user_id % 3 = 1 THEN event_type ELSE CAST(event_id AS VARCHAR) END AS value FROM events")
def group_key(spark, sf_dir):
    k = F.col("user_id") % 3
    identity = F.when(k == 0, F.concat(F.lit(" u"), F.col("user_id").cast("string"))).otherwise(" Unknown ")
    original = F.when(k == 1, F.col("event_type")).otherwise("n/a")
    return table(spark, sf_dir, "events").select("event_id", ids.group_key(identity, original, F.col("event_id")).alias("g")).select("event_id", "g.*")


@register("function_fraction", "SELECT event_id, round(value / (1 + user_id % 7), 6) AS f, CASE WHEN event_id % 5 = 0 THEN 0 ELSE value END AS x FROM events")
def fraction(spark, sf_dir):
    v = F.col("value").cast("string")
    text = F.concat(v, F.lit("/"), (1 + F.col("user_id") % 7).cast("string"))
    return table(spark, sf_dir, "events").select("event_id", F.round(ids.fraction(text), 6).alias("f"), ids.finite(F.when(F.col("event_id") % 5 == 0, "inf").otherwise(v)).alias("x"))


@register("function_url_parts", f"SELECT page_id, {HOST} AS host, replace({HOST}, 'www.', '') AS domain, lower(regexp_extract(url, '^([a-z]+)://', 1) || '://' || regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) || regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', '')) AS normal FROM pages")
def url_parts(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", u.host(url).alias("host"), u.base_domain(url).alias("domain"), u.normalize_url(url).alias("normal"))


@register("function_public_url", f"SELECT page_id, false AS by_default, NOT ({HOST} = 'example.net' OR suffix({HOST}, '.example.net')) AS other_list FROM pages")
def public(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", u.public_url(url).alias("by_default"), u.public_url(url, ["example.net"], ()).alias("other_list"))


@register("function_authoritative", f"SELECT page_id, ({HOST} = 'example.org' OR suffix({HOST}, '.example.org')) AS wire FROM pages")
def authoritative(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", u.authoritative(u.host(F.col("url")), ["reuters.com", "example.org"]).alias("wire"))


POSTS = "SELECT event_id, user_id, CASE event_id % 5 WHEN 0 THEN 'https://www.reddit.com/user/u' || user_id || '/c' WHEN 1 THEN 'https://x.com/acc' || user_id || '/status/' || event_id WHEN 2 THEN 'https://youtu.be/watch?v=' || event_id WHEN 3 THEN 'https://m.facebook.com/page' || user_id ELSE 'https://site' || user_id || '.org/2024/01/15/story-of_' || event_id END AS url FROM events"


def _posts(spark, sf_dir):
    e, who = F.col("event_id"), F.col("user_id").cast("string")
    k, s = e % 5, e.cast("string")
    url = (
        F.when(k == 0, F.concat(F.lit("https://www.reddit.com/user/u"), who, F.lit("/c"))).when(k == 1, F.concat(F.lit("https://x.com/acc"), who, F.lit("/status/"), s))
        .when(k == 2, F.concat(F.lit("https://youtu.be/watch?v="), s)).when(k == 3, F.concat(F.lit("https://m.facebook.com/page"), who)).otherwise(F.concat(F.lit("https://site"), who, F.lit(".org/2024/01/15/story-of_"), s))
    )
    return table(spark, sf_dir, "events").select("event_id", "user_id", url.alias("url"))


@register("function_platform_account", f"WITH p AS ({POSTS}) SELECT event_id, ['reddit', 'x', 'youtube', 'facebook', 'web'][event_id % 5 + 1] AS platform, CASE event_id % 5 WHEN 0 THEN regexp_extract(url, 'user/(u[0-9]+)', 1) WHEN 1 THEN regexp_extract(url, '(acc[0-9]+)', 1) WHEN 3 THEN regexp_extract(url, '(page[0-9]+)', 1) WHEN 4 THEN '2024' END AS account FROM p")
def platform_account(spark, sf_dir):
    url = F.col("url")
    return _posts(spark, sf_dir).select("event_id", u.platform(url).alias("platform"), u.account(url).alias("account"))


@register("function_url_dates", f"WITH p AS ({POSTS}) SELECT event_id, CASE WHEN event_id % 5 = 4 THEN '2024-01-15' END AS day, CASE event_id % 5 WHEN 0 THEN 'user u' || user_id || ' c' WHEN 1 THEN 'acc' || user_id || ' status ' || event_id WHEN 2 THEN 'watch' WHEN 3 THEN 'page' || user_id ELSE '2024 01 15 story of ' || event_id END AS slug FROM p")
def url_dates(spark, sf_dir):
    url = F.col("url")
    return _posts(spark, sf_dir).select("event_id", u.url_date(url).cast("string").alias("day"), u.slug_words(url).alias("slug"))


@register("function_snowflake", "SELECT event_id, epoch_ms(make_timestamp(((event_id * 9973 + 1500000000000 * 4194304) >> 22) * 1000 + 1288834974657000)) AS ms FROM events")
def snowflake(spark, sf_dir):
    i = F.col("event_id") * 9973 + F.lit(1500000000000 * 4194304)
    return table(spark, sf_dir, "events").select("event_id", F.unix_millis(u.snowflake_time(i)).alias("ms"))


@register("function_strip_resize", "SELECT event_id, 'https://cdn.org/i' || event_id || '.jpg' || CASE WHEN event_id % 2 = 0 THEN '?id=' || user_id ELSE '' END AS url FROM events")
def strip_resize(spark, sf_dir):
    e, w = F.col("event_id"), F.col("user_id").cast("string")
    url = F.concat(F.lit("https://cdn.org/i"), e.cast("string"), F.lit(".jpg"), F.when(e % 2 == 0, F.concat(F.lit("?w=300&id="), w, F.lit("&h=20"))).otherwise(F.concat(F.lit("?width="), w, F.lit("&quality=80"))))
    return table(spark, sf_dir, "events").select("event_id", u.strip_resize(url).alias("url"))


@register("function_meaningful_filename", "SELECT event_id, event_id % 4 = 3 AS meaningful FROM events")
def filename(spark, sf_dir):
    e = F.col("event_id")
    name = F.when(e % 4 == 0, F.concat(F.md5(e.cast("string").cast("binary")), F.lit(".jpg"))).when(e % 4 == 1, F.concat(F.lit("IMG_"), e.cast("string"), F.lit(".JPG"))).when(e % 4 == 2, F.lit("untitled.png")).otherwise(F.concat(F.lit("flood at bridge "), e.cast("string"), F.lit(".mp4")))
    return table(spark, sf_dir, "events").select("event_id", u.meaningful_filename(name).alias("meaningful"))


@register("function_text_date", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN '2024-03-' || lpad(CAST(1 + event_id % 28 AS VARCHAR), 2, '0') WHEN 1 THEN '2023-02-' || lpad(CAST(1 + event_id % 28 AS VARCHAR), 2, '0') WHEN 2 THEN '2022-11-' || lpad(CAST(1 + event_id % 28 AS VARCHAR), 2, '0') END AS day FROM events")
def text_date(spark, sf_dir):
    e = F.col("event_id")
    d = (1 + e % 28).cast("string")
    text = F.when(e % 4 == 0, F.concat(F.lit("seen 2024-03-"), F.lpad(d, 2, "0"), F.lit(" Feb 3, 2021"))).when(e % 4 == 1, F.concat(F.lit("on February "), d, F.lit(", 2023 in"))).when(e % 4 == 2, F.concat(F.lit("the "), d, F.lit(" Nov 2022"))).otherwise("no date 2020")
    return table(spark, sf_dir, "events").select("event_id", u.text_date(text).alias("day"))


@register("function_page_fields", "SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>([^<]*)</title>', 1)) AS title, CAST(len(list_distinct(regexp_extract_all(html, '(?is)<a[^>]*href=[\"'']([^\"'']+)', 1))) AS INT) AS n_links, 0 AS n_images FROM pages")
def page_fields(spark, sf_dir):
    h = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", pg.title(h).alias("title"), F.size(pg.links(h)).alias("n_links"), F.size(pg.image_urls(h)).alias("n_images"))


@register("function_page_links", "WITH l AS (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '(?is)<a[^>]*href=[\"'']([^\"'']+)', 1))) AS href FROM pages) SELECT page_id, href FROM l")
def page_links(spark, sf_dir):
    return pg.exploded_links(table(spark, sf_dir, "pages")).select("page_id", "href")


@register("function_visible_text", r"SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'))) AS digest FROM pages")
def visible_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(pg.visible_text(F.col("html")).cast("binary")).alias("digest"))


@register("function_redaction", "SELECT doc_id, md5(replace(replace(text, 'tion', '[REDACTED]'), 'the', '[REDACTED]')) AS digest FROM documents")
def redaction(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(ids.redact(F.col("text"), ["the", "", "tion"]).cast("binary")).alias("digest"))


@register("function_safe_filename", "SELECT event_id, 'a_b_' || event_type || '_' || event_id || '.mp4' AS name FROM events")
def safe(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", ids.safe_filename(F.concat(F.lit("../x/.a b?"), F.col("event_type"), F.lit("  "), F.col("event_id").cast("string"), F.lit(".mp4_"))).alias("name"))


@register("function_first_reason", "SELECT event_id, CASE WHEN value < 1 THEN 'TOO_SMALL' WHEN event_type = 'error' THEN 'ERROR' WHEN user_id = 3 THEN 'BLOCKED' END AS reason FROM events")
def reason(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", ids.first_reason((F.col("value") < 1, "TOO_SMALL"), (F.col("event_type") == "error", "ERROR"), (F.col("user_id") == 3, "BLOCKED")).alias("reason"))


@register("function_media_type", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/png' WHEN 2 THEN 'video/mp4' END AS kind FROM events")
def media(spark, sf_dir):
    e = F.col("event_id") % 4
    head = F.when(e == 0, "FFD8FFE000104A46").when(e == 1, "89504E470D0A1A0A").when(e == 2, "0000001866747970").otherwise("FFD8FFE000104A46")
    return table(spark, sf_dir, "events").select("event_id", ids.media_type(F.unhex(head), F.when(e == 0, "JPG").when(e == 1, "png").when(e == 2, "mov").otherwise("png")).alias("kind"))


@register("score_sigmoid_softmax", "WITH e AS (SELECT event_id, value / 20 - 3 AS a, user_id / 50.0 AS b FROM events) SELECT event_id, round(1 / (1 + exp(-a)), 6) AS p, round(exp(a) / (exp(a) + exp(b) + 1), 6) AS s0, CASE WHEN a >= b AND a >= 0 THEN 0 WHEN b >= 0 THEN 1 ELSE 2 END AS top FROM e")
def sigmoid_softmax(spark, sf_dir):
    a, b = F.col("value") / 20 - 3, F.col("user_id") / 50.0
    s = sc.softmax([a, b, F.lit(0.0)])
    return table(spark, sf_dir, "events").select("event_id", F.round(sc.sigmoid(a), 6).alias("p"), F.round(F.get(s, F.lit(0)), 6).alias("s0"), sc.argmax(F.array(a, b.cast("double"), F.lit(0.0))).alias("top"))


@register("score_evidence_vector", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE value END AS visual, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS visual_mask, CASE WHEN event_id % 5 = 0 THEN 0 ELSE 1 END AS audio_mask FROM events WHERE NOT (event_id % 3 = 0 AND event_id % 5 = 0)")
def evidence_vector(spark, sf_dir):
    e = F.col("event_id")
    v = sc.evidence_vector([(F.col("value"), e % 3 != 0), (F.col("user_id"), e % 5 != 0)])
    return table(spark, sf_dir, "events").select("event_id", v.alias("v")).where("v is not null").select("event_id", F.get("v", F.lit(0)).alias("visual"), F.get("v", F.lit(2)).cast("int").alias("visual_mask"), F.get("v", F.lit(3)).cast("int").alias("audio_mask"))


@register("score_leave_one_out", "SELECT event_id, b AS branch, CASE WHEN b = 0 THEN CASE WHEN event_id % 5 = 0 THEN 0 ELSE 3 END ELSE CASE WHEN event_id % 3 = 0 THEN 0 ELSE value + 1 END END::DOUBLE AS total FROM events, (SELECT unnest([0, 1]) AS b) WHERE (b = 0 AND event_id % 3 <> 0) OR (b = 1 AND event_id % 5 <> 0)")
def leave_one_out(spark, sf_dir):
    e = F.col("event_id")
    v = sc.evidence_vector([(F.col("value"), e % 3 != 0), (F.lit(2.0), e % 5 != 0)])
    d = table(spark, sf_dir, "events").select("event_id", F.explode(sc.leave_one_out(v, 2)).alias("x"))
    return d.select("event_id", "x.branch", F.aggregate("x.vector", F.lit(0.0), lambda s, y: s + y).alias("total"))


@register("score_boxes", "WITH p AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS s FROM part) SELECT p_partkey, greatest(0, s - 10 - 0.2 * 30) AS x0, least(60, s + 20 + 0.2 * 30) AS x1, s / 100 >= 0 AND s / 100 + 0.7 <= 1 AS valid, CASE WHEN s > 0 THEN round(sqrt(s * 2) / 2, 6) ELSE 1 END AS scale FROM p")
def boxes(spark, sf_dir):
    s = F.col("p_size").cast("double")
    xs = F.array(s - 10, s, s + 20)
    b = sc.margin_box(xs, xs, F.lit(60.0), F.lit(60.0), 0.2)
    return table(spark, sf_dir, "part").select("p_partkey", b["x0"].alias("x0"), b["x1"].alias("x1"), sc.valid_box(s / 100, F.lit(0.0), F.lit(0.7), F.lit(0.5)).alias("valid"), F.round(sc.homography_scale(s, F.lit(0.0), F.lit(0.0), F.lit(2.0), F.lit(2.0)), 6).alias("scale"))


@register("score_eye_aspect", "SELECT p_partkey, round((2.0 * p_size / 50) / (2 * (1 + p_partkey % 3)), 6) AS ear FROM part")
def eye(spark, sf_dir):
    w, h = 1 + F.col("p_partkey") % 3, F.col("p_size") / 50
    pt = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    z = F.lit(0.0)
    pts = F.array(pt(z, z), pt(w / 3, h / 2), pt(2 * w / 3, h / 2), pt(w, z), pt(2 * w / 3, -h / 2), pt(w / 3, -h / 2))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(sc.eye_aspect_ratio(pts), 6).alias("ear"))


@register("score_acceptance", "WITH u AS (SELECT user_id, avg(value) / 40 AS a, min(value) AS b FROM events GROUP BY 1) SELECT user_id, (a + 1e-9 >= 0.98 AND b + 1e-9 >= 0.97) AS accepted, CAST(CASE WHEN a + 1e-9 >= 0.98 THEN 0 ELSE 1 END + CASE WHEN b + 1e-9 >= 0.97 THEN 0 ELSE 1 END AS INT) AS n_reasons FROM u")
def acceptance(spark, sf_dir):
    d = table(spark, sf_dir, "events").groupBy("user_id").agg((F.avg("value") / 40).alias("a"), F.min("value").alias("b"))
    d = d.select("user_id", sc.acceptance(F.col("a"), F.col("b"), F.lit(0.0)).alias("x"))
    return d.select("user_id", "x.accepted", F.size("x.reasons").alias("n_reasons"))


@register("score_fingerprint_decision", "WITH e AS (SELECT event_id, value / 200 AS c, user_id % 10 / 100.0 AS m FROM events) SELECT event_id, CASE WHEN c < 0.15 THEN 'no_match' WHEN m < 0.02 THEN 'ambiguous' ELSE 'match' END AS decision, round(CASE WHEN c < 0.15 THEN 0 WHEN m < 0.02 THEN least(0.6, c) ELSE least(0.99, 0.5 + c) END, 6) AS confidence FROM e")
def fingerprint(spark, sf_dir):
    d = table(spark, sf_dir, "events").select("event_id", sc.fingerprint_decision(F.col("value") / 200, F.col("user_id") % 10 / 100.0).alias("x"))
    return r6(d.select("event_id", "x.*"))
