"""Queries of record normalisation and of labels. Input columns are written once, in SQL that both engines read."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import labels as lb, records as rc
from tessera.operators import audits as au
from tessera.plans.metric_plans import r6
from tessera.plans.registry import register, table
from tessera.session import bounded_batches

C = F.col


def made(spark, sf_dir, name: str, cols: dict[str, str], dealt=lambda d: d):
    """The columns in SQL over a table, whose rows go through dealt first."""
    return dealt(table(spark, sf_dir, name)).selectExpr(*[f"{e} AS {n}" for n, e in cols.items()])


def sql(name: str, cols: dict[str, str]) -> str:
    return f"r AS (SELECT {', '.join(f'{e} AS {n}' for n, e in cols.items())} FROM {name})"


RECORD = {
    "event_id": "event_id", "url": "CASE WHEN event_id % 5 = 0 THEN '' ELSE ' https://s' || CAST(user_id AS STRING) || '.org/' END",
    "is_synthetic": "CASE event_id % 7 WHEN 0 THEN 'Yes' WHEN 1 THEN '1' WHEN 2 THEN 'no' END", "evidence_status": "CASE event_id % 6 WHEN 0 THEN 'verified' WHEN 1 THEN 'bogus' WHEN 2 THEN '' END",
    "published_at": "CASE event_id % 4 WHEN 1 THEN 'not a date' WHEN 2 THEN '2024-03-01T10:00:00Z' WHEN 3 THEN '2024-03-02' END",
    "timestamp_type": "CASE event_id % 9 WHEN 0 THEN 'published' WHEN 1 THEN 'retrieved_at' WHEN 2 THEN 'weird' WHEN 3 THEN 'platform_decoded' END",
    "has_media": "event_id % 2 = 0", "media_verification": "CASE event_id % 8 WHEN 0 THEN 'exact' WHEN 1 THEN 'strange' END",
}


@register("record_normalized", f"""WITH {sql('events', RECORD)}, k AS (SELECT *, coalesce(lower(is_synthetic) IN ('1', 'true', 'yes'), false) AS syn, coalesce(timestamp_type, CASE WHEN published_at IS NULL THEN 'unknown' ELSE 'published' END) AS t FROM r),
t AS (SELECT *, CASE WHEN t = 'weird' THEN 'unknown' ELSE t END AS tt FROM k), b AS (SELECT *, published_at IS NOT NULL AND tt NOT IN ('retrieved_at', 'unknown') AS cnt, coalesce(published_at = 'not a date', false) AS bad FROM t)
SELECT event_id, 'search' AS source_connector, CASE WHEN cnt AND NOT bad THEN published_at END AS published_at, CASE WHEN cnt AND bad THEN 'unknown' ELSE tt END AS timestamp_type,
CASE media_verification WHEN 'exact' THEN 'exact' WHEN 'strange' THEN 'unverified_text' ELSE CASE WHEN has_media THEN 'not_downloaded' ELSE 'unverified_text' END END AS media_verification,
CASE WHEN evidence_status = 'verified' THEN 'verified' WHEN evidence_status = 'bogus' THEN 'unverified' WHEN syn THEN 'fixture' ELSE 'unverified' END AS evidence_status, syn AS is_synthetic, trim(url) AS post_url FROM b""")
def normalized(spark, sf_dir):
    d = rc.normalized_candidates(made(spark, sf_dir, "events", RECORD), "search", "2024-05-01T00:00:00Z")
    return d.select("event_id", "source_connector", "published_at", "timestamp_type", "media_verification", "evidence_status", "is_synthetic", "post_url")


CONTEXT = {"event_id": "event_id", "a": "CASE WHEN event_id % 5 = 0 THEN ' seen ' || event_type ELSE '  ' END", "b": "CASE WHEN event_id % 3 = 0 THEN 'searched' END", "c": "CASE WHEN event_id % 2 = 0 THEN event_type ELSE '' END"}


@register("record_context_choice", f"WITH {sql('events', CONTEXT)} SELECT event_id, coalesce(nullif(trim(a), ''), b, nullif(c, ''), '') AS text, CASE WHEN trim(a) <> '' THEN 'investigator' WHEN b IS NOT NULL THEN 'search' WHEN c <> '' THEN 'local' END AS source FROM r")
def context(spark, sf_dir):
    d = made(spark, sf_dir, "events", CONTEXT)
    return d.select("event_id", rc.context_choice(("investigator", C("a")), ("search", C("b")), ("local", C("c"))).alias("x")).select("event_id", "x.*")


CONNECTOR = {"user_id": "user_id", "status": "CASE event_id % 3 WHEN 0 THEN 'not_run' WHEN 1 THEN 'completed' END", "n": "CASE WHEN event_id % 2 = 0 THEN event_id END", "seen": "CASE WHEN event_id % 5 = 0 THEN 'then' END", "event_id": "event_id"}


@register("record_connector_status", f"WITH {sql('events', CONNECTOR)} SELECT event_id, CASE WHEN status = 'completed' THEN status ELSE 'empty' END AS status, coalesce(n, 0) AS result_count, coalesce(seen, 'now') AS retrieved_at FROM r")
def connector(spark, sf_dir):
    d = made(spark, sf_dir, "events", CONNECTOR)
    return d.select("event_id", rc.connector_status(C("status"), C("n"), C("seen"), "empty", "now").alias("s")).select("event_id", "s.*")


MANIFEST = {
    "event_id": "event_id", "sample_id": "CASE WHEN event_id % 97 = 96 THEN '' ELSE CAST(event_id AS STRING) END", "file_path": "CASE WHEN event_id % 89 = 88 THEN NULL ELSE 'f' END",
    "modality": "CASE event_id % 3 WHEN 0 THEN 'audio_only' WHEN 1 THEN 'audio_video' ELSE CASE WHEN event_id % 83 = 5 THEN 'text' ELSE 'audio_video' END END",
}


@register("record_required_branches", f"WITH {sql('events', MANIFEST)} SELECT event_id, unnest(CASE modality WHEN 'audio_only' THEN ['audio'] WHEN 'audio_video' THEN ['visual', 'audio', 'dense_av'] END) AS branch FROM r")
def branches(spark, sf_dir):
    return made(spark, sf_dir, "events", MANIFEST).select("event_id", F.explode(rc.required_branches(C("modality"))).alias("branch"))


@register("record_manifest_problem", f"WITH {sql('events', MANIFEST)} SELECT event_id, CASE WHEN sample_id = '' THEN 'missing sample_id' WHEN file_path IS NULL THEN 'missing file_path' ELSE 'unsupported modality ' || modality END AS problem FROM r WHERE sample_id = '' OR file_path IS NULL OR modality = 'text'")
def problems(spark, sf_dir):
    d = made(spark, sf_dir, "events", MANIFEST)
    return d.select("event_id", rc.manifest_problem(["sample_id", "file_path", "modality"], "modality").alias("problem")).where("problem is not null")


@register("record_batches", "SELECT o_orderkey, CAST(floor((row_number() OVER (ORDER BY o_orderkey) - 1) / 64) AS BIGINT) AS batch FROM orders")
def batches(spark, sf_dir):
    return au.row_batches(table(spark, sf_dir, "orders"), ["o_orderkey"], 64).select("o_orderkey", "batch")


SCORES = {"event_id": "event_id", "s": "event_type", "value": "value"}


@register("record_timeline_score", "SELECT event_id, CASE WHEN event_type = 'click' THEN value / 500 WHEN event_type = 'view' THEN value / 100 END AS value, CASE event_type WHEN 'click' THEN 'softmax' WHEN 'view' THEN 'logit' ELSE 'unavailable' END AS label FROM events")
def timeline_score(spark, sf_dir):
    d = made(spark, sf_dir, "events", SCORES)
    soft = F.create_map(F.lit("click"), C("value") / 500, F.lit("view"), F.lit(float("nan")))
    return d.select("event_id", rc.timeline_score(C("s"), ("softmax", soft), ("logit", F.create_map(F.lit("view"), C("value") / 100))).alias("x")).select("event_id", "x.*")


@register("record_sensitivity_sentence", """WITH g AS (SELECT user_id, list_sort(list_distinct(list(event_type) FILTER (value > 150))) AS c, list_sort(list_distinct(list(event_type) FILTER (value < 5))) AS s FROM events GROUP BY 1)
SELECT user_id, CASE WHEN c IS NULL AND s IS NULL THEN 'No branch could be left out.' ELSE concat_ws(' ', 'The selected class changed without ' || array_to_string(c, ', ') || '.', 'It stayed the same without ' || array_to_string(s, ', ') || '.') END AS sentence FROM g""")
def sentence(spark, sf_dir):
    t = C("event_type")
    g = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_set(F.when(C("value") > 150, t))).alias("c"), F.sort_array(F.collect_set(F.when(C("value") < 5, t))).alias("s"))
    return g.select("user_id", rc.sensitivity_sentence(C("c"), C("s")).alias("sentence"))


NUMBERS = {"event_id": "event_id", "x": "CASE event_id % 5 WHEN 0 THEN 'true' WHEN 1 THEN CAST(event_id AS STRING) || '.5' WHEN 2 THEN 'NaN' WHEN 3 THEN 'Infinity' END"}


@register("record_number", f"WITH {sql('events', NUMBERS)} SELECT event_id, CASE WHEN event_id % 5 = 1 THEN CAST(x AS DOUBLE) END AS x FROM r")
def number(spark, sf_dir):
    from tessera.functions.ids import finite

    return made(spark, sf_dir, "events", NUMBERS).select("event_id", finite(C("x"), None).alias("x"))


@register("record_unique_keys", "WITH k AS (SELECT p_partkey, p_brand || '_' || CAST(p_size % 5 AS VARCHAR) AS k FROM part), n AS (SELECT p_partkey, replace(k, '#', '_') AS k, row_number() OVER (PARTITION BY k ORDER BY p_partkey) AS n FROM k) SELECT p_partkey, CASE WHEN n = 1 THEN k ELSE k || '_' || n END AS key FROM n")
def unique_keys(spark, sf_dir):
    d = table(spark, sf_dir, "part").withColumn("name", F.concat(F.lit("-"), C("p_brand"), F.lit(" "), (C("p_size") % 5).cast("string"), F.lit("?")))
    return au.unique_keys(d.withColumn("k", rc.safe_key(C("name"))), "k", ["p_partkey"]).select("p_partkey", "key")


@register("record_humanized", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'OnePlus 9 Pro' WHEN 1 THEN 'EXIF A Phone' ELSE 'Pixel ' || p_partkey END AS name FROM part")
def humanized(spark, sf_dir):
    k = C("p_partkey")
    return table(spark, sf_dir, "part").select(k, rc.humanized(F.when(k % 3 == 0, "oneplus_9-pro").when(k % 3 == 1, " exif__a_phone ").otherwise(F.concat(F.lit("pixel-"), k.cast("string")))).alias("name"))


@register("record_readiness", "WITH g AS (SELECT user_id, bool_or(value > 300) AS demo, count(*) > 15 AS t FROM events GROUP BY 1) SELECT user_id, CASE WHEN t AND NOT demo THEN 'ready' ELSE 'degraded' END AS status, t AND NOT demo AS usable, demo FROM g")
def readiness(spark, sf_dir):
    g = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(F.when(C("value") > 300, "Synthetic A").otherwise("phone")).alias("l"), (F.count("*") > 15).alias("t"))
    return g.select("user_id", rc.readiness(C("t"), C("l")).alias("x")).select("user_id", "x.*")


@register("record_result_problem", """SELECT event_id, CASE WHEN event_type = 'view' THEN 'label' WHEN value > 300 THEN 'confidence' WHEN event_id % 7 = 0 THEN 'signals' WHEN event_id % 5 = 0 THEN 'signal' END AS problem FROM events""")
def result_problem(spark, sf_dir):
    e = C("event_id")
    signal = F.array(F.struct(F.lit("edges").alias("name"), F.lit("high").alias("severity")), F.struct(F.when(e % 5 == 0, " ").otherwise("noise").alias("name"), F.lit("low").alias("severity")))
    d = table(spark, sf_dir, "events").select("event_id", C("event_type").alias("label"), (C("value") / 300).alias("confidence"), F.when(e % 7 != 0, signal).alias("signals"))
    return d.select("event_id", rc.valid_result(["click", "purchase", "signup", "error"], ["low", "high"]).alias("problem"))


FILES = {"p_partkey": "p_partkey", "name": "'FakeVideo/000' || CAST(p_partkey AS STRING) || '_id01005' || CASE p_partkey % 4 WHEN 0 THEN '_wavtolip' WHEN 1 THEN '_id777_FaceSwap' WHEN 2 THEN '_x_sv2tts' ELSE '' END || '.mp4'"}


@register("label_filename_parts", "SELECT p_partkey, '000' || p_partkey AS content_id, CASE WHEN p_partkey % 4 = 1 THEN 'id01005;id777' ELSE 'id01005' END AS linked, CASE p_partkey % 4 WHEN 0 THEN 'wav2lip' WHEN 1 THEN 'faceswap' WHEN 2 THEN 'sv2tts' ELSE 'unknown' END AS method FROM part")
def filename_parts(spark, sf_dir):
    return made(spark, sf_dir, "part", FILES).select("p_partkey", lb.filename_parts(C("name")).alias("x")).select("p_partkey", "x.*")


@register("label_classes", "SELECT p_partkey, CAST(p_partkey % 4 IN (1, 3) AS INT) AS visual_label, CAST(p_partkey % 4 IN (2, 3) AS INT) AS audio_label, CAST(p_partkey % 4 AS INT) AS final_label, ['REAL', 'VISUAL_MANIPULATION', 'AUDIO_MANIPULATION', 'AUDIO_VISUAL_MANIPULATION'][p_partkey % 4 + 1] AS semantic_class FROM part")
def classes(spark, sf_dir):
    k = C("p_partkey")
    folder = F.concat(F.when(k % 4 % 2 == 1, "Fake").otherwise("Real"), F.lit("Video-"), F.when(k % 4 >= 2, "Fake").otherwise("Real"), F.lit("Audio"))
    return table(spark, sf_dir, "part").select(k, lb.class_labels(folder).alias("x")).select("p_partkey", "x.*")


@register("label_same_text", "SELECT p_partkey, coalesce(p_partkey % 3 = 0, false) AS same FROM part")
def same_text(spark, sf_dir):
    k = C("p_partkey")
    return table(spark, sf_dir, "part").select(k, lb.same_text(F.when(k % 3 == 0, " hInDi ").when(k % 3 == 1, "hindi2"), "Hindi").alias("same"))


MENTIONS = {"event_id": "event_id", "text": "CASE event_id % 5 WHEN 0 THEN 'a tweet by @user_' || CAST(user_id AS STRING) || ' today' WHEN 1 THEN 'shared via @YouTube' WHEN 2 THEN 'Posted on x.com by @abc' WHEN 3 THEN 'mail me @nobody' END"}


@register("label_suspect_account", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN '@user_' || user_id WHEN 2 THEN '@abc' END AS account FROM events")
def suspect(spark, sf_dir):
    return made(spark, sf_dir, "events", MENTIONS).select("event_id", lb.suspect_account(C("text")).alias("account"))


@register("label_media_url", """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'https://t/' || event_id WHEN 1 THEN 'https://i/' || event_id WHEN 2 THEN 'https://img.youtube.com/vi/abcdefghijk/hqdefault.jpg' WHEN 3 THEN 'https://a.org/x.WEBP' WHEN 4 THEN 'https://i.redd.it/abc' END AS media FROM events""")
def media_url(spark, sf_dir):
    e = C("event_id")
    url = F.when(e % 6 == 2, "https://www.youtube.com/watch?v=abcdefghijk&t=1").when(e % 6 == 3, "https://a.org/x.WEBP").when(e % 6 == 4, "https://i.redd.it/abc").otherwise("https://a.org/page")
    thumb, image = F.when(e % 6 == 0, F.concat(F.lit("https://t/"), e.cast("string"))).otherwise(""), F.when(e % 6 == 1, F.concat(F.lit("https://i/"), e.cast("string")))
    return table(spark, sf_dir, "events").select("event_id", lb.media_url(url, thumb, image).alias("media"))


@register("label_platform_domain", """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'x' WHEN 1 THEN 'reddit' WHEN 2 THEN 'news' WHEN 3 THEN 'web' WHEN 4 THEN 'web' ELSE 'youtube' END AS platform,
CASE event_id % 6 WHEN 0 THEN 'x.com' WHEN 1 THEN 'reddit.com' WHEN 2 THEN 'apnews.com' WHEN 3 THEN 'unknown' WHEN 4 THEN 'site' || user_id || '.org' ELSE 'bbc.com' END AS domain FROM events""")
def platform_domain(spark, sf_dir):
    e = C("event_id") % 6
    label = F.when(e == 0, "Twitter").when(e == 1, "").when(e == 2, "AP News").when(e == 5, "BBC")
    url = F.when(e == 1, "https://reddit.com/r/x").when(e == 2, "https://m.ndtv.com/a").when(e == 3, "https://www.google.com/goto?x").when(e == 4, F.concat(F.lit("https://www.site"), C("user_id").cast("string"), F.lit(".org/a"))).when(e == 5, "https://youtu.be/abc").otherwise("https://a.org")
    return table(spark, sf_dir, "events").select("event_id", lb.label_platform(url, label).alias("platform"), lb.label_domain(url, F.when(e == 1, "Reddit").otherwise(label)).alias("domain"))


@register("label_folder", """SELECT p_partkey, ['original', 'original', 'whatsapp', 'instagram', 'my_phone', 'unknown'][p_partkey % 6 + 1] AS platform, ['reference', 'test', 'platform_sample', 'test', 'platform_sample', 'platform_sample'][p_partkey % 6 + 1] AS split FROM part""")
def folder(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, ["Reference", "Native-test", " whatsApp compressed", "ig query 7", "My Phone", " "])), (C("p_partkey") % 6 + 1).cast("int"))
    platform = lb.folder_platform(name)
    return table(spark, sf_dir, "part").select("p_partkey", platform.alias("platform"), lb.folder_split(name, platform).alias("split"))


SIZES = {"p_partkey": "p_partkey", "w": "CASE p_partkey % 5 WHEN 0 THEN 1080 WHEN 1 THEN 720 WHEN 2 THEN 2048 WHEN 3 THEN 0 ELSE 4000 END", "h": "CAST(200 + p_size * 20 AS INT)"}


@register("label_dimension_hints", f"""WITH {sql('part', SIZES)}, x AS (SELECT *, greatest(w, h) AS l, least(w, h) AS s FROM r WHERE w > 0)
SELECT p_partkey, 'instagram' AS label, 0.22::DOUBLE AS score FROM x WHERE l IN (1080, 1350, 1440) OR w = 1080 OR h = 1080 UNION ALL SELECT p_partkey, 'facebook', 0.18 FROM x WHERE l IN (720, 960, 1200, 2048) UNION ALL SELECT p_partkey, 'reddit', 0.1 FROM x WHERE l <= 1280 AND l < 2.2 * s""")
def dimension_hints(spark, sf_dir):
    return made(spark, sf_dir, "part", SIZES).select("p_partkey", F.inline(lb.dimension_hints(C("w"), C("h"))))


DATED = {"p_partkey": "p_partkey", "d": "CASE WHEN p_partkey % 5 = 0 THEN '2021:03:04 05:06:07' ELSE ' ' END", "name": "CASE p_partkey % 5 WHEN 1 THEN '0123456789abcdef0123456789abcdef_shot 2022-05-06 at 7.08.09.png' WHEN 2 THEN 'pxl_20230102_030405.jpg' WHEN 3 THEN 'img-20230908.jpg' ELSE 'x.jpg' END"}


@register("label_date_hint", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '2021-03-04 05:06:07' WHEN 1 THEN '2022-05-06 07:08:09' WHEN 2 THEN '2023-01-02 03:04:05' WHEN 3 THEN '2023-09-08 00:00:00' END AS at FROM part")
def date_hint(spark, sf_dir):
    return made(spark, sf_dir, "part", DATED).select("p_partkey", lb.date_hint(C("d"), C("name")).alias("at"))


@register("label_device", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Acme One' WHEN 1 THEN 'acme Two' WHEN 2 THEN 'Acme' END AS device FROM part")
def device(spark, sf_dir):
    k = C("p_partkey") % 4
    return table(spark, sf_dir, "part").select("p_partkey", lb.device_label(F.when(k < 3, " Acme"), F.when(k == 0, "One ").when(k == 1, "acme Two").when(k == 2, "")).alias("device"))


@register("label_floor_date", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN DATE '2021-01-26' - 30 WHEN 1 THEN DATE '2019-01-01' - 30 END AS floor FROM part")
def floor_date(spark, sf_dir):
    k = C("p_partkey") % 3
    return table(spark, sf_dir, "part").select("p_partkey", lb.floor_date(F.when(k == 0, "on 2021/01-26 or 2018").when(k == 1, "in 2019").otherwise("1999")).alias("floor"))


ROLES = {"p_partkey": "p_partkey", "c": "CASE p_partkey % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'target_is_crop_of_candidate' WHEN 2 THEN 'candidate_is_crop_of_target' ELSE 'none' END", "d": "p_partkey * 37 % 60"}


@register("label_match_roles", f"""WITH {sql('part', ROLES)} SELECT p_partkey, CASE WHEN c LIKE 'target%' THEN 'uncropped_parent' WHEN c LIKE 'candidate%' THEN 'derivative_crop' WHEN c = 'exact' OR d <= 30 THEN 'exact_clone' ELSE 'frontier' END AS role,
CASE WHEN c LIKE 'target%' THEN 'parent_master_original' WHEN c = 'exact' OR d <= 30 THEN 'exact_clone' WHEN c LIKE 'candidate%' THEN 'downscaled_crop' ELSE 'visual_match' END AS label FROM r""")
def match_roles(spark, sf_dir):
    return made(spark, sf_dir, "part", ROLES).select("p_partkey", lb.match_role(C("c"), C("d")).alias("role"), lb.match_label(C("c"), C("d")).alias("label"))


@register("label_scene_tokens", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'flood,bridge,thumb' ELSE '' END AS tokens, CASE WHEN p_partkey % 2 = 0 THEN 'flood bridge' ELSE 'Protest rally procession' END AS event, CASE WHEN p_partkey % 2 = 0 THEN '2019' ELSE '2021' END AS year FROM part")
def scene(spark, sf_dir):
    name = F.when(C("p_partkey") % 2 == 0, "a/flood-at bridge.2019-640_thumb.jpg").otherwise("12.png")
    return table(spark, sf_dir, "part").select("p_partkey", lb.scene_tokens(name).alias("x")).select("p_partkey", F.array_join("x.tokens", ",").alias("tokens"), "x.event", "x.year")


VERDICTS = {"event_id": "event_id", "user_id": "user_id", "cosine": "CAST(event_id % 101 AS DOUBLE) / 100", "similarity": "CASE WHEN event_id % 3 > 0 THEN CAST(event_id % 97 AS DOUBLE) / 100 END", "media": "CASE WHEN event_id % 5 > 0 THEN 'm' END"}


@register("evidence_visual_verification", f"""WITH {sql('events', VERDICTS)}, p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY coalesce(similarity, 0) DESC, event_id) AS n FROM r WHERE media IS NOT NULL)
SELECT event_id, CASE WHEN cosine >= 0.9 THEN 'exact' WHEN cosine >= 0.8 THEN 'near_duplicate' ELSE 'failed' END AS media_verification, CAST(floor(100 * CASE WHEN cosine >= 0.8 THEN least(0.96, greatest(coalesce(similarity, 0), cosine * 1.05)) ELSE similarity END + 1e-6) AS BIGINT) AS percent FROM p WHERE n <= 15""")
def visual_verification(spark, sf_dir):
    d = au.first_of(made(spark, sf_dir, "events", VERDICTS).where("media is not null"), ["user_id"], [F.desc(F.coalesce("similarity", F.lit(0.0))), "event_id"], 15)
    d = d.select("event_id", lb.visual_verdict(C("cosine"), C("similarity")).alias("x")).select("event_id", "x.*")
    return d.select("event_id", "media_verification", F.floor(100 * C("similarity") + 1e-6).cast("long").alias("percent"))


PAGES = {"event_id": "event_id", "user_id": "user_id", "domain": "CASE event_id % 7 WHEN 0 THEN 'www.reuters.com' ELSE 'site' || CAST(event_id AS STRING) || '.org' END", "hop": "CASE event_id % 3 WHEN 0 THEN 'exact_match' WHEN 1 THEN 'visual' ELSE 'link' END", "image": "'https://i/' || CASE event_id % 4 WHEN 0 THEN 'Original' WHEN 1 THEN '1920' ELSE 'x' END"}


@register("search_page_plan", f"""WITH {sql('events', PAGES)}, k AS (SELECT *, CASE WHEN domain LIKE '%reuters.com' THEN 0 WHEN hop <> 'link' THEN 1 ELSE 2 END AS priority, CASE WHEN image LIKE '%Original' THEN 0 WHEN image LIKE '%1920' THEN 1 ELSE 2 END AS image_rank FROM r),
p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY priority, event_id) AS page, row_number() OVER (PARTITION BY user_id ORDER BY image_rank, event_id) AS image_place FROM k) SELECT event_id, priority, image_rank, page <= 15 AS scraped, image_place <= 6 AS fetched FROM p WHERE page <= 15 OR image_place <= 6""")
def page_plan(spark, sf_dir):
    d = made(spark, sf_dir, "events", PAGES).withColumn("priority", lb.page_priority(C("domain"), C("hop"), ["reuters.com"])).withColumn("image_rank", lb.image_rank(C("image")))
    pages, images = au.first_of(d, ["user_id"], ["priority", "event_id"], 15), au.first_of(d, ["user_id"], ["image_rank", "event_id"], 6)
    both = pages.select("event_id", "priority", "image_rank", F.lit(True).alias("scraped")).join(images.select("event_id", C("priority").alias("p"), C("image_rank").alias("i"), F.lit(True).alias("fetched")), "event_id", "full")
    no = F.lit(False)
    return both.select("event_id", F.coalesce("priority", "p").alias("priority"), F.coalesce("image_rank", "i").alias("image_rank"), F.coalesce("scraped", no).alias("scraped"), F.coalesce("fetched", no).alias("fetched"))


@register("search_queries", """WITH u AS (SELECT c_custkey, c_mktsegment FROM customer) SELECT c_custkey, p AS platform, unnest(CASE WHEN c_custkey % 3 = 0 THEN ['Anna Berg Rome ' || lower(c_mktsegment) || ' flood', 'Anna Berg Rome ' || p, lower(c_mktsegment) || ' flood'] ELSE [lower(c_mktsegment) || ' flood', p] END) AS query FROM u, (SELECT unnest(['reddit', 'x']) AS p)""")
def search_queries(spark, sf_dir):
    from tessera.operators.profiles import search_queries as queries

    text = F.when(C("c_custkey") % 3 == 0, "when Anna Berg went to Rome, and Anna Berg back to Oslo").otherwise("nothing here")
    q = queries(text, F.array(F.lower("c_mktsegment"), F.lit("flood")), ["reddit", "x"])
    return table(spark, sf_dir, "customer").select("c_custkey", F.explode(q).alias("platform", "queries")).select("c_custkey", "platform", F.explode("queries").alias("query"))


@register("score_blend", "SELECT event_id, CAST(round(1000 * least(1, greatest(0, 0.7 * (event_id % 10) / 10 + 0.3 * value / 97)) + 1e-7) AS BIGINT) AS score FROM events")
def blend(spark, sf_dir):
    from tessera.functions.scores import blend as b

    s = b((C("event_id") % 10) / 10, C("value") / 97, F.lit(0.7), F.lit(0.3))
    return table(spark, sf_dir, "events").select("event_id", F.round(1000 * s + 1e-7).cast("long").alias("score"))


@register("audit_value_counts", "SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1")
def value_counts(spark, sf_dir):
    return au.value_counts(table(spark, sf_dir, "events"), "event_type")


@register("audit_component_classes", "SELECT user_id % 7 AS component, count(*) AS videos, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'error') AS error FROM events GROUP BY 1")
def component_classes(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    members = ev.select("user_id", (C("user_id") % 7).alias("component")).distinct()
    return au.component_classes(ev, members, "user_id", "component", "event_type", ["click", "view", "error"])


@register("audit_retention", "SELECT event_type AS cohort, count(*) AS records, count(DISTINCT user_id) AS sources, count(DISTINCT user_id % 10) AS identities FROM events GROUP BY 1")
def retention(spark, sf_dir):
    return au.retention(table(spark, sf_dir, "events").withColumn("identity", C("user_id") % 10), "event_type", "user_id", "identity").withColumnRenamed("event_type", "cohort")


@register("audit_extraction_summary", """WITH s AS (SELECT *, CASE WHEN value < 5 THEN 'FAILED' WHEN event_id % 4 = 0 THEN 'SKIPPED_VALID_OUTPUT' ELSE 'COMPLETED' END AS st FROM events)
SELECT user_id, count(*) AS selected, count(*) FILTER (st = 'COMPLETED') AS completed, count(*) FILTER (st = 'SKIPPED_VALID_OUTPUT') AS skipped, count(*) FILTER (st = 'FAILED') AS failed, round(count(*) FILTER (st = 'FAILED') / count(*), 6) AS failure_rate,
round(sum(event_id % 10) FILTER (st = 'COMPLETED') / nullif(sum(event_id % 20) FILTER (st = 'COMPLETED'), 0), 6) AS coverage, round(sum(value) FILTER (st = 'COMPLETED') / nullif(count(*) FILTER (st = 'COMPLETED'), 0), 6) AS mean_bytes FROM s GROUP BY user_id""")
def extraction(spark, sf_dir):
    e = C("event_id")
    ev = table(spark, sf_dir, "events").select("user_id", F.when(C("value") < 5, "FAILED").when(e % 4 == 0, "SKIPPED_VALID_OUTPUT").otherwise("COMPLETED").alias("status"), (e % 10).alias("aligned"), (e % 20).alias("windows"), C("value").alias("bytes"))
    return r6(au.extraction_summary(ev, ["user_id"]))


@register("audit_census", """SELECT CAST(event_id % 2 AS INT) AS label, count(*) AS n, count(*) FILTER (user_id % 5 = 0) AS offset_m4, count(*) FILTER (user_id % 5 = 1) AS offset_m2, count(*) FILTER (user_id % 5 = 2) AS offset_0, count(*) FILTER (user_id % 5 = 3) AS offset_2, count(*) FILTER (user_id % 5 = 4) AS offset_4,
count(*) FILTER (value > 100) AS padded, round(avg(greatest(0, value - 100)), 6) AS mean_padding, round(avg(event_id), 6) AS mean_position FROM events GROUP BY 1""")
def census(spark, sf_dir):
    d = table(spark, sf_dir, "events").select((C("event_id") % 2).cast("int").alias("label"), ((C("user_id") % 5 - 2) * 2).alias("offset"), F.greatest(F.lit(0.0), C("value") - 100).alias("padding"), C("event_id").alias("position"))
    return r6(au.census(d, [-4, -2, 0, 2, 4]))


@register("search_earliest_valid", "SELECT user_id, CAST(min(epoch_us(ts)) FILTER (event_id % 20 <> 0 AND (event_type <> 'error' OR value <= 30)) AS BIGINT) AS earliest_us FROM events GROUP BY 1")
def earliest(spark, sf_dir):
    """Some events are moved to 1999, where no publication can be."""
    ev = table(spark, sf_dir, "events").withColumn("ts", F.when(C("event_id") % 20 == 0, F.lit("1999-01-01").cast("timestamp")).otherwise(C("ts")))
    ok = (C("event_type") != "error") | (C("value") <= 30)
    return au.earliest_valid(ev, ["user_id"], "ts", ok).select("user_id", F.unix_micros("earliest").alias("earliest_us"))


TIMED = {
    "event_id": "event_id", "url": "CASE event_id % 6 WHEN 0 THEN 'https://a/2021/03/04/x.jpg' WHEN 1 THEN 'https://a/x-2022-05_06.jpg' WHEN 2 THEN 'https://a/x20230708.jpg' WHEN 3 THEN 'https://a/2020/09/x.jpg' ELSE 'https://a/x.jpg' END",
    "modified": "CASE WHEN event_id % 12 = 3 THEN 'Wed, 21 Oct 2015 07:28:00 GMT' WHEN event_id % 12 = 4 THEN 'soon' END", "dated": "CASE WHEN event_id % 6 = 4 THEN 'Tue, 3 Feb 2015 00:00:01 GMT' END",
}


@register("function_media_time", "SELECT event_id, CASE event_id % 6 WHEN 0 THEN '2021-03-04 00:00:00' WHEN 1 THEN '2022-05-06 00:00:00' WHEN 2 THEN '2023-07-08 00:00:00' WHEN 3 THEN CASE WHEN event_id % 12 = 3 THEN '2015-10-21 07:28:00' ELSE '2020-09-01 00:00:00' END WHEN 4 THEN '2015-02-03 00:00:01' END AS at FROM events")
def media_time(spark, sf_dir):
    from tessera.functions.urls import media_time as when

    return made(spark, sf_dir, "events", TIMED).select("event_id", F.date_format(when(C("url"), C("modified"), C("dated")), "yyyy-MM-dd HH:mm:ss").alias("at"))


PAYLOAD = {"p_partkey": "p_partkey", "payload": """'{"a":{"media_path":"/tmp/x' || CAST(p_partkey AS STRING) || '.mp4","log_directory":"data/l","n":1},"l":[{"u":"file:///tmp/y"},{"plot":"/out/p.png"}],"note":"/kept/as/text","cache_path":"relative"}'"""}


@register("function_public_payload", """SELECT p_partkey, '{"a":{"media_path":"evidence://sha256/s' || p_partkey || '","log_directory":"REDACTED_INTERNAL_PATH","n":1},"l":[{"u":"REDACTED_INTERNAL_PATH"},{"plot":"/api/p"}],"note":"/kept/as/text","cache_path":"relative"}' AS payload FROM part""")
def public_payload(spark, sf_dir):
    from tessera.functions.payloads import public_payload as public

    bounded_batches(spark)
    sha = F.concat(F.lit("s"), C("p_partkey").cast("string"))
    return made(spark, sf_dir, "part", PAYLOAD).select("p_partkey", public(C("payload"), sha, {"/out/p.png": "/api/p"}).alias("payload"))


@register("function_public_texts", r"""
SELECT doc_id, md5('see "REDACTED_INTERNAL_PATH" \ ' || text) AS note_md5, 'evidence://sha256/' || sha256(text) AS own, 'REDACTED_INTERNAL_PATH' AS first_log, 'kept "as" it is' AS second_log, '/api/' || doc_id AS plot, '/x\"y/' || doc_id AS label FROM documents""")
def public_texts(spark, sf_dir):
    """Payloads around whole texts, with quotes and backslashes in paths, nested lists and file URLs inside a text."""
    from tessera.functions.payloads import public_payload as public

    bounded_batches(spark)
    key = C("doc_id").cast("string")
    inner = F.struct(F.concat(F.lit('/srv/a"b\\'), key, F.lit(".mp4")).alias("Image_Path"), F.array(F.array(F.concat(F.lit('outputs/"x"/'), key)), F.array(F.lit('kept "as" it is'))).alias("log_folders"))
    whole = F.struct(F.concat(F.lit('see "file:///tmp/'), key, F.lit('" \\ '), C("text")).alias("note"), F.array(inner).alias("items"), F.lit("file:///out/p.png").alias("plot"), F.concat(F.lit('/x\\"y/'), key).alias("label"))
    kind = "note string, items array<struct<Image_Path: string, log_folders: array<array<string>>>>, plot string, label string"
    d = table(spark, sf_dir, "documents").select("doc_id", F.from_json(public(F.to_json(whole), F.sha2("text", 256), {"/out/p.png": "/api/"}), kind).alias("p"))
    logs = F.flatten(C("p.items")[0]["log_folders"])
    return d.select("doc_id", F.md5(C("p.note").cast("binary")).alias("note_md5"), C("p.items")[0]["Image_Path"].alias("own"), logs[0].alias("first_log"), logs[1].alias("second_log"), F.concat("p.plot", C("doc_id").cast("string")).alias("plot"), C("p.label").alias("label"))


@register("function_redacted_payload", "SELECT doc_id, md5(replace(replace(text, 'tion', '[REDACTED]'), 'the', '[REDACTED]')) AS nested_md5, 'o[REDACTED]r' AS key, md5(replace(replace(text || '\"', 'tion', '[REDACTED]'), 'the', '[REDACTED]')) AS value_md5 FROM documents")
def redacted_payload(spark, sf_dir):
    from tessera.functions.payloads import redacted_payload as redacted

    bounded_batches(spark)
    whole = F.struct(F.array(F.array("text")).alias("a"), F.create_map(F.lit("other"), F.concat("text", F.lit('"'))).alias("m"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.from_json(redacted(F.to_json(whole), ["the", "", "tion"]), "a array<array<string>>, m map<string, string>").alias("p"))
    return d.select("doc_id", F.md5(F.flatten("p.a")[0].cast("binary")).alias("nested_md5"), F.map_keys("p.m")[0].alias("key"), F.md5(F.map_values("p.m")[0].cast("binary")).alias("value_md5"))
