"""Series queries over events (one series a user) and vector queries over embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import metrics, pairs, series as s, vectors as v
from tessera.plans.metric_plans import r6
from tessera.plans.registry import register, table

RUNS = """
e AS (SELECT event_id, user_id, event_type, value, epoch(ts) AS t FROM events),
st AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) > 36000 THEN 1 ELSE 0 END AS b FROM e),
r0 AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS run, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS pos FROM st),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY t, event_id) - 1 AS run_pos FROM r0)"""


def _runs(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.col("ts").cast("double").alias("t"))
    runs = s.gap_runs(ev, ["user_id"], "t", 36000.0, "event_id")
    return runs.withColumns({c: F.col(c).cast("int") for c in ("pos", "run_pos")})


@register("series_gap_runs", f"WITH {RUNS} SELECT user_id, CAST(run AS BIGINT) AS run, CAST(min(pos) AS INT) AS first, CAST(max(pos) + 1 AS INT) AS last, count(*) AS n, round(min(t), 3) AS start, round(max(t), 3) AS \"end\" FROM r GROUP BY user_id, run")
def gap_runs(spark, sf_dir):
    return s.run_table(_runs(spark, sf_dir), ["user_id"], "t").select("user_id", "run", "first", "last", "n", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


@register("series_segments", f"""
WITH {RUNS}, g AS (SELECT user_id, run, run_pos, t AS start, max(t) OVER w AS e, avg(value) OVER w AS m, count(*) OVER w AS c FROM r WINDOW w AS (PARTITION BY user_id, run ORDER BY run_pos ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING))
SELECT user_id, CAST(run AS BIGINT) AS run, CAST(run_pos AS INT) AS run_pos, round(start, 3) AS start, round(e, 3) AS "end", round(m, 6) AS mean, round((start + e) / 2, 3) AS centre FROM g WHERE c = 4 AND run_pos % 2 = 0""")
def segments(spark, sf_dir):
    g = s.segments(_runs(spark, sf_dir), ["user_id"], "t", "value", 4, 2)
    return g.select("user_id", "run", "run_pos", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), F.round("mean", 6).alias("mean"), F.round("centre", 3).alias("centre"))


@register("series_velocity", f"""
WITH {RUNS} SELECT event_id, round(coalesce((value - lag(value) OVER w) / CASE WHEN t - lag(t) OVER w > 0 THEN t - lag(t) OVER w END, 0), 6) AS velocity FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)""")
def velocity(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "value", F.col("ts").cast("double").alias("t"))
    return s.velocity(ev, ["user_id"], "t", "value", "event_id").select("event_id", F.round("velocity", 6).alias("velocity"))


@register("series_collapse_repeats", "WITH l AS (SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) SELECT event_id, user_id, event_type FROM l WHERE b IS NULL OR b <> event_type")
def collapse(spark, sf_dir):
    return s.collapse_repeats(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "user_id", "event_type")


@register("series_first_per_tick", "WITH e AS (SELECT user_id, event_id, epoch(ts) AS t, CAST(floor((epoch(ts) + 1e-9) / 86400) AS BIGINT) AS tick FROM events) SELECT user_id, tick, arg_min(event_id, (t, event_id)) AS event_id FROM e GROUP BY user_id, tick")
def first_per_tick(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("double").alias("t"))
    return s.first_per_tick(ev, ["user_id"], "t", 1 / 86400, "event_id").select("user_id", "tick", "event_id")


@register("series_interval_align", """
WITH w AS (SELECT DISTINCT user_id, floor(epoch(ts) / 21600) * 21600 + 3600 AS s FROM events WHERE event_type = 'signup'), f AS (SELECT user_id, epoch(ts) AS t, value FROM events),
h AS (SELECT w.user_id, s, t, value, abs(value - lag(value) OVER (PARTITION BY w.user_id, s ORDER BY t)) AS d FROM w JOIN f ON w.user_id = f.user_id AND t >= s AND t < s + 43200)
SELECT user_id, s AS start_sec, count(*) AS n, round(avg(value), 6) AS mean, round(avg(d), 6) AS motion FROM h GROUP BY user_id, s HAVING count(*) >= 2""")
def interval_align(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("user_id", "event_type", "value", F.col("ts").cast("double").alias("ts"))
    start = (F.floor(F.col("ts") / 21600) * 21600 + 3600).cast("double").alias("start_sec")
    w = ev.where("event_type = 'signup'").select("user_id", start).distinct().withColumn("end_sec", F.col("start_sec") + 43200)
    return r6(s.interval_align(w, ev.drop("event_type"), "user_id", 43200.0).drop("end_sec"))


@register("series_mixed_windows", """
WITH e AS (SELECT user_id, event_id, epoch(ts) AS t, value FROM events), w AS (SELECT DISTINCT user_id, floor(t / 60) * 60 AS s, floor(t / 60) * 60 + 60 * pow(10, event_id % 5) AS z FROM e WHERE event_id % 3 = 0),
h AS (SELECT w.user_id, s, z, value, abs(value - lag(value) OVER (PARTITION BY w.user_id, s, z ORDER BY t, value)) AS d FROM w JOIN e ON w.user_id = e.user_id AND t >= s AND t < z)
SELECT user_id, s AS start_sec, z AS end_sec, count(*) AS n, round(avg(value), 6) AS mean, round(avg(d), 6) AS motion FROM h GROUP BY user_id, s, z HAVING count(*) >= 2""")
def mixed_windows(spark, sf_dir):
    """Windows of a minute to a week, overlapping, of one table."""
    ev = table(spark, sf_dir, "events").select("user_id", "event_id", "value", F.col("ts").cast("double").alias("ts"))
    start = (F.floor(F.col("ts") / 60) * 60).cast("double").alias("start_sec")
    w = ev.where("event_id % 3 = 0").select("user_id", start, (60 * F.pow(F.lit(10.0), F.col("event_id") % 5)).alias("_l")).select("user_id", "start_sec", (F.col("start_sec") + F.col("_l")).alias("end_sec"))
    return r6(s.interval_align(w, ev.drop("event_id"), "user_id", 60.0))


@register("series_shifted_pairs", f"""
WITH {RUNS}, o AS (SELECT unnest([-4, -2, 0, 2, 4]) AS off)
SELECT a.user_id, CAST(a.run AS BIGINT) AS run, CAST(a.run_pos AS INT) AS run_pos, CAST(off AS INT) AS "offset", a.value AS left_value, b.value AS right_value FROM r a CROSS JOIN o JOIN r b ON a.user_id = b.user_id AND a.run = b.run AND b.run_pos = a.run_pos + off""")
def shifted_pairs(spark, sf_dir):
    return s.shifted_pairs(_runs(spark, sf_dir), ["user_id"], "value", "value", [-4, -2, 0, 2, 4]).select("user_id", "run", "run_pos", "offset", "left_value", "right_value")


@register("series_circular_negatives", f"""
WITH {RUNS}, c AS (SELECT user_id, pos, value, count(*) OVER (PARTITION BY user_id) AS n FROM r),
h AS (SELECT *, 1 + CAST(CAST('0x' || substr(sha256('7:' || CAST(user_id AS VARCHAR)), 1, 16) AS UBIGINT) % greatest(n - 1, 1) AS BIGINT) AS sh FROM c)
SELECT user_id, CAST(pos AS INT) AS pos, 1 AS label, value, value AS other FROM c
UNION ALL SELECT a.user_id, CAST(a.pos AS INT), 0, a.value, b.value FROM h a JOIN h b ON a.user_id = b.user_id AND b.pos = (a.pos + a.sh) % a.n WHERE a.n > 1""")
def circular_negatives(spark, sf_dir):
    rows = _runs(spark, sf_dir).select("user_id", "pos", "value")
    shift = 1 + metrics.hash_choice(F.concat(F.lit("7:"), F.col("user_id").cast("string")), F.greatest(F.col("n") - 1, F.lit(1)).cast("decimal(20,0)"))
    return s.circular_negatives(rows, "user_id", "pos", "value", shift)


@register("series_fixed_windows", "WITH p AS (SELECT p_partkey, p_size * 1000 + 7 AS n FROM part), w AS (SELECT p_partkey, n, unnest(generate_series(0, n - 1, 4000)) AS s FROM p) SELECT p_partkey, CAST(s // 4000 AS INT) AS \"window\", s / 16000 AS start_sec, least(s + 8000, n) / 16000 AS end_sec FROM w")
def fixed_windows(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 1000 + 7).cast("long").alias("n"))
    return s.fixed_windows(p, "p_partkey", "n", 8000, 4000, 16000.0)


@register("series_context_padding", "SELECT p_partkey, greatest(0, -(p_size * 100 - 4000)) AS left_pad, greatest(0, p_size * 100 - 4000 + 8000 - 6000) AS right_pad, greatest(0, 8000 - greatest(0, -(p_size * 100 - 4000)) - greatest(0, p_size * 100 - 4000 + 8000 - 6000)) AS inside FROM part")
def context_padding(spark, sf_dir):
    left, right, inside = s.context_padding(F.col("p_size") * 100, F.lit(6000), 8000)
    return table(spark, sf_dir, "part").select("p_partkey", left.alias("left_pad"), right.alias("right_pad"), inside.alias("inside"))


@register("series_intervals_cv", "WITH d AS (SELECT user_id, epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY epoch(ts), event_id) AS d FROM events) SELECT user_id, count(d) AS n, round(stddev_pop(d) / avg(d), 6) AS cv, round(quantile_cont(d, 0.9) / avg(d), 6) AS ratio90 FROM d WHERE d IS NOT NULL GROUP BY user_id")
def intervals_cv(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("double").alias("t"))
    return r6(s.intervals_cv(ev, ["user_id"], "t", "event_id"))


V = "SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings"
P = f"p AS (SELECT vec_id, label, unnest(e) AS x, unnest(range(64)) AS pos FROM ({V}))"


@register("vector_column_moments", f"WITH {P} SELECT CAST(pos AS INT) AS pos, round(avg(x), 6) AS mean, round(greatest(stddev_pop(x), 1e-4), 6) AS std FROM p GROUP BY pos")
def column_moments(spark, sf_dir):
    return r6(v.column_moments(table(spark, sf_dir, "embeddings"), "embedding"))


@register("vector_moments_by_sums", f"WITH {P} SELECT CAST(pos AS INT) AS pos, round(avg(x), 6) AS mean, round(sqrt(greatest(sum(x * x) / count(*) - avg(x) * avg(x), 1e-8)), 6) AS std FROM p GROUP BY pos")
def moments_by_sums(spark, sf_dir):
    return r6(v.column_moments_by_sums(table(spark, sf_dir, "embeddings"), "embedding"))


@register("vector_centroids", f"WITH {P} SELECT label, CAST(pos AS INT) AS pos, round(avg(x), 6) AS m FROM p GROUP BY label, pos")
def centroids(spark, sf_dir):
    return v.centroids(table(spark, sf_dir, "embeddings"), "embedding", "label").select("label", F.posexplode("centroid").alias("pos", "m")).select("label", "pos", F.round("m", 6).alias("m"))


@register("vector_standardised_centroids", f"WITH {P}, z AS (SELECT pos, avg(x) AS a, stddev_pop(x) AS d FROM p GROUP BY pos) SELECT label, CAST(p.pos AS INT) AS pos, round(avg((x - a) / CASE WHEN d < 1e-6 THEN 1 ELSE d END), 6) AS m FROM p JOIN z ON p.pos = z.pos GROUP BY label, p.pos")
def standardised_centroids(spark, sf_dir):
    return v.standardised_centroids(table(spark, sf_dir, "embeddings"), "embedding", "label").select("label", F.posexplode("centroid").alias("pos", "m")).select("label", "pos", F.round("m", 6).alias("m"))


@register("vector_centroid_ranking", f"""
WITH {P}, c AS (SELECT label, list(m ORDER BY pos) AS c FROM (SELECT label, pos, avg(x) AS m FROM p GROUP BY label, pos) GROUP BY label),
s AS (SELECT vec_id, c.label, 1 / (1 + list_distance(e, c)) AS score FROM ({V}) q CROSS JOIN c),
t AS (SELECT *, score / sum(score) OVER (PARTITION BY vec_id) AS share, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS rank FROM s)
SELECT vec_id, label, round(score, 6) AS score, round(share, 6) AS share, CAST(rank AS INT) AS rank FROM t WHERE rank <= 8""")
def centroid_ranking(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return r6(v.centroid_ranking(e, "vec_id", "embedding", v.centroids(e, "embedding", "label"), "label", 8))


NEAR = f"""
WITH v AS ({V}), q AS (SELECT vec_id AS query, e AS q FROM v WHERE vec_id % 50 = 0),
s AS (SELECT query, vec_id, label, round(greatest(0, least(1, list_cosine_similarity(e, q))), 3) AS similarity FROM v CROSS JOIN q)"""


@register("vector_nearest", NEAR + ", r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, vec_id) AS rank FROM s) SELECT query, vec_id, similarity, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5")
def nearest(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return v.nearest(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", 5)


@register("vector_diverse_top", NEAR + """, f AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY query, label ORDER BY similarity DESC, vec_id) > 1 THEN 1 ELSE 0 END AS f FROM s),
c AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY f, similarity DESC, vec_id) AS c FROM f)
SELECT query, vec_id, label, similarity, CAST(row_number() OVER (PARTITION BY query ORDER BY similarity DESC, vec_id) AS INT) AS place FROM c WHERE c <= 15""")
def diverse_top(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    s_ = pairs.top_cosine(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", 15, group="label")
    return v.diverse_top(s_, "query", "label", "similarity", "vec_id", 15)


@register("vector_hamming", "WITH h AS (SELECT doc_id, sha256(text) AS a, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE sha256(CAST(doc_id AS VARCHAR)) END AS b FROM documents) SELECT doc_id, CAST(CASE WHEN b IS NULL THEN 999 ELSE list_sum(list_transform(range(64), lambda i: bit_count(xor(CAST('0x' || substr(a, i + 1, 1) AS INT), CAST('0x' || substr(b, i + 1, 1) AS INT))))) END AS INT) AS distance FROM h")
def hamming(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("a"), F.when(F.col("doc_id") % 9 != 0, F.sha2(F.col("doc_id").cast("string"), 256)).alias("b"))
    return d.select("doc_id", v.hamming256(F.col("a"), F.col("b")).alias("distance"))


@register("vector_correlation", f"WITH v AS ({V}), q AS (SELECT vec_id AS query, e AS q FROM v WHERE vec_id % 50 = 0), p AS (SELECT query, vec_id, unnest(e) AS x, unnest(q) AS y FROM v CROSS JOIN q) SELECT query, vec_id, round(corr(x, y), 6) AS r FROM p GROUP BY query, vec_id")
def correlation(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return r6(pairs.correlations(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding"))


HASHES = "h AS (SELECT p_partkey, substr(sha256(CAST(p_partkey // 20 AS VARCHAR)), 1, 52) || substr(sha256(CAST(CASE WHEN p_partkey % 3 = 0 THEN p_partkey // 20 * 1000 ELSE p_partkey END AS VARCHAR)), 1, 12) AS h FROM part)"
WORDS = ", ".join(f"CAST('0x' || substr(h, {1 + 16 * k}, 16) AS UBIGINT) AS w{k}" for k in range(4))
APART = " + ".join(f"CAST(bit_count(xor(a.w{k}, b.w{k})) AS INT)" for k in range(4))


@register("vector_hamming_pairs", f"""WITH {HASHES}, c AS (SELECT h, min(p_partkey) AS class, count(*) AS n, {WORDS} FROM h GROUP BY h)
SELECT a.class AS "left", b.class AS "right", CAST({APART} AS INT) AS distance, a.n AS n_left, b.n AS n_right FROM c a JOIN c b ON a.class < b.class WHERE {APART} <= 22""")
def hamming_pairs(spark, sf_dir):
    """Parts of twenty share most of their hash's bits; every third part of them has the same hash."""
    key = F.col("p_partkey")
    group = F.floor(key / 20)
    own = F.when(key % 3 == 0, group * 1000).otherwise(key)
    h = F.concat(F.substring(F.sha2(group.cast("string"), 256), 1, 52), F.substring(F.sha2(own.cast("string"), 256), 1, 12))
    classes, _ = pairs.hash_classes(table(spark, sf_dir, "part").select("p_partkey", h.alias("h")), "p_partkey", "h")
    return pairs.hamming_pairs(classes, 22)


@register("vector_token_overlap", """
WITH i AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f]+'), lambda w: w <> '')) AS w FROM benchmark), d AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f]+'), lambda w: w <> '')) AS w FROM documents)
SELECT item_id, doc_id, round(len(list_intersect(i.w, d.w)) / greatest(len(i.w), 1), 6) AS overlap FROM d CROSS JOIN i WHERE item_id % 50 = 0""".replace("\\t", "\t").replace("\\n", "\n").replace("\\r", "\r").replace("\\f", "\f"))
def token_overlap(spark, sf_dir):
    i = table(spark, sf_dir, "benchmark").where("item_id % 50 = 0").select("item_id", F.col("text").alias("_t"))
    return table(spark, sf_dir, "documents").crossJoin(i).select("item_id", "doc_id", F.round(v.token_overlap(F.col("_t"), F.col("text")), 6).alias("overlap"))


@register("vector_tfidf", """
WITH t AS (SELECT item_id AS k, unnest(regexp_extract_all(lower(text), '[a-z0-9_]{2,}')) AS t FROM benchmark), f AS (SELECT k, t, count(*) AS tf FROM t GROUP BY k, t),
i AS (SELECT t, ln((1.0 + (SELECT count(*) FROM benchmark)) / (1 + count(*))) + 1 AS idf FROM f GROUP BY t), w AS (SELECT k, t, tf * idf AS w FROM f JOIN i USING (t)), u AS (SELECT k, t, w / sqrt(sum(w * w) OVER (PARTITION BY k)) AS w FROM w)
SELECT q.k AS query, u.k AS item_id, round(sum(u.w * q.w), 6) AS similarity FROM u JOIN u q ON u.t = q.t WHERE q.k % 50 = 0 GROUP BY ALL""")
def tfidf(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    return r6(v.tfidf_cosine(b, "item_id", "text", b.where("item_id % 50 = 0")))
