"""Queries of frames and segments, model scores, evaluations, orderings, sets, and of sources and sinks by round trip."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions import scores as sc
from tessera.operators import audits as au, lineage, metrics as m, protocol as p, series as s
from tessera.plans.metric_plans import r6
from tessera.plans.record_plans import made, sql
from tessera.plans.registry import register, table
from tessera.session import shared_dir
from tessera.sources import sinks, tables as tb, versioned

C = F.col

STEPS = {"event_id": "event_id", "user_id": "user_id", "value": "value"}
#: Per user, rows a quarter second apart; some are moved, and a long gap starts a run.
EVEN = """e0 AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events), e1 AS (SELECT *, n * 0.25 + CASE WHEN n >= 25 THEN 5 ELSE 0 END + CASE WHEN event_id % 41 = 0 THEN 0.1 ELSE 0 END AS t FROM e0),
e2 AS (SELECT *, CASE WHEN n >= 25 THEN 1 ELSE 0 END AS run, CASE WHEN n >= 25 THEN n - 25 ELSE n END AS run_pos FROM e1)"""


def _even(spark, sf_dir):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    ev = table(spark, sf_dir, "events").withColumn("n", n)
    t = C("n") * 0.25 + F.when(C("n") >= 25, 5).otherwise(0) + F.when(C("event_id") % 41 == 0, 0.1).otherwise(0)
    runs = s.gap_runs(ev.withColumn("t", t), ["user_id"], "t", 4.0, "event_id")
    return runs.withColumns({c: C(c).cast("int") for c in ("pos", "run_pos")})


@register("series_vector_deltas", f"WITH {EVEN} SELECT event_id, round(coalesce(value - lag(value) OVER w, 0), 6) AS d0, round(coalesce(2 * (value - lag(value) OVER w), 0), 6) AS d1 FROM e2 WINDOW w AS (PARTITION BY user_id, run ORDER BY run_pos)")
def vector_deltas(spark, sf_dir):
    d = _even(spark, sf_dir).withColumn("v", F.array("value", C("value") * 2))
    d = s.vector_deltas(d, ["user_id"], "v")
    return d.select("event_id", F.round(F.get("delta", F.lit(0)), 6).alias("d0"), F.round(F.get("delta", F.lit(1)), 6).alias("d1"))


ANCHORS = f"""WITH {EVEN}, l AS (SELECT user_id, run, list(t ORDER BY run_pos) AS ts, list(event_id % 53 > 0 ORDER BY run_pos) AS seen FROM e2 GROUP BY ALL), a AS (SELECT *, unnest(range(0, len(ts), 2)) AS a FROM l),
o AS (SELECT *, unnest([-4, -2, 0, 2, 4]) AS o FROM a), c AS (SELECT *, a + o >= 0 AND a + o + 3 <= len(ts) AND a + 3 <= len(ts) AS fits FROM o),
k AS (SELECT user_id, run, a, bool_and(fits AND abs(ts[a+2] - ts[a+1] - 0.25) <= 0.05 AND abs(ts[a+3] - ts[a+2] - 0.25) <= 0.05 AND abs(ts[a+o+2] - ts[a+o+1] - 0.25) <= 0.05 AND abs(ts[a+o+3] - ts[a+o+2] - 0.25) <= 0.05
AND abs(ts[a+o+1] - ts[a+1] - o * 0.25) <= 0.05 AND abs(ts[a+o+2] - ts[a+2] - o * 0.25) <= 0.05 AND abs(ts[a+o+3] - ts[a+3] - o * 0.25) <= 0.05) AS ok, bool_and(list_bool_and(seen[a-3:a+7])) AND a - 4 > 0 AS strict FROM c GROUP BY user_id, run, a)
SELECT user_id, CAST(run AS BIGINT) AS run, CAST(a AS INT) AS run_pos FROM k WHERE ok"""


@register("series_anchors", ANCHORS)
def anchors(spark, sf_dir):
    return s.anchors(_even(spark, sf_dir), ["user_id"], "t", 3, 2, 0.25, 0.05)


@register("series_strict_anchors", ANCHORS + " AND strict")
def strict_anchors(spark, sf_dir):
    return s.anchors(_even(spark, sf_dir).withColumn("seen", C("event_id") % 53 > 0), ["user_id"], "t", 3, 2, 0.25, 0.05, observed="seen")


PROBE = """f AS (SELECT user_id, event_id, epoch(ts) AS t, value AS packet, event_type = 'click' AS key, CASE event_type WHEN 'click' THEN 'i' WHEN 'view' THEN 'P' ELSE 'B' END AS kind FROM events),
g AS (SELECT *, row_number() OVER w AS no, t - lag(t) OVER w AS dt FROM f WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), h AS (SELECT user_id, no - lag(no) OVER (PARTITION BY user_id ORDER BY no) AS gop FROM g WHERE key),
q AS (SELECT user_id, avg(gop) AS gm, stddev_pop(gop) AS gs, max(gop) AS gx FROM h GROUP BY 1)"""


def _frames(spark, sf_dir):
    t = C("event_type")
    return table(spark, sf_dir, "events").select("user_id", "event_id", C("ts"), C("value").alias("packet"), (t == "click").alias("key"), F.when(t == "click", "i").when(t == "view", "P").otherwise("B").alias("kind"), "value")


@register("series_probe_statistics", f"""WITH {PROBE} SELECT g.user_id, count(*) AS frames, round(count(*) FILTER (key) / count(*), 6) AS key_share, round(coalesce(any_value(gm), count(*)), 6) AS gop_mean, round(coalesce(any_value(gs), 0), 6) AS gop_std, round(coalesce(any_value(gx), count(*)), 6) AS gop_max,
round(coalesce(stddev_pop(packet) FILTER (packet > 0) / avg(packet) FILTER (packet > 0), 0), 6) AS packet_cv, round(coalesce(quantile_cont(packet, 0.9) FILTER (packet > 0) / avg(packet) FILTER (packet > 0), 1), 6) AS packet_p90, round(coalesce(stddev_pop(dt) FILTER (dt > 0) / avg(dt) FILTER (dt > 0), 0), 5) AS step_cv,
round(count(*) FILTER (kind = 'i') / count(*), 6) AS i_share, round(count(*) FILTER (kind = 'P') / count(*), 6) AS p_share, round(count(*) FILTER (kind = 'B') / count(*), 6) AS b_share FROM g LEFT JOIN q ON q.user_id = g.user_id GROUP BY g.user_id""")
def probe(spark, sf_dir):
    return r6(s.probe_statistics(_frames(spark, sf_dir), ["user_id"], "event_id").withColumn("step_cv", F.round("step_cv", 5)))


STATS = """d AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id)) AS d FROM events), st AS (SELECT user_id, count(*) AS frames, avg(value) AS value_mean, stddev_pop(value) AS value_std, coalesce(stddev_pop(value) / avg(value), 0) AS value_cv,
coalesce(avg(CAST(d <= 10 AS INT)), 0) AS near_duplicates, coalesce(avg(d), 0) AS change_mean, coalesce(stddev_pop(d) / avg(d), 0) AS change_cv FROM d GROUP BY user_id)"""


@register("series_frame_statistics", f"WITH {STATS} SELECT user_id, frames, round(value_mean, 6) AS value_mean, round(value_std, 6) AS value_std, round(value_cv, 6) AS value_cv, round(near_duplicates, 6) AS near_duplicates, round(change_mean, 6) AS change_mean, round(change_cv, 6) AS change_cv FROM st")
def frame_stats(spark, sf_dir):
    return r6(s.frame_statistics(_frames(spark, sf_dir), ["user_id"], "event_id", ["value"], "value", 10.0))


@register("score_compression_vector", f"WITH {STATS} SELECT user_id, CAST(unnest([0, 1, 2, 3]) AS INT) AS pos, round(unnest([ln(1 + value_mean), value_cv, near_duplicates, change_cv]), 6) AS x FROM st")
def compression_vector(spark, sf_dir):
    d = s.frame_statistics(_frames(spark, sf_dir), ["user_id"], "event_id", ["value"], "value", 10.0)
    return r6(d.select("user_id", F.posexplode(sc.compression_vector(["value_mean", "value_cv", "near_duplicates", "change_cv"], ["value_mean"])).alias("pos", "x")))


#: A small fixed network for the query; a trained model's weights take its place.
NET = {
    "gain": (1.0, 0.5, 2.0), "shift": (0.1, 0.0, -0.1), "hidden": ((0.5, -1.0, 0.25), (1.5, 0.5, -0.75)), "hidden_bias": (0.1, -0.2),
    "out": ((1.0, -0.5), (0.25, 0.75), (-1.0, 1.0), (0.0, 0.5)), "out_bias": (0.0, 0.1, 0.2, 0.3),
}


def _net_sql() -> str:
    x = ["value / 100", "(event_id % 10) / 5.0", "(user_id % 7) / 3.0"]
    mean = f"(({' + '.join(x)}) / 3)"
    var = "((" + " + ".join(f"pow({a} - {mean}, 2)" for a in x) + ") / 3)"
    norm = [f"(({a} - {mean}) / sqrt({var} + 1e-5) * {g} + {b})" for a, g, b in zip(x, NET["gain"], NET["shift"])]
    hid = [" + ".join(f"{w} * {n}" for w, n in zip(row, norm)) + f" + {b}" for row, b in zip(NET["hidden"], NET["hidden_bias"])]
    t = lambda z: f"(1 / (1 + 0.3275911 * abs({z} / sqrt(2))))"
    erf = lambda z: f"(sign({z}) * (1 - (0.254829592 * {t(z)} - 0.284496736 * pow({t(z)}, 2) + 1.421413741 * pow({t(z)}, 3) - 1.453152027 * pow({t(z)}, 4) + 1.061405429 * pow({t(z)}, 5)) * exp(-{z} * {z} / 2)))"
    g = ", ".join(f"h{i} * 0.5 * (1 + {erf(f'h{i}')}) AS g{i}" for i in range(2))
    out = ", ".join("round(" + " + ".join(f"{w} * g{i}" for i, w in enumerate(row)) + f" + {b}, 5) AS l{k}" for k, (row, b) in enumerate(zip(NET["out"], NET["out_bias"])))
    return f"WITH h AS (SELECT event_id, {', '.join(f'{e} AS h{i}' for i, e in enumerate(hid))} FROM events), a AS (SELECT event_id, {g} FROM h) SELECT event_id, {out} FROM a"


@register("score_fusion_forward", _net_sql())
def fusion(spark, sf_dir):
    x = F.array(C("value") / 100, (C("event_id") % 10) / 5.0, (C("user_id") % 7) / 3.0)
    logits = sc.fusion_forward(x, NET["gain"], NET["shift"], NET["hidden"], NET["hidden_bias"], NET["out"], NET["out_bias"])
    return table(spark, sf_dir, "events").select("event_id", logits.alias("l")).select("event_id", *[F.round(F.get("l", F.lit(k)), 5).alias(f"l{k}") for k in range(4)])


@register("score_segment_inconsistency", f"WITH {EVEN}, g AS (SELECT user_id, run_pos, avg(value) OVER w AS mean, count(*) OVER w AS c FROM e2 WINDOW w AS (PARTITION BY user_id, run ORDER BY run_pos ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)), k AS (SELECT * FROM g WHERE c = 4 AND run_pos % 4 = 0) SELECT u.user_id, count(k.mean) AS segments, round(-avg(k.mean), 10) AS inconsistency, CASE WHEN count(k.mean) = 0 THEN 'NO_DENSE_AV_SEGMENTS' END AS reason FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN k USING (user_id) GROUP BY 1")
def inconsistency(spark, sf_dir):
    runs = _even(spark, sf_dir)
    seg = s.segments(runs, ["user_id"], "t", "value", 4, 4).groupBy("user_id").agg(F.count("*").alias("segments"), (-F.avg("mean")).alias("inconsistency"))
    d = p.with_reason(runs.select("user_id").distinct(), seg, "user_id", "NO_DENSE_AV_SEGMENTS").withColumn("segments", F.coalesce("segments", F.lit(0)).cast("long"))
    return d.withColumn("inconsistency", F.round("inconsistency", 10))


@register("series_pair_sources", f"WITH {EVEN}, q AS (SELECT a.user_id, count(*) AS pairs FROM e2 a JOIN e2 b ON a.user_id = b.user_id AND a.run = b.run AND b.run_pos = a.run_pos + 20 GROUP BY 1) SELECT u.user_id, coalesce(pairs, 0) AS pairs, CASE WHEN pairs IS NULL THEN 'NO_PAIRS' END AS reason FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN q USING (user_id)")
def pair_sources(spark, sf_dir):
    runs = _even(spark, sf_dir)
    q = s.shifted_pairs(runs, ["user_id"], "value", "value", [20]).groupBy("user_id").agg(F.count("*").alias("pairs"))
    return p.with_reason(runs.select("user_id").distinct(), q, "user_id", "NO_PAIRS").withColumn("pairs", F.coalesce("pairs", F.lit(0)).cast("long"))


@register("series_inside_waveform", "SELECT event_id FROM events WHERE value / 100 - 0.5 >= 0 AND value / 100 - 0.5 < 16000 * (user_id % 3) / 16000.0 + 1e-6")
def inside(spark, sf_dir):
    d = table(spark, sf_dir, "events").withColumn("t", C("value") / 100 - 0.5).withColumn("n", 16000 * (C("user_id") % 3))
    return s.inside_waveform(d, "t", "n", 16000).select("event_id")


@register("score_blink_vector", """WITH e AS (SELECT event_id, user_id, epoch(ts) AS t, value / 1000 AS l, value / 900 AS r FROM events), m AS (SELECT *, (l + r) / 2 AS m, lag((l + r) / 2) OVER w AS mb, t - lag(t) OVER w AS dt FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
SELECT event_id, round(l, 6) AS l, round(m, 6) AS mean, round(abs(l - r), 6) AS apart, round(abs(l - r) / greatest(m, 1e-6), 6) AS relative, round(coalesce(CASE WHEN dt > 0 THEN (m - mb) / dt END, 0) * 1000, 5) AS speed FROM m""")
def blink(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    d = table(spark, sf_dir, "events").select("event_id", "user_id", C("ts").cast("double").alias("t"), (C("value") / 1000).alias("l"), (C("value") / 900).alias("r"))
    before = F.lag((C("l") + C("r")) / 2).over(w)
    d = d.select("event_id", sc.blink_vector(C("l"), C("r"), before, C("t") - F.lag("t").over(w)).alias("v"))
    at = lambda k: F.get("v", F.lit(k))
    return d.select("event_id", *[F.round(at(k), 6).alias(n) for k, n in ((0, "l"), (2, "mean"), (3, "apart"), (4, "relative"))], F.round(at(5) * 1000, 5).alias("speed"))


@register("score_pixel_points", "SELECT event_id, CAST(least(639, greatest(0, trunc(value / 300 * 640))) AS INT) AS x, CAST(least(479, greatest(0, trunc((event_id % 10) / 9.0 * 480))) AS INT) AS y FROM events")
def pixels(spark, sf_dir):
    pt = F.struct((C("value") / 300).alias("x"), ((C("event_id") % 10) / 9.0).alias("y"))
    got = sc.pixel_points(F.array(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), pt), [1], F.lit(640), F.lit(480))
    return table(spark, sf_dir, "events").select("event_id", F.get(got, F.lit(0)).alias("p")).select("event_id", "p.x", "p.y")


@register("metric_evaluation", """WITH e AS (SELECT CAST(event_type IN ('click', 'view') AS INT) AS y, round(1 / (1 + exp(-(value - 60) / 40)), 9) AS s FROM events), t AS (SELECT count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS n FROM e),
w AS (SELECT sum((SELECT count(*) FROM e b WHERE b.y = 0 AND b.s < a.s) + 0.5 * (SELECT count(*) FROM e b WHERE b.y = 0 AND b.s = a.s)) AS w FROM e a WHERE a.y = 1)
SELECT (SELECT count(*) FROM e) AS n, p AS positives, round(w / (p * n), 6) AS auc, round((SELECT avg(s) FROM e WHERE y = 1), 6) AS mean_positive, round((SELECT avg(s) FROM e WHERE y = 0), 6) AS mean_negative FROM t, w""")
def evaluation(spark, sf_dir):
    d = table(spark, sf_dir, "events").select(C("event_type").isin("click", "view").cast("int").alias("y"), F.round(sc.sigmoid((C("value") - 60) / 40), 9).alias("s"))
    return r6(m.evaluation(d, "y", "s"))


EXTERNAL = {"event_id": "event_id", "dataset": "CASE WHEN user_id % 3 = 0 THEN 'a' ELSE 'mlaad' END", "language": "event_type", "y": "CAST(event_id % 2 AS INT)", "s": "value / 200", "available": "event_id % 6 > 0"}


@register("metric_coverage", f"WITH {sql('events', EXTERNAL)} SELECT dataset, count(*) AS rows, count(*) FILTER (available) AS available, round(avg(CAST((s >= 0.5) = (y = 1) AS INT)) FILTER (available), 6) AS accuracy FROM r GROUP BY 1")
def coverage(spark, sf_dir):
    d = made(spark, sf_dir, "events", EXTERNAL)
    return r6(m.coverage(d, "dataset", "available", "y", "s", 0.5))


@register("metric_by_language", f"WITH {sql('events', EXTERNAL)}, g AS (SELECT dataset, CAST(NULL AS VARCHAR) AS language, y, s FROM r UNION ALL SELECT dataset, language, y, s FROM r WHERE dataset = 'mlaad') SELECT dataset, language, count(*) AS n, round(avg(CAST((s >= 0.5) = (y = 1) AS INT)), 6) AS accuracy FROM g GROUP BY ALL")
def by_language(spark, sf_dir):
    d = made(spark, sf_dir, "events", EXTERNAL)
    d = m.with_level(d, "dataset", "language", "mlaad")
    return r6(m.confusion_metrics(d, "y", "s", 0.5, ["dataset", "language"]).select("dataset", "language", "n", "accuracy"))


@register("metric_branch_record", "SELECT user_id, round(1 / (1 + exp(-greatest(-80, least(80, avg((value - 60) / 20))))), 6) AS probability, count(*) AS windows FROM events GROUP BY 1")
def branch_record(spark, sf_dir):
    d = table(spark, sf_dir, "events").select("user_id", ((C("value") - 60) / 40).alias("lp0"), ((60 - C("value")) / 40).alias("lp1"))
    return r6(m.branch_record(d, "user_id", "lp0", "lp1"))


@register("order_multi_key", "SELECT p_partkey, CAST(row_number() OVER (ORDER BY p_size DESC, round(p_retailprice) DESC, p_partkey % 7, p_partkey) AS INT) AS place FROM part")
def multi_key(spark, sf_dir):
    from tessera.operators.running import numbered

    d = table(spark, sf_dir, "part").withColumn("area", F.round("p_retailprice")).withColumn("f", C("p_partkey") % 7)
    return numbered(d, [F.desc("p_size"), F.desc("area"), "f", "p_partkey"], "place").select("p_partkey", C("place").cast("int").alias("place"))


@register("order_nulls_last", "SELECT p_partkey, CAST(row_number() OVER (ORDER BY CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size END ASC NULLS LAST, p_partkey) AS INT) AS place FROM part")
def nulls_last(spark, sf_dir):
    from tessera.operators.running import numbered

    d = table(spark, sf_dir, "part").withColumn("t", F.when(C("p_partkey") % 5 != 0, C("p_size")))
    return numbered(d, [F.asc_nulls_last("t"), "p_partkey"], "place").select("p_partkey", C("place").cast("int").alias("place"))


@register("sample_uniform", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY sha256('11:' || o_orderkey), o_orderkey) AS r FROM orders) WHERE r <= 40")
def uniform(spark, sf_dir):
    return p.uniform_sample(table(spark, sf_dir, "orders"), "o_orderkey", 40, 11).select("o_orderkey")


@register("sample_head", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 50")
def head(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy("o_orderkey").limit(50).select("o_orderkey", "o_custkey")


@register("sample_first_queries", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) WHERE r <= 4")
def first_queries(spark, sf_dir):
    return au.first_of(table(spark, sf_dir, "events"), ["user_id"], ["event_id"], 4).select("user_id", "event_id")


@register("set_linked_only", "SELECT DISTINCT user_id + 1 AS id FROM events EXCEPT SELECT DISTINCT user_id FROM events")
def linked_only(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return ev.select((C("user_id") + 1).alias("id")).distinct().subtract(ev.select(C("user_id").alias("id")))


@register("set_union", "SELECT o_orderkey AS id, 'order' AS kind FROM orders UNION ALL SELECT c_custkey, 'customer' FROM customer")
def union(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(C("o_orderkey").alias("id"), F.lit("order").alias("kind")).unionByName(table(spark, sf_dir, "customer").select(C("c_custkey").alias("id"), F.lit("customer").alias("kind")))


@register("set_distinct", "SELECT DISTINCT o_custkey, o_orderstatus FROM orders")
def distinct(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus").distinct()


@register("set_ordered_union", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'b,a,c' ELSE 'b,a' END AS items FROM part")
def ordered_union(spark, sf_dir):
    a, b = F.array(F.lit("b"), F.lit("a"), F.lit("b")), F.when(C("p_partkey") % 2 == 0, F.array(F.lit("a"), F.lit("c"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_union(a, b), ",").alias("items"))


@register("ledger_genesis", """WITH RECURSIVE b AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS s, '{"event_id":' || event_id || '}' AS body FROM events),
c(user_id, s, prev, h) AS (SELECT user_id, s, repeat('0', 64), sha256(body || '|' || repeat('0', 64)) FROM b WHERE s = 1 UNION ALL SELECT b.user_id, b.s, c.h, sha256(b.body || '|' || c.h) FROM c JOIN b ON b.user_id = c.user_id AND b.s = c.s + 1) SELECT user_id, CAST(s AS INT) AS sequence, prev AS previous_hash, h AS entry_hash FROM c""")
def genesis(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", "user_id")
    return lineage.chain(ev, "user_id", ["event_id"], ["event_id"], lineage.GENESIS).select("user_id", "sequence", "previous_hash", "entry_hash")


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"


@register("sink_csv", "SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice FROM orders")
def csv(spark, sf_dir):
    """Written as CSV with a stated field list and read back by schema."""
    path = _folder(spark, "csv")
    d = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.round("o_totalprice", 2).alias("o_totalprice"))
    sinks.write_csv(d, path, ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"])
    return tb.read_csv(spark, path, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double")


@register("sink_csv_by_split", "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus AS split FROM orders")
def csv_by_split(spark, sf_dir):
    path = _folder(spark, "split")
    sinks.write_csv(table(spark, sf_dir, "orders").select("o_orderkey", C("o_orderstatus").alias("split")), path, partition="split")
    return tb.read_text_csv(spark, path).select("o_orderkey", C("split").cast("string").alias("split"))


@register("source_manifest", "SELECT CAST(o_orderkey AS VARCHAR) AS sample_id, o_orderstatus AS label FROM orders")
def manifest(spark, sf_dir):
    """A manifest with its columns and unique ids checked, one column found by its second alias."""
    path = _folder(spark, "manifest")
    sinks.write_csv(table(spark, sf_dir, "orders").select(C("o_orderkey").alias("sample_id"), F.lit("").alias("target"), C("o_orderstatus").alias("class"), F.lit("train").alias("split")), path)
    d = tb.read_manifest(spark, path, ["sample_id", "split"], split="train")
    return tb.aliased(d, {"sample_id": ["sample_id", "id"], "label": ["target", "class", "label"]})


@register("sink_json_lines", "SELECT event_id, event_type, value FROM events")
def json_lines(spark, sf_dir):
    """Appended in two writes, blank lines and all, and read back."""
    path = _folder(spark, "lines")
    d = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    sinks.write_json(d.where("event_id % 2 = 0"), path)
    sinks.write_json(d.where("not coalesce(event_id % 2 = 0, false)"), path, append=True)
    return tb.read_json_lines(spark, path, "event_id long, event_type string, value double")


@register("source_json_buckets", "SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'real' END AS bucket FROM events")
def json_buckets(spark, sf_dir):
    path = _folder(spark, "array")
    table(spark, sf_dir, "events").select("event_id", F.concat(F.lit(" "), F.upper("event_type")).alias("modify_type")).write.json(path)
    d = tb.read_json_lines(spark, path, "event_id long, modify_type string")
    return tb.bucketed_by_type(d, "modify_type", ["click", "view"]).select("event_id", "bucket")


@register("sink_upsert", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_mktsegment END AS segment FROM customer UNION ALL SELECT -1 - c_custkey, 'added' FROM customer WHERE c_custkey % 10 = 0")
def upsert(spark, sf_dir):
    cu = table(spark, sf_dir, "customer")
    new = cu.where("c_custkey % 3 = 0").select("c_custkey", F.explode(F.array(F.struct(F.lit("old").alias("s"), F.lit(1).cast("long").alias("o")), F.struct(F.lit("new").alias("s"), F.lit(2).cast("long").alias("o")))).alias("x"))
    added = cu.where("c_custkey % 10 = 0").select((-1 - C("c_custkey")).alias("c_custkey"), F.lit("added").alias("segment"), F.lit(1).cast("long").alias("_ord"))
    return sinks.upsert(cu.select("c_custkey", C("c_mktsegment").alias("segment")), new.select("c_custkey", C("x.s").alias("segment"), C("x.o").alias("_ord")).unionByName(added), "c_custkey")


@register("sink_versions", "SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice, 'csv' AS kind FROM orders UNION ALL SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2), 'json' FROM orders WHERE o_orderkey % 2 = 0")
def written_versions(spark, sf_dir):
    """A second write fails at its last rows, by a number that is not finite, and the first version stays."""
    d = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).alias("o_totalprice"))
    out = None
    for kind, rows in (("csv", d), ("json", d.where("o_orderkey % 2 = 0"))):
        root = _folder(spark, f"versions-{kind}")
        versioned.write(rows, root, kind, ["o_orderkey", "o_orderstatus", "o_totalprice"], **({"header": "true"} if kind == "csv" else {}))
        last = rows.agg(F.max("o_orderkey")).first()[0]
        try:
            versioned.write(rows.withColumn("o_totalprice", F.when(C("o_orderkey") == last, F.lit(float("nan"))).otherwise(C("o_totalprice"))), root, kind)
        except Exception as e:  # noqa: BLE001
            if "a number is not finite" not in str(e):
                raise
        found = versioned.read(spark, root).select("o_orderkey", "o_orderstatus", "o_totalprice", F.lit(kind).alias("kind"))
        out = found if out is None else out.unionByName(found)
    return out


@register("sink_bucketed_upsert", "SELECT c_custkey, CASE WHEN c_custkey = 1 THEN 'third' WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_mktsegment END AS segment FROM customer UNION ALL SELECT -1 - c_custkey, 'added' FROM customer WHERE c_custkey % 10 = 0")
def bucketed_upsert(spark, sf_dir):
    """Three versions of a table in buckets; the last touches one of them."""
    root, cu = _folder(spark, "upserts"), table(spark, sf_dir, "customer").select("c_custkey", C("c_mktsegment").alias("segment"))
    row = lambda d, segment, order: d.select("c_custkey", F.lit(segment).alias("segment"), F.lit(order).cast("long").alias("o"))
    some, added = cu.where("c_custkey % 3 = 0"), cu.where("c_custkey % 10 = 0").select((-1 - C("c_custkey")).alias("c_custkey"))
    versioned.upsert(cu.withColumn("o", F.lit(0).cast("long")), root, "c_custkey", "o", buckets=16)
    versioned.upsert(row(some, "new", 2).unionByName(row(some, "old", 1)).unionByName(row(added, "added", 1)), root, "c_custkey", "o", buckets=16)
    versioned.upsert(row(cu.where("c_custkey = 1"), "third", 1), root, "c_custkey", "o", buckets=16)
    return versioned.read(spark, root)


@register("audit_ordered_digest", """WITH RECURSIVE r AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS no, event_id || '|' || event_type AS t FROM events),
l AS (SELECT no, sha256(t) AS h, count(*) OVER () AS w FROM r UNION ALL SELECT no // 1024, sha256(string_agg(h, '' ORDER BY no)), any_value((w + 1023) // 1024) FROM l WHERE w > 1 GROUP BY no // 1024)
SELECT sha256(h || ':' || (SELECT count(*) FROM events)) AS digest, (SELECT count(*) FROM events) AS n FROM l WHERE w = 1""")
def ordered_digest(spark, sf_dir):
    return versioned.ordered_digest(table(spark, sf_dir, "events").select("event_id", "event_type"), ["event_id"], F.concat_ws("|", C("event_id").cast("string"), "event_type"))


@register("sink_valid_only", "SELECT event_id, CASE WHEN value > 100 THEN 'too large' ELSE 'too small' END AS reason FROM events WHERE value > 100 OR value < 2")
def valid_only(spark, sf_dir):
    d = table(spark, sf_dir, "events").select("event_id", p.first_problem([(C("value") > 100, "too large"), (C("value") < 2, "too small")]).alias("reason"))
    return sinks.write_valid(d, _folder(spark, "valid"), "reason")


@register("source_usable", "SELECT o_orderkey AS sample_id, CASE WHEN o_orderkey % 3 = 0 THEN 'MISSING_ARTIFACT' END AS exclusion_reason FROM orders")
def usable(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(C("o_orderkey").alias("sample_id"))
    return tb.usable(o, o.where("not coalesce(sample_id % 3 = 0, false)"))


@register("source_frames", "SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INT) AS frame, round((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) / 25.0, 6) AS ts FROM events")
def cached_frames(spark, sf_dir):
    return r6(tb.frame_times(table(spark, sf_dir, "events"), ["user_id"], "event_id", 25.0).select("user_id", "event_id", "frame", C("ts_sec").alias("ts")))


@register("source_keyframes", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events) WHERE n % 5 = 0 AND n < 5 * 3")
def keyframes(spark, sf_dir):
    return tb.keyframes(tb.frame_times(table(spark, sf_dir, "events"), ["user_id"], "event_id", 5.0), 5.0, 1.0, 3).select("user_id", "event_id")


@register("source_probe_json", "SELECT user_id, count(*) AS frames, CAST(count(*) FILTER (event_type = 'click') AS BIGINT) AS keys, round(sum(value), 4) AS bytes, 25.0::DOUBLE AS fps FROM events GROUP BY 1")
def probe_json(spark, sf_dir):
    frame = F.struct(C("value").cast("string").alias("pkt_size"), (C("event_type") == "click").cast("int").alias("key_frame"), F.unix_seconds("ts").cast("string").alias("best_effort_timestamp_time"), F.lit("P").alias("pict_type"))
    stream = F.array(F.struct(F.lit("h264").alias("codec_name"), F.lit(640).alias("width"), F.lit(360).alias("height"), F.lit("25/1").alias("avg_frame_rate")))
    d = table(spark, sf_dir, "events").groupBy("user_id").agg(F.to_json(F.struct(F.collect_list(frame).alias("frames"), F.first(stream).alias("streams"))).alias("payload"))
    f = tb.probe_frames(d, "user_id", "payload")
    return f.groupBy("user_id").agg(F.count("*").alias("frames"), F.sum(C("key").cast("long")).alias("keys"), F.round(F.sum("packet"), 4).alias("bytes"), F.max("fps").alias("fps"))


@register("source_real_list", "SELECT 'dense/' || p_partkey || '.npz' AS dense_path, p_partkey FROM part WHERE p_partkey % 4 = 0 ORDER BY p_partkey LIMIT 20")
def real_list(spark, sf_dir):
    d = table(spark, sf_dir, "part").withColumn("semantic_class", F.when(C("p_partkey") % 4 == 0, "REAL").otherwise("FAKE"))
    return tb.real_sources(d, "p_partkey", {"dense_path": "dense"}, 20).select("dense_path", "p_partkey")


@register("source_local_facts", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'filename: flood.jpg; Make: Acme' WHEN 1 THEN 'Model: One' ELSE '' END AS facts FROM part")
def local_facts(spark, sf_dir):
    k = C("p_partkey") % 3
    d = table(spark, sf_dir, "part").select("p_partkey", F.when(k == 0, "flood.jpg").otherwise("IMG_1.jpg").alias("name"), F.when(k == 0, " Acme ").alias("Make"), F.when(k == 1, "One").otherwise("").alias("Model"))
    return d.select("p_partkey", F.array_join(tb.local_facts("name", ["Make", "Model"]), "; ").alias("facts"))


@register("source_checked_arrays", "SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN 'missing_key:mouth' WHEN vec_id % 5 = 0 THEN 'shape_mismatch:mouth' WHEN vec_id % 11 = 0 THEN 'non_finite:mouth' END AS reason FROM embeddings")
def checked_arrays(spark, sf_dir):
    k, e = C("vec_id"), C("embedding")
    mouth = F.when(k % 7 == 0, F.lit(None)).when(k % 5 == 0, F.slice(e, 1, 3)).when(k % 11 == 0, F.transform(e, lambda x, i: F.when(i == 0, F.lit(float("nan")).cast("float")).otherwise(x))).otherwise(e)
    d = table(spark, sf_dir, "embeddings").select("vec_id", e.alias("audio"), mouth.alias("mouth"))
    width = d.select(F.max(F.size("audio"))).first()[0] or 0
    return d.select("vec_id", p.array_problem({"audio": width, "mouth": width}).alias("reason"))


@register("score_min_shift_share", "SELECT user_id, event_id, round(CASE WHEN sum(value - m) OVER (PARTITION BY user_id) > 1e-9 THEN (value - m) / sum(value - m) OVER (PARTITION BY user_id) ELSE 1.0 / k END, 6) AS share FROM (SELECT *, min(value) OVER (PARTITION BY user_id) AS m, count(*) OVER (PARTITION BY user_id) AS k FROM events)")
def min_shift(spark, sf_dir):
    from pyspark.sql import Window

    from tessera.operators.vectors import min_shift_share

    return r6(table(spark, sf_dir, "events").select("user_id", "event_id", min_shift_share(C("value"), Window.partitionBy("user_id")).alias("share")))


@register("score_anchor", """WITH x AS (SELECT event_id, event_id % 4 AS k, user_id % 2 = 0 AS media, greatest(0, least(1, (value / 314.159265 - 0.45) / (0.75 - 0.45))) AS e, greatest(0, least(1, (value / 314.159265 - 0.16) / (0.32 - 0.16))) AS i, greatest(0, least(1, (value / 314.159265 - 0.55) / (0.90 - 0.55))) AS t FROM events),
b AS (SELECT event_id, media, round(least(0.98, greatest(0.05, CASE k WHEN 0 THEN 0.15 + 0.80 * (0.65 * e + 0.35 * i) WHEN 1 THEN 0.15 + 0.80 * e WHEN 2 THEN 0.15 + 0.80 * i ELSE 0.15 + 0.80 * t END)), 3) AS base FROM x) SELECT event_id, CAST(round(1000 * CASE WHEN media THEN least(0.98, base + 0.05) ELSE base END) AS BIGINT) AS score FROM b""")
def anchor_score(spark, sf_dir):
    from tessera.operators.candidates import anchor_score as a

    k, v = C("event_id") % 4, C("value") / 314.159265
    score = a(F.when(k < 2, v), F.when(k.isin(0, 2), v), F.when(k == 3, v), C("user_id") % 2 == 0)
    return table(spark, sf_dir, "events").select("event_id", F.round(1000 * score).cast("long").alias("score"))
