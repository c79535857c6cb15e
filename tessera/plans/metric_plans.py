"""Metric queries over the event table: the label is a purchase or sign-up, the score the value cut to tenths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.operators import metrics as m
from tessera.plans.registry import register, table

SCORED = "SELECT event_id, user_id, event_type, CAST(event_type IN ('purchase', 'signup') AS INT) AS y, floor(value * 10) / 1000 AS s FROM events"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", "user_id", "event_type", F.col("event_type").isin("purchase", "signup").cast("int").alias("y"), (F.floor(F.col("value") * 10) / 1000).alias("s"))


def signed_round(c: Column, places: int = 6) -> Column:
    """c rounded; what is below zero and rounds to it stays -0.0, as in SQL over doubles (Spark's round, by decimals, gives 0.0)."""
    r = F.round(c, places)
    return F.when(r == 0, c * F.lit(0.0)).otherwise(r)


def r6(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@register("metric_average_ranks", f"""
WITH e AS ({SCORED}) SELECT event_id, s, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS avg_rank FROM e""")
def average_ranks(spark, sf_dir):
    return m.average_ranks(scored(spark, sf_dir).select("event_id", "s"), "s").select("event_id", "s", "avg_rank")


RANKING = """
, g AS (SELECT k, s, sum(y) AS pos, count(*) AS n FROM e GROUP BY k, s),
t AS (SELECT k, s, pos, n, sum(pos) OVER w - pos AS pb, sum(n) OVER w - n AS nb, sum(pos) OVER (PARTITION BY k) AS p, sum(n) OVER (PARTITION BY k) AS a FROM g WINDOW w AS (PARTITION BY k ORDER BY s)),
b AS (SELECT k, s, a, p, pos * ((nb - pb) + (n - pos) / 2.0) AS wins, pos * (p - pb) / (a - nb) AS step, ((p - pb) / greatest(p, 1) + (nb - pb) / greatest(a - p, 1)) / 2 AS ba FROM t)
SELECT {key} CAST(any_value(a) AS BIGINT) AS n, CAST(any_value(p) AS BIGINT) AS positives, round(sum(wins) / (any_value(p) * (any_value(a) - any_value(p))), 6) AS auc,
round(sum(step) / any_value(p), 6) AS average_precision, round(max(ba), 6) AS balanced_accuracy, round(min(s) FILTER (ba = mb), 6) AS threshold
FROM (SELECT *, max(ba) OVER (PARTITION BY k) AS mb FROM b) GROUP BY k"""


@register("metric_ranking", f"WITH e AS (SELECT *, 1 AS k FROM ({SCORED}))" + RANKING.format(key=""))
def ranking(spark, sf_dir):
    return r6(m.ranking_metrics(scored(spark, sf_dir), "y", "s"))


@register("metric_ranking_by_user", f"WITH e AS (SELECT *, user_id AS k FROM ({SCORED}))" + RANKING.format(key="k AS user_id,"))
def ranking_by_user(spark, sf_dir):
    return r6(m.ranking_metrics(scored(spark, sf_dir), "y", "s", ["user_id"]))


@register("metric_rowwise_ap", f"""
WITH e AS ({SCORED}), r AS (SELECT y, sum(y) OVER (ORDER BY s DESC, event_id ROWS UNBOUNDED PRECEDING) AS c, row_number() OVER (ORDER BY s DESC, event_id) AS n FROM e)
SELECT round(sum(y * c / n) / greatest(sum(y), 1), 6) AS average_precision FROM r""")
def rowwise_ap(spark, sf_dir):
    return r6(m.rowwise_average_precision(scored(spark, sf_dir), "y", "s", "event_id"))


@register("metric_confusion_by_user", f"""
WITH e AS ({SCORED}), c AS (SELECT user_id, count(*) AS n, count(*) FILTER (y = 1 AND s >= 0.5) AS tp, count(*) FILTER (y = 0 AND s >= 0.5) AS fp, count(*) FILTER (y = 0 AND s < 0.5) AS tn, count(*) FILTER (y = 1 AND s < 0.5) AS fn FROM e GROUP BY user_id),
r AS (SELECT *, tp / greatest(tp + fn, 1) AS rec, tn / greatest(tn + fp, 1) AS spe, tp / greatest(tp + fp, 1) AS pre FROM c)
SELECT user_id, n, tp, fp, tn, fn, round(rec, 6) AS recall, round(spe, 6) AS specificity, round(pre, 6) AS precision, round((tp + tn) / greatest(n, 1), 6) AS accuracy,
round(2 * pre * rec / greatest(pre + rec, 1e-12), 6) AS f1, CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN round((rec + spe) / 2, 6) END AS balanced_accuracy FROM r""")
def confusion_by_user(spark, sf_dir):
    return r6(m.confusion_metrics(scored(spark, sf_dir), "y", "s", 0.5, ["user_id"]))


CLASSES = ["click", "error", "purchase", "signup", "view", "refund"]


@register("metric_multiclass", """
WITH e AS (SELECT event_type AS y, CASE WHEN value < 5 THEN 'click' WHEN value < 20 THEN 'view' WHEN value < 60 THEN 'signup' ELSE 'purchase' END AS p FROM events),
k AS (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view', 'refund']) AS class),
r AS (SELECT class, (SELECT count(*) FROM e WHERE y = class AND p = class) AS tp, (SELECT count(*) FROM e WHERE y = class) AS support, (SELECT count(*) FROM e WHERE p = class) AS g FROM k),
f AS (SELECT class, support, tp / greatest(g, 1) AS pre, tp / greatest(support, 1) AS rec FROM r)
SELECT class, support, round(pre, 6) AS precision, round(rec, 6) AS recall, round(2 * pre * rec / greatest(pre + rec, 1e-12), 6) AS f1,
round((SELECT count(*) FILTER (y = p) / count(*) FROM e), 6) AS accuracy, round(sum(2 * pre * rec / greatest(pre + rec, 1e-12)) OVER () / 6, 6) AS macro_f1 FROM f""")
def multiclass(spark, sf_dir):
    v = F.col("value")
    ev = table(spark, sf_dir, "events").select("event_type", F.when(v < 5, "click").when(v < 20, "view").when(v < 60, "signup").otherwise("purchase").alias("guess"))
    return r6(m.multiclass_report(ev, "event_type", "guess", CLASSES))


@register("metric_distribution", """
SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS min, max(value) AS max, round(quantile_cont(value, 0.05), 6) AS p05, round(quantile_cont(value, 0.25), 6) AS p25,
round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type""")
def distribution(spark, sf_dir):
    return r6(m.distribution_summary(table(spark, sf_dir, "events"), "value", ["event_type"]))


@register("metric_separation", f"WITH e AS ({SCORED}) SELECT user_id, round(min(s) FILTER (y = 1) - max(s) FILTER (y = 0), 6) AS margin FROM e GROUP BY user_id")
def separation(spark, sf_dir):
    return r6(m.separation(scored(spark, sf_dir), "y", "s", ["user_id"]))


@register("metric_group_scores", f"""
WITH e AS ({SCORED}) SELECT event_type, count(*) AS n, round(avg(s), 6) AS mean_score, round(min(s), 6) AS min_score, round(max(s), 6) AS max_score, count(*) FILTER ((s >= 0.2) <> (y = 1)) AS errors FROM e GROUP BY event_type""")
def group_scores(spark, sf_dir):
    return r6(m.group_scores(scored(spark, sf_dir), "event_type", "y", "s", 0.2))


@register("metric_deltas", """
WITH o AS (SELECT CASE event_type WHEN 'error' THEN 'fault' ELSE event_type END AS metric, avg(value) AS old FROM events GROUP BY 1), n AS (SELECT event_type AS metric, avg(least(value, 150)) AS new FROM events GROUP BY 1)
SELECT metric, round(old, 6) AS old, round(new, 6) AS new, round(new - old, 6) AS delta, coalesce(abs(new - old) <= 1e-6, false) AS reproduced FROM o FULL JOIN n USING (metric)""")
def deltas(spark, sf_dir):
    """Means over all events against those of capped values; one metric was renamed, so each side lacks one."""
    ev = table(spark, sf_dir, "events")
    t = F.col("event_type")
    old = ev.groupBy(F.when(t == "error", "fault").otherwise(t).alias("metric")).agg(F.avg("value").alias("value"))
    return r6(m.metric_deltas(old, ev.groupBy(t.alias("metric")).agg(F.avg(F.least("value", F.lit(150.0))).alias("value"))))


@register("metric_deltas_all", """
WITH o AS (SELECT event_type AS metric, avg(value) AS old FROM events GROUP BY 1), n AS (SELECT metric, avg(v) AS new FROM (SELECT event_type AS metric, user_id, avg(value) AS v FROM events GROUP BY 1, 2) GROUP BY 1)
SELECT metric, round(old, 6) AS old, round(new, 6) AS new, round(new - old, 6) AS delta, coalesce(abs(new - old) <= 1e-6, false) AS reproduced FROM o FULL JOIN n USING (metric)""")
def deltas_all(spark, sf_dir):
    """Means over all events against those that count users equally."""
    ev = table(spark, sf_dir, "events")
    old = ev.groupBy(F.col("event_type").alias("metric")).agg(F.avg("value").alias("value"))
    return r6(m.metric_deltas(old, m.two_level_mean(ev, "event_type", "user_id", "value").select(F.col("event_type").alias("metric"), F.col("mean").alias("value"))))


@register("metric_two_level_mean", "SELECT user_id, round(avg(m), 6) AS mean FROM (SELECT user_id, event_type, avg(value) AS m FROM events GROUP BY ALL) GROUP BY user_id")
def two_level(spark, sf_dir):
    return r6(m.two_level_mean(table(spark, sf_dir, "events"), "user_id", "event_type", "value"))


@register("metric_clustered_bootstrap", """
WITH u AS (SELECT user_id, avg(m) AS v FROM (SELECT user_id, event_type, avg(value) AS m FROM events GROUP BY ALL) GROUP BY user_id),
c AS (SELECT row_number() OVER (ORDER BY user_id) - 1 AS no, v, count(*) OVER () AS k FROM u),
d AS (SELECT i // k AS rep, CAST(CAST('0x' || substr(sha256('42:' || CAST(i AS VARCHAR)), 1, 16) AS UBIGINT) % k AS BIGINT) AS no FROM (SELECT unnest(generate_series(0, 200 * k - 1)) AS i, k FROM (SELECT any_value(k) AS k FROM c))),
r AS (SELECT rep, avg(v) AS m FROM d JOIN c USING (no) GROUP BY rep)
SELECT (SELECT any_value(k) FROM c) AS n_clusters, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.5), 6) AS mid, round(quantile_cont(m, 0.975), 6) AS high FROM r""")
def bootstrap(spark, sf_dir):
    means = m.two_level_mean(table(spark, sf_dir, "events"), "user_id", "event_type", "value")
    return r6(m.clustered_bootstrap(means, "user_id", "mean", reps=200))


MIXED = "base"
for _shift, _factor in m.MIX:
    MIXED = f"CAST(CAST(xor({MIXED}, ({MIXED}) >> {_shift}) AS UHUGEINT) * {_factor}::UHUGEINT % 18446744073709551616::UHUGEINT AS UBIGINT)"


@register("metric_weighted_bootstrap", f"""
WITH u AS (SELECT user_id, avg(m) AS v FROM (SELECT user_id, event_type, avg(value) AS m FROM events GROUP BY ALL) GROUP BY user_id),
k AS (SELECT v, r, CAST((CAST('0x' || substr(sha256('42:' || user_id), 1, 16) AS UBIGINT)::UHUGEINT + (r + 1)::UHUGEINT * {m.GOLD}::UHUGEINT) % 18446744073709551616::UHUGEINT AS UBIGINT) AS base FROM u, (SELECT unnest(range(2000)) AS r)),
z AS (SELECT v, r, {MIXED} AS z FROM k), d AS (SELECT v, r, CAST(xor(z, z >> 31) >> 12 AS DOUBLE) / 4503599627370496 AS d FROM z),
w AS (SELECT r, v, {" + ".join(f"CAST(d >= {x!r}::DOUBLE AS INT)" for x in m.POISSON)} AS w FROM d), s AS (SELECT r, sum(v * w) / sum(w) AS m FROM w GROUP BY r)
SELECT (SELECT count(*) FROM u) AS n_clusters, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.5), 6) AS mid, round(quantile_cont(m, 0.975), 6) AS high FROM s""")
def weighted_bootstrap(spark, sf_dir):
    return r6(m.weighted_bootstrap(m.two_level_mean(table(spark, sf_dir, "events"), "user_id", "event_type", "value"), "user_id", "mean"))


@register("metric_crossover", """
WITH r AS (SELECT user_id AS block, CASE event_type WHEN 'click' THEN 'aa' WHEN 'view' THEN 'bb' WHEN 'purchase' THEN 'ab' WHEN 'signup' THEN 'ba' END AS role, value FROM events),
p AS (SELECT block, avg(value) FILTER (role = 'aa') AS aa, avg(value) FILTER (role = 'bb') AS bb, avg(value) FILTER (role = 'ab') AS ab, avg(value) FILTER (role = 'ba') AS ba FROM r GROUP BY block)
SELECT block, round((aa + bb - ab - ba) / 2, 6) AS interaction FROM p WHERE aa IS NOT NULL AND bb IS NOT NULL AND ab IS NOT NULL AND ba IS NOT NULL""")
def crossover(spark, sf_dir):
    t = F.col("event_type")
    ev = table(spark, sf_dir, "events").select(F.col("user_id").alias("block"), F.when(t == "click", "aa").when(t == "view", "bb").when(t == "purchase", "ab").when(t == "signup", "ba").alias("role"), "value")
    return r6(m.crossover_interaction(ev, "block", "role", "value"))
