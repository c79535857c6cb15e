"""Queries of text evidence, votes and batch accounting."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tessera.operators import profiles as pf
from tessera.plans.metric_plans import r6
from tessera.plans.registry import register, table


@register("profile_pattern_hits", "SELECT doc_id, n AS name FROM documents, (SELECT unnest(['licence', 'mail', 'card']) AS n, unnest(['licensed? under', '[a-z0-9.]+@[a-z0-9.]+', '[0-9]{16}']) AS p) WHERE regexp_matches(lower(text), p)")
def pattern_hits(spark, sf_dir):
    return pf.pattern_hits(table(spark, sf_dir, "documents"), "doc_id", "text", {"licence": "licensed? under", "mail": r"[a-z0-9.]+@[a-z0-9.]+", "card": "[0-9]{16}"})


@register("profile_top_terms", """
WITH w AS (SELECT item_id AS o, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS term, generate_subscripts(regexp_extract_all(lower(text), '[a-z]{4,}'), 1) AS p FROM benchmark),
c AS (SELECT term, count(*) AS n, min((o, p)) AS f FROM w WHERE term <> 'that' GROUP BY term ORDER BY n DESC, f LIMIT 20) SELECT term, n, CAST(row_number() OVER (ORDER BY n DESC, f) AS INT) AS rank FROM c""")
def top_terms(spark, sf_dir):
    return pf.top_terms(table(spark, sf_dir, "benchmark"), "text", "item_id", 20, stop=["that"])


@register("profile_votes", """
WITH s AS (SELECT user_id, event_type, sum(value) AS score FROM events GROUP BY 1, 2) SELECT user_id, event_type, round(score, 6) AS score, round(score / (sum(score) OVER (PARTITION BY user_id) + 0.15), 6) AS confidence, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_type) AS INT) AS rank FROM s""")
def votes(spark, sf_dir):
    return r6(pf.votes(table(spark, sf_dir, "events"), "user_id", "event_type", "value"))


@register("profile_ledger_search", "SELECT event_id, event_type FROM events WHERE event_type IN ('click') AND (contains(CAST(event_id AS VARCHAR), '77') OR contains(lower(props), '77'))")
def ledger_search(spark, sf_dir):
    ev = table(spark, sf_dir, "events").withColumn("category", F.col("event_type"))
    return pf.ledger_search(ev, "click", "77", ["event_id", "props"]).select("event_id", "event_type")


@register("profile_batch_status", """
WITH s AS (SELECT user_id, event_type AS branch, CASE WHEN value > 200 THEN 'failed' WHEN user_id % 2 = 0 THEN 'cached' ELSE 'success' END AS state FROM events),
g AS (SELECT user_id, list_sort(list_distinct(list(branch) FILTER (state <> 'failed'))) AS done, bool_and(state = 'cached') AS c FROM s GROUP BY 1)
SELECT user_id, coalesce(array_to_string(done, ','), '') AS done, CASE WHEN NOT list_has_all(coalesce(done, []), ['click', 'view']) THEN 'failed' WHEN c THEN 'cached' ELSE 'success' END AS status FROM g""")
def batch_status(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    s = ev.select("user_id", F.col("event_type").alias("branch"), F.when(F.col("value") > 200, "failed").when(F.col("user_id") % 2 == 0, "cached").otherwise("success").alias("state"))
    return pf.batch_status(s, "user_id", ["click", "view"]).select("user_id", F.array_join("done", ",").alias("done"), "status")


@register("profile_benchmark", """
WITH c AS (SELECT user_id, min(event_type) AS truth, list(event_type ORDER BY event_id) AS found, max(value) - 100 AS h, count(*) % 2 = 0 AS r FROM events GROUP BY 1)
SELECT count(*) AS cases, round(avg(CAST(list_contains(found[1:3], truth) AS INT)), 6) AS recall, round(avg(CAST(found[1] = truth AS INT)), 6) AS top1, round(avg(abs(h)), 6) AS mae_hours, round(avg(CAST(r AS INT)), 6) AS robustness FROM c""")
def benchmark(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    # only the first three of a user are collected
    few = ev.select("user_id", "event_id", "event_type", place.alias("place")).where("place <= 3").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"]).alias("found"))
    c = ev.groupBy("user_id").agg(F.min("event_type").alias("truth"), (F.max("value") - 100).alias("h"), (F.count("*") % 2 == 0).alias("r")).join(few, "user_id")
    return r6(pf.benchmark_rows(c, "truth", "found", "h", "r", 3))
