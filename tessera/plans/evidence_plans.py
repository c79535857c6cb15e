"""Queries over candidates, splits, audits and ledgers. Candidates are made from events, nodes of the search from parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import candidates as c, lineage, protocol as p
from tessera.operators.components import connected_components
from tessera.plans.metric_plans import r6
from tessera.plans.registry import SQL, register, table

CANDS = """
c AS (SELECT event_id AS _ord, event_type AS platform, 'acc' || (user_id % 17) AS account,
CASE WHEN event_id % 11 = 0 THEN '' ELSE 'https://site' || (user_id % 40) || '.org/p/' || (event_id % 700) END AS post_url, 'title ' || (event_id % 23) AS title,
ts AS published_at, CASE WHEN event_id % 13 = 0 THEN 'retrieved_at' ELSE 'published' END AS timestamp_type,
CASE WHEN event_id % 3 = 0 THEN 'exact' WHEN event_id % 3 = 1 THEN 'near_duplicate' ELSE 'none' END AS media_verification,
CASE WHEN event_id % 19 = 0 THEN 'lead' ELSE 'verified' END AS evidence_status, event_id % 29 = 0 AS is_synthetic, value / 500 AS similarity FROM events)"""


def cands(spark, sf_dir):
    i, u = F.col("event_id"), F.col("user_id")
    return table(spark, sf_dir, "events").select(
        i.alias("_ord"), F.col("event_type").alias("platform"), F.concat(F.lit("acc"), (u % 17).cast("string")).alias("account"),
        F.when(i % 11 == 0, "").otherwise(F.concat(F.lit("https://site"), (u % 40).cast("string"), F.lit(".org/p/"), (i % 700).cast("string"))).alias("post_url"),
        F.concat(F.lit("title "), (i % 23).cast("string")).alias("title"), F.col("ts").alias("published_at"), F.when(i % 13 == 0, "retrieved_at").otherwise("published").alias("timestamp_type"),
        F.when(i % 3 == 0, "exact").when(i % 3 == 1, "near_duplicate").otherwise("none").alias("media_verification"),
        F.when(i % 19 == 0, "lead").otherwise("verified").alias("evidence_status"), (i % 29 == 0).alias("is_synthetic"), (F.col("value") / 500).alias("similarity"),
    )


CHRON = f"""WITH {CANDS}, v AS (SELECT * FROM c WHERE post_url <> '' AND NOT is_synthetic AND evidence_status = 'verified' AND media_verification <> 'none' AND timestamp_type = 'published'),
d AS (SELECT *, row_number() OVER (PARTITION BY post_url ORDER BY _ord) AS r FROM v),
k AS (SELECT * FROM d WHERE r = 1 AND published_at >= TIMESTAMP '2024-01-02'),
o AS (SELECT *, row_number() OVER (ORDER BY published_at, _ord) AS rank, epoch(published_at) - min(epoch(published_at)) OVER () AS el FROM k)"""


def _chron(spark, sf_dir):
    return c.chronology(cands(spark, sf_dir), floor_date=F.lit("2024-01-02").cast("timestamp"))


@register("evidence_chronology", CHRON + """
SELECT CAST(rank AS INT) AS rank, CASE WHEN rank = 1 THEN 'primary_origin' WHEN el <= 7200 THEN 'early_reporting' WHEN el <= 86400 THEN 'viral_spread' ELSE 'current_circulation' END AS role, platform, account, post_url, round(el, 3) AS elapsed_sec,
CASE WHEN floor(el) <= 60 THEN '+0m' WHEN el < 3600 THEN '+' || CAST(floor(el / 60) AS BIGINT) || 'm' ELSE '+' || CAST(floor(el / 3600) AS BIGINT) || 'h ' || lpad(CAST(CAST(floor((floor(el) % 3600) / 60) AS BIGINT) AS VARCHAR), 2, '0') || 'm' END AS elapsed,
round(similarity, 6) AS similarity, CASE WHEN media_verification = 'exact' THEN 'high' ELSE 'moderate' END AS confidence FROM o""")
def chronology(spark, sf_dir):
    d = _chron(spark, sf_dir)
    return d.select("rank", "role", "platform", "account", "post_url", F.round("elapsed_sec", 3).alias("elapsed_sec"), "elapsed", F.round("similarity", 6).alias("similarity"), "confidence")


@register("evidence_circulation", CHRON + """
SELECT count(*) AS tracked, round(greatest(0.1, max(el) / 3600), 6) AS span_hours, round(count(*) / greatest(0.1, max(el) / 3600), 6) AS velocity, count(DISTINCT platform) FILTER (rank <= 50) AS listed_platforms, count(*) FILTER (rank <= 50) AS listed FROM o""")
def circulation(spark, sf_dir):
    return r6(c.circulation(_chron(spark, sf_dir)))


@register("evidence_account_edges", CHRON + ", l AS (SELECT account AS src, lead(account) OVER (ORDER BY published_at, _ord) AS dst FROM o) SELECT DISTINCT src, dst FROM l WHERE dst IS NOT NULL AND src <> dst")
def account_edges(spark, sf_dir):
    d = _chron(spark, sf_dir)
    return c.account_graph(d, ["ts", "rank"])[1]


@register("evidence_first_wins", f"WITH {CANDS}, k AS (SELECT *, CASE WHEN post_url <> '' THEN post_url ELSE platform || ':' || account || ':' || title END AS key FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY _ord) AS r FROM k) SELECT _ord, key FROM r WHERE r = 1")
def first_wins(spark, sf_dir):
    return c.first_wins(cands(spark, sf_dir).withColumn("key", c.dedup_key()), ["key"], ["_ord"]).select("_ord", "key")


NODES = """
n AS (SELECT p_partkey, 40 + p_size * 7 AS w, 30 + (p_partkey % 50) * 9 AS h, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE TIMESTAMP '2019-01-01' + to_hours(CAST(p_partkey * 31 AS INT)) END AS ts,
(p_partkey * 37) % 256 AS d, ((p_partkey * 13) % 100) / 100.0 AS ir, (p_partkey * 7) % 1200 AS n, p_partkey % 5 < 3 AS m,
CASE p_partkey % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'target_is_crop_of_candidate' WHEN 2 THEN 'candidate_is_crop_of_target' ELSE 'none' END AS ct,
CASE p_partkey % 6 WHEN 0 THEN 'apnews.com' WHEN 1 THEN 'bbc.co.uk' WHEN 2 THEN 'blog.example.com' ELSE 'site' || (p_partkey % 90) || '.org' END AS dom, p_partkey % 17 = 0 AS wire, p_partkey % 4 AS depth FROM part)"""


def nodes(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k, (40 + F.col("p_size") * 7).alias("width"), (30 + (k % 50) * 9).alias("height"), F.when(k % 7 != 0, (F.lit(1546300800) + k * 31 * 3600).cast("timestamp")).alias("ts"),
        ((k * 37) % 256).alias("pdq_distance"), (((k * 13) % 100) / 100).alias("inlier_ratio"), ((k * 7) % 1200).alias("inlier_count"), (k % 5 < 3).alias("is_match"),
        F.when(k % 4 == 0, "exact").when(k % 4 == 1, "target_is_crop_of_candidate").when(k % 4 == 2, "candidate_is_crop_of_target").otherwise("none").alias("crop_type"),
        F.when(k % 6 == 0, "apnews.com").when(k % 6 == 1, "bbc.co.uk").when(k % 6 == 2, "blog.example.com").otherwise(F.concat(F.lit("site"), (k % 90).cast("string"), F.lit(".org"))).alias("domain"), (k % 17 == 0).alias("is_wire"), (k % 4).alias("depth"),
    )


@register("search_costs", f"""WITH {NODES}, x AS (SELECT *, (epoch(TIMESTAMP '2021-06-01') - epoch(ts)) / 86400 AS days, (1767225600 - epoch(ts)) / 86400 AS age, CAST(w * h AS DOUBLE) AS a, 60000.0 AS ta FROM n),
y AS (SELECT p_partkey, CASE WHEN ct = 'exact' OR d <= 30 THEN d / 10 + depth * 0.5 WHEN ct LIKE 'target%' THEN 5 + (1 - least(1, ir)) * 5 + depth * 0.5 WHEN ct LIKE 'cand%' THEN 45 + depth * 2 WHEN m THEN 12 + d / 20 + depth ELSE 150 + least(50, d) END AS g,
greatest(0, 45 + CASE WHEN ts IS NULL THEN 0 WHEN days > 0 THEN -least(12, 3 + log2(greatest(1, days))) WHEN days < 0 THEN least(15, 3 + abs(days) / 60 * 1.5) ELSE 0 END
- CASE WHEN ts IS NULL THEN 0 ELSE least(8, age / 365 * 1.5) END + CASE WHEN a > ta THEN -least(12, 4 * log2(greatest(1, a / ta))) WHEN a < ta AND a > 0 THEN least(10, 3 * log2(greatest(1, ta / a))) ELSE 0 END
+ CASE WHEN wire OR dom = 'apnews.com' THEN -18 WHEN dom LIKE 'bbc%' THEN -8 ELSE 0 END) AS h FROM x)
SELECT p_partkey, round(g, 6) AS g, round(h, 6) AS h, round(g + h, 6) AS f FROM y""")
def search_costs(spark, sf_dir):
    n = nodes(spark, sf_dir)
    h = c.origin_distance(F.lit(1622505600).cast("timestamp"), F.lit(60000.0))
    n = n.select("p_partkey", c.path_cost(F.col("depth")).cast("double").alias("g"), h.alias("h"))
    return r6(n.withColumn("f", F.col("g") + F.col("h")))


@register("search_confidence", f"""WITH {NODES}, x AS (SELECT *, CAST(w * h AS DOUBLE) AS a, 60000.0 AS ta, epoch(ts) - epoch(TIMESTAMP '2020-03-01') AS late FROM n),
s AS (SELECT p_partkey, m, d, CASE WHEN ct LIKE 'target%' THEN 0.35 WHEN ct = 'exact' OR d <= 30 THEN 0.2 WHEN m AND n >= 18 THEN 0.15 WHEN ct LIKE 'cand%' THEN -0.2 ELSE 0 END + CASE WHEN n >= 1000 THEN 0.1 WHEN n >= 100 THEN 0.05 WHEN n < 20 AND d > 30 THEN -0.1 ELSE 0 END
+ CASE WHEN a >= 3.5 * ta THEN 0.2 WHEN a >= 1.8 * ta THEN 0.12 WHEN a > ta THEN 0.06 WHEN a < 0.5 * ta AND d > 10 THEN -0.1 ELSE 0 END + CASE WHEN wire OR dom = 'apnews.com' OR dom LIKE 'bbc%' THEN 0.25 ELSE 0 END
+ CASE WHEN ts < TIMESTAMP '2021-06-01' THEN 0.1 + CASE WHEN year(ts) <= 2021 THEN 0.05 ELSE 0 END WHEN year(ts) <= 2021 THEN 0.05 ELSE 0 END
- CASE WHEN late > 43200 THEN least(0.3, 0.15 + 0.05 * log2(greatest(1, late / 86400))) ELSE 0 END AS v FROM x)
SELECT p_partkey, CAST(round(100 * CASE WHEN NOT m AND d > 30 THEN 0 ELSE least(0.99, greatest(0.05, v)) END + 0.001) AS BIGINT) AS percent FROM s""")
def search_confidence(spark, sf_dir):
    conf = c.origin_confidence(F.lit(1622505600).cast("timestamp"), F.lit(60000.0), F.lit(1583020800).cast("timestamp"))
    return nodes(spark, sf_dir).select("p_partkey", F.round(100 * conf + 0.001).cast("long").alias("percent"))


#: The search in one row a step: the frontier is a sorted list whose first entry is popped.
BEST_FIRST = """adj AS (SELECT CAST(p_partkey // 5 AS VARCHAR) AS src, list({'f': f, 'node': CAST(p_partkey AS VARCHAR)}) AS nb FROM z WHERE p_partkey // 5 <> p_partkey GROUP BY 1),
st(step, open, reached, cur) AS (SELECT 0, [{'f': 0::DOUBLE, 'found': 0, 'node': '0', 'parent': NULL::VARCHAR, 'depth': 0}], ['0'], {'f': 0::DOUBLE, 'found': 0, 'node': '', 'parent': NULL::VARCHAR, 'depth': 0}
UNION ALL SELECT step + 1, list_sort(list_concat(open[2:], CASE WHEN open[1].depth < 3 THEN list_transform(list_filter(coalesce(nb, []), lambda x: NOT list_contains(reached, x.node)), lambda x: {'f': x.f, 'found': step + 1, 'node': x.node, 'parent': open[1].node, 'depth': open[1].depth + 1}) ELSE [] END)),
CASE WHEN open[1].depth < 3 THEN list_distinct(list_concat(reached, list_transform(coalesce(nb, []), lambda x: x.node))) ELSE reached END, open[1] FROM st LEFT JOIN adj ON adj.src = open[1].node WHERE step < 12 AND len(open) > 0)
SELECT cur.node AS node, cur.parent AS parent, cur.depth AS depth, cur.f AS f, step - 1 AS step FROM st WHERE step > 0"""


@register("search_best_first", f"""WITH RECURSIVE {NODES}, x AS (SELECT *, (epoch(TIMESTAMP '2021-06-01') - epoch(ts)) / 86400 AS days, (1767225600 - epoch(ts)) / 86400 AS age, CAST(w * h AS DOUBLE) AS a, 60000.0 AS ta FROM n),
z AS (SELECT p_partkey, round(CASE WHEN ct = 'exact' OR d <= 30 THEN d / 10 + depth * 0.5 WHEN ct LIKE 'target%' THEN 5 + (1 - least(1, ir)) * 5 + depth * 0.5 WHEN ct LIKE 'cand%' THEN 45 + depth * 2 WHEN m THEN 12 + d / 20 + depth ELSE 150 + least(50, d) END +
greatest(0, 45 + CASE WHEN ts IS NULL THEN 0 WHEN days > 0 THEN -least(12, 3 + log2(greatest(1, days))) WHEN days < 0 THEN least(15, 3 + abs(days) / 60 * 1.5) ELSE 0 END
- CASE WHEN ts IS NULL THEN 0 ELSE least(8, age / 365 * 1.5) END + CASE WHEN a > ta THEN -least(12, 4 * log2(greatest(1, a / ta))) WHEN a < ta AND a > 0 THEN least(10, 3 * log2(greatest(1, ta / a))) ELSE 0 END
+ CASE WHEN wire OR dom = 'apnews.com' THEN -18 WHEN dom LIKE 'bbc%' THEN -8 ELSE 0 END), 6) AS f FROM x), {BEST_FIRST}""")
def best_first(spark, sf_dir):
    n = nodes(spark, sf_dir)
    f = F.round(c.path_cost(F.col("depth")) + c.origin_distance(F.lit(1622505600).cast("timestamp"), F.lit(60000.0)), 6)
    k = F.col("p_partkey")
    edges = n.select(F.floor(k / 5).cast("long").alias("src"), k.alias("dst")).where("src <> dst")
    return lineage.best_first(n.select(k.alias("node"), f.alias("f")), edges, 0)


#: The same with a sorted list a case.
BEST_FIRST_MANY = """adj AS (SELECT CAST(p_partkey // 5 AS VARCHAR) AS src, list({'f': f, 'node': CAST(p_partkey AS VARCHAR)}) AS nb FROM z WHERE p_partkey // 5 <> p_partkey GROUP BY 1),
st("case", step, open, reached, cur) AS (SELECT p_partkey, 0, [{'f': 0::DOUBLE, 'found': 0, 'node': CAST(p_partkey // 50 AS VARCHAR), 'parent': NULL::VARCHAR, 'depth': 0}], [CAST(p_partkey // 50 AS VARCHAR)], {'f': 0::DOUBLE, 'found': 0, 'node': '', 'parent': NULL::VARCHAR, 'depth': 0} FROM part WHERE p_partkey % 50 = 0
UNION ALL SELECT "case", step + 1, list_sort(list_concat(open[2:], CASE WHEN open[1].depth < 3 THEN list_transform(list_filter(coalesce(nb, []), lambda x: NOT list_contains(reached, x.node)), lambda x: {'f': x.f, 'found': step + 1, 'node': x.node, 'parent': open[1].node, 'depth': open[1].depth + 1}) ELSE [] END)),
CASE WHEN open[1].depth < 3 THEN list_distinct(list_concat(reached, list_transform(coalesce(nb, []), lambda x: x.node))) ELSE reached END, open[1] FROM st LEFT JOIN adj ON adj.src = open[1].node WHERE step < 12 AND len(open) > 0)
SELECT "case", cur.node AS node, cur.parent AS parent, cur.depth AS depth, cur.f AS f, step - 1 AS step FROM st WHERE step > 0"""


@register("search_best_first_many", SQL["search_best_first"].replace(BEST_FIRST, BEST_FIRST_MANY))
def best_first_many(spark, sf_dir):
    """The search from a node for every part whose key is divisible by 50, all at once."""
    n = nodes(spark, sf_dir)
    f = F.round(c.path_cost(F.col("depth")) + c.origin_distance(F.lit(1622505600).cast("timestamp"), F.lit(60000.0)), 6)
    k = F.col("p_partkey")
    edges = n.select(F.floor(k / 5).cast("long").alias("src"), k.alias("dst")).where("src <> dst")
    roots = n.where(k % 50 == 0).select(k.alias("case"), F.floor(k / 50).cast("long").alias("node"))
    return lineage.best_first_many(n.select(k.alias("node"), f.alias("f")), edges, roots)


@register("search_best_per_domain", f"WITH {NODES}, r AS (SELECT p_partkey, dom AS domain, ir, row_number() OVER (PARTITION BY dom ORDER BY ir DESC, p_partkey) AS r FROM n) SELECT domain, p_partkey, ir AS inlier_ratio FROM r WHERE r = 1")
def best_per_domain(spark, sf_dir):
    return c.best_per_key(nodes(spark, sf_dir), "domain", "inlier_ratio", "p_partkey").select("domain", "p_partkey", "inlier_ratio")


@register("search_capped_union", """
WITH r AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS r, list_position(['error', 'click', 'view', 'purchase', 'signup'], event_type) AS p FROM events),
k AS (SELECT * FROM r WHERE r <= CASE event_type WHEN 'error' THEN 1000000000 WHEN 'click' THEN 4 WHEN 'view' THEN 3 ELSE 2 END),
o AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY p, event_id) AS place FROM k) SELECT user_id, event_id, CAST(place AS INT) AS place FROM o WHERE place <= 15""")
def capped(spark, sf_dir):
    order = ["error", "click", "view", "purchase", "signup"]
    caps = {"click": 4, "view": 3, "purchase": 2, "signup": 2}
    return c.capped_union(table(spark, sf_dir, "events"), "user_id", "event_type", ["event_id"], order, caps, 15).select("user_id", "event_id", "place")


@register("evidence_temporal_weights", "SELECT event_id, CASE WHEN epoch(TIMESTAMP '2024-01-20') - epoch(ts) >= 172800 THEN 'older' ELSE 'new' END AS kind, CASE WHEN epoch(TIMESTAMP '2024-01-20') - epoch(ts) >= 172800 THEN 0.3::DOUBLE ELSE 0.7 END AS internal, CASE WHEN epoch(TIMESTAMP '2024-01-20') - epoch(ts) >= 172800 THEN 0.7::DOUBLE ELSE 0.3 END AS external FROM events")
def temporal(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", c.temporal_weights(F.col("ts"), F.lit(1705708800).cast("timestamp")).alias("w")).select("event_id", "w.*")


@register("protocol_assign_groups", """
WITH g AS (SELECT DISTINCT user_id FROM events), o AS (SELECT user_id, row_number() OVER (ORDER BY sha256('7:' || CAST(user_id AS VARCHAR))) - 1 AS n, count(*) OVER () AS k FROM g),
b AS (SELECT *, greatest(1, round_even(k * 0.6, 0)) AS a FROM o), d AS (SELECT *, least(greatest(a + 1, round_even(k * 0.8, 0)), k - 1) AS z FROM b)
SELECT user_id, CASE WHEN n < a THEN 'train' WHEN n < z THEN 'dev' ELSE 'holdout' END AS role FROM d""")
def assign(spark, sf_dir):
    return p.assign_groups(table(spark, sf_dir, "events"), ["user_id"], 7)


@register("protocol_validate", "SELECT 0::BIGINT AS missing_roles, 0::BIGINT AS duplicate_samples, 0::BIGINT AS crossing_groups")
def validate(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return p.validate_assignment(ev.join(p.assign_groups(ev, ["user_id"], 7), "user_id"), "event_id", ["user_id"], "role", ["train", "dev", "holdout"])


@register("protocol_stratified_sample", "WITH r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY sha256('3:' || CAST(event_id AS VARCHAR)), event_id) AS r FROM events) SELECT event_id, event_type FROM r WHERE r <= 20")
def stratified(spark, sf_dir):
    return p.stratified_sample(table(spark, sf_dir, "events"), "event_type", "event_id", 20, 3).select("event_id", "event_type")


@register("protocol_systematic_sample", "WITH r AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS n FROM events) SELECT event_id FROM r WHERE n % 37 = 0 AND n < 37 * 100")
def systematic(spark, sf_dir):
    return p.systematic_sample(table(spark, sf_dir, "events"), ["event_id"], 37, 100).select("event_id")


#: Two sides that hold every order once: a third against the rest.
SIDES = "l AS (SELECT * FROM orders WHERE coalesce(o_orderkey % 3 = 0, false)), r AS (SELECT * FROM orders WHERE NOT coalesce(o_orderkey % 3 = 0, false))"


def _sides(spark, sf_dir):
    o, third = table(spark, sf_dir, "orders"), F.coalesce(F.col("o_orderkey") % 3 == 0, F.lit(False))
    return o.where(third), o.where(~third)


@register("audit_overlap_examples", f"WITH {SIDES}, a AS (SELECT o_custkey, min(o_orderkey) AS left_sample FROM l GROUP BY 1), b AS (SELECT o_custkey, min(o_orderkey) AS right_sample FROM r GROUP BY 1) SELECT * FROM a JOIN b USING (o_custkey)")
def overlap(spark, sf_dir):
    return p.overlap_examples(*_sides(spark, sf_dir), "o_custkey", "o_orderkey", "o_orderkey")


@register("audit_leakage_kinds", f"WITH {SIDES} " + " UNION ALL ".join(f"SELECT '{k}' AS kind, count(*) AS shared FROM (SELECT DISTINCT {k} FROM l INTERSECT SELECT DISTINCT {k} FROM r)" for k in ("o_custkey", "o_orderkey", "o_orderpriority")))
def leakage(spark, sf_dir):
    return p.leakage_kinds(*_sides(spark, sf_dir), ["o_custkey", "o_orderkey", "o_orderpriority"])


#: Two sides that hold every order once.
HALVES = "l AS (SELECT * FROM orders WHERE coalesce(o_orderkey % 2 = 0, false)), r AS (SELECT * FROM orders WHERE NOT coalesce(o_orderkey % 2 = 0, false))"


def _halves(spark, sf_dir):
    o, even = table(spark, sf_dir, "orders"), F.coalesce(F.col("o_orderkey") % 2 == 0, F.lit(False))
    return o.where(even), o.where(~even)


@register("audit_overlap_examples_all", f"WITH {HALVES}, a AS (SELECT o_custkey, min(o_orderkey) AS left_sample FROM l GROUP BY 1), b AS (SELECT o_custkey, min(o_orderkey) AS right_sample FROM r GROUP BY 1) SELECT * FROM a JOIN b USING (o_custkey) ORDER BY o_custkey LIMIT 100")
def overlap_all(spark, sf_dir):
    return p.overlap_examples(*_halves(spark, sf_dir), "o_custkey", "o_orderkey", "o_orderkey", limit=100)


@register("audit_leakage_kinds_all", f"WITH {HALVES} " + " UNION ALL ".join(f"SELECT '{k}' AS kind, count(*) AS shared FROM (SELECT DISTINCT {k} FROM l INTERSECT SELECT DISTINCT {k} FROM r)" for k in ("o_custkey", "o_orderkey", "o_orderpriority")))
def leakage_all(spark, sf_dir):
    return p.leakage_kinds(*_halves(spark, sf_dir), ["o_custkey", "o_orderkey", "o_orderpriority"])


@register("protocol_assign_components", """
WITH s AS (SELECT event_type AS c, count(*) AS n, count(*) FILTER (value > 50) AS m FROM events GROUP BY 1 UNION ALL SELECT 'u' || (user_id % 5), count(*), count(*) FILTER (value > 50) FROM events GROUP BY 1),
t AS (SELECT sum(n)::DOUBLE AS tn, sum(m)::DOUBLE AS tm FROM s), x AS (SELECT a.c AS dev, b.c AS test, d.c AS holdout,
pow((tn - a.n - b.n - d.n) / tn - 0.7, 2) + pow(a.n / tn - 0.1, 2) + pow(b.n / tn - 0.1, 2) + pow(d.n / tn - 0.1, 2) + pow((tm - a.m - b.m - d.m) / tm - 0.7, 2) + pow(a.m / tm - 0.1, 2) + pow(b.m / tm - 0.1, 2) + pow(d.m / tm - 0.1, 2) AS score
FROM s a, s b, s d, t WHERE a.c <> b.c AND a.c <> d.c AND b.c <> d.c) SELECT dev, test, holdout, round(score, 6) AS score FROM x ORDER BY round(x.score, 12), dev, test, holdout LIMIT 1""")
def assign_components(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    of = lambda k: ev.groupBy(k.alias("c")).agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("m"))
    return r6(p.assign_components(of(F.col("event_type")).unionByName(of(F.concat(F.lit("u"), (F.col("user_id") % 5).cast("string")))), "c", ["n", "m"]))


@register("protocol_class_weights", "WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1) SELECT event_type, n, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS class_weight, round(1 / n, 6) AS sampler_weight FROM c")
def class_weights(spark, sf_dir):
    return r6(p.class_weights(table(spark, sf_dir, "events"), "event_type"))


@register("audit_grouping_summary", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), (o_orderstatus, o_orderpriority), ())")
def grouping_summary(spark, sf_dir):
    return p.grouping_summary(table(spark, sf_dir, "orders"), [["o_orderstatus"], ["o_orderpriority"], ["o_orderstatus", "o_orderpriority"], []])


@register("audit_mode_first_seen", "WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS o FROM events GROUP BY 1, 2) SELECT user_id, arg_max(event_type, (n, -o)) AS mode FROM c GROUP BY user_id")
def mode_first(spark, sf_dir):
    return p.mode_first_seen(table(spark, sf_dir, "events"), "user_id", "event_type", "event_id")


@register("audit_crosstab", "SELECT o_orderpriority, round(100 * count(*) FILTER (o_orderstatus = 'F') / count(*) FILTER (o_orderstatus IN ('F', 'O', 'P')), 6) AS \"F\", round(100 * count(*) FILTER (o_orderstatus = 'O') / count(*) FILTER (o_orderstatus IN ('F', 'O', 'P')), 6) AS \"O\", round(100 * count(*) FILTER (o_orderstatus = 'P') / count(*) FILTER (o_orderstatus IN ('F', 'O', 'P')), 6) AS \"P\" FROM orders GROUP BY 1")
def crosstab(spark, sf_dir):
    return r6(p.crosstab_percent(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"]))


@register("graph_components", """
WITH RECURSIVE up(node, cur) AS (SELECT c_custkey, c_custkey FROM customer UNION ALL SELECT node, cur // 3 FROM up WHERE cur % 7 <> 0 AND cur > 0) SELECT node, min(cur) AS component FROM up GROUP BY node""")
def components(spark, sf_dir):
    k = F.col("c_custkey")
    e = table(spark, sf_dir, "customer").select(k.alias("src"), F.when(k % 7 == 0, k).otherwise(F.floor(k / 3)).cast("long").alias("dst"))
    return connected_components(e)


@register("graph_component_sizes", "WITH RECURSIVE up(node, cur) AS (SELECT c_custkey, c_custkey FROM customer UNION ALL SELECT node, cur // 3 FROM up WHERE cur % 7 <> 0 AND cur > 0), c AS (SELECT node, min(cur) AS component FROM up GROUP BY node) SELECT component, count(*) AS size, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM c GROUP BY 1")
def component_sizes(spark, sf_dir):
    sizes = components(spark, sf_dir).groupBy("component").agg(F.count("*").alias("size"))
    return r6(sizes.crossJoin(F.broadcast(sizes.agg(F.sum("size").alias("_t")))).select("component", "size", (F.col("size") / F.col("_t")).alias("share")))


@register("ledger_overall_status", "WITH m AS (SELECT user_id, event_type, CASE WHEN value < 3 THEN 'failed' WHEN value < 12 THEN 'timeout' WHEN value < 30 THEN 'skipped' ELSE 'completed' END AS s FROM events) SELECT user_id, CASE WHEN count(*) FILTER (s = 'completed') = 0 THEN 'failed' WHEN count(*) FILTER (s IN ('failed', 'timeout')) > 0 THEN 'partial' ELSE 'completed' END AS status FROM m GROUP BY 1")
def overall(spark, sf_dir):
    v = F.col("value")
    return lineage.overall_status(table(spark, sf_dir, "events").select("user_id", F.when(v < 3, "failed").when(v < 12, "timeout").when(v < 30, "skipped").otherwise("completed").alias("status")), "user_id")


@register("ledger_chain", """
WITH RECURSIVE b AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS s, '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' AS body FROM events),
c(user_id, s, prev, h) AS (SELECT user_id, s, NULL::VARCHAR, sha256(body || '|') FROM b WHERE s = 1 UNION ALL SELECT b.user_id, b.s, c.h, sha256(b.body || '|' || c.h) FROM c JOIN b ON b.user_id = c.user_id AND b.s = c.s + 1)
SELECT user_id, CAST(s AS INT) AS sequence, prev AS previous_hash, h AS entry_hash FROM c""")
def ledger(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return lineage.chain(ev, "user_id", ["event_id"], ["event_id", "event_type"]).select("user_id", "sequence", "previous_hash", "entry_hash")


@register("ledger_verify", "SELECT user_id, count(*) AS entries, 0::BIGINT AS broken FROM events GROUP BY user_id")
def ledger_verify(spark, sf_dir):
    return lineage.verify_chain(ledger(spark, sf_dir), "user_id")
