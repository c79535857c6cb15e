"""Odd rows of candidates, pages, hits, chains and searches; SQL comparisons of their queries are in test_queries."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import labels, pages, records, scores
from tessera.operators import audits, candidates, lineage, metrics, protocol, series
from tessera.operators.components import connected_components
from tessera.session import materialise, release


def test_candidates_of_nulls_and_missing_columns(spark):
    df = spark.createDataFrame([(None, None), ("yes", "x"), ("0", "2024-01-01T00:00:00+02:00")], "is_synthetic string, published_at string")
    got = records.normalized_candidates(df, "web", "now").collect()
    assert [(r.evidence_status, r.timestamp_type, r.published_at, r.post_url, r.source_connector) for r in got] == [
        ("unverified", "unknown", None, "", "web"), ("fixture", "unknown", None, "", "web"), ("unverified", "published", "2024-01-01T00:00:00+02:00", "", "web"),
    ]
    assert records.normalized_candidates(df.limit(0), "web", "now").count() == 0


def test_decoded_times_are_usable(spark):
    df = spark.createDataFrame([("platform_decoded",), ("retrieved_at",), (None,)], "timestamp_type string").withColumn("published_at", F.current_timestamp())
    assert [r[0] for r in df.select(candidates.has_usable_time()).collect()] == [True, False, False]


@pytest.mark.parametrize("url, want", [("//c.org/a", "https://c.org/a"), ("/a", "https://h.org/a"), ("a.jpg", "https://h.org/d/a.jpg"), (" http://x/y ", "http://x/y")])
def test_resolved_urls(spark, url, want):
    assert spark.range(1).select(pages.resolved(F.lit(url), F.lit("https://h.org/d/p?q/r"))).first()[0] == want
    assert spark.range(1).select(pages.resolved(F.lit("a"), F.lit("https://h.org"))).first()[0] == "https://h.org/a"


def test_pages_without_anything(spark):
    df = spark.createDataFrame([(None, None), ("", "https://h.org"), ("<p>", None)], "html string, url string")
    assert all(not r[0] and r[1] is None for r in df.select(pages.page_images(F.col("html"), F.col("url")), pages.embedded_post(F.col("html"))).collect())


def test_lens_hits_share_links_and_thumbnails(spark):
    rows = [(1, 1, "visual-match", "https://a", "Blog", "t1"), (1, 2, "exact-match", "https://b", "Blog", "t1"), (1, 3, "odd", "https://c", "Reuters", None), (1, 4, "exact-match", "https://c", "x", ""), (1, 5, "all", "", "x", "t"), (1, 6, "all", "https://d", None, "t9")]
    df = spark.createDataFrame(rows, "q int, o int, bucket string, link string, label string, thumbnail string")
    got = sorted((r.place, r.o) for r in candidates.lens_hits(df, "q", "o").collect())
    assert got == [(1, 3), (2, 2), (3, 6)]  # the agency first, then the exact match, whose thumbnail shuts out the visual one


def test_chain_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    df = spark.createDataFrame([(k, i) for k in (1, 2) for i in range(50)], "k int, i int").repartition(4)
    got = {(r.k, r.sequence): r for r in lineage.chain(df, "k", ["i"], ["i"]).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k in (1, 2):
        prev = None
        for n in range(1, 51):
            assert got[k, n].previous_hash == prev
            prev = hashlib.sha256(f'{{"i":{n - 1}}}|{prev or ""}'.encode()).hexdigest()
            assert got[k, n].entry_hash == prev


def test_best_first_stops_at_the_goal_and_keeps_hubs_away_from_the_driver(spark):
    nodes = spark.createDataFrame([("r", 0.0), ("a", 2.0), ("b", 1.0), ("c", 0.5)] + [(f"h{i}", 9.0) for i in range(500)], "node string, f double")
    edges = spark.createDataFrame([("r", "a"), ("r", "b"), ("b", "c"), ("b", "r")] + [("r", f"h{i}") for i in range(500)], "src string, dst string")
    got = lineage.best_first(nodes, edges, "r", goal="node = 'c'").collect()
    assert [(r.node, r.parent, r.depth) for r in got] == [("r", None, 0), ("b", "r", 1), ("c", "b", 2)]


def test_path_with_quotes(spark):
    tree = spark.createDataFrame([("it's", "b"), ("b", None)], "node string, parent string")
    assert [tuple(r) for r in lineage.path_to_root(tree, "it's").orderBy("position").collect()] == [(0, "it's"), (1, "b")]


def test_quantiles_of_few_and_null_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0), ("b", None), ("b", float("nan"))], "k string, v double")
    got = {r.k: (r.n, r.p50, r.p95) for r in metrics.distribution_summary(df, "v", ["k"]).collect()}
    assert got == {"a": (2, 2.0, pytest.approx(2.9)), None: (1, 5.0, 5.0)}
    whole = metrics.distribution_summary(df, "v").first()
    assert (whole.n, whole.p25, whole.p75) == (3, 2.0, 4.0)


def test_too_many_components_are_an_error(spark):
    stats = spark.range(70).select(F.col("id").cast("string").alias("c"), F.lit(1).alias("n"))
    with pytest.raises(ValueError, match="64"):
        protocol.assign_components(stats, "c", ["n"])
    with pytest.raises(ValueError, match="fill"):
        protocol.assign_components(stats.limit(2), "c", ["n"])


def test_overlaps_have_no_cut(spark):
    df = spark.range(300).select("id", F.col("id").alias("k"))
    assert protocol.overlap_examples(df, df, "k", "id", "id").count() == 300


def test_link_leakage_of_unknown_identities(spark):
    df = spark.createDataFrame([("s", "a", ["b", "zz"], "train"), ("t", "b", None, "dev")], "sample string, identity string, links array<string>, split string")
    got = {(r["sample"], r.linked_identity, r.linked_split) for r in audits.link_leakage(df, "sample", "identity", F.col("links"), "split").collect()}
    assert got == {("s", "b", "dev"), ("s", "zz", None)}


def test_edges_follow_time_with_missing_times_first(spark):
    df = spark.createDataFrame([("a", "2", "+2m"), ("b", None, "+0m"), ("c", "1", "+1m")], "id string, ts string, elapsed string")
    assert {tuple(r) for r in audits.dissemination_edges(df, ["ts", "id"]).collect()} == {("b", "c", "+1m"), ("c", "a", "+2m")}


def test_error_function(spark):
    xs = [-3.0, -0.5, 0.0, 0.3, 1.7]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(scores.erf(F.col("x"))).collect()]
    assert all(abs(g - math.erf(x)) < 2e-7 for g, x in zip(got, xs))


def test_vector_of_odd_features_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 2.0), (1.0, float("inf"))], "a double, b double")
    assert [r[0] is None for r in df.select(scores.compression_vector(["a", "b"])).collect()] == [False, True, True]


def test_anchor_needs_even_steps(spark):
    even = [(0, i, i * 0.25) for i in range(20)]
    odd = [(1, i, i * 0.25 + (0.1 if i == 10 else 0)) for i in range(20)]
    df = spark.createDataFrame(even + odd, "run int, run_pos int, t double").withColumn("k", F.lit("k"))
    got = {(r.run, r.run_pos) for r in series.anchors(df, ["k"], "t", 3, 1, 0.25, 0.05).collect()}
    assert got == {(0, a) for a in range(4, 14)}


def test_folder_names(spark):
    got = spark.createDataFrame([(None,), ("",), ("Originals",)], "n string").select(labels.folder_platform(F.col("n"))).collect()
    assert [r[0] for r in got] == ["unknown", "unknown", "original"]


def test_hub_component_and_released_tables(spark):
    edges = spark.range(1, 400).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))
    assert {r.component for r in connected_components(edges).collect()} == {0}
    t = materialise(spark.range(3))
    release(t)
    with pytest.raises(Exception, match="(?i)not exist|path"):
        spark.read.parquet(t.materialised_at).count()


def test_few_row_groups_are_spread(spark, tmp_path):
    """One file of one row group was one task for all of a costly expression."""
    from tessera.plans import registry

    spark.range(40).selectExpr("id AS p_partkey", "'n' AS p_name", "CAST(id AS INT) % 5 + 1 AS p_size", "1.5D AS p_retailprice").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for name in ("page_images", "score_file_vector"):
        d = registry.queries()[name](spark, str(tmp_path))
        assert d.rdd.getNumPartitions() > 8 and d.select("p_partkey").distinct().count() == 40
    plan = registry.queries()["page_images"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "size(" not in plan.split("Generate")[1].split("Project")[0]


def test_tables_of_a_file_vector_are_worked_out_once(spark, tmp_path):
    """Their number asked for the whole expression again, and squares were made twice; zeros behind the values were divided too."""
    from tessera.operators.attribution import file_vector
    from tessera.plans import registry

    spark.range(4).selectExpr("id AS p_partkey", "CAST(id AS INT) + 1 AS p_size", "1.5D AS p_retailprice").write.parquet(f"{tmp_path}/part.parquet")
    plan = registry.queries()["score_file_vector"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("% 50") == 1
    rows = spark.createDataFrame([(None,), ([],), ([[3, 0, None, 4], None],), ([[3, 0, None, 4]],), ([[1] * 70, [2] * 70],)], "t array<array<int>>")
    got = [r.v for r in rows.select(file_vector(*[F.lit(None)] * 5, F.col("t"), places=6).alias("v")).collect()]
    assert [len(v) for v in got] == [17] * 5
    assert [v[7:] for v in got[:3]] == [[0.0] * 10, [0.0] * 10, [0.5, *[0.0] * 9]]
    assert got[3][7:] == [0.25, 3.5 / 255, 0.5 / 255, 3.5 / 255, 3 / 255, 0.0, None, 4 / 255, 0.0, 0.0]
    assert got[4][7:] == [0.5, 1.5 / 255, 0.5 / 255, sum([1] * 32 + [2] * 64) / 96 / 255, *[1 / 255] * 6]
