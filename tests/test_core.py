"""Golden frames of the library's own operators; SQL comparisons of all queries are in test_queries."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import ids, scores, urls
from tessera.operators import candidates, lineage, metrics, protocol, running, series, vectors
from tessera.operators.components import connected_components
from tessera.sources import sinks, tables


def one(df):
    return df.collect()[0]


def test_auc_and_threshold(spark):
    rows = spark.createDataFrame([(0, 0.1), (0, 0.2), (1, 0.8), (1, 0.9)], "y int, s double")
    r = one(metrics.ranking_metrics(rows, "y", "s"))
    assert (r.auc, r.average_precision, r.balanced_accuracy, r.threshold) == (1.0, 1.0, 1.0, 0.8)
    single = one(metrics.ranking_metrics(rows.where("y = 1"), "y", "s"))
    assert single.auc is None and single.balanced_accuracy is None and single.n == 2
    assert one(metrics.confusion_metrics(rows.where("y = 1"), "y", "s", 0.85)).recall == 0.5


def test_tied_scores_get_half(spark):
    rows = spark.createDataFrame([(0, 0.5), (1, 0.5)], "y int, s double")
    r = one(metrics.ranking_metrics(rows, "y", "s"))
    assert r.auc == 0.5 and r.average_precision == 0.5


def test_running_totals_match_a_window(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("o"), (F.col("id") % 3).alias("k"), (F.col("id") % 11).alias("v"))
    got = {(r.k, r.o): r.c for r in running.running_totals(df, ["o"], {"c": "v"}, ["k"]).collect()}
    total: dict = {}
    for r in sorted(df.collect(), key=lambda r: (r.k, r.o)):
        total[r.k] = total.get(r.k, 0) + r.v
        assert got[(r.k, r.o)] == total[r.k]


def test_gap_runs(spark):
    df = spark.createDataFrame([("a", t) for t in (0.0, 0.25, 0.5, 1.5, 1.75)], "k string, t double")
    runs = series.run_table(series.gap_runs(df, ["k"], "t", 0.375, "t"), ["k"], "t").orderBy("run").collect()
    assert [(r["first"], r["last"]) for r in runs] == [(0, 3), (3, 5)]


def test_interval_alignment(spark):
    w = spark.createDataFrame([("s", 0.0, 4.0), ("s", 4.0, 8.0)], "id string, start_sec double, end_sec double")
    f = spark.createDataFrame([("s", 0.0, 0.0), ("s", 1.0, 1.0), ("s", 4.0, 2.0), ("s", 5.0, 4.0)], "id string, ts double, value double")
    got = {r.start_sec: (r.n, r["mean"], r.motion) for r in series.interval_align(w, f, "id", 4.0).collect()}
    assert got == {0.0: (2, 0.5, 1.0), 4.0: (2, 3.0, 2.0)}
    assert series.interval_align(w, f.where("ts in (0, 4)"), "id", 4.0).count() == 0


def test_padding(spark):
    left, right, inside = series.context_padding(F.lit(0), F.lit(16000), 4000)
    assert tuple(spark.range(1).select(left, right, inside).first()) == (2000, 0, 2000)


def test_chronology_of_seventy(spark):
    t0 = dt.datetime(2026, 8, 18, 6, 30)
    rows = [(i, ["x", "reddit", "web", "youtube", "visual"][i % 5], f"a{i}", f"https://site.org/post/{i}", f"t{i}", t0 + dt.timedelta(minutes=12 * i), "published", "exact", "verified", False, 0.85 - 0.002 * i) for i in range(70)]
    schema = "_ord long, platform string, account string, post_url string, title string, published_at timestamp, timestamp_type string, media_verification string, evidence_status string, is_synthetic boolean, similarity double"
    d = candidates.chronology(spark.createDataFrame(rows, schema))
    got = d.orderBy("rank").collect()
    assert len(got) == 70 and (got[0].role, got[0].elapsed, got[0].confidence) == ("primary_origin", "+0m", "high")
    assert (got[1].role, got[1].elapsed) == ("early_reporting", "+12m")
    c = one(candidates.circulation(d))
    assert c.tracked == 70 and c.listed == 50
    twice = spark.createDataFrame([rows[0], (99, *rows[0][1:]), rows[1]], schema)
    assert candidates.chronology(twice).count() == 2
    lead = spark.createDataFrame([(*rows[0][:8], "lead", *rows[0][9:])], schema)
    assert candidates.chronology(lead).count() == 0


@pytest.mark.parametrize("sec,text", [(20, "+0m"), (840, "+14m"), (8100, "+2h 15m"), (60, "+0m")])
def test_elapsed(spark, sec, text):
    assert spark.range(1).select(candidates.elapsed_text(F.lit(sec))).first()[0] == text


def test_vectors(spark):
    df = spark.createDataFrame([("a", [0.1, 0.2, 0.3]), ("b", [0.9, 0.8, 0.7]), ("z", [0.0, 0.0, 0.0]), ("s", [1.0])], "k string, v array<float>")
    near = vectors.nearest(df.where("k = 'a'"), df, "k", "v", 4).orderBy("rank").collect()
    assert near[0].k == "a" and near[0].similarity == 1.0 and near[0].similarity > near[1].similarity
    assert {r.k: r.similarity for r in near}["s"] == 0.5 and {r.k: r.similarity for r in near}["z"] == 0.0
    h = lambda a, b: spark.range(1).select(vectors.hamming256(F.lit(a), F.lit(b))).first()[0]
    assert h("0" * 64, "f" * 64) == 256 and h("0" * 64, None) == 999 and h("0" * 64, "1" + "0" * 63) == 1


def test_split_is_whole_and_stable(spark):
    df = spark.range(100).select((F.col("id") % 10).cast("string").alias("g"), "id")
    a = {r.g: r.role for r in protocol.assign_groups(df, ["g"], 7).collect()}
    assert a == {r.g: r.role for r in protocol.assign_groups(df.orderBy(F.desc("id")), ["g"], 7).collect()}
    assert sorted(a.values()).count("train") == 6 and set(a.values()) == {"train", "dev", "holdout"}
    with pytest.raises(ValueError):
        protocol.assign_groups(df.where("g = '1'"), ["g"], 7)


def test_overlap_has_one_row_a_key(spark):
    l_ = spark.createDataFrame([(1, "k"), (2, "k"), (3, "m"), (4, None)], "id int, k string")
    r_ = spark.createDataFrame([(7, "k"), (8, "k"), (9, None)], "id int, k string")
    assert [tuple(x) for x in protocol.overlap_examples(l_, r_, "k", "id", "id").collect()] == [("k", 1, 7)]


def test_components(spark):
    e = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (7, 7), (None, 1)], "src long, dst long")
    assert {r.node: r.component for r in connected_components(e).collect()} == {5: 3, 4: 3, 3: 3, 9: 8, 8: 8, 7: 7}
    assert connected_components(e.limit(0)).count() == 0


def test_ledger_and_tampering(spark):
    rows = spark.createDataFrame([("c", i, f"e{i}") for i in range(4)], "case string, i int, event string")
    led = lineage.chain(rows, "case", ["i"], ["event"], lineage.GENESIS)
    assert one(led.where("sequence = 1")).previous_hash == lineage.GENESIS
    assert one(lineage.verify_chain(led, "case")).broken == 0
    assert one(lineage.verify_chain(led.withColumn("entry_hash", F.when(F.col("sequence") == 2, "x").otherwise(F.col("entry_hash"))), "case")).broken == 1


def test_lineage_search(spark):
    nodes = spark.createDataFrame([(str(i), float(f)) for i, f in enumerate([0, 5, 3, 4, 1])], "node string, f double")
    edges = spark.createDataFrame([("0", "1"), ("0", "2"), ("2", "3"), ("3", "4"), ("1", "0")], "src string, dst string")
    got = [(r.node, r.parent, r.depth) for r in lineage.best_first(nodes, edges, "0").orderBy("step").collect()]
    assert got == [("0", None, 0), ("2", "0", 1), ("3", "2", 2), ("4", "3", 3), ("1", "0", 1)]
    tree = lineage.best_first(nodes, edges, "0")
    assert [r.node for r in lineage.path_to_root(tree, "4").orderBy("position").collect()] == ["4", "3", "2", "0"]


def test_two_key_dedup_and_tolerant_best(spark):
    rows = spark.createDataFrame([("q", 1, "u", "t"), ("q", 2, "u", "x"), ("q", 3, "v", "t"), ("q", 4, "w", ""), ("q", 5, "y", "")], "q string, o int, url string, thumb string")
    assert sorted(r.o for r in lineage.two_key_dedup(rows, "q", "o", ("url", "thumb")).collect()) == [1, 4, 5]
    t = dt.datetime(2024, 1, 1)
    c = spark.createDataFrame([("q", 1, "a", 0.5, t, 10, 1.0), ("q", 2, "b", 0.5, t + dt.timedelta(minutes=30), 20, 1.0), ("q", 3, "c", 0.5, t - dt.timedelta(hours=2), 1, 9.0)], "q string, o int, key string, conf double, ts timestamp, area int, f double")
    assert one(lineage.tolerant_best(c, "q", "o"))["key"] == "c"


def test_scores(spark):
    v = lambda c: spark.range(1).select(c).first()[0]
    assert abs(v(scores.sigmoid(F.lit(1000.0))) - 1) < 1e-9 and v(scores.argmax(F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0)))) == 1
    assert v(scores.evidence_vector([(F.lit(None).cast("double"), F.lit(False)), (F.lit(2.0), F.lit(True))])) == [0, 2, 0, 1]
    assert v(scores.evidence_vector([(F.lit(1.0), F.lit(False))])) is None
    assert v(candidates.anchor_score(F.lit(0.75), F.lit(0.32), F.lit(None).cast("double"), F.lit(True))) == 0.98
    assert math.isclose(v(vectors.calibrate(F.lit(0.6), 0.45, 0.75)), 0.5)
    assert v(scores.homography_scale(*[F.lit(float(x)) for x in (2, 0, 0, 2, 1)])) == 2.0


def test_urls(spark):
    v = lambda c: spark.range(1).select(c).first()[0]
    assert v(urls.public_url(F.lit("https://news.site.org/a"))) and not v(urls.public_url(F.lit("https://x.example.com/a")))
    assert not v(urls.public_url(F.lit("ftp://site.org/a"))) and not v(urls.public_url(F.lit(None).cast("string"))) and not v(urls.public_url(F.lit("http://10.0.0.1/a")))
    assert v(urls.normalize_url(F.lit("HTTPS://Site.org/Path/?q=1#x"))) == "https://site.org/path"
    assert v(ids.fraction(F.lit("30000/1001"))) == 30000 / 1001 and v(ids.fraction(F.lit("1/0"))) == 0.0
    assert v(ids.redact_paths(F.lit("see /home/u/file.mp4 now"))) == "see [path] now"


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "train", 1.0), ("b", "train", 2.0)], "sample_id string, split string, v double")
    sinks.write_csv(df, str(tmp_path / "c"), ["sample_id", "split", "v"])
    assert tables.read_manifest(spark, str(tmp_path / "c"), ["sample_id", "split"], split="train").count() == 2
    with pytest.raises(ValueError):
        tables.read_manifest(spark, str(tmp_path / "c"), ["missing"])
    with pytest.raises(ValueError):
        tables.read_manifest(spark, str(tmp_path / "c"), ["split"], split="dev")
    with pytest.raises(ValueError):
        sinks.write_csv(df, str(tmp_path / "d"), ["v"])
    with pytest.raises(ValueError):
        sinks.write_json(df.withColumn("v", F.lit(float("nan"))), str(tmp_path / "j"))
    sinks.write_json(df, str(tmp_path / "j"))
    assert tables.read_json_lines(spark, str(tmp_path / "j"), "sample_id string, v double").count() == 2
    assert sinks.content_digest(df, ["sample_id"]) == sinks.content_digest(df.repartition(3), ["sample_id"])
    up = sinks.upsert(df, spark.createDataFrame([(1, "a", "dev", 9.0), (2, "a", "test", 8.0), (3, "c", "dev", 1.0)], "_ord long, sample_id string, split string, v double"), "sample_id")
    assert {r.sample_id: r.split for r in up.collect()} == {"a": "test", "b": "train", "c": "dev"}
    bad = sinks.write_valid(df.withColumn("why", F.when(F.col("v") > 1, "LARGE")), str(tmp_path / "p"), "why")
    assert bad.count() == 1 and spark.read.parquet(str(tmp_path / "p")).count() == 1
    (tmp_path / "m" / "real" / "id12").mkdir(parents=True)
    (tmp_path / "m" / "real" / "id12" / "x.jpg").write_bytes(bytes.fromhex("FFD8FFE0") + b"0" * 20)
    r = one(tables.media_files(spark, str(tmp_path / "m"), "*.jpg"))
    assert (r.class_folder, r.identity, r.media) == ("real", "id12", "image/jpeg")
    assert tables.usable(df, df.where("sample_id = 'a'")).where("exclusion_reason is not null").count() == 1
    al = tables.aliased(spark.createDataFrame([("", "p", None)], "file_path string, path string, x string"), {"file": ["file_path", "path"], "none": ["q"]})
    assert tuple(one(al)) == ("p", None)
    assert tables.fixture_rows(spark, 3, "x").where("is_synthetic").count() == 3


def test_kernels(spark):
    import numpy as np

    from tessera.functions import kernels as k

    rng = np.random.default_rng(0)
    plane = rng.normal(size=(24, 32))
    assert abs(k.residual_plane(plane).std() - 1) < 1e-9 and not k.residual_plane(np.ones((8, 8))).any()
    blocks = np.kron(rng.normal(size=(4, 4)), np.ones((8, 8))) + 0.01 * rng.normal(size=(32, 32))
    assert k.blockiness_of(blocks) > 5 > k.blockiness_of(plane) > 0.5
    direct = np.array([[np.pad(plane, 2, mode="edge")[i : i + 5, j : j + 5].mean() for j in range(32)] for i in range(24)])
    assert np.allclose(k.box_blur(plane), direct)
    assert k.audio_descriptor_of(np.sin(np.arange(4000) / 5)).shape == (82,)
    df = spark.createDataFrame([(plane.ravel().tolist(), 24), (None, 24)], "v array<double>, h int")
    got = df.select(k.residual("v", "h").alias("r"), k.blockiness("v", "h").alias("b"), k.audio_descriptor("v").alias("a")).collect()
    assert np.allclose(got[0].r, k.residual_plane(plane).ravel()) and got[1].b is None and len(got[0].a) == 82


def test_queries_from_text(spark):
    from tessera.operators import profiles

    df = spark.createDataFrame([("Flood near Old Bridge in Delhi today", ["flood", "bridge", "river", "rain"]), (None, [])], "t string, k array<string>")
    got = [r[0] for r in df.select(profiles.search_queries(F.col("t"), F.col("k"), ["x", "reddit"])).collect()]
    assert got[0]["x"] == ["Flood Old Bridge flood bridge river", "Flood Old Bridge x", "flood bridge river"]
    assert got[1]["reddit"] == ["reddit"]
