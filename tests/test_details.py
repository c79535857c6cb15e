"""Device models, folds, vectors, windows, fractions and projections on small odd tables."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import records, scores
from tessera.operators import candidates, devices, folds, lineage, protocol, series, vectors


def image(no, device, platform, split, residual, features, make=None, model=None):
    return (no, device, platform, split, [float(x) for x in residual], [float(x) for x in features], make, model, None, 10, 20)


SCHEMA = "no long, device string, platform string, split string, residual array<double>, features array<double>, make string, model string, software string, width int, height int"


@pytest.fixture(scope="module")
def images(spark):
    rng = random.Random(2)
    noise = lambda base: [x + rng.gauss(0, 0.3) for x in base]
    base = {d: [rng.gauss(0, 1) for _ in range(40)] for d in "abc"}
    rows = [image(i, "a", "original", "reference" if i < 3 else "train", noise(base["a"]), [1, 2 + i], "Canon", "Canon X") for i in range(5)]
    rows += [image(10 + i, "b", "original", "reference" if i == 0 else "train", noise(base["b"]), [9, 2], "Nikon", "Z9" if i else "Z8") for i in range(2)]
    rows += [image(20 + i, "b", "whatsapp", "s", noise(base["b"]), [9, 4]) for i in range(2)] + [image(25, "b", "reddit", "s", noise(base["b"]), [9, 4])]
    rows += [image(30 + i, "c", "whatsapp", "s", noise(base["c"]), [5, 5]) for i in range(4)]
    return rows, base, noise, spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_device_model(spark, images):
    rows, base, noise, df = images
    model = devices.train(df, "no")
    # a: three references; b: one reference only, so all two originals, and a template of two others; c: no original, so nothing
    assert {(r.device, r.template): r.n for r in model.prints.collect()} == {("a", "reference"): 3, ("a", "original"): 5, ("b", "reference"): 2, ("b", "whatsapp"): 2}
    assert {r.device: (r.make, r.model, r.resolution) for r in model.profiles.collect()} == {"a": ("Canon", "Canon X", "10x20"), "b": ("Nikon", "Z8", "10x20")}
    assert {r.label for r in model.devices.collect()} == set("abc") and {r.label for r in model.platforms.collect()} == {"original", "whatsapp", "reddit"}
    asked = [image(1, None, None, None, noise(base["a"]), [1, 3]), image(2, None, None, None, [1.0] * 40, [5, 5], " nikon ", "z8"), image(3, None, None, None, [1.0] * 40, [5, 5], "Other", "Thing"), image(4, None, None, None, [1.0] * 40, [5, 4])]
    got = {r.no: r for r in devices.predict(spark.createDataFrame(asked, SCHEMA), "no", model).collect()}
    assert (got[1].prediction, got[1].method) == ("a", "prnu") and 0.8 < got[1].confidence <= 0.95
    assert (got[2].prediction, got[2].method, got[2].confidence, got[2].camera_model) == ("b", "metadata", 0.85, "nikon z8")
    assert (got[3].prediction, got[3].method, got[3].confidence) == ("Other Thing", "metadata", 0.68)
    assert got[4].method in ("weak_file_features", "inconclusive") and got[4].confidence <= 0.55
    assert all(r.platform in ("original", "whatsapp", "reddit") for r in got.values())


def test_folds_hold_no_group(spark):
    """Groups longer than a batch; null and empty keys; a null group."""
    rng = random.Random(1)
    rows = [(rng.choice(["g", "g", "h", None]), i, rng.choice([None, "", *(f"u{k}" for k in range(300))]), rng.choice([None, *(f"t{k}" for k in range(300))])) for i in range(4000)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = sorted(r.o for r in lineage.two_key_dedup(spark.createDataFrame(rows, "g string, o long, a string, b string").repartition(7), "g", "o", ("a", "b")).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    wanted = []
    for g in ("g", "h", None):
        seen = (set(), set())
        for _, o, *keys in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
            used = [(s, k) for s, k in zip(seen, keys) if k]
            if not any(k in s for s, k in used):
                wanted.append(o)
                for s, k in used:
                    s.add(k)
    assert got == sorted(wanted)


def test_tolerant_best_with_nulls(spark):
    import datetime as dt

    t = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    rows = [("a", 1, "k1", 0.5, t(5), 10.0, 1.0), ("a", 2, "k2", 0.5, t(5.5), 11.0, 1.0), ("a", 3, "k3", None, t(0), 99.0, 0.0), ("a", 4, "k4", 0.5, t(1), 1.0, 1.0), ("b", 1, "k5", None, None, None, None), ("b", 2, "k6", 0.9, None, 1.0, 1.0)]
    got = {r.g: r.key for r in lineage.tolerant_best(spark.createDataFrame(rows, "g string, o long, key string, conf double, ts timestamp, area double, f double"), "g", "o").collect()}
    assert got == {"a": "k4", "b": "k5"}
    assert folds.__doc__ and candidates.__doc__


def test_window_values(spark):
    got = {(r.k, r.window): (r.start, r.valid, r["values"]) for r in series.window_values(spark.createDataFrame([(1, [1, 2, 3, 4, 5]), (2, []), (3, None), (4, [7])], "k int, s array<int>"), "k", "s", 4, 3).collect()}
    assert got == {(1, 0): (0, 4, [1, 2, 3, 4]), (1, 1): (3, 2, [4, 5, 4, 5]), (4, 0): (0, 1, [7, 7, 7, 7])}


def test_attached_scores(spark):
    rows = [("matched_a", 1, 7, None, 0.9, 2.0, 1), ("matched_a", 1, 7, None, 0.8, 1.0, 2), ("matched_a", 0, 8, 7, 0.1, -2.0, 3), ("matched_b", 0, 8, 7, 0.1, -2.0, 4), ("legacy", 1, 7, 7, 0.5, 0.0, 5), ("matched_a", 0, 9, None, 0.2, -1.0, 6)]
    got = {r.o: r.aligned_score for r in series.attach_aligned(spark.createDataFrame(rows, "cohort string, label int, anchor_id long, paired_anchor_id long, score double, logit double, o long"), "o").collect()}
    assert got == {1: None, 2: None, 3: 0.8, 4: None, 5: None, 6: None}


def test_dev_fraction(spark):
    df = spark.createDataFrame([(f"g{i // 3}", i % 2, i) for i in range(60)], "g string, y int, no long")
    roles = {}
    for r in protocol.dev_fraction(df, "g", "y", 3, 0.25).collect():
        roles.setdefault(r.g, set()).add(r.role)
    assert all(len(x) == 1 for x in roles.values()) and sum(x == {"dev"} for x in roles.values()) == 5
    with pytest.raises(ValueError, match="one role alone"):
        protocol.dev_fraction(df.withColumn("y", F.when(F.col("no") == 0, 9).otherwise(F.col("y"))), "g", "y", 3)
    with pytest.raises(ValueError, match="without g"):
        protocol.dev_fraction(df.withColumn("g", F.when(F.col("no") > 0, F.col("g"))), "g", "y", 3)
    with pytest.raises(ValueError, match="half"):
        protocol.dev_fraction(df, "g", "y", 3, 0.5)


def test_text_fallback(spark):
    c = spark.createDataFrame([("x", 1, "red fox jumps"), ("x", 2, "RED FOX"), ("x", 3, None), ("x", 4, "blue sea"), ("y", 5, "red fox"), ("z", 6, "anything")], "case string, k long, t string")
    ref = spark.createDataFrame([("x", "a red fox"), ("y", "the the")], "case string, t string")
    got = {r.k: r.score for r in vectors.text_fallback(c, "case", "k", "t", ref, ["the"]).collect()}
    assert got == {1: pytest.approx(0.663, abs=0.1), 2: 0.95, 3: 0.15, 4: 0.15, 5: 0.15}


def test_compression_features(spark):
    names = [n for n in scores.COMPRESSION_FEATURES if not n.endswith("_sec") and n != "bits_per_pixel_frame"]
    d = spark.range(2).select(*[F.lit(0.5).alias(n) for n in names], *[F.lit(50.0).alias(f"gop_{k}") for k in ("mean", "std", "max")], F.lit(1000.0).alias("bitrate"), F.lit(10).alias("width"), F.lit(10).alias("height"), F.when(F.col("id") == 0, 25.0).otherwise(0.0).alias("fps"))
    first, second = scores.compression_features(d).orderBy(F.desc("fps")).collect()
    assert len(first.features) == 20 and first.features[2:5] == [2.0] * 3 and first.features[0] == pytest.approx(0.3364722) and first.features[13] == pytest.approx(0.4054651) and second.features is None


def test_projections(spark):
    row = {c: None for c in "post_url url platform account title text snippet source_connector retrieved_at published_at timestamp_type media_verification evidence_status failure_reason".split()}
    df = spark.createDataFrame([tuple((row | {"post_url": "", "url": "u", "snippet": "s", "platform": "p"}).values())], ", ".join(f"{c} string" for c in row)).withColumns({c: F.lit(None).cast("boolean") for c in ("has_media", "is_synthetic")})
    v, m = df.select(records.lead_view(), records.external_match()).first()
    assert (v.url, v.post_url, v.text, v.has_media, v.timestamp_type, v.evidence_status) == ("u", "u", "s", False, "unknown", "unverified")
    assert tuple(m) == ("u", "p", None, None)
    assert records.compact_records(df.select(F.lit(1).alias("x"), F.lit(0.5).alias("score"), F.lit("c").alias("cohort"))).columns == ["cohort", "score"]


def test_labelled_images(spark, tmp_path):
    from tessera.sources import tables

    def put(name, text=b"x"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(text)

    for name in ("cam/a.jpg", "cam/Original-reference/b.PNG", "cam/ig query/deep/c.webp", "cam/whatsapp/d.txt", "top.jpg", "phone/unknown place/e.dng"):
        put(name)
    read = lambda: sorted(tuple(r) for r in tables.labelled_images(spark, str(tmp_path)).collect())
    assert read() == [
        ("cam/Original-reference/b.PNG", "cam", "original", "reference"), ("cam/a.jpg", "cam", "original", "train"), ("cam/ig query/deep/c.webp", "cam", "instagram", "test"), ("phone/unknown place/e.dng", "phone", "unknown_place", "platform_sample"),
    ]
    put("labels.csv", b"path,relative_path,device,platform,is_reference,split\n,cam/a.jpg,,,yes,\ncam/ig query/deep/c.webp,,d9,Reddit,,mine\nmissing.jpg,,d,,,\ncam/whatsapp/d.txt,,d,,,\n,,d,,,\ncam/Original-reference/b.PNG,,,,,\n")
    assert read() == [("cam/Original-reference/b.PNG", "cam", "original", "reference"), ("cam/a.jpg", None, "cam", "reference"), ("cam/ig query/deep/c.webp", "d9", "reddit", "mine")]


def test_small_negatives_keep_their_sign(spark, tmp_path):
    """-2e-7 rounds to -0.0 in SQL; nulls, zeros and others as before."""
    from tessera.plans import registry

    spark.createDataFrame([(3, [-2e-7, 2e-7, 0.0, -0.5])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = registry.queries()["series_window_values"](spark, str(tmp_path)).first()["values"]
    assert [str(x) for x in got[:4]] == ["-0.0", "0.0", "0.0", "-0.5"]


def test_equal_votes_tie(spark):
    """0.3 + 0.2 + 0.1 and 0.1 + 0.2 + 0.3 differ as doubles, so that b came first; 1e-20 is no decimal of twelve places."""
    from tessera.operators import profiles

    rows = [(1, "a", 0.3), (1, "a", 0.2), (1, "a", 0.1), (1, "b", 0.1), (1, "b", 0.2), (1, "b", 0.3), (2, "a", 1e-20), (2, "b", 3e-20), (2, "c", None), (3, "a", 1e300)]
    got = profiles.votes(spark.createDataFrame(rows, "q int, l string, w double").coalesce(1), "q", "l", "w", 0.0).collect()
    assert sorted((r.q, r.l, r.rank) for r in got) == [(1, "a", 1), (1, "b", 2), (2, "a", 2), (2, "b", 1), (2, "c", 3), (3, "a", 1)]
    assert {r.l: r.score for r in got if r.q == 1} == {"a": 0.6, "b": 0.6} and {r.l: r.score for r in got if r.q == 2} == {"a": 1e-20, "b": 3e-20, "c": None}


def test_shares_halfway_round_up(spark):
    """Odd cents of 128, damping included, lie halfway between two millionths; sums of doubles fell on either side of it."""
    from tessera.operators import profiles

    rows = [(p, label, cents / 100) for p in range(1, 113, 2) for label, cents in [("a", p), ("b", (113 - p) // 3), ("c", (113 - p) // 3), ("c", 113 - p - 2 * ((113 - p) // 3))]]
    got = profiles.votes(spark.createDataFrame(rows, "q int, l string, w double"), "q", "l", "w").where("l = 'a'").select("q", F.round("confidence", 6).alias("c")).collect()
    assert {r.q: r.c for r in got} == {p: (p * 78125 + 5) // 10 / 1e6 for p in range(1, 113, 2)}
    rows = [(1, "a", -0.15), (2, "a", -1.15), (2, "b", 1.0), (3, "a", 0.0), (3, "b", -0.15)]
    got = profiles.votes(spark.createDataFrame(rows, "q int, l string, w double"), "q", "l", "w").collect()
    assert sorted((r.q, r.l, str(r.confidence)) for r in got) == [(1, "a", "-inf"), (2, "a", "-inf"), (2, "b", "inf"), (3, "a", "nan"), (3, "b", "-inf")]
