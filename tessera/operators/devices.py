"""Device attribution: what one scan of reference images teaches, and the decision cascade that uses it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions.labels import device_label
from tessera.operators import pairs, vectors
from tessera.operators.attribution import mean_fingerprints
from tessera.operators.audits import fingerprint_ranking, first_of
from tessera.operators.protocol import mode_first_seen
from tessera.session import materialise

#: Images a reference fingerprint and a template of originals need, and a template of another platform.
LEAST_ORIGINAL, LEAST_OTHER = 3, 2
PROFILE = ("make", "model", "software", "resolution")


@dataclass
class DeviceModel:
    """prints: print (a name), device, template ("reference", "original" or a platform), n, fingerprint; moments: mean and std a feature; centroids: label, centroid, of standardised features; profiles: device and its most frequent make, model, software and resolution."""

    prints: DataFrame
    moments: list[tuple[float, float]]
    devices: DataFrame
    platforms: DataFrame
    profiles: DataFrame


def train(images: DataFrame, key: str) -> DeviceModel:
    """A model of images (key, device, platform, split, residual, features, make, model, software, width, height).

    A device's reference is the mean residual of its originals in the split `reference` if there are three, else of all its
    originals; devices without originals have no prints. Templates are those of each platform with three originals or two
    other images. Sums meet before the shuffle; the driver sees two numbers a feature.
    """
    images = materialise(images.where("device is not null"), "images")
    original = F.col("platform") == "original"
    kinds = F.array_compact(F.array(F.struct(F.col("platform").alias("kind"), F.lit(False).alias("part")), F.when(original & (F.col("split") == "reference"), F.struct(F.lit("original").alias("kind"), F.lit(True).alias("part")))))
    groups = images.where("platform is not null").select("device", "residual", F.explode(kinds).alias("k")).select("device", "k.kind", "k.part", "residual")
    means = materialise(mean_fingerprints(groups, ["device", "kind", "part"], "residual"), "prints")
    usable = means.where((F.col("kind") == "original") & (~F.col("part") | (F.col("n") >= LEAST_ORIGINAL)))
    reference = first_of(usable, ["device"], [F.desc("part")], 1).select("device", F.lit("reference").alias("template"), "n", "fingerprint")
    templates = means.where(~F.col("part") & (F.col("n") >= F.when(F.col("kind") == "original", LEAST_ORIGINAL).otherwise(LEAST_OTHER))).join(reference.select("device"), "device", "left_semi").select("device", F.col("kind").alias("template"), "n", "fingerprint")
    prints = materialise(reference.unionByName(templates).withColumn("print", F.concat_ws("\t", "device", "template")), "model-prints")
    moments = vectors.column_moments(images, "features", 0.0).withColumn("std", F.when(F.col("std") < 1e-6, 1.0).otherwise(F.col("std"))).orderBy("pos").collect()
    centroids = {c: materialise(vectors.standardised_centroids(images.where(F.col(c).isNotNull()), "features", c).select(F.col(c).alias("label"), "centroid"), f"model-{c}") for c in ("device", "platform")}
    known = images.where(original).withColumn("resolution", F.when((F.col("width") > 0) & (F.col("height") > 0), F.concat_ws("x", F.col("width").cast("string"), F.col("height").cast("string"))))
    profiles = known.select("device").distinct()
    for c in PROFILE:
        profiles = profiles.join(mode_first_seen(known, "device", c, key).withColumnRenamed("mode", c), "device", "left")
    return DeviceModel(prints, [(r["mean"], r["std"]) for r in moments], centroids["device"], centroids["platform"], materialise(profiles, "model-profiles"))


def _ranked(queries: DataFrame, key: str, cents: DataFrame) -> DataFrame:
    """(query, label, confidence, rank): shares of 1 / (1 + distance) to all centroids."""
    named = cents.select(F.col("label").cast("string").alias(key), F.col("centroid").alias("z"))
    near = pairs.distances(queries.select(key, "z"), named, key, "z").select("query", F.col(key).alias("label"), (1 / (1 + F.col("distance"))).alias("score"))
    total = F.sum("score").over(Window.partitionBy("query"))
    order = Window.partitionBy("query").orderBy(F.desc("confidence"), "label")
    return near.select("query", "label", (F.col("score") / F.when(total == 0, 1.0).otherwise(total)).alias("confidence")).withColumn("rank", F.row_number().over(order))


def _names(a: Column, b: Column) -> Column:
    """Whether one of two non-empty texts holds the other."""
    return F.coalesce((a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a)), F.lit(False))


def predict(queries: DataFrame, key: str, model: DeviceModel) -> DataFrame:
    """(key, prediction, confidence, method, camera_model, platform, platform_confidence) of queries (key, residual, features, make, model).

    First a trusted fingerprint (prnu), then camera metadata, by a trained profile or by itself, then the nearest
    centroid of features with a share of 0.65 (weak_file_features), else inconclusive. platform is the nearest
    centroid's; its templates get the fingerprints' bonus.
    """
    q = queries.select(F.col(key).alias("query"), "residual", "features", F.nullif(F.trim("make"), F.lit("")).alias("make"), F.nullif(F.trim("model"), F.lit("")).alias("model"))
    mean, std = (F.array(*[F.lit(float(m[i])) for m in model.moments]) for i in (0, 1))
    z = F.zip_with(F.zip_with(vectors.doubles(F.col("features")), mean, lambda x, a: x - a), std, lambda x, s: x / s)
    zs = q.select(F.col("query").alias(key), z.alias("z"))
    platform = materialise(_ranked(zs, key, model.platforms).where("rank = 1").select("query", F.col("label").alias("platform"), F.col("confidence").alias("platform_confidence")), "platforms")
    feature = _ranked(zs, key, model.devices).where("rank = 1").select("query", F.col("label").alias("near"), F.col("confidence").alias("near_share"))
    against = pairs.correlations(q.select(F.col("query").alias(key), F.col("residual").alias("v")), model.prints.select(F.col("print").alias(key), F.col("fingerprint").alias("v")), key, "v")
    part = F.split(key, "\t")
    matches = against.select("query", part[0].alias("device"), part[1].alias("template"), F.col("r").alias("correlation")).join(platform.select("query", "platform"), "query", "left")
    ranks = fingerprint_ranking(matches, "query", F.col("platform"))
    best = ranks.where("rank <= 2").groupBy("query").agg(
        F.max(F.when(F.col("rank") == 1, F.struct("device", "score", "correlation", "confidence", "trusted"))).alias("top"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"),
    )
    lead = F.coalesce(F.least(F.greatest(F.col("top.score") - F.col("second"), F.lit(0.0)), F.lit(0.25)) * 0.2, F.lit(0.0))
    sure = F.least(F.lit(0.95), 0.55 + F.least(F.greatest(F.col("top.correlation"), F.lit(0.0)), F.lit(0.35)) * 0.8 + F.col("top.confidence") * 0.12 + lead)
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    # profiles that hold the make, or the model, of a query: the distinct pairs of texts are few, and so meet the profiles once each
    cameras = q.where("make is not null or model is not null").select(low(F.col("make")).alias("make_"), low(F.col("model")).alias("model_")).distinct()
    score = F.when(_names(F.col("model_"), low(F.col("model"))), 0.75).otherwise(0.0) + F.when(_names(F.col("make_"), low(F.col("make"))), 0.2).otherwise(0.0)
    fits = cameras.join(model.profiles, score > 0).select("make_", "model_", "device", F.least(score, F.lit(0.85)).alias("fit"))
    fit = first_of(fits, ["make_", "model_"], [F.desc("fit"), "device"], 1).withColumnRenamed("device", "fits")
    d = q.select("query", device_label(F.col("make"), F.col("model")).alias("camera_model"), low(F.col("make")).alias("make_"), low(F.col("model")).alias("model_"))
    d = d.join(fit, ["make_", "model_"], "left").join(best, "query", "left").join(feature, "query", "left").join(platform, "query", "left")
    choice = (
        F.when(F.coalesce("top.trusted", F.lit(False)), F.struct(F.col("top.device").cast("string").alias("prediction"), sure.alias("confidence"), F.lit("prnu").alias("method")))
        .when(F.col("camera_model").isNotNull(), F.struct(F.coalesce(F.col("fits").cast("string"), "camera_model").alias("prediction"), F.coalesce("fit", F.lit(0.68)).alias("confidence"), F.lit("metadata").alias("method")))
        .when(F.col("near_share") >= 0.65, F.struct(F.col("near").alias("prediction"), F.least("near_share", F.lit(0.55)).alias("confidence"), F.lit("weak_file_features").alias("method")))
        .otherwise(F.struct(F.lit(None).cast("string").alias("prediction"), F.lit(0.0).alias("confidence"), F.lit("inconclusive").alias("method")))
    )
    return d.withColumn("c", choice).select(F.col("query").alias(key), "c.prediction", "c.confidence", "c.method", "camera_model", "platform", "platform_confidence")
