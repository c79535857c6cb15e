"""Numeric expressions of decisions and features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def sigmoid(x: Column, limit: float = 80.0) -> Column:
    return 1 / (1 + F.exp(-F.least(F.lit(limit), F.greatest(F.lit(-limit), x))))


def softmax(xs: Sequence[Column]) -> Column:
    """Array of shares, computed from the differences to the largest."""
    top = F.greatest(*xs) if len(xs) > 1 else xs[0]
    e = [F.exp(x - top) for x in xs]
    total = sum(e[1:], e[0])
    return F.array(*[x / total for x in e])


def argmax(xs: Column) -> Column:
    """0-based place of the first largest element."""
    return (F.array_position(xs, F.array_max(xs)) - 1).cast("int")


def evidence_vector(branches: Sequence[tuple[Column, Column]]) -> Column:
    """Logits (0 where unavailable) and then availability masks; null if nothing is available."""
    logits = [F.when(ok & l.isNotNull(), l.cast("double")).otherwise(0.0) for l, ok in branches]
    masks = [(ok & l.isNotNull()).cast("double") for l, ok in branches]
    some = sum(masks[1:], masks[0]) > 0
    return F.when(some, F.array(*logits, *masks))


def leave_one_out(vector: Column, n: int) -> Column:
    """Array of (branch, vector without it) for the branches that are available."""
    def without(i: Column) -> Column:
        return F.struct(i.alias("branch"), F.transform(vector, lambda x, k: F.when((k == i) | (k == i + n), 0.0).otherwise(x)).alias("vector"))

    return F.filter(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(F.get(vector, i + n) > 0, without(i))), lambda x: x.isNotNull())


def blend(p: Column, r: Column, wp: Column, wr: Column) -> Column:
    return F.bround(F.least(F.lit(1.0), F.greatest(F.lit(0.0), wp * p + wr * r)), 3)


def eye_aspect_ratio(points: Column) -> Column:
    """(|p2 p6| + |p3 p5|) / (2 |p1 p4|) of six {x, y}; null for another number of points or no width."""
    d = lambda i, j: F.hypot(F.get(points, F.lit(i))["x"] - F.get(points, F.lit(j))["x"], F.get(points, F.lit(i))["y"] - F.get(points, F.lit(j))["y"])
    return F.when((F.size(points) == 6) & (d(0, 3) > 0), (d(1, 5) + d(2, 4)) / (2 * d(0, 3)))


def margin_box(xs: Column, ys: Column, width: Column, height: Column, margin: float) -> Column:
    """{x0, y0, x1, y1} around points, widened by a share of its size and cut to the frame."""
    x0, x1, y0, y1 = F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)
    mx, my = (x1 - x0) * margin, (y1 - y0) * margin
    z = F.lit(0.0)
    return F.struct(F.greatest(z, x0 - mx).alias("x0"), F.greatest(z, y0 - my).alias("y0"), F.least(width, x1 + mx).alias("x1"), F.least(height, y1 + my).alias("y1"))


def valid_box(x: Column, y: Column, w: Column, h: Column) -> Column:
    """A normalised box inside the unit square with positive size."""
    return F.coalesce((x >= 0) & (y >= 0) & (w > 0) & (h > 0) & (x + w <= 1) & (y + h <= 1), F.lit(False))


def homography_scale(a: Column, b: Column, c: Column, d: Column, h22: Column) -> Column:
    """Root of the determinant of the 2 x 2 part over |h22|; 1 where it is degenerate."""
    det = F.abs(a * d - b * c)
    return F.when((det > 1e-12) & (F.abs(h22) > 1e-12), F.sqrt(det) / F.abs(h22)).otherwise(1.0)


def central_box(width: Column, height: Column, share: float = 0.6) -> Column:
    w, h = (width * share).cast("int"), (height * share).cast("int")
    return F.struct(F.floor((width - w) / 2).cast("int").alias("x"), F.floor((height - h) / 2).cast("int").alias("y"), w.alias("w"), h.alias("h"))


def acceptance(auc: Column, ba: Column, drop: Column, min_auc: float = 0.98, min_ba: float = 0.97, max_drop: float = 0.02) -> Column:
    """{accepted, reasons} of three gates; a missing figure fails its gate."""
    e = 1e-9
    reasons = F.array_compact(F.array(
        F.when(~F.coalesce(auc + e >= min_auc, F.lit(False)), "auc"), F.when(~F.coalesce(ba + e >= min_ba, F.lit(False)), "balanced_accuracy"), F.when(~F.coalesce(drop - e <= max_drop, F.lit(False)), "auc_drop"),
    ))
    return F.struct((F.size(reasons) == 0).alias("accepted"), reasons.alias("reasons"))


def fingerprint_decision(correlation: Column, margin: Column, least: float = 0.15) -> Column:
    """{decision, confidence} from a correlation and its lead over the second."""
    return (
        F.when(correlation.isNull() | (correlation < least), F.struct(F.lit("no_match").alias("decision"), F.lit(0.0).alias("confidence")))
        .when(F.coalesce(margin, F.lit(1.0)) < 0.02, F.struct(F.lit("ambiguous").alias("decision"), F.least(F.lit(0.6), correlation).alias("confidence")))
        .otherwise(F.struct(F.lit("match").alias("decision"), F.least(F.lit(0.99), 0.5 + correlation).alias("confidence")))
    )


def erf(x: Column) -> Column:
    """The error function to 1.5e-7 (Abramowitz and Stegun 7.1.26)."""
    #: Fixed values of that formula.
    p, a = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    t = 1 / (1 + p * F.abs(x))
    poly = F.lit(0.0)
    for c in reversed(a):
        poly = (poly + c) * t
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def gelu(x: Column) -> Column:
    return x * 0.5 * (1 + erf(x / 2**0.5))


def layer_norm(x: Column, gain: Sequence[float], shift: Sequence[float], eps: float = 1e-5) -> Column:
    """An array of fixed size brought to mean 0 and population deviation 1, then scaled."""
    n = len(gain)
    at = [F.get(x, F.lit(i)) for i in range(n)]
    mean = sum(at[1:], at[0]) / n
    var = sum([(a - mean) * (a - mean) for a in at[1:]], (at[0] - mean) * (at[0] - mean)) / n
    return F.array(*[(a - mean) / F.sqrt(var + eps) * g + s for a, g, s in zip(at, gain, shift)])


def linear(x: Column, weights: Sequence[Sequence[float]], bias: Sequence[float]) -> Column:
    """One output a row of weights: its product with x, plus bias."""
    products = lambda row: F.aggregate(F.zip_with(x, F.array(*map(F.lit, row)), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return F.array(*[products(row) + b for row, b in zip(weights, bias)])


def fusion_forward(x: Column, gain, shift, hidden, hidden_bias, out, out_bias) -> Column:
    """Logits of a small network: layer norm, linear, GELU, linear. Weights are literals of a trained model's size."""
    h = F.transform(linear(layer_norm(x, gain, shift), hidden, hidden_bias), gelu)
    return linear(h, out, out_bias)


def compression_vector(names: Sequence[str], logged: Sequence[str] = ()) -> Column:
    """An array of feature columns, those in logged as log(1 + x); null where one is missing or not finite."""
    cols = [F.log1p(F.col(n)) if n in logged else F.col(n).cast("double") for n in names]
    bad = F.lit(False)
    for c in cols:
        bad = bad | c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return F.when(~bad, F.array(*cols))


#: The twenty numbers of a video's compression, in order; the first and the one of Laplacian means as log(1 + x).
COMPRESSION_FEATURES = (
    "bits_per_pixel_frame", "key_share", "gop_mean_sec", "gop_std_sec", "gop_max_sec", "packet_cv", "packet_p90", "step_cv", "i_share", "p_share", "b_share",
    "blockiness_mean", "blockiness_std", "laplacian_mean", "laplacian_cv", "residual_mean", "residual_cv", "near_duplicates", "change_mean", "change_cv",
)
LOGGED_FEATURES = ("bits_per_pixel_frame", "laplacian_mean")


def compression_features(statistics: DataFrame) -> DataFrame:
    """statistics with features: the vector of COMPRESSION_FEATURES, null where one is missing or not finite.

    statistics joins `probe_statistics` (its gop_mean, gop_std and gop_max in frames) and `frame_statistics` of
    blockiness, laplacian and residual with bitrate, width, height and fps.
    """
    per = F.col("width") * F.col("height") * F.col("fps")
    d = statistics.withColumn("bits_per_pixel_frame", F.try_divide("bitrate", per))
    d = d.withColumns({f"gop_{k}_sec": F.try_divide(f"gop_{k}", "fps") for k in ("mean", "std", "max")})
    return d.select(*statistics.columns, compression_vector(COMPRESSION_FEATURES, LOGGED_FEATURES).alias("features"))


def pixel_points(points: Column, places: Sequence[int], width: Column, height: Column) -> Column:
    """Chosen landmarks {x, y} in 0 to 1 as whole pixels inside the frame."""
    clamp = lambda v, n: F.greatest(F.lit(0), F.least(n - 1, (v * n).cast("int")))
    return F.transform(F.array(*map(F.lit, places)), lambda i: F.struct(clamp(F.get(points, i)["x"], width).alias("x"), clamp(F.get(points, i)["y"], height).alias("y")))


def point_distance(a: Column, b: Column) -> Column:
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"])


def blink_vector(left: Column, right: Column, mean_before: Column, seconds: Column) -> Column:
    """Seven numbers of two eyes: both openings, their mean, difference and relative difference, and the mean's change a second with its size; no change without a row before."""
    mean, apart = (left + right) / 2, F.abs(left - right)
    speed = F.coalesce(F.try_divide(mean - mean_before, F.when(seconds > 0, seconds)), F.lit(0.0))
    return F.array(left, right, mean, apart, apart / F.greatest(mean, F.lit(1e-6)), speed, F.abs(speed))
