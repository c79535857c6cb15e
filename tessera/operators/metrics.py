"""Ranking and classification metrics over (label, score) rows, by any grouping.

Rows are first counted per distinct score, so every metric works on one row a
score. Metrics that need both classes are null where one is missing.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.operators.running import numbered, running_totals
from tessera.session import materialise


def score_table(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, score, pos, n, pos_below, n_below, p_all, n_all): counts at each distinct score and below it."""
    counts = df.groupBy(*by, F.col(score).alias("score")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count("*").alias("n"))
    run = running_totals(counts, ["score"], {"pos_upto": "pos", "n_upto": "n"}, by)
    totals = counts.groupBy(*by).agg(F.sum("pos").alias("p_all"), F.sum("n").alias("n_all"))
    run = run.join(totals, list(by)) if by else run.crossJoin(totals)
    return run.select(*by, "score", "pos", "n", (F.col("pos_upto") - F.col("pos")).alias("pos_below"), (F.col("n_upto") - F.col("n")).alias("n_below"), "p_all", "n_all")


def average_ranks(df: DataFrame, score: str, by: Sequence[str] = ()) -> DataFrame:
    """df with avg_rank: the mean of the places that rows of equal score share."""
    counts = df.groupBy(*by, score).agg(F.count("*").alias("_n"))
    run = running_totals(counts, [score], {"_upto": "_n"}, by)
    return df.join(run, [*by, score]).withColumn("avg_rank", F.col("_upto") - (F.col("_n") - 1) / 2).drop("_n", "_upto")


def ranking_metrics(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, positives, auc, average_precision, balanced_accuracy, threshold).

    auc is Mann-Whitney with average ranks; average_precision treats equal
    scores as one step; balanced_accuracy is the best over thresholds
    (score >= threshold), the lowest threshold winning ties.
    """
    t = score_table(df, label, score, by)
    neg, negs = F.col("n") - F.col("pos"), F.col("n_all") - F.col("p_all")
    both = (F.col("p_all") > 0) & (negs > 0)
    above_p, above_n = F.col("p_all") - F.col("pos_below"), F.col("n_all") - F.col("n_below")
    neg_below = F.col("n_below") - F.col("pos_below")
    t = t.select(
        *by, "score", "p_all", "n_all", both.alias("both"),
        (F.col("pos") * (neg_below + neg / 2)).alias("wins"),
        (F.col("pos") * above_p / above_n).alias("step"),
        ((above_p / F.greatest(F.col("p_all"), F.lit(1)) + neg_below / F.greatest(negs, F.lit(1))) / 2).alias("ba"),
    )
    out = t.groupBy(*by).agg(
        F.first("n_all").alias("n"), F.first("p_all").alias("positives"), F.first("both").alias("both"),
        F.sum("wins").alias("wins"), F.sum("step").alias("steps"), F.max(F.struct("ba", (-F.col("score")).alias("neg"))).alias("best"),
    )
    return out.select(
        *by, "n", "positives",
        F.when(F.col("both"), F.col("wins") / (F.col("positives") * (F.col("n") - F.col("positives")))).alias("auc"),
        F.when(F.col("both"), F.col("steps") / F.col("positives")).alias("average_precision"),
        F.when(F.col("both"), F.col("best.ba")).alias("balanced_accuracy"),
        F.when(F.col("both"), -F.col("best.neg")).alias("threshold"),
    )


def rowwise_average_precision(df: DataFrame, label: str, score: str, ordinal: str) -> DataFrame:
    """One row: average precision where equal scores keep their input order (ordinal), row by row."""
    rows = df.select(F.col(label).cast("long").alias("y"), F.lit(1).cast("long").alias("one"), F.col(score).alias("s"), F.col(ordinal).alias("o"))
    run = running_totals(rows, [F.desc("s"), "o"], {"cum": "y", "rn": "one"})
    return run.agg((F.sum(F.col("y") * F.col("cum") / F.col("rn")) / F.greatest(F.sum("y"), F.lit(1))).alias("average_precision"))


def _ratio(a: Column, b: Column, least: float = 1.0) -> Column:
    return a / F.greatest(b.cast("double"), F.lit(least))


def confusion_metrics(df: DataFrame, label: str, score: str, threshold: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, tp, fp, tn, fn, rates): decisions score >= threshold; empty denominators count as 1; balanced accuracy is null with one class."""
    y, hit = F.col(label) == 1, F.col(score) >= threshold
    c = df.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(y & hit).alias("tp"), F.count_if(~y & hit).alias("fp"), F.count_if(~y & ~hit).alias("tn"), F.count_if(y & ~hit).alias("fn")
    )
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    tpr, tnr = _ratio(tp, tp + fn), _ratio(tn, tn + fp)
    precision = _ratio(tp, tp + fp)
    return c.select(
        *by, "n", "tp", "fp", "tn", "fn", tpr.alias("recall"), tnr.alias("specificity"), precision.alias("precision"),
        ((tp + tn) / F.greatest(F.col("n"), F.lit(1))).alias("accuracy"),
        (2 * precision * tpr / F.greatest(precision + tpr, F.lit(1e-12))).alias("f1"),
        F.when((tp + fn > 0) & (tn + fp > 0), (tpr + tnr) / 2).alias("balanced_accuracy"),
    )


def multiclass_report(df: DataFrame, label: str, predicted: str, classes: Sequence[str]) -> DataFrame:
    """(class, support, precision, recall, f1, accuracy, macro_f1): every class of the list, seen or not; the macro mean is over all of them."""
    spine = df.sparkSession.createDataFrame([(c,) for c in classes], "class string")
    pairs = df.groupBy(F.col(label).alias("y"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    per = spine.join(pairs, (F.col("class") == F.col("y")) | (F.col("class") == F.col("p")), "left").groupBy("class").agg(
        F.sum(F.when((F.col("y") == F.col("class")) & (F.col("p") == F.col("class")), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("y") == F.col("class"), F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("p") == F.col("class"), F.col("n")).otherwise(0)).alias("guessed"),
    )
    precision, recall = _ratio(F.col("tp"), F.col("guessed")), _ratio(F.col("tp"), F.col("support"))
    f1 = 2 * precision * recall / F.greatest(precision + recall, F.lit(1e-12))
    total = pairs.agg(F.sum("n").alias("all"), F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)).alias("right"))
    rep = per.select("class", "support", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))
    macro = rep.agg((F.sum("f1") / len(classes)).alias("macro_f1"))
    return rep.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(macro)).select("class", "support", "precision", "recall", "f1", _ratio(F.col("right"), F.col("all")).alias("accuracy"), "macro_f1")


def distribution_summary(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean, population deviation, extremes and linearly interpolated quantiles; null and non-finite values are left out.

    Quantiles are exact: values are counted, counts run up over a range
    partition, and the two values around each place are minima over all rows.
    """
    v = F.col(value)
    ok = df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    q = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
    whole = ok.groupBy(*by).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    upto = running_totals(ok.groupBy(*by, v.cast("double").alias("_v")).agg(F.count("*").alias("_c")), ["_v"], {"_upto": "_c"}, by)
    sizes = whole.select(*[F.col(b).alias(f"_b{i}") for i, b in enumerate(by)], F.col("n").alias("_n"))
    same = F.lit(True)
    for i, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"_b{i}"))
    at = lambda place: F.min(F.when(F.col("_upto") > place, F.col("_v")))
    place = lambda p: (F.col("_n") - 1) * p
    between = {n: (at(F.floor(place(p))), at(F.ceil(place(p))), F.max(place(p) - F.floor(place(p)))) for n, p in q.items()}
    found = upto.join(sizes, same).groupBy(*[f"_b{i}" for i in range(len(by))]).agg(*[(lo + (hi - lo) * part).alias(n) for n, (lo, hi, part) in between.items()])
    return whole.join(found, same).select(*by, "n", "mean", "std", "min", "max", *q)


def separation(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, margin): the least score of positives less the greatest of negatives."""
    return df.groupBy(*by).agg((F.min(F.when(F.col(label) == 1, F.col(score))) - F.max(F.when(F.col(label) == 0, F.col(score)))).alias("margin"))


def group_scores(df: DataFrame, key: str, label: str, score: str, threshold: float) -> DataFrame:
    """(key, n, mean, min, max, errors) at a threshold."""
    wrong = (F.col(score) >= threshold) != (F.col(label) == 1)
    return df.groupBy(key).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.min(score).alias("min_score"), F.max(score).alias("max_score"), F.count_if(wrong).alias("errors"))


def metric_deltas(old: DataFrame, new: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(metric, old, new, delta, reproduced) of two (metric, value) tables."""
    o, n = old.select("metric", F.col("value").alias("old")), new.select("metric", F.col("value").alias("new"))
    d = F.col("new") - F.col("old")
    return o.join(n, "metric", "full").select("metric", "old", "new", d.alias("delta"), F.coalesce(F.abs(d) <= tolerance, F.lit(False)).alias("reproduced"))


def two_level_mean(df: DataFrame, cluster: str, source: str, value: str) -> DataFrame:
    """(cluster, mean): sources count equally within their cluster."""
    return df.groupBy(cluster, source).agg(F.avg(value).alias("m")).groupBy(cluster).agg(F.avg("m").alias("mean"))


def clustered_bootstrap(means: DataFrame, cluster: str, value: str, reps: int = 2000, seed: int = 42) -> DataFrame:
    """(n_clusters, low, mid, high): percentile interval of the mean over resampled clusters.

    Draw i of repetition r takes the cluster numbered
    hash(seed, r, i) mod k, so the interval repeats exactly. Draws are generated
    on the executors and meet the clusters by an equi-join on their number; with many clusters
    `weighted_bootstrap` has the same purpose without a row a draw.
    """
    k = means.count()
    if not k:
        return means.sparkSession.createDataFrame([], "n_clusters long, low double, mid double, high double")
    named = numbered(means.select(F.col(cluster).alias("c"), F.col(value).alias("v")), ["c"], "no").select((F.col("no") - 1).alias("no"), "v")
    draws = means.sparkSession.range(reps * k).select((F.col("id") / k).cast("long").alias("rep"), hash_choice(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string")), k).alias("no"))
    per = draws.join(named, "no").groupBy("rep").agg(F.avg("v").alias("m"))
    return per.agg(F.lit(k).cast("long").alias("n_clusters"), F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.5).alias("mid"), F.percentile("m", 0.975).alias("high"))


def hash_choice(key: Column, n: int | Column) -> Column:
    """The first 64 bits of sha256(key) modulo n, as an unsigned number."""
    big = F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return (big % (n if isinstance(n, Column) else F.lit(n))).cast("long")


#: The constants of SplitMix64, and the cumulated chances of a Poisson number of mean 1.
GOLD, MIX = 0x9E3779B97F4A7C15, ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB))
POISSON = [math.fsum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(17)]
#: Clusters weighed at once.
CLUSTERS = 64


def poisson_weights(keys: np.ndarray, reps: int) -> np.ndarray:
    """(keys, reps): a Poisson number of mean 1 for every 64-bit key and repetition, by SplitMix64."""
    with np.errstate(over="ignore"):
        z = keys[:, None] + np.arange(1, reps + 1, dtype=np.uint64) * np.uint64(GOLD)
        for shift, factor in MIX:
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    z ^= z >> np.uint64(31)
    return np.searchsorted(POISSON, (z >> np.uint64(12)) / float(1 << 52), "right")


def weighted_bootstrap(means: DataFrame, cluster: str, value: str, reps: int = 2000, seed: int = 42) -> DataFrame:
    """(n_clusters, low, mid, high): percentile interval of the mean over clusters, each counted a Poisson number of times a repetition.

    The weight of a cluster in a repetition is a keyed hash of both, so the interval repeats exactly, wherever
    rows lie. Every task adds weights and weighted values into two arrays of `reps` numbers and
    sends one row, so the shuffle does not grow with the clusters. A repetition in which no cluster counts has no
    mean; rows without cluster or value do not count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, weights, totals = 0, np.zeros(reps, np.int64), np.zeros(reps)
        for b in batches:
            keys = np.array([int.from_bytes(hashlib.sha256(f"{seed}:{c}".encode()).digest()[:8], "big") for c in b.column(0).to_pylist()], np.uint64)
            v = b.column(1).to_numpy()
            for k in range(0, len(keys), CLUSTERS):
                w = poisson_weights(keys[k : k + CLUSTERS], reps)
                weights += w.sum(0)
                totals += v[k : k + CLUSTERS] @ w
            n += len(keys)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([weights.tolist()], pa.list_(pa.int64())), pa.array([totals.tolist()], pa.list_(pa.float64()))], names=["n", "w", "t"])

    own = means.where(F.col(cluster).isNotNull() & F.col(value).isNotNull()).select(F.col(cluster).cast("string").alias("c"), F.col(value).cast("double").alias("v"))
    parts = materialise(own.mapInArrow(run, "n long, w array<long>, t array<double>"), "sums")
    # one row a task, then one a repetition
    rep = parts.select(F.posexplode(F.arrays_zip("w", "t")).alias("rep", "x")).groupBy("rep").agg(F.try_divide(F.sum("x.t"), F.sum("x.w")).alias("m"))
    ends = rep.agg(*[F.percentile("m", q).alias(c) for c, q in (("low", 0.025), ("mid", 0.5), ("high", 0.975))])
    return parts.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_clusters")).crossJoin(ends)


def crossover_interaction(df: DataFrame, block: str, role: str, value: str) -> DataFrame:
    """(block, interaction): (aa + bb - ab - ba) / 2 of blocks that hold all four roles."""
    p = df.groupBy(block).pivot(role, ["aa", "bb", "ab", "ba"]).agg(F.avg(value))
    return p.where("aa is not null and bb is not null and ab is not null and ba is not null").select(block, ((F.col("aa") + F.col("bb") - F.col("ab") - F.col("ba")) / 2).alias("interaction"))


def best_threshold_window(df: DataFrame, label: str, score: str) -> DataFrame:
    """Every distinct score with the balanced accuracy it gives as a threshold."""
    t = score_table(df, label, score)
    negs = F.col("n_all") - F.col("p_all")
    return t.select("score", (((F.col("p_all") - F.col("pos_below")) / F.greatest(F.col("p_all"), F.lit(1)) + (F.col("n_below") - F.col("pos_below")) / F.greatest(negs, F.lit(1))) / 2).alias("balanced_accuracy"))


def rank_window(by: Sequence[str], *order: Column) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order))


def evaluation(df: DataFrame, label: str, probability: str) -> DataFrame:
    """One row: n, positives, auc, and the mean probability of positives (aligned) and of negatives (shifted)."""
    means = df.agg(F.avg(F.when(F.col(label) == 1, F.col(probability))).alias("mean_positive"), F.avg(F.when(F.col(label) == 0, F.col(probability))).alias("mean_negative"))
    return ranking_metrics(df, label, probability).select("n", "positives", "auc").crossJoin(means)


def coverage(df: DataFrame, dataset: str, available: str, label: str, score: str, threshold: float) -> DataFrame:
    """(dataset, rows, available, accuracy): accuracy over the rows whose features are there; null without any."""
    ok = F.coalesce(F.col(available), F.lit(False))
    right = ((F.col(score) >= threshold) == (F.col(label) == 1)).cast("double")
    return df.groupBy(dataset).agg(F.count("*").alias("rows"), F.count_if(ok).alias("available"), F.avg(F.when(ok, right)).alias("accuracy"))


def with_level(df: DataFrame, dataset: str, level: str, split: str) -> DataFrame:
    """df once a dataset (level null), and once more a level for the dataset `split`: the groups that an evaluation reports."""
    both = F.when(F.col(dataset) == split, F.array(F.lit(None).cast("string"), F.col(level))).otherwise(F.array(F.lit(None).cast("string")))
    return df.withColumn(level, F.explode(both))


def branch_record(df: DataFrame, sample: str, first: str, second: str, limit: float = 80.0) -> DataFrame:
    """(sample, probability, windows): the logistic of the mean log-odds of a sample's windows."""
    odds = F.avg(F.col(first) - F.col(second))
    return df.groupBy(sample).agg((1 / (1 + F.exp(-F.least(F.lit(limit), F.greatest(F.lit(-limit), odds))))).alias("probability"), F.count("*").alias("windows"))
