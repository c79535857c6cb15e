"""Leakage-safe splits, samples and audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.operators.running import numbered
from tessera.session import materialise


def assign_groups(df: DataFrame, key: Sequence[str], seed: int, roles: Sequence[str] = ("train", "dev", "holdout"), ends: Sequence[float] = (0.6, 0.8)) -> DataFrame:
    """(key, role): whole groups by the order of sha256(seed:key); bounds round half to even, every role gets a group.

    Groups are numbered by a distributed running total, not in one task.
    """
    groups = df.select(*key).distinct().withColumn("_h", F.sha2(F.concat_ws(":", F.lit(str(seed)), *key), 256))
    n = groups.count()
    if n < len(roles):
        raise ValueError(f"{n} groups do not fill {len(roles)} roles")
    first = max(1, round(n * ends[0]))
    second = min(max(first + 1, round(n * ends[1])), n - 1)
    no = F.col("_no") - 1
    role = F.when(no < first, roles[0]).when(no < second, roles[1]).otherwise(roles[2])
    return numbered(groups, ["_h"], "_no").select(*key, role.alias("role"))


def dev_fraction(df: DataFrame, key: str, label: str, seed: int, fraction: float = 0.2) -> DataFrame:
    """df with role: dev for the first round(n * fraction) groups, one at least, by the order of sha256(seed:key), train for the others.

    A null or empty key is an error, and so is a label that one of the roles lacks. Groups are numbered by
    a distributed running total; what is checked is one row a label.
    """
    if not 0 < fraction < 0.5:
        raise ValueError("fraction lies between 0 and a half")
    groups = materialise(df.select(F.col(key).alias("_key")).distinct().withColumn("_h", F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("_key").cast("string")), 256)), "groups")
    if groups.where(F.col("_key").isNull() | (F.col("_key").cast("string") == "")).limit(1).count():
        raise ValueError(f"rows without {key}")
    dev = max(1, round(groups.count() * fraction))
    roles = materialise(numbered(groups, ["_h"], "_no").select("_key", F.when(F.col("_no") <= dev, "dev").otherwise("train").alias("role")), "roles")
    out = df.join(roles, F.col(key) == F.col("_key")).drop("_key")
    seen = out.groupBy(label).agg(F.count_distinct("role").alias("n"))
    lacking = [r[0] for r in seen.where("n < 2").select(label).limit(20).collect()]
    if lacking:
        raise ValueError(f"labels of one role alone: {lacking}")
    return out


def validate_assignment(df: DataFrame, sample: str, group: Sequence[str], role: str, roles: Sequence[str]) -> DataFrame:
    """One row of counts that must all be 0: missing_roles, duplicate_samples, crossing_groups."""
    seen = df.agg(F.count_distinct(F.when(F.col(role).isin(*roles), F.col(role))).alias("s"))
    dup = df.groupBy(sample).count().where("count > 1").agg(F.count("*").alias("duplicate_samples"))
    cross = df.groupBy(*group).agg(F.count_distinct(role).alias("r")).where("r > 1").agg(F.count("*").alias("crossing_groups"))
    return seen.crossJoin(dup).crossJoin(cross).select((F.lit(len(roles)) - F.col("s")).alias("missing_roles"), "duplicate_samples", "crossing_groups")


def stratified_sample(df: DataFrame, stratum: str, key: str, n: int, seed: int, strict: bool = False) -> DataFrame:
    """Up to n rows of every stratum, in the order of sha256(seed:key); with strict, a stratum of fewer rows is an error."""
    if strict and (short := df.groupBy(stratum).count().where(F.col("count") < n).limit(3).collect()):
        raise ValueError(f"fewer than {n} rows of {[r[0] for r in short]}")
    h = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256)
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(stratum).orderBy(h, key))).where(F.col("_r") <= n).drop("_r")


def systematic_sample(df: DataFrame, order: Sequence[str], step: int, most: int) -> DataFrame:
    """Every step-th row from the first, `most` in all."""
    return numbered(df, order, "_no").where((F.col("_no") - 1) % step == 0).where(F.col("_no") <= step * most).drop("_no")


def overlap_examples(left: DataFrame, right: DataFrame, key: str, sample: str, order: str, limit: int | None = None) -> DataFrame:
    """(key, left_sample, right_sample): one row a shared key, with the first example of each side; all of them, or the first `limit` by key."""
    of = lambda d, n: d.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(sample, order).alias(n))
    both = of(left, "left_sample").join(of(right, "right_sample"), key)
    return both if limit is None else both.orderBy(key).limit(limit)


def leakage_kinds(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(kind, shared): distinct values that both sides have, column by column.

    Both sides are aggregated as one table, so that a task passes on one row a value: an intersection would
    shuffle every row of a frequent value into one task.
    """
    out = None
    for c in columns:
        side = lambda d, bit: d.select(F.col(c).cast("string").alias("v"), F.lit(bit).alias("side")).where("v is not null")  # noqa: E731, B023
        seen = side(left, 1).unionByName(side(right, 2)).groupBy("v").agg(F.bit_or("side").alias("sides"))
        one = seen.where("sides = 3").agg(F.lit(c).alias("kind"), F.count("*").alias("shared"))
        out = one if out is None else out.unionByName(one)
    return out


def assign_components(stats: DataFrame, component: str, measures: Sequence[str], held: int = 3, goals: Sequence[float] = (0.7, 0.1, 0.1, 0.1), most: int = 64) -> DataFrame:
    """The choice of `held` = 3 components for the small splits that comes nearest the goal shares in all measures.

    stats: a row a component with its measures; at most `most` rows, which is
    checked, as all ordered choices are compared. Returns (dev, test, holdout,
    score); the first in component order wins ties.
    """
    if (n := stats.limit(most + 1).count()) > most:
        raise ValueError(f"more than {most} components: all ordered choices of {held} of them would be compared")
    if n < held:
        raise ValueError(f"{n} components do not fill {held} splits")
    total = stats.agg(*[F.sum(m).alias(f"_t_{m}") for m in measures])
    one = stats.select(component, *measures)
    pick = lambda n: one.select(F.col(component).alias(n), *[F.col(m).alias(f"{n}_{m}") for m in measures])
    names = ("dev", "test", "holdout")
    combos = pick(names[0]).crossJoin(pick(names[1])).crossJoin(pick(names[2])).where("dev <> test and dev <> holdout and test <> holdout").crossJoin(total)
    score = F.lit(0.0)
    for m in measures:
        t = F.col(f"_t_{m}").cast("double")
        parts = [F.col(f"{n}_{m}") for n in names]
        shares = [(t - parts[0] - parts[1] - parts[2]) / t, *[p / t for p in parts]]
        for s, g in zip(shares, goals):
            score = score + (s - g) * (s - g)
    return combos.select(*names, score.alias("score")).orderBy(F.round("score", 12), *names).limit(1)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, class_weight, sampler_weight): n_all / (classes * n) and 1 / n."""
    c = df.groupBy(label).agg(F.count("*").alias("n"))
    t = c.agg(F.sum("n").alias("a"), F.count("*").alias("k"))
    return c.crossJoin(F.broadcast(t)).select(label, "n", (F.col("a") / (F.col("k") * F.col("n"))).alias("class_weight"), (1 / F.col("n")).alias("sampler_weight"))


def grouping_summary(df: DataFrame, sets: Sequence[Sequence[str]]) -> DataFrame:
    """Counts over hand-picked grouping sets; columns outside a set are null."""
    cols = list(dict.fromkeys(c for s in sets for c in s))
    return df.groupingSets([list(map(F.col, s)) for s in sets], *map(F.col, cols)).agg(F.count("*").alias("n"))


def mode_first_seen(df: DataFrame, by: str, value: str, order: str) -> DataFrame:
    """(by, mode): the most frequent non-empty value, the first seen among equals."""
    c = df.where(F.col(value).isNotNull() & (F.col(value).cast("string") != "")).groupBy(by, value).agg(F.count("*").alias("n"), F.min(order).alias("o"))
    return c.groupBy(by).agg(F.max_by(value, F.struct("n", (-F.col("o")).alias("o"))).alias("mode"))


def crosstab_percent(df: DataFrame, row: str, col: str, values: Sequence[str]) -> DataFrame:
    """(row, one share in percent a value)."""
    p = df.groupBy(row).pivot(col, list(values)).count().na.fill(0)
    total = sum((F.col(v) for v in values), F.lit(0))
    return p.select(row, *[(100 * F.col(v) / total).alias(v) for v in values])


def require(df: DataFrame, columns: Sequence[str], unique: str | None = None) -> DataFrame:
    """df, or an error for missing columns or, if asked for, a repeated key."""
    if missing := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"missing columns: {missing}")
    if unique and (twice := df.groupBy(unique).count().where("count > 1").limit(3).collect()):
        raise ValueError(f"repeated {unique}: {[r[0] for r in twice]}")
    return df


def first_problem(checks: Sequence[tuple[Column, str]]) -> Column:
    return F.coalesce(*[F.when(c, F.lit(n)) for c, n in checks])


def uniform_sample(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """k rows drawn evenly: those that come first by sha256(seed:key)."""
    h = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256)
    return df.withColumn("_h", h).orderBy("_h", key).limit(k).drop("_h")


def with_reason(samples: DataFrame, results: DataFrame, key: str, reason: str) -> DataFrame:
    """Every sample with its results, and the reason where it has none."""
    found = results.withColumn("_found", F.lit(True))
    return samples.join(found, key, "left").withColumn("reason", F.when(F.col("_found").isNull(), reason)).drop("_found")


def array_problem(widths: dict[str, int]) -> Column:
    """What is wrong with array columns: a missing one, another width, or a number that is not finite; null if nothing is."""
    checks = []
    for name, width in widths.items():
        c = F.col(name)
        odd = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        checks += [(c.isNull(), f"missing_key:{name}"), (F.size(c) != width, f"shape_mismatch:{name}"), (odd, f"non_finite:{name}")]
    return first_problem(checks)
