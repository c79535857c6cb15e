"""Text evidence: pattern tables, event profiles, search queries, votes and benchmark rows."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, functions as F


def pattern_hits(df: DataFrame, key: str, text: str, patterns: dict[str, str]) -> DataFrame:
    """(key, name): the named regular expressions that a text matches. The table of patterns is a literal of stated size."""
    found = F.array_compact(F.array(*[F.when(F.lower(F.coalesce(F.col(text), F.lit(""))).rlike(p), F.lit(n)) for n, p in patterns.items()]))
    return df.select(key, F.explode(found).alias("name"))


def top_terms(df: DataFrame, text: str, order: str, k: int, least: int = 4, stop: Sequence[str] = ()) -> DataFrame:
    """(term, n, rank): the k most frequent lower-case words of `least` letters or more; the first seen wins ties."""
    words = df.select(F.col(order).alias("o"), F.posexplode(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(rf"[a-z]{{{least},}}"), 0)).alias("p", "term"))
    if stop:
        words = words.where(~F.col("term").isin(*stop))
    c = words.groupBy("term").agg(F.count("*").alias("n"), F.min(F.struct("o", "p")).alias("first")).orderBy(F.desc("n"), "first").limit(k)
    return c.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "first"))).drop("first")


def proper_nouns(text: Column, most: int = 2) -> Column:
    """The first runs of capitalised words, in order, distinct."""
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\b([A-Z][a-z]+(?: [A-Z][a-z]+)*)\b"), 1)
    return F.slice(F.array_distinct(runs), 1, most)


def search_queries(text: Column, keywords: Column, platforms: Sequence[str]) -> Column:
    """map of platform to queries from two proper nouns and three keywords; empty parts are left out."""
    names, words = proper_nouns(text, 2), F.slice(keywords, 1, 3)
    base = F.concat_ws(" ", names, words)
    own = lambda p: F.filter(F.array(base, F.concat_ws(" ", names, F.lit(p)), F.concat_ws(" ", words)), lambda q: F.trim(q) != "")
    return F.create_map(*[x for p in platforms for x in (F.lit(p), F.array_distinct(own(p)))])


def votes(df: DataFrame, query: str, label: str, weight: str, damping: float = 0.15) -> DataFrame:
    """(query, label, score, confidence, rank): summed votes; confidence is the share of all votes plus a damping term.

    Votes that are decimals of up to 12 places are summed as such, so equal scores tie (and go by label) and shares that
    lie halfway between two roundings stay there, whatever the order in which tasks add them; sums of other doubles are
    those of doubles.
    """
    w = F.col(weight).cast("double")
    exact = w.try_cast("decimal(28,12)")
    whole = F.bool_and(w.isNull() | F.coalesce(exact.cast("double") == w, F.lit(False)))
    s = df.groupBy(query, label).agg(whole.alias("_whole"), F.when(whole, F.try_sum(exact)).alias("_exact"), F.sum(w).alias("_plain"))
    s = s.withColumn("score", F.coalesce(F.col("_exact").cast("double"), "_plain"))
    own = Window.partitionBy(query)
    total = F.when(F.bool_and("_whole").over(own), F.try_sum("_exact").over(own))
    # whole numbers of the last place, so that the one rounding is the quotient's
    units = lambda d: F.try_multiply(d, F.lit(Decimal(10**12))).cast("double")
    part = lambda n, d: F.when(d == 0, n * F.lit(float("inf"))).otherwise(n / d)
    share = part(units(F.col("_exact")), units(total) + float(Decimal(str(damping)) * 10**12))
    s = s.withColumn("confidence", F.coalesce(share, part(F.col("score"), F.sum("score").over(own) + damping)))
    return s.withColumn("rank", F.row_number().over(own.orderBy(F.desc("score"), label))).drop("_whole", "_exact", "_plain")


def benchmark_rows(cases: DataFrame, truth: str, found: str, hours: str, robust: str, k: int = 10) -> DataFrame:
    """One row: cases, recall within the first k, top-1 share, mean absolute error in hours, share of robust cases."""
    hit = F.exists(F.slice(F.col(found), 1, k), lambda x: x == F.col(truth))
    top = F.coalesce(F.get(F.col(found), F.lit(0)) == F.col(truth), F.lit(False))
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    return cases.agg(F.count("*").alias("cases"), share(hit).alias("recall"), share(top).alias("top1"), F.avg(F.abs(F.col(hours))).alias("mae_hours"), share(F.col(robust)).alias("robustness"))


def ledger_search(entries: DataFrame, category: str | None, needle: str | None, columns: Sequence[str]) -> DataFrame:
    """Entries of a category (all for None) of which any column contains the needle, whatever its case."""
    if category is not None:
        entries = entries.where(F.col("category") == category)
    if needle:
        any_ = F.lit(False)
        for c in columns:
            any_ = any_ | F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(needle.lower()))
        entries = entries.where(any_)
    return entries


def batch_status(steps: DataFrame, sample: str, required: Sequence[str]) -> DataFrame:
    """(sample, done, missing, status): cached if every required branch was, success if all are there, else failed with the branches that are not."""
    have = steps.groupBy(sample).agg(F.collect_set(F.when(F.col("state").isin("success", "cached"), F.col("branch"))).alias("done"), F.bool_and(F.col("state") == "cached").alias("c"))
    need = F.array(*map(F.lit, required))
    missing = F.array_except(need, F.col("done"))
    return have.select(sample, F.sort_array("done").alias("done"), missing.alias("missing"), F.when(F.size(missing) > 0, "failed").when(F.col("c"), "cached").otherwise("success").alias("status"))
