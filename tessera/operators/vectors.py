"""Vector expressions and rankings over array columns, in double precision on the JVM."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.operators import pairs
from tessera.session import materialise


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine cut to 0..1; a zero norm counts as 1, vectors of different length as 0.5."""
    one = lambda n: F.when(n == 0, 1.0).otherwise(n)
    return F.when(F.size(a) != F.size(b), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / (one(norm(a)) * one(norm(b))))))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def hamming256(a: Column, b: Column) -> Column:
    """Differing bits of two 64-digit hex hashes; 999 where one is missing or malformed."""
    ok = F.coalesce(a.rlike("^[0-9a-fA-F]{64}$") & b.rlike("^[0-9a-fA-F]{64}$"), F.lit(False))
    bits = None
    for k in range(8):
        word = lambda c: F.conv(F.substring(c, 1 + 8 * k, 8), 16, 10).cast("long")  # noqa: E731, B023
        d = F.bit_count(word(a).bitwiseXOR(word(b)))
        bits = d if bits is None else bits + d
    return F.when(ok, bits).otherwise(999).cast("int")


def calibrate(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / max(1e-5, high - low)))


def column_moments(df: DataFrame, vector: str, floor: float = 1e-4, by: Sequence[str] = ()) -> DataFrame:
    """(by, pos, mean, std): population deviation, not below floor."""
    long_ = df.select(*by, F.posexplode(doubles(F.col(vector))).alias("pos", "x"))
    return long_.groupBy(*by, "pos").agg(F.avg("x").alias("mean"), F.greatest(F.stddev_pop("x"), F.lit(floor)).alias("std"))


def column_moments_by_sums(df: DataFrame, vector: str, floor: float = 1e-8) -> DataFrame:
    """(pos, mean, std) from sums and sums of squares; the variance is not below floor."""
    long_ = df.select(F.posexplode(doubles(F.col(vector))).alias("pos", "x"))
    s = long_.groupBy("pos").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("x").alias("n"))
    mean = F.col("s") / F.col("n")
    return s.select("pos", mean.alias("mean"), F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(floor))).alias("std"))


def centroids(df: DataFrame, vector: str, label: str) -> DataFrame:
    """(label, centroid): the mean vector of every label."""
    per = df.select(label, F.posexplode(doubles(F.col(vector))).alias("pos", "x")).groupBy(label, "pos").agg(F.avg("x").alias("m"))
    return per.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda p: p["m"]).alias("centroid"))


def standardised_centroids(df: DataFrame, vector: str, label: str) -> DataFrame:
    """Centroids of z-scored vectors; deviations under 1e-6 count as 1."""
    mom = column_moments(df, vector, 0.0).withColumn("std", F.when(F.col("std") < 1e-6, 1.0).otherwise(F.col("std")))
    long_ = df.select(label, F.posexplode(doubles(F.col(vector))).alias("pos", "x")).join(mom, "pos")
    per = long_.groupBy(label, "pos").agg(F.avg((F.col("x") - F.col("mean")) / F.col("std")).alias("m"))
    return per.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda p: p["m"]).alias("centroid"))


def centroid_ranking(queries: DataFrame, key: str, vector: str, cents: DataFrame, label: str, limit: int = 8) -> DataFrame:
    """(key, label, score, share, rank): score 1 / (1 + distance), share of the scores of all labels, the best `limit`."""
    near = queries.select(key, vector).crossJoin(cents.select(F.col(label).alias("label"), "centroid"))
    s = near.select(key, "label", (1 / (1 + l2(F.col(vector), F.col("centroid")))).alias("score"))
    total = F.sum("score").over(Window.partitionBy(key))
    s = s.withColumn("share", F.col("score") / F.when(total == 0, 1.0).otherwise(total)).withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "label")))
    return s.where(F.col("rank") <= limit)


def nearest(queries: DataFrame, store: DataFrame, key: str, vector: str, k: int = 5) -> DataFrame:
    """(query, key, similarity, rank): top k by cosine rounded to 3 places, ties by key; a query set of any size against all rows, in blocks."""
    return pairs.best(pairs.top_cosine(queries, store, key, vector, k), "query", key, "similarity", k)


def diverse_top(df: DataFrame, query: str, group: str, score: str, tie: str, k: int) -> DataFrame:
    """The best row of every group first, then the best of the rest, k in all; with more groups than k the cut is by score. Adds place."""
    first = F.row_number().over(Window.partitionBy(query, group).orderBy(F.desc(score), tie))
    df = df.withColumn("_first", (first > 1).cast("int"))
    chosen = F.row_number().over(Window.partitionBy(query).orderBy("_first", F.desc(score), tie))
    out = df.withColumn("_c", chosen).where(F.col("_c") <= k)
    return out.withColumn("place", F.row_number().over(Window.partitionBy(query).orderBy(F.desc(score), tie))).drop("_first", "_c")


def min_shift_share(score: Column, over) -> Column:
    """(s - min) over the sum of those; equal shares if all are the same."""
    low = F.min(score).over(over)
    total = F.sum(score).over(over) - low * F.count(score).over(over)
    return F.when(total <= 1e-9, 1 / F.count(score).over(over)).otherwise((score - low) / total)


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation of two arrays of one length; 0 where one has no spread."""
    n = F.size(a).cast("double")
    total = lambda v: F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x)
    cov = dot(a, b) / n - total(a) / n * total(b) / n
    var = lambda v: F.greatest(dot(v, v) / n - total(v) / n * total(v) / n, F.lit(0.0))
    return F.coalesce(F.try_divide(cov, F.when(var(a) * var(b) > 0, F.sqrt(var(a) * var(b)))), F.lit(0.0))


def token_overlap(a: Column, b: Column) -> Column:
    """Share of the first text's distinct words found in the second."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[ \t\n\r\f]+"), lambda w: w != ""))
    return F.size(F.array_intersect(words(a), words(b))) / F.greatest(F.size(words(a)), F.lit(1))


#: Documents and characters of a case that one task counts together, on average.
TOGETHER, CHARACTERS = 2048, 16 << 20


def _word_counts(docs: pa.Table) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block (k, ref, words): its distinct documents (k, ref; rows of one key are one) and words, and place of document, place of word and count of every pair."""
    own = pa.chunked_array([pa.StructArray.from_arrays([docs.column(c).combine_chunks() for c in ("k", "ref")], ["k", "ref"])]).combine_chunks()
    places = {}
    at = np.array([places.setdefault((r["ref"], r["k"]), len(places)) for r in own.to_pylist()], np.int64)
    lists = docs.column("words").combine_chunks()
    words = lists.flatten().dictionary_encode()
    row = np.repeat(at, np.diff(lists.offsets.to_numpy()))
    n = max(1, len(words.dictionary))
    pair, count = np.unique(row * n + words.indices.to_numpy(), return_counts=True)
    first = np.unique(at, return_index=True)[1]
    return own.take(pa.array(first)), words.dictionary, pair // n, pair % n, count


def text_fallback(candidates: DataFrame, case: str, key: str, text: str, references: DataFrame, stop: Sequence[str] = ()) -> DataFrame:
    """(case, key, score): clip(0.85 s + 0.10, 0.15, 0.95) to 3 places, s the tf-idf cosine of a candidate with its case's reference text.

    Document frequencies are those of a case's reference and candidates: idf = ln((1 + n) / (1 + df)) + 1. stop: words
    left out, as a frozen list that the caller keeps. A text without a word in common scores 0.15. references: case, text,
    one row a case; candidates of a case without one have no row.

    Texts are dealt into blocks of a case, whose size is bounded by the number of blocks. A block asks for each of its
    words once, the answers (in how many documents, how often in the reference) come back to it, and it weighs its own
    texts: what is shuffled are the texts and each block's distinct words, not each text's.
    """
    own = candidates.select(F.col(case).alias("c"), F.col(key).alias("k"), F.lit(False).alias("ref"), F.col(text).alias("t"))
    ref = references.select(F.col(case).alias("c"), F.lit(None).cast(candidates.schema[key].dataType).alias("k"), F.lit(True).alias("ref"), F.col(text).alias("t"))
    # written, so that the optimiser knows the size of what is usually a short list and does not shuffle the texts for it
    own = own.join(materialise(ref.select("c").distinct(), "cases"), "c", "left_semi")
    sizes = own.groupBy("c").agg(F.greatest(F.count("*") / TOGETHER, F.sum(F.length("t")) / CHARACTERS).alias("n"))
    blocks = max(1, int(sizes.agg(F.ceil(F.max("n"))).first()[0] or 1))
    # the reference has a block of its own
    block = F.when(F.col("ref"), -1).otherwise(F.pmod(F.xxhash64("k"), F.lit(blocks))).cast("int").alias("b")
    every = F.regexp_extract_all(F.lower(F.coalesce("t", F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}"), 0)
    words = F.filter(every, lambda w: ~w.isin(*stop)) if stop else every
    docs = own.unionByName(ref).select("c", block, "k", "ref", "t").repartition("c", "b").select("c", "b", "k", "ref", words.alias("words"))
    ckind, kkind = docs.schema["c"].dataType.simpleString(), docs.schema["k"].dataType.simpleString()

    def ask(of: tuple, d: pa.Table) -> pa.Table:
        """(c, b, w, n, times): the documents of the block with a word, and how often the reference has it; the empty word counts documents."""
        _, names, _, word, count = _word_counts(d)
        n, times = np.bincount(word, minlength=len(names)), np.bincount(word, np.where(of[1].as_py() < 0, count, 0), len(names)).astype(np.int64)
        names = pa.concat_arrays([names, pa.array([""], names.type)])
        c, b = (pa.repeat(x, len(names)) for x in of)
        return pa.table({"c": c, "b": b, "w": names, "n": pa.array([*n, d.num_rows], pa.int64()), "times": pa.array([*times, 0], pa.int64())})

    def weigh(of: tuple, d: pa.Table, told: pa.Table) -> pa.Table:
        """(c, k, ref, xy, nx) of the block's documents; a word without an answer is in one of them and nowhere else."""
        texts, names, row, word, count = _word_counts(d)
        at = pc.index_in(names, value_set=told.column("w")).fill_null(-1).to_numpy(zero_copy_only=False)
        df, times = (np.append(told.column(c).to_numpy(), none) for c, none in (("df", 1), ("times", 0)))
        size = pc.index(told.column("w"), "").as_py()
        idf = np.log((1 + df[size]) / (1 + df[at])) + 1
        x, y = count * idf[word], (times[at] * idf)[word]
        total = lambda v: pa.array(np.bincount(row, v, len(texts)), pa.float64())
        return pa.table({"c": pa.repeat(of[0], len(texts)), "k": texts.field("k"), "ref": texts.field("ref"), "xy": total(x * y), "nx": pa.array(np.sqrt(np.bincount(row, x * x, len(texts))))})

    asked = docs.groupBy("c", "b").applyInArrow(ask, f"c {ckind}, b int, w string, n long, times long")
    whole = Window.partitionBy("c", "w")
    told = asked.select("c", "b", "w", F.sum("n").over(whole).alias("df"), F.max("times").over(whole).alias("times")).where("df > 1")
    found = docs.groupBy("c", "b").cogroup(told.groupBy("c", "b")).applyInArrow(weigh, f"c {ckind}, k {kkind}, ref boolean, xy double, nx double")
    found = materialise(found, "weighed")
    norm = found.where("ref").select("c", F.col("nx").alias("ny"))
    s = found.where(~F.col("ref")).join(norm, "c").select("c", "k", F.try_divide("xy", F.col("nx") * F.col("ny")).alias("s"))
    rows = own.select("c", "k").join(s, ["c", "k"], "left")
    return rows.select(F.col("c").alias(case), F.col("k").alias(key), F.round(F.least(F.lit(0.95), F.greatest(F.lit(0.15), F.coalesce("s", F.lit(0.0)) * 0.85 + 0.10)), 3).alias("score"))


def tfidf_cosine(docs: DataFrame, key: str, text: str, queries: DataFrame, stop: Sequence[str] = ()) -> DataFrame:
    """(query, key, similarity): smoothed tf-idf with unit length, joined on terms; pairs without a common term are absent.

    The document frequencies are those of docs; idf = ln((1 + n) / (1 + df)) + 1.
    """
    def terms(d: DataFrame, k: str) -> DataFrame:
        t = d.select(F.col(k).alias("k"), F.explode(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"[a-z0-9_]{2,}"), 0)).alias("t"))
        return (t.where(~F.col("t").isin(*stop)) if stop else t).groupBy("k", "t").agg(F.count("*").alias("tf"))

    own = terms(docs, key)
    n = docs.count()
    idf = own.groupBy("t").agg((F.log((1 + F.lit(n)) / (1 + F.count("*"))) + 1).alias("idf"))

    def unit(d: DataFrame) -> DataFrame:
        w = d.join(idf, "t").select("k", "t", (F.col("tf") * F.col("idf")).alias("w"))
        size = w.groupBy("k").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("s"))
        return w.join(size, "k").select("k", "t", (F.col("w") / F.col("s")).alias("w"))

    q = unit(terms(queries, key)).select(F.col("k").alias("query"), "t", F.col("w").alias("v"))
    return unit(own).join(q, "t").groupBy("query", F.col("k").alias(key)).agg(F.sum(F.col("w") * F.col("v")).alias("similarity"))
