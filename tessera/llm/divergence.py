"""Quality rules by distribution divergence, in DataFrame functions only.

A text's histogram over character classes and over its language's most common
words is compared with the language's own reference histogram by
Jensen-Shannon distance (base 2, 0 to 1). References are counted over all rows
of a table. Texts below the minimum lengths are not judged by divergence: a
short text's histogram says little.

Common words cover only a part of a language's words, so a text without any of
them is at a bounded distance, word_none, which can be far below
max_word_distance. Therefore a text is also too far at a stated part of word_none
and what chance adds at its length. Rows without a lang are spared this: a mixture
of languages has no words that each text should hold.

Cases: a null text counts as having no words and fails the base rule; rows
with a null lang (all, where there is no such column) are a language of their own, "und"; an empty table gives no rows;
rows are never joined by doc_id, so repeated or null doc_ids do no harm; a very
long text is one row whose words and windows are arrays of one task; extra
columns stay out, also ones named like the output's.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.session import materialise

WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "[#*$%&|<>]"
#: Character classes by pattern; symbols and white space are counted with the base columns, what is left (mostly small letters) is the last class.
CLASSES = {"upper": r"[A-Z\u00C0-\u00D6\u00D8-\u00DE]", "digit": r"[0-9]", "punct": r"[.,;:!?'\"()\-]"}


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: inside a lambda a plain column expression would be computed again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """The words of a text, by one split; white space at the ends makes no word."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def repeated_words(words: Column, n_words: Column, k: int = 5) -> Column:
    """Words inside k-word windows that occur twice or more in the text, the first occurrence included.

    Windows are compared by a 64-bit hash inside one text. Most texts repeat no
    window; a hash set tells that, and only the others sort their windows.
    """
    hashes = F.when(
        n_words >= k,
        F.transform(F.sequence(F.lit(1), n_words.cast("int") - (k - 1)), lambda i: F.xxhash64(*[F.get(words, i + (j - 1)) for j in range(k)])),
    ).otherwise(F.array().cast("array<bigint>"))

    def spread(at: Column, n: Column) -> Column:
        ends = F.transform(at, lambda a, i: F.least(F.lit(k), F.coalesce(F.get(at, i + 1), n + k) - a))
        return F.aggregate(ends, F.lit(0), lambda s, x: s + x)

    def hit_places(placed: Column) -> Column:
        hits = F.transform(placed, lambda p, i: F.when((F.get(placed, i - 1)["h"] == p["h"]) | (F.get(placed, i + 1)["h"] == p["h"]), p["at"]))
        return F.array_sort(F.filter(hits, lambda at: at.isNotNull()))

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
        return let(let(placed, hit_places), lambda at: spread(at, F.size(h)))

    def judged(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))

    return let(hashes, judged).cast("long")


def base_columns(docs: DataFrame) -> DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed beside doc_id, lang and text."""
    text = F.coalesce("text", F.lit(""))
    df = docs.select("doc_id", _lang_of(docs).alias("lang"), text.alias("text")).withColumn("words", words_of(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    df = df.select(
        "doc_id", "lang", "text", "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    df = df.withColumn("n_repeat_words", repeated_words(F.col("words"), F.col("n_words")))
    return df.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def _lang_of(docs: DataFrame) -> Column:
    return F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")


def _lang(lang: Column) -> Column:
    return F.coalesce(lang.cast("string"), F.lit("und"))


def few_rows(df: DataFrame, most: int = 256) -> DataFrame:
    """df marked for broadcast if it has `most` rows or fewer, else written, for a shuffled join in which adaptive execution splits large languages."""
    df = materialise(df, "few")
    rows = df.limit(most + 1).collect()
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)) if len(rows) <= most else df


def common_words(docs: DataFrame, top_words: int = 16) -> DataFrame:
    """Per language its top words, their shares (the last is that of all other words) and word_none, the distance of a text without any of them.

    Words are lower-cased and counted over all rows before the shuffle, one row a word and
    language. Of those each task passes on its first top_words (a limit that Spark puts before
    the shuffle of a window whose rows are cut by rank), so ranking needs no memory that grows with a
    vocabulary.
    """
    base = docs.select(_lang(_lang_of(docs)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    counts = base.select("lang", F.explode(words_of(F.lower("text"))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    counts = materialise(counts, "words")
    sums = counts.groupBy("lang").agg(F.sum("n").alias("all_words"))
    last = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    top = counts.withColumn("r", F.row_number().over(last)).where(F.col("r") <= top_words)
    return (
        top.join(sums, "lang").groupBy("lang")
        .agg(F.array_sort(F.collect_list(F.struct("r", "word", (F.col("n") / F.col("all_words")).alias("share")))).alias("top"))
        .select("lang", F.col("top.word").alias("top_words"), with_rest(F.col("top.share")).alias("word_ref"))
        .withColumn("word_none", js_distance(with_rest(F.transform("top_words", lambda w: F.lit(0.0))), F.col("word_ref")))
    )


def text_counts(docs: DataFrame, words: DataFrame) -> DataFrame:
    """Per row: the base columns, n_chars, class_counts and the shares of its language's top words (word_hist) beside word_ref."""
    df = base_columns(docs).withColumn("lang", _lang(F.col("lang"))).join(few_rows(words), "lang", "left")
    patterns = [F.regexp_count("text", F.lit(p)) for p in CLASSES.values()]
    n_chars = F.length("text").cast("long")
    # one scan finds all top words of the language between white space; a lambda over all words takes twice as long
    inside = F.array_join(F.transform("top_words", lambda w: F.concat(F.lit("\\Q"), F.replace(w, F.lit("\\E"), F.lit("")), F.lit("\\E"))), "|")
    pattern = F.concat(F.lit(r"(?<![^\x20\x09-\x0D])(?:"), inside, F.lit(r")(?![^\x20\x09-\x0D])"))
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    found = let(F.regexp_extract_all(F.lower("text"), pattern, F.lit(0)), lambda m: F.transform("top_words", lambda w: F.size(m) - F.size(F.array_remove(m, w))))
    return df.select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", n_chars.alias("n_chars"),
        F.array(*[p.cast("double") for p in patterns], F.col("n_symbols").cast("double"), (n_chars - F.col("word_chars")).cast("double")).alias("class_counts"),
        with_rest(F.transform(found, lambda x: x / n)).alias("word_hist"), "word_ref", "word_none",
    )


def class_references(counts: DataFrame) -> DataFrame:
    """(lang, class_ref): shares of the character classes over all rows of a language; the last is that of all other characters."""
    k = len(CLASSES) + 2
    sums = counts.groupBy("lang").agg(*[F.sum(F.get("class_counts", F.lit(i))).alias(f"c{i}") for i in range(k)], F.sum("n_chars").alias("all"))
    return sums.select("lang", with_rest(F.array(*[F.col(f"c{i}") / F.greatest(F.col("all"), F.lit(1)) for i in range(k)])).alias("class_ref"))


def with_rest(shares: Column) -> Column:
    """The shares and what they leave of 1."""
    return let(shares, lambda x: F.concat(x, F.array(F.greatest(F.lit(0.0), 1 - F.aggregate(x, F.lit(0.0), lambda s, y: s + y)))))


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence in bits of two arrays of shares."""

    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))

    terms = F.zip_with(p, q, lambda a, b: part(a, b) + part(b, a))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2))


def distribution_rules(
    docs: DataFrame, top_words: int = 16, max_class_distance: float = 0.32, max_word_distance: float = 0.42, min_chars: int = 200, min_words: int = 50, max_missing: float = 0.6
) -> DataFrame:
    """doc_id, the base counts, base_failed, class_distance, word_distance, kept of every row of docs (doc_id, text, lang).

    kept is false where base_failed, or where a text of at least min_chars
    characters is further than max_class_distance from its language's character
    classes, or one of at least min_words words further than max_word_distance
    from its common words, or further than max_missing of word_none, with chance
    added in squares (a histogram of k + 1 shares over n words drawn from the
    reference is at a mean squared distance of about k / (8 n ln 2)). So a text
    that misses the common words goes if its length lets about 8 of them be
    expected, whatever they cover. Distances are null below those lengths. Texts are
    read twice, for the common words and for all counts, and never shuffled.
    """
    counts = materialise(text_counts(docs, common_words(docs, top_words)), "counts")
    df = counts.join(few_rows(class_references(counts)), "lang", "left")
    shares = with_rest(F.transform("class_counts", lambda c: c / F.greatest(F.col("n_chars"), F.lit(1))))
    df = df.withColumn("class_distance", F.when((F.col("n_chars") >= min_chars) & F.col("class_ref").isNotNull(), js_distance(shares, F.col("class_ref"))))
    df = df.withColumn("word_distance", F.when((F.col("n_words") >= min_words) & F.col("word_ref").isNotNull(), js_distance(F.col("word_hist"), F.col("word_ref"))))
    chance = (F.size("word_ref") - 1) / (8 * math.log(2) * F.col("n_words"))
    missing = (F.col("lang") != "und") & (F.col("word_distance") > F.sqrt((max_missing * F.col("word_none")) ** 2 + chance))
    far = (F.coalesce("class_distance", F.lit(0.0)) > max_class_distance) | (F.coalesce("word_distance", F.lit(0.0)) > max_word_distance) | F.coalesce(missing, F.lit(False))
    return df.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "class_distance", "word_distance", (~F.col("base_failed") & ~far).alias("kept"),
    )
