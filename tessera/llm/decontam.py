"""Benchmark decontamination by MinHash containment search, in DataFrame functions only.

Items are short and documents long, so their Jaccard similarity says nothing;
what counts is the share of an item's word shingles inside a document. Items
are partitioned by size (powers of two). Every item of a partition keeps its
smallest shingle hashes, as many as its partition's largest size u needs:
u - ceil(t u) + 1. A document that contains the share t of an item misses fewer
of its shingles than that, so it holds one of these minima at least: the search
loses nothing. Candidates are verified by counting all shingles of the item in
the text.

A text is judged once, whatever its number of copies: the plan is keyed by a
128-bit hash of the text, not by doc_id. Item tables are joined without a hint;
the optimiser broadcasts them only below its own size limit.

Cases: null texts and items hold nothing; a text or item of fewer words than a
shingle has its whole word sequence as only shingle; null and repeated doc_ids
are judged row by row through their texts; a very long text is one array of
hashes, exploded row by row; empty tables give no rows; extra columns, also ones
named like the output's or like the keys here, stay with their rows in
`decontaminate` and out of `contamination`.

Beyond the optimiser's broadcast limit for the item tables (10 MB of minima, about
600,000 of them) every shingle of the corpus is shuffled by its hash, about five
times the input; the results are the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.llm.divergence import let, words_of
from tessera.session import materialise


def shingle_hashes(text: Column, k: int) -> Column:
    """Hashes of the k-word shingles of a text in lower case, repeated ones repeated."""

    def of(words: Column) -> Column:
        n = F.size(words)
        return (
            F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1))), lambda i: F.xxhash64(*[F.get(words, i + (j - 1)) for j in range(k)])))
            .when(n > 0, F.array(F.xxhash64(words)))
            .otherwise(F.array().cast("array<bigint>"))
        )

    return let(words_of(F.lower(text)), of)


def text_key(text: Column) -> list[Column]:
    """Two 64-bit hashes of the text; null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(t).alias("k1"), F.xxhash64(F.lit(1), t).alias("k2")]


def item_shingles(items: DataFrame, k: int) -> DataFrame:
    """(item_id, h, n): distinct shingles of every item and how many it has. Rows of one item_id count as one item."""
    sets = items.select("item_id", F.explode(shingle_hashes(F.col("text"), k)).alias("h")).distinct()
    return sets.withColumn("n", F.count("*").over(Window.partitionBy("item_id")))


def size_partitions(shingles: DataFrame, percent: int) -> DataFrame:
    """(h, item_id) of the minima that every item is searched by."""
    part = F.floor(F.log2(F.col("n").cast("double"))).cast("int").alias("part")
    sized = shingles.select("item_id", "h", "n", part)
    most = sized.groupBy("part").agg(F.max("n").alias("u"))
    need = (F.col("u") - F.ceil(F.col("u") * percent / 100) + 1).alias("need")
    ranked = sized.withColumn("r", F.row_number().over(Window.partitionBy("item_id").orderBy(F.xxhash64("h"), "h")))
    return ranked.join(most.select("part", need), "part").where("r <= need").select("h", "item_id")


def contaminated_texts(docs: DataFrame, items: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """(k1, k2, item_id, n_shared, n_item): texts that hold at least percent of an item's shingles."""
    all_items = materialise(item_shingles(items, shingle_words), "items")
    minima = materialise(size_partitions(all_items, percent), "minima")
    hashed = docs.select(*text_key(F.col("text")), shingle_hashes(F.col("text"), shingle_words).alias("hashes"))
    hits = hashed.select("k1", "k2", F.explode("hashes").alias("h")).join(minima, "h").select("k1", "k2", "item_id").distinct()
    hits = materialise(hits, "hits")
    # verification sees only texts with a hit, one row a text
    wanted = hits.select("k1", "k2").distinct()
    texts = docs.select(*text_key(F.col("text")), "text").join(wanted, ["k1", "k2"], "left_semi")
    sets = texts.select("k1", "k2", F.explode(F.array_distinct(shingle_hashes(F.col("text"), shingle_words))).alias("h"))
    shared = sets.join(all_items, "h").select("k1", "k2", "item_id", "h", "n").distinct()
    counted = shared.groupBy("k1", "k2", "item_id").agg(F.count("*").alias("n_shared"), F.first("n").alias("n_item"))
    return counted.join(hits, ["k1", "k2", "item_id"], "left_semi").where(100 * F.col("n_shared") >= percent * F.col("n_item"))


def contamination(docs: DataFrame, items: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment: one row a contaminated row of docs and item."""
    found = contaminated_texts(docs, items, shingle_words, percent)
    rows = docs.select("doc_id", *text_key(F.col("text")))
    return rows.join(found, ["k1", "k2"]).select("doc_id", "item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def decontaminate(docs: DataFrame, items: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, whose text holds no item."""
    found = contaminated_texts(docs, items, shingle_words, percent).select(F.col("k1").alias("_gone1"), F.col("k2").alias("_gone2")).distinct()
    k1, k2 = (c for c in text_key(docs["text"]))
    found = materialise(found, "gone")
    return docs.join(found, (k1 == found["_gone1"]) & (k2 == found["_gone2"]), "left_anti")


#: The same rows in DuckDB's SQL.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, s, s + 4), ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS s FROM d WHERE len(w) > 0)),
is_ AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, s, s + 4), ' ') AS g FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS s FROM i WHERE len(w) > 0)),
n AS (SELECT item_id, count(*) AS n_item FROM is_ GROUP BY item_id),
m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN is_ USING (g) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shared, n_item, CAST(n_shared AS DOUBLE) / n_item AS containment
FROM m JOIN n USING (item_id) WHERE 100 * n_shared >= 80 * n_item
"""
