"""How five quality filters interact: what each removes at each place of each of the 120 orders.

Filters, by letter: A fewer than 200 words; B fewer than half of the words distinct; C more
than 3 % of the code points are A-Z; D holds one of #$%&*|; E equal to a text of a smaller
doc_id anywhere in the table. Words are maximal runs of characters other than blanks and
0x09-0x0D, case-sensitive.

A document's five verdicts are a number below 32. First-failure lookup: a table of 32 by 120
says at which step of each order such a document goes (5: it stays). `mapInArrow` looks up
every document, `numpy.bincount` counts by part, order, step and label, and Spark adds up
the tasks' counts. All figures follow from these: what fails a filter is what the filter
removes where it comes first, what fails nothing else is what it removes where it comes last.

E is found by 128-bit digests of whole texts: smallest doc_ids of digests that occur
more than once are combined before they are shuffled, written, and joined back.

Cases: a null text is empty (it fails A, and E after the first); a null lang is the part "",
as an empty one; an empty table gives no rows; a row with a null doc_id never fails
E, is nobody's original and has no label; equal texts of one doc_id do not make each other
fail; rows with a repeated doc_id are counted each, with the doc_id's labels; of several labels of
one doc_id any 1 counts; a very long text is held by one task; extra columns are ignored, also
ones named like the output's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tessera.llm._text import bounded_batches, slices
from tessera.session import materialise

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Documents looked up at once: 120 steps each.
BLOCK = 8192
#: Parts whose counts a task holds at once; beyond, it sends on what it has.
PARTS = 64


def first_failures() -> np.ndarray:
    """table[mask, order]: the step, from 0, at which documents of this mask go; 5 if they stay. Bit i of a mask: filter i fails."""
    out = np.full((1 << len(FILTERS), len(ORDERS)), len(FILTERS), np.int8)
    for mask in range(len(out)):
        for k, order in enumerate(ORDERS):
            out[mask, k] = next((step for step, f in enumerate(order) if mask >> FILTERS.index(f) & 1), len(FILTERS))
    return out


def _per_row(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _text_flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id and part with the mask of A to D and two halves of a digest of the text."""
    sign = np.zeros(256, bool)
    sign[list(b"#$%&*|")] = True
    for b in batches:
        masks, digests = [], []
        for s in slices(b.column("text")):
            words, hashes = s.counts(), s.word_hashes(lower=False)
            distinct = np.array([len(np.unique(hashes[i:j])) for i, j in zip(s.offsets[:-1], s.offsets[1:])], np.int64)
            points = _per_row((s.data & 0xC0) != 0x80, s.bounds)
            capitals = _per_row((s.data >= 65) & (s.data <= 90), s.bounds)
            fails = [words < 200, 100 * distinct < 50 * words, 100 * capitals > 3 * points, _per_row(sign[s.data], s.bounds) > 0]
            masks.append(sum(f.astype(np.int32) << i for i, f in enumerate(fails)))
            view = memoryview(np.ascontiguousarray(s.data))
            digests += [hashlib.blake2b(view[i:j], digest_size=16).digest() for i, j in zip(s.bounds[:-1].tolist(), s.bounds[1:].tolist())]
        halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
        mask = np.concatenate(masks) if masks else np.zeros(0, np.int32)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), pa.array(mask), pa.array(halves[:, 0]), pa.array(halves[:, 1])], names=["doc_id", "part", "mask", "h1", "h2"])


def failure_masks(docs: DataFrame) -> DataFrame:
    """doc_id, part and mask (bit i: filter i fails) of every row."""
    rows = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), "text")
    flags = materialise(rows.mapInArrow(_text_flags, "doc_id long, part string, mask int, h1 long, h2 long"), "flags")
    repeated = flags.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    return flags.join(materialise(repeated, "firsts"), ["h1", "h2"], "left").select("doc_id", "part", F.when(F.col("doc_id") > F.col("first"), F.col("mask") + 16).otherwise(F.col("mask")).alias("mask"))


def _removals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of part, order and step with the counts of all, good and toxic documents that go there."""
    table = first_failures()
    steps, places = len(FILTERS) + 1, len(ORDERS) * (len(FILTERS) + 1)
    base = np.arange(len(ORDERS), dtype=np.int64) * steps
    order, step = np.divmod(np.arange(places, dtype=np.int32), np.int32(steps))
    held: dict[str, np.ndarray] = {}

    def flush() -> pa.RecordBatch:
        names, counts = list(held), np.stack(list(held.values()))
        held.clear()
        by = counts.reshape(len(names) * places, 4)
        part = pa.DictionaryArray.from_arrays(pa.array(np.repeat(np.arange(len(names), dtype=np.int32), places)), pa.array(names, pa.string())).cast(pa.string())
        columns = [part, pa.array(np.tile(order, len(names))), pa.array(np.tile(step, len(names))), pa.array(by.sum(1)), pa.array(by[:, 1] + by[:, 3]), pa.array(by[:, 2] + by[:, 3])]
        return pa.RecordBatch.from_arrays(columns, names=["part", "order_id", "step_id", "n", "n_good", "n_toxic"])

    for whole in batches:
        for k in range(0, whole.num_rows, BLOCK):
            b = whole.slice(k, BLOCK)
            part = b.column("part").dictionary_encode()
            at, names = part.indices.to_numpy().astype(np.int64), part.dictionary.to_pylist()
            label = b.column("good").to_numpy() + 2 * b.column("toxic").to_numpy()
            mask = b.column("mask").to_numpy()
            for p in range(0, len(names), PARTS):
                own = (at >= p) & (at < p + PARTS)
                some = names[p : p + PARTS]
                key = (((at[own] - p) * places)[:, None] + base + table[mask[own]]) * 4 + label[own][:, None]
                counts = np.bincount(key.ravel(), minlength=len(some) * places * 4).reshape(len(some), places, 4)
                for name, c in zip(some, counts):
                    held[name] = held[name] + c if name in held else c
                if len(held) >= PARTS:
                    yield flush()
    if held:
        yield flush()


def removals(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, order_id, step_id (5: stays), n, n_good, n_toxic: the tasks' counts added up."""
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality").eqNullSafe(1).cast("int")).alias("good"), F.max(F.col("toxic").eqNullSafe(1).cast("int")).alias("toxic"))
    marked = failure_masks(docs).join(materialise(marks, "marks"), "doc_id", "left")
    rows = marked.select("part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    counts = rows.mapInArrow(_removals, "part string, order_id int, step_id int, n long, n_good long, n_toxic long")
    return counts.groupBy("part", "order_id", "step_id").agg(*[F.sum(c).alias(c) for c in ("n", "n_good", "n_toxic")])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: 600 rows a part."""
    order = F.element_at(F.array(*map(F.lit, ORDERS)), F.col("order_id") + 1)
    step = F.col("step_id") + 1
    counts = removals(docs, labels).select("*", order.alias("filter_order"), step.alias("step"), F.substring(order, step, F.lit(1)).alias("filter"))
    along = Window.partitionBy("part", "filter_order").orderBy(F.col("step").desc()).rowsBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy("part", "filter")
    found = counts.select("*", F.sum("n").over(along).alias("kept")).where(F.col("step") <= len(FILTERS))
    at = lambda k: F.max(F.when(F.col("step") == k, F.col("n"))).over(same)
    return found.select(
        "part", "filter_order", "step", "kept", F.col("n").alias("removed"), (at(1) - F.col("n")).alias("redundant"), at(len(FILTERS)).alias("unique_fails"),
        F.col("n_good").alias("good_lost"), F.col("n_toxic").alias("toxic_lost"), F.sum("n").over(same).alias("shapley"),
    )


_ORDERS_SQL = "SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e WHERE length(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5"

SQL = rf"""
WITH letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS ({_ORDERS_SQL}),
texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
verdicts AS (
  SELECT doc_id, part, (CASE WHEN len(w) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t) THEN 'C' ELSE '' END) || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END)
    || (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END) AS fails
  FROM texts),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
kinds AS (
  SELECT part, fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM verdicts LEFT JOIN marks USING (doc_id) GROUP BY part, fails),
placed AS (
  SELECT k.*, filter_order, s.step, filter_order[s.step] AS letter, contains(fails, filter_order[s.step]) AS failing, length(translate(filter_order[1:s.step - 1], fails, '')) < s.step - 1 AS gone
  FROM kinds k, orders, (SELECT unnest(range(1, 6)) AS step) s),
steps AS (
  SELECT part, filter_order, step, letter,
    sum(CASE WHEN NOT gone AND NOT failing THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND failing THEN n ELSE 0 END) AS removed, sum(CASE WHEN gone AND failing THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = letter THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN NOT gone AND failing THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND failing THEN toxic ELSE 0 END) AS toxic_lost
  FROM placed GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM steps
"""
