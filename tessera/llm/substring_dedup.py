"""Removal of long repeated passages, found by difference-cover anchors.

A passage is a window of `window` consecutive words. Every word inside a window
whose word sequence also starts in a document with a smaller doc_id is removed;
windows are judged on the input.

Hashing every window of every text would shuffle a row a word. Anchors are
shorter windows, hashed only at word positions p with p mod P in a difference
cover D of P: for any two positions i, j some t < P puts both i + t and j + t
on the cover, so two equal windows always hold an equal aligned anchor of
window - P + 1 words. With the perfect difference set of P = 31 that is a row
for every fifth word. Only anchors found in different texts count; around them
matches are extended by comparing full windows (128-bit hashes). Which anchors
and windows are shared is found by partial minima and maxima, so a common one
costs each task one row; the joins back meet one row a shared value, and adaptive
execution splits those that a common value makes large.

Texts with the same words form one class and are handled as its smallest
doc_id: every other member of a class loses all its words (if it has a window),
so large groups of copies meet once. A bitmap of fixed size tells the second
scan which texts can hold a shared anchor; its false positives cost only work.

Cases: null and empty texts have no words and lose none; texts shorter than the
window lose none; rows with a null doc_id have no order: they keep all words and
remove none elsewhere; rows with the same doc_id never remove from each other;
a very long text is hashed and cut whole by one task; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm._text import GOLD, Slice, bounded_batches, fixed_bitmap, has_bit, mix, run_hash, signed, slices, window_starts
from tessera.session import materialise, release

#: A perfect difference set: every residue modulo 31 is a difference of two members.
PERIOD, COVER = 31, (0, 1, 3, 8, 12, 18)


def covers(period: int, cover: tuple[int, ...]) -> bool:
    return {(a - b) % period for a in cover for b in cover} == set(range(period))


def _two(piece: Slice) -> tuple[np.ndarray, np.ndarray]:
    one = piece.word_hashes(lower=False)
    return one, mix(one ^ GOLD)


def _whole(piece: Slice, values: np.ndarray) -> np.ndarray:
    return run_hash(values, piece.offsets[:-1], piece.offsets[1:])


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column("text").to_pylist()
        for piece in slices(b.column("text")):
            one, two = _two(piece)
            sha = [hashlib.sha256(b" ".join((t or "").encode().split())).hexdigest() for t in texts[piece.first : piece.first + piece.n]]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(piece.first, piece.n), pa.array(piece.counts().astype(np.int64)), pa.array(signed(_whole(piece, one))), pa.array(signed(_whole(piece, two))), pa.array(sha)], names=["doc_id", "n_words", "s1", "s2", "whole_sha"])


def _anchors(window: int, period: int, cover: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.zeros(period, bool)
        on[list(cover)] = True
        k = window - period + 1
        seen: set[int] = set()
        for b in batches:
            for piece in slices(b.column("text")):
                one, counts = piece.word_hashes(lower=False), piece.counts()
                s1 = _whole(piece, one)
                use = counts >= window
                for r in np.flatnonzero(use):
                    use[r] = (key := int(s1[r])) not in seen
                    seen.add(key)
                row, start = window_starts(counts, k)
                at = start - piece.offsets[row]
                keep = use[row] & on[at % period]
                row, start, at = row[keep], start[keep], at[keep]
                yield pa.RecordBatch.from_arrays([pa.array(signed(run_hash(one, start, start + k))), pa.array(signed(s1[row])), pa.array(at.astype(np.int32))], names=["h", "s1", "at"])

    return run


def _possible(window: int, bitmap: np.ndarray):
    """Texts that can hold a shared anchor; of a task's copies of a text, each whose doc_id is the smallest so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], int] = {}
        for b in batches:
            ids = b.column("doc_id").to_numpy()
            for piece in slices(b.column("text")):
                one, two = _two(piece)
                s1, s2 = _whole(piece, one), _whole(piece, two)
                rows = []
                for r in np.flatnonzero((piece.counts() >= window) & has_bit(bitmap, s1)):
                    key, own = (int(s1[r]), int(s2[r])), int(ids[piece.first + r])
                    if key not in seen or own < seen[key]:
                        seen[key] = own
                        rows.append(r)
                if rows:
                    at = pa.array(np.array(rows) + piece.first)
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").take(at), pa.array(signed(s1[rows])), pa.array(signed(s2[rows])), b.column("text").take(at)], names=["doc_id", "s1", "s2", "text"])

    return run


def _windows(window: int, period: int):
    """Hashes of all windows that hold a shared anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = period - 1
        for b in batches:
            lists = b.column("at")
            cut, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            for piece in slices(b.column("text")):
                one, two = _two(piece)
                row, start = window_starts(piece.counts(), window)
                at = start - piece.offsets[row]
                # anchors at p lie in the windows that start at p - reach .. p
                marks = np.zeros(len(one) + 1, np.int64)
                own = np.concatenate([flat[cut[piece.first + r] : cut[piece.first + r + 1]] + piece.offsets[r] for r in range(piece.n)]) if piece.n else np.zeros(0, np.int64)
                np.add.at(marks, own.astype(np.int64), 1)
                total = np.concatenate([[0], np.cumsum(marks)])
                keep = total[start + reach + 1] > total[start]
                row, start, at = row[keep], start[keep], at[keep]
                pick = lambda c: b.column(c).slice(piece.first, piece.n).take(pa.array(row))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([pa.array(signed(run_hash(one, start, start + window))), pa.array(signed(run_hash(two, start, start + window))), pick("text_no"), pick("rep"), pa.array(at.astype(np.int32))], names=["a", "b", "text_no", "rep", "at"])

    return run


def remove_windows(text: str, starts: list[int], window: int) -> tuple[int, str]:
    """How many words go, and the words that stay, joined by a blank."""
    words = text.encode().split()
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, np.array(starts, np.int64), 1)
    np.add.at(gone, np.array(starts, np.int64) + window, -1)
    stay = np.cumsum(gone)[:-1] == 0
    return int((~stay).sum()), b" ".join(w for w, s in zip(words, stay) if s).decode()


def _removed(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [remove_windows(t, s, window) for t, s in zip(b.column("text").to_pylist(), b.column("starts").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("s1"), b.column("s2"), pa.array([n for n, _ in done], pa.int64()), pa.array([t for _, t in done], pa.string())], names=["s1", "s2", "n_removed", "kept_text"])

    return run


def substring_dedup(docs: DataFrame, window: int = 50, period: int = PERIOD, cover: tuple[int, ...] = COVER) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text of every row of docs (doc_id, text).

    kept_text is null where no word goes (the text itself is the result).
    """
    if not covers(period, cover) or period > window:
        raise ValueError("cover must be a difference cover of a period not above the window")
    source = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    heads = materialise(source.mapInArrow(_heads, "doc_id long, n_words long, s1 long, s2 long, whole_sha string"), "heads")
    long_ = (F.col("n_words") >= window) & F.col("doc_id").isNotNull()
    reps = materialise(heads.where(long_).groupBy("s1", "s2").agg(F.min("doc_id").alias("rep")), "reps")

    ordered = source.where("doc_id is not null").select("text")
    anchors = ordered.mapInArrow(_anchors(window, period, cover), "h long, s1 long, at int")
    # a second scan finds the shared anchors' places: cheaper than to keep all anchors
    shared = materialise(anchors.groupBy("h").agg(F.min("s1").alias("low"), F.max("s1").alias("high")).where("low <> high").select("h"), "anchors")
    places = materialise(anchors.join(shared, "h").groupBy("s1").agg(F.collect_set("at").alias("at")), "places")
    release(shared)

    # copies meet their class by doc_id, too, so that each but the class's own goes to a task of its own and ends there
    possible = source.where("doc_id is not null").mapInArrow(_possible(window, fixed_bitmap(places.select("s1"))), "doc_id long, s1 long, s2 long, text string")
    texts = possible.withColumnRenamed("doc_id", "rep").join(reps, ["rep", "s1", "s2"]).dropDuplicates(["s1", "s2"]).join(places, "s1")
    texts = materialise(texts.withColumn("text_no", F.monotonically_increasing_id()), "texts")
    windows = materialise(texts.select("text_no", "rep", "at", "text").mapInArrow(_windows(window, period), "a long, b long, text_no long, rep long, at int"), "windows")
    first = materialise(windows.groupBy("a", "b").agg(F.min("rep").alias("first"), F.max("rep").alias("last")).where("first < last").select("a", "b", "first"), "first")
    starts = windows.join(first, ["a", "b"]).where("rep > first").groupBy("text_no").agg(F.collect_list("at").alias("starts"))
    cut = texts.select("text_no", "s1", "s2", "text").join(starts, "text_no").mapInArrow(_removed(window), "s1 long, s2 long, n_removed long, kept_text string")
    # one row a text; the join with all its copies is the only one by (s1, s2) in its stage, so that it can be split
    verdicts = materialise(reps.join(cut, ["s1", "s2"], "left"), "verdicts")
    release(places, texts, windows, first, reps)

    whole = heads.where(~F.coalesce(long_, F.lit(False))).select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("whole_sha").alias("kept_sha256"), F.lit(None).cast("string").alias("kept_text"))
    copy = F.col("doc_id") > F.col("rep")
    judged = heads.where(long_).join(verdicts, ["s1", "s2"]).select(
        "doc_id", "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce(F.sha2(F.col("kept_text").cast("binary"), 256), F.col("whole_sha"))).alias("kept_sha256"),
        F.when(copy, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"),
    )
    return whole.unionByName(judged)
