"""Packing of documents into sequences of a fixed length by minimum bin slack.

A document is its token ids and an end id. One longer than the capacity is cut
into pieces of the capacity, the last one shorter. Sequences are filled one at
a time with the fullest combination of pieces still left, found by a bitset
dynamic program of subset sums: bit s of a Python integer says that the lengths
so far can add up to s. Of equally full combinations the one with the longest
pieces is taken, as those are hardest to place later.

Only lengths matter for that, so the program runs on the histogram of lengths
(at most `capacity` numbers), which is all that the driver sees. A combination
stays the fullest one for as long as its pieces last, so it is taken as many times
at once as they allow; each step uses up a length or leaves less of it than one
combination took, so the number of steps depends on the capacity and not on the
number of documents. Executors then give every piece its place: the rank of
a piece among those of its length says which use of which combination takes it.

The plain rule can use up the short pieces first and leave long ones alone, so a second
run asks each sequence to hold the longest piece left (and the fullest rest); the run
with fewer sequences counts.

Cases: a null or empty text is its end id alone; rows with a null or repeated doc_id are
documents of their own; equal texts give equal pieces in places of their own; a very long
text is encoded whole by one task; an empty table gives no rows; extra columns are ignored,
also ones named like the output's. sequence_id is gapless from 0.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tessera.llm._text import bounded_batches
from tessera.llm.token_store import _ENCODERS, WordEncoder
from tessera.session import materialise

#: Ranks of pieces of one length, and lengths, share 63 bits.
RANK_BITS = 42


def _reachable(bits: int, length: int, copies: int, mask: int) -> int:
    """Sums reachable from those in bits with 0 to copies more pieces of this length."""
    step = 1
    while copies > 0:
        some = min(step, copies)
        bits |= bits << (length * some)
        copies, step = copies - some, 2 * step
    return bits & mask


def _fill(counts: list[int], capacity: int, longest: bool) -> list[tuple[int, list[tuple[int, int]]]]:
    """(times, [(length, copies), ...]) of every combination in the order in which they are taken; uses up counts."""
    mask = (1 << (capacity + 1)) - 1
    usable = lambda n: min(counts[n], capacity // n)
    lengths = [n for n in range(1, capacity + 1) if counts[n]]
    upto = [1]  # upto[i]: sums of the i shortest lengths
    for n in lengths:
        upto.append(_reachable(upto[-1], n, usable(n), mask))
    out = []
    while lengths:
        if longest:
            last = lengths[-1]
            rest = _reachable(upto[-2], last, usable(last) - 1, mask >> last)
            left = last + rest.bit_length() - 1
        else:
            left = upto[-1].bit_length() - 1
        i, taken = len(lengths), []
        while left:
            i = min(i, bisect_right(lengths, left)) - 1
            n = lengths[i]
            copies = next(k for k in range(min(counts[n], left // n), -1, -1) if upto[i] >> (left - k * n) & 1)
            if copies:
                taken.append((n, copies))
                left -= copies * n
        times = min(counts[n] // copies for n, copies in taken)
        out.append((times, taken))
        changed = None
        for n, copies in taken:  # longest first
            before = usable(n)
            counts[n] -= copies * times
            if usable(n) != before:
                changed = n
        if changed is not None:
            i = bisect_left(lengths, changed)
            lengths[i:] = [n for n in lengths[i:] if counts[n]]
            del upto[i + 1 :]
            for n in lengths[i:]:
                upto.append(_reachable(upto[-1], n, usable(n), mask))
    return out


def fill_patterns(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(times, [(length, copies), ...]) that use up counts (pieces by length), in as few sequences as the two rules find."""
    both = []
    for longest in (False, True):
        left = [0] * (capacity + 1)
        for n, k in counts.items():
            left[n] = k
        both.append(_fill(left, capacity, longest))
    return min(both, key=lambda x: sum(times for times, _ in x))


def _cut(path: str, capacity: int, end_id: int, rows: int, tokens: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _ENCODERS.get(path) or _ENCODERS.setdefault(path, WordEncoder(path))
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for whole in batches:
            for k in range(0, whole.num_rows, rows):
                b = whole.slice(k, rows)
                ids, n = enc.encode(b.column("text"), end_id)
                ids = np.ascontiguousarray(ids, "<u4")
                per = -(-n // capacity)
                doc = np.repeat(np.arange(len(n)), per)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
                start = piece * capacity
                length = np.minimum(n[doc] - start, capacity)
                ends = np.cumsum(length)
                crc = [zlib.crc32(ids[e - m : e]) for e, m in zip(ends.tolist(), length.tolist())]
                # the place of a piece among the task's pieces of its length
                order = np.argsort(length, kind="stable")
                first = np.searchsorted(length[order], length[order], "left")
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order)) - first
                rank += seen[length]
                seen += np.bincount(length, minlength=capacity + 1)
                columns = [b.column("doc_id").take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), part, np.int32)), pa.array(rank)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"]
                if tokens:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.view("<i4"))))
                    names.append("tokens")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, tokens: bool = False, batch_rows: int = 1_000) -> DataFrame:
    """Written table of pieces: doc_id, piece, start, length, ids_crc32, the task that cut it and its rank among that task's pieces of its length; with tokens, the ids too."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long" + ", tokens array<int>" * tokens
    rows = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return materialise(rows.mapInArrow(_cut(tokenizer_path, capacity, end_id, batch_rows, tokens), schema), "pieces")


def _place(patterns: list[tuple[int, list[tuple[int, int]]]]):
    """Arrow batches with length and rank to ones with sequence_id and offset."""
    used: dict[int, int] = {}
    entries, sequence = [], 0
    for times, taken in patterns:
        offset = 0
        for n, copies in taken:
            entries.append((n << RANK_BITS | used.get(n, 0), copies, sequence, offset))
            used[n] = used.get(n, 0) + times * copies
            offset += n * copies
        sequence += times
    key, copies, first, offset = np.array(sorted(entries), np.int64).reshape(-1, 4).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            own = length << RANK_BITS | rank
            at = np.searchsorted(key, own, "right") - 1
            turn, nth = np.divmod(own - key[at], copies[at])
            keep = [c for c in b.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(first[at] + turn), pa.array(offset[at] + nth * length)], names=[*keep, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, tokens: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece; with tokens, its ids too.

    The pieces are shuffled once, for the join with the ranks at which tasks start (a row
    a task and length); their tokens only if asked for.
    """
    pieces = cut_pieces(docs, tokenizer_path, capacity, end_id, tokens)
    sizes = materialise(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *["tokens"] * tokens]
    ranked = pieces.join(starts, ["part", "length"]).select(*columns, (F.col("before") + F.col("rank")).alias("rank"))
    kinds = {f.name: f.dataType.simpleString() for f in pieces.schema}
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in columns], "sequence_id long", "offset long"])
    return ranked.mapInArrow(_place(fill_patterns(counts, capacity)), schema)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, tokens, and in the same order doc_ids, pieces and lengths, of `pack(..., tokens=True)`. A sequence has at most `capacity` pieces."""
    whole = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "tokens"))).alias("p"))
    return whole.select("sequence_id", F.flatten("p.tokens").alias("tokens"), F.col("p.doc_id").alias("doc_ids"), F.col("p.piece").alias("pieces"), F.col("p.length").alias("lengths"))
