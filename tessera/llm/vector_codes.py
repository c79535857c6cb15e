"""Product codes of vectors: codebooks trained in integers, nearest entries by a kd-tree each.

A component x becomes floor(1024 * x); a vector is cut into equal consecutive parts, each
with a codebook whose entries start as that part of the smallest vec_ids. In each round
every part is assigned to its nearest entry (squared Euclidean distance, ties to the lower
index), then every entry becomes the componentwise floor(sum / count) of its parts; one
without parts stays. After the last round the parts are assigned once more.

Per round the driver builds a kd-tree a codebook, with the box of the entries below each
node, and broadcasts them (at most `entries` rows a part). The search is branch and bound over
whole blocks of vectors: each vector visits the nearer box first and a box only if its
least possible distance is not above the vector's best so far; boxes at exactly that distance
are visited, so that an equal entry with a lower index is still found. Tasks send sums and
counts of integers, at most one row an entry, which Spark adds up exactly; the driver sees
`parts * entries` rows a round.

Cases: a null vector, or one with a null or non-finite component, is dropped; a shorter vector
counts as if zeros followed, and so does a length that `parts` does not divide; with fewer rows
than entries the codebooks are smaller; rows of equal vec_id seed in the order of their components, a
null vec_id seeds last; equal vectors get equal codes; an empty table (or one without kept rows) gives
no rows; components saturate at 2**27 for parts of 16 (|x| of 131,072; twice the width, 2**26.5), so
that distances stay in 64 bits; sums beyond 64 bits are reported as the greatest number; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm._text import bounded_batches
from tessera.session import materialise

#: Entries in a leaf, compared by one matrix product, and vectors searched at once.
LEAF, BLOCK = 32, 8192
MOST = (1 << 63) - 1


@dataclass
class Node:
    """The box of the entries below, and either two children or a leaf's entries in ascending order."""

    low: np.ndarray
    high: np.ndarray
    entries: np.ndarray | None = None
    left: Node | None = None
    right: Node | None = None


def build_tree(book: np.ndarray, own: np.ndarray | None = None, leaf: int = LEAF) -> Node:
    """Halved at the median of the widest dimension until a leaf has `leaf` entries at most."""
    own = np.arange(len(book)) if own is None else own
    low, high = book[own].min(0), book[own].max(0)
    if len(own) <= leaf:
        return Node(low, high, np.sort(own))
    along = own[np.argsort(book[own, np.argmax(high - low)], kind="stable")]
    half = len(own) // 2
    return Node(low, high, None, build_tree(book, along[:half], leaf), build_tree(book, along[half:], leaf))


def _least(q: np.ndarray, node: Node) -> np.ndarray:
    """Squared distances from vectors to the node's box."""
    gap = q - np.minimum(np.maximum(q, node.low), node.high)
    return np.einsum("ij,ij->i", gap, gap)


def nearest(tree: Node, book: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry, the lowest of equally near ones, and its squared distance, for each row of q.

    Doubles count integers exactly up to 2**53; where components are too large for that, the arithmetic is that of 64-bit integers.
    """
    most = max(int(np.abs(q).max(initial=0)), int(np.abs(book).max(initial=0)))
    kind = np.float64 if 4 * book.shape[1] * most * most < 1 << 53 else np.int64
    q, entries = q.astype(kind), book.astype(kind)
    own, theirs = np.einsum("ij,ij->i", q, q), np.einsum("ij,ij->i", entries, entries)
    best, index = np.full(len(q), MOST, kind), np.full(len(q), len(book), np.int64)

    def visit(node: Node, rows: np.ndarray, bound: np.ndarray) -> None:
        rows = rows[bound <= best[rows]]
        if not len(rows):
            return
        some = q[rows]
        if node.entries is not None:
            d = theirs[node.entries] - 2 * (some @ entries[node.entries].T) + own[rows][:, None]
            at = d.argmin(1)
            least, entry = d[np.arange(len(rows)), at], node.entries[at]
            better = (least < best[rows]) | ((least == best[rows]) & (entry < index[rows]))
            won = rows[better]
            best[won], index[won] = least[better], entry[better]
            return
        to_left, to_right = _least(some, node.left), _least(some, node.right)
        first = to_left <= to_right
        visit(node.left, rows[first], to_left[first])
        visit(node.right, rows[~first], to_right[~first])
        visit(node.right, rows[first], to_right[first])
        visit(node.left, rows[~first], to_left[~first])

    visit(tree, np.arange(len(q)), np.zeros(len(q), kind))
    return index, best.astype(np.int64)


def _blocks(column: pa.Array, parts: int, width: int) -> Iterator[np.ndarray]:
    """Arrays of BLOCK vectors at most: (vectors, parts, width), zeros behind short ones."""
    for k in range(0, len(column), BLOCK):
        some = column.slice(k, BLOCK)
        at = some.offsets.to_numpy()
        flat = some.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]]
        size = np.diff(at)
        out = np.zeros((len(some), parts * width), np.int64)
        row = np.repeat(np.arange(len(some)), size)
        out[row, np.arange(len(flat)) - np.repeat(at[:-1] - at[0], size)] = flat
        yield out.reshape(len(some), parts, width)


def _sums(books: np.ndarray):
    """One row an entry that got parts: its count and the sums of their components."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [build_tree(b) for b in books]
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for b in batches:
            for v in _blocks(b.column("v"), parts, width):
                for p in range(parts):
                    index, _ = nearest(trees[p], books[p], v[:, p])
                    count[p] += np.bincount(index, minlength=entries)
                    np.add.at(total[p], index, v[:, p])
        part, entry = np.nonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(count[part, entry]), pa.array(total[part, entry].tolist(), pa.list_(pa.int64()))],
            names=["part", "entry", "n", "sums"],
        )

    return run


def _codes(books: np.ndarray):
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [build_tree(b) for b in books]
        for b in batches:
            codes, errors = [], []
            for v in _blocks(b.column("v"), parts, width):
                found = [nearest(trees[p], books[p], v[:, p]) for p in range(parts)]
                codes += np.stack([i for i, _ in found], 1).astype(np.uint8).tobytes().hex(" ", parts).split()
                errors.append(sum(d for _, d in found))
            error = np.concatenate(errors) if errors else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(codes, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return run


def integer_vectors(vectors: DataFrame, parts: int) -> tuple[DataFrame, int]:
    """Written table of vec_id, label, v (integers) of the rows that are kept, and the width of a part."""
    kept = vectors.where(F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    longest = kept.agg(F.max(F.size("embedding"))).first()[0] or 0
    width = max(1, -(-longest // parts))
    # a difference is twice a component; its square, summed over a vector, stays below 2**62
    most = int(2 ** ((60 - np.log2(width)) / 2 - 1))
    scaled = F.transform("embedding", lambda x: F.floor(F.greatest(F.least(x.cast("double") * 1024, F.lit(float(most))), F.lit(-float(most)))).cast("int"))
    return materialise(kept.select(F.col("vec_id").cast("long").alias("vec_id"), "label", scaled.alias("v")), "vectors"), width


def train(rows: DataFrame, width: int, parts: int, entries: int, rounds: int) -> np.ndarray | None:
    """Codebooks (parts, entries, width) of `integer_vectors`' rows; None without rows."""
    seeds = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    if not seeds:
        return None
    books = np.zeros((len(seeds), parts * width), np.int64)
    for i, r in enumerate(seeds):
        books[i, : len(r["v"])] = r["v"]
    books = np.ascontiguousarray(books.reshape(len(seeds), parts, width).transpose(1, 0, 2))
    exact = lambda c: F.sum(c.cast("decimal(38,0)"))
    for _ in range(rounds):
        found = rows.select("v").mapInArrow(_sums(books), "part int, entry int, n long, sums array<long>")
        for r in found.groupBy("part", "entry").agg(exact(F.col("n")).alias("n"), F.array(*[exact(F.col("sums")[i]) for i in range(width)]).alias("sums")).collect():
            books[r["part"], r["entry"]] = [int(x) // int(r["n"]) for x in r["sums"]]
    return books


def book_digest(books: np.ndarray) -> str:
    """sha256 of all components as decimals by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4) -> DataFrame:
    """vec_id, code (two hexadecimal digits a part), error, label_error, codebooks_sha256 of vectors (vec_id, embedding, label)."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte a part")
    rows, width = integer_vectors(bounded_batches(vectors), parts)
    books = train(rows, width, parts, entries, rounds)
    kind = rows.schema["label"].dataType.simpleString()
    if books is None:
        return rows.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    coded = materialise(rows.mapInArrow(_codes(books), f"vec_id long, label {kind}, code string, error long"), "codes")
    exact = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)"))
    sums = materialise(coded.groupBy(F.col("label").alias("of")).agg(exact.cast("long").alias("label_error")), "errors")
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(book_digest(books)).alias("codebooks_sha256"))


def sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """The same for DuckDB on vectors whose common length `parts` divides, with all distances of every round."""
    floored = lambda s, n: f"(({s}) - (({s}) % ({n}) + ({n})) % ({n})) / ({n})"
    near = f"""SELECT q.id, q.p, arg_min(b.e, list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(q.v, b.v)])::HUGEINT * {entries} + b.e) AS e,
      min(list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(q.v, b.v)])) AS d
    FROM cut q JOIN {{book}} b ON q.p = b.p GROUP BY q.id, q.p"""
    steps = [
        "kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS id, vec_id, label, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)",
        f"cut AS MATERIALIZED (SELECT id, p, v[len(v) // {parts} * p + 1 : len(v) // {parts} * (p + 1)] AS v FROM kept, (SELECT unnest(range({parts})) AS p))",
        f"b0 AS MATERIALIZED (SELECT p, id - 1 AS e, v FROM cut WHERE id <= {entries})",
    ]
    for k in range(rounds):
        steps += [
            f"n{k} AS MATERIALIZED ({near.format(book=f'b{k}')})",
            f"s{k} AS (SELECT p, e, i, sum(x) AS s, count(*) AS n FROM (SELECT cut.p, e, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM cut JOIN n{k} USING (id, p)) GROUP BY p, e, i)",
            f"u{k} AS (SELECT p, e, list(CAST({floored('s', 'n')} AS BIGINT) ORDER BY i) AS v FROM s{k} GROUP BY p, e)",
            f"b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(u.v, b.v) AS v FROM b{k} b LEFT JOIN u{k} u ON b.p = u.p AND b.e = u.e)",
        ]
    steps += [
        f"last AS MATERIALIZED ({near.format(book=f'b{rounds}')})",
        "coded AS (SELECT id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM last GROUP BY id)",
        f"digest AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})",
    ]
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN kept USING (id), digest"


SQL = sql()
