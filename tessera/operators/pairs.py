"""Pairs without cross joins: hashes within a Hamming radius, and vectors against vectors in blocks."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.session import materialise

BITS, WORDS = 256, 4


def hash_classes(df: DataFrame, key: str, digest: str) -> tuple[DataFrame, DataFrame]:
    """(digest, class, n) of the distinct hashes, named by their smallest key, and (key, class) of all rows with a well-formed one (64 hexadecimal digits, either case)."""
    good = df.where(F.col(key).isNotNull() & F.col(digest).rlike("^[0-9a-fA-F]{64}$")).select(key, F.lower(digest).alias("digest"))
    classes = materialise(good.groupBy("digest").agg(F.min(key).alias("class"), F.count("*").alias("n")), "classes")
    return classes, good.join(classes, "digest").select(key, "class")


def _masks(width: int, most: int) -> Column:
    """Array of all numbers of `width` bits with `most` ones or fewer."""
    return F.array(*[F.lit(sum(1 << i for i in ones)) for k in range(most + 1) for ones in combinations(range(width), k)]).cast("array<long>")


def hamming_pairs(classes: DataFrame, radius: int, bands: int = 16) -> DataFrame:
    """(left, right, distance, n_left, n_right) of all pairs of distinct hashes at most radius bits apart, left below right; classes are those of `hash_classes`.

    Multi-index hashing: the bits are cut into bands, and the radius + 1 is dealt over them: of hashes within the radius, some
    band with share s differs in fewer than s bits (pigeonhole). Both sides put every band down with up to
    half of those bits changed and meet where they agree, so the search loses nothing; `bit_count` of the whole
    hashes decides, and a pair counts in the first band that finds it. Bands of about log2 of the number of hashes keep
    chance meetings few: 16 for tens of thousands to millions, 8 beyond (with larger radii at the price of more changed
    bands). The two sides are many times their tables, which the optimiser does not see: they are sorted and merged, never broadcast.
    """
    if bands not in (8, 16, 32):
        raise ValueError("bands is 8, 16 or 32")
    width = BITS // bands
    share, more = divmod(radius + 1, bands)
    allowed = [share + (b < more) - 1 for b in range(bands)]  # bits in which band b may differ; -1: not needed
    words = [F.conv(F.substring("digest", 1 + 16 * k, 16), 16, -10).cast("long").alias(f"w{k}") for k in range(WORDS)]
    rows = materialise(classes.select("class", "n", "digest", *words), "hashes")

    def probes(most: Callable[[int], int], names: tuple[str, str], mark: str) -> DataFrame:
        def band(b: int, bits: int) -> Column:
            value = F.conv(F.substring("digest", 1 + b * width // 4, width // 4), 16, 10).cast("long")
            return F.transform(_masks(width, bits), lambda m: value.bitwiseXOR(m) * bands + b)

        every = F.flatten(F.array(*[band(b, most(t)) for b, t in enumerate(allowed) if t >= 0]))
        return rows.select(F.col("class").alias(names[0]), F.col("n").alias(names[1]), *[F.col(f"w{k}").alias(f"{mark}{k}") for k in range(WORDS)], F.explode(every).alias("probe"))

    left, right = probes(lambda t: t // 2, ("left", "n_left"), "a"), probes(lambda t: t - t // 2, ("right", "n_right"), "b")
    apart = [F.col(f"a{k}").bitwiseXOR(F.col(f"b{k}")) for k in range(WORDS)]
    distance = sum((F.bit_count(x) for x in apart), F.lit(0))

    def own(b: int) -> Column:
        k, place = divmod(b * width, BITS // WORDS)
        return F.bit_count(F.shiftrightunsigned(apart[k], BITS // WORDS - width - place).bitwiseAND(F.lit((1 << width) - 1)))

    first = F.coalesce(*[F.when(own(b) <= t, F.lit(b)) for b, t in enumerate(allowed) if t >= 0])
    met = left.join(right.hint("merge"), "probe").where((F.col("left") < F.col("right")) & (distance <= radius)).where(F.col("probe") % bands == first)
    found = met.select("left", "right", distance.cast("int").alias("distance"), "n_left", "n_right")
    # with two bits changed or more, a band finds a pair by several changes
    return found.dropDuplicates(["left", "right"]) if max(allowed) > 1 else found


#: Vectors of a block; a task holds one block of queries, one of rows and their products.
BLOCK = 2048


def against_all(queries: DataFrame, rows: DataFrame, key: str, kernel: Callable[[pa.Table, pa.Table], pa.Table], schema: str, block: int = BLOCK) -> DataFrame:
    """kernel(block of queries, block of rows) for every two blocks, as one DataFrame; both sides have the column key.

    Rows are dealt into blocks by hash and shuffled once a block of queries, queries once a block of rows; a
    task holds about two blocks, whatever the sizes of the tables.
    """
    blocks = [max(1, -(-d.count() // block)) for d in (queries, rows)]

    def dealt(d: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        # aliases: both sides may come from one table, and a cogroup needs columns of its own on each
        d = d.select(*[F.col(c).alias(c) for c in d.columns])
        return d.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    q, r = dealt(queries, "_qb", blocks[0], "_rb", blocks[1]), dealt(rows, "_rb", blocks[1], "_qb", blocks[0])
    return q.groupBy("_qb", "_rb").cogroup(r.groupBy("_qb", "_rb")).applyInArrow(kernel, schema)


def matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of doubles, zeros behind short ones, and their lengths."""
    lists = column.combine_chunks()
    at = lists.offsets.to_numpy()
    size = np.diff(at)
    out = np.zeros((len(lists), int(size.max(initial=0))))
    row = np.repeat(np.arange(len(lists)), size)
    out[row, np.arange(at[-1] - at[0]) - np.repeat(at[:-1] - at[0], size)] = lists.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]]
    return out, size


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(norm == 0, 1, norm)


def _both(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Products of all rows with all queries, as (queries, rows)."""
    n = min(q.shape[1], r.shape[1])
    return q[:, :n] @ r[:, :n].T


def top_cosine(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int, group: str | None = None, block: int = BLOCK) -> DataFrame:
    """(query, key, similarity, and group if asked for) that hold the k best rows of every query by (similarity, then the smaller key); with group, the k best of each group's best too.

    similarity is the cosine cut to 0..1 and rounded to 3 places; a zero norm counts as 1, another length gives 0.5. Of two
    blocks k rows a query leave (2k with group). Rows without key or vector take no part.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    qkind = queries.schema[key].dataType.simpleString()
    columns = [key, vector, *([group] if group else [])]

    def kernel(a: pa.Table, b: pa.Table) -> pa.Table:
        picked_q, picked_r, picked_s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if a.num_rows and b.num_rows:
            b = b.sort_by(key)  # so that a stable sort breaks ties by key
            (q, nq), (r, nr) = matrix(a.column(vector)), matrix(b.column(vector))
            s = np.where(nq[:, None] != nr, 0.5, np.clip(_both(_unit(q), _unit(r)), 0, 1))
            s = np.floor(s * 1000 + 0.5) / 1000
            order = np.argsort(-s, axis=1, kind="stable")
            codes = np.unique(np.array([repr(x) for x in b.column(group).to_pylist()]), return_inverse=True)[1] if group else None
            for i, own in enumerate(order):
                some = own[:k]
                if group:
                    firsts = np.sort(np.unique(codes[own], return_index=True)[1])[:k]
                    some = np.union1d(some, own[firsts])
                picked_q.append(np.full(len(some), i))
                picked_r.append(some)
                picked_s.append(s[i, some])
        at_q, at_r = pa.array(np.concatenate(picked_q)), pa.array(np.concatenate(picked_r))
        return pa.table({"query": a.column(key).take(at_q), key: b.column(key).take(at_r), **({group: b.column(group).take(at_r)} if group else {}), "similarity": pa.array(np.concatenate(picked_s))})

    there = lambda d: d.where(F.col(key).isNotNull() & F.col(vector).isNotNull())
    schema = f"query {qkind}, {key} {kinds[key]}, " + (f"{group} {kinds[group]}, " if group else "") + "similarity double"
    return against_all(there(queries).select(key, vector), there(rows).select(*columns), key, kernel, schema, block)


#: Rows that a query meets in a row; a multiple of eight, as Parquet packs the places in its dictionary by eights.
TILE = 64


def _tiled(ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) where ok holds, by tiles of columns: both keys repeat at short, even distances, so files hold little but the figure."""
    found = [np.nonzero(ok[:, t : t + TILE]) for t in range(0, ok.shape[1], TILE)]
    return np.concatenate([i for i, _ in found]), np.concatenate([j + TILE * t for t, (_, j) in enumerate(found)])


def correlations(queries: DataFrame, rows: DataFrame, key: str, vector: str, block: int = BLOCK) -> DataFrame:
    """(query, key, r): the Pearson correlation of every query with every row of its length; 0 where one has no spread."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    qkind = queries.schema[key].dataType.simpleString()

    def spread(x: np.ndarray, n: np.ndarray) -> np.ndarray:
        inside = np.arange(x.shape[1]) < n[:, None]
        return _unit(np.where(inside, x - (x.sum(1) / np.maximum(n, 1))[:, None], 0))

    def kernel(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"query": a.column(key).slice(0, 0), key: b.column(key).slice(0, 0), "r": pa.array([], pa.float64())})
        (q, nq), (r, nr) = matrix(a.column(vector)), matrix(b.column(vector))
        i, j = _tiled(nq[:, None] == nr)
        return pa.table({"query": a.column(key).take(pa.array(i)), key: b.column(key).take(pa.array(j)), "r": pa.array(_both(spread(q, nq), spread(r, nr))[i, j])})

    there = lambda d: d.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(key, vector)
    return against_all(there(queries), there(rows), key, kernel, f"query {qkind}, {key} {kinds[key]}, r double", block)


def distances(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int | None = None, block: int = BLOCK) -> DataFrame:
    """(query, key, distance): the Euclidean distance of every query to every row, the shorter vector as if zeros followed; with k, of each two blocks a query's k nearest, ties by key."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    qkind = queries.schema[key].dataType.simpleString()

    def kernel(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"query": a.column(key).slice(0, 0), key: b.column(key).slice(0, 0), "distance": pa.array([], pa.float64())})
        b = b.sort_by(key)
        (q, _), (r, _) = matrix(a.column(vector)), matrix(b.column(vector))
        wide = max(q.shape[1], r.shape[1])
        q, r = (np.pad(x, ((0, 0), (0, wide - x.shape[1]))) for x in (q, r))
        d = np.stack([np.sqrt(((r - one) ** 2).sum(1)) for one in q])
        near = np.argsort(d, axis=1, kind="stable")[:, :k] if k else np.broadcast_to(np.arange(len(r)), d.shape)
        i = np.repeat(np.arange(len(q)), near.shape[1])
        j = near.ravel()
        return pa.table({"query": a.column(key).take(pa.array(i)), key: b.column(key).take(pa.array(j)), "distance": pa.array(d[i, j])})

    there = lambda d: d.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(key, vector)
    return against_all(there(queries), there(rows), key, kernel, f"query {qkind}, {key} {kinds[key]}, distance double", block)


def best(found: DataFrame, query: str, key: str, score: str, k: int) -> DataFrame:
    """found with rank, the first k of a query by score, ties by key."""
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc(score), key))).where(F.col("rank") <= k)
