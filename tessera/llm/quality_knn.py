"""Quality classifier: nearest-neighbour voting in a latent semantic space.

A text is a bag of hashed byte trigrams (ASCII lower case is kept apart from
upper case: shouting is a sign) and of one more term, words said again at once,
weighted log(1 + count) * idf. Document frequencies are counted over all texts. A bounded sample of labelled texts,
balanced over the labels, gives a term matrix whose leading right singular
vectors are the latent space. The sample's latent vectors are broadcast (rows
times dimensions is the proven bound), every text's vector meets all of them in
blocks of exact cosine products, and its nearest neighbours vote with weights
that grow with similarity.

Cases: null texts are empty; a text of fewer than three bytes has no trigram
and scores 0; rows pass one by one, so null and repeated doc_ids come back as
they are; null labels are no labels, of several labels of a doc_id the least
counts; without labels of both kinds the score is the share of label 1 among
those there are (0.5 if none); a very long text is counted whole; an empty table
gives no rows; extra columns pass.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tessera.llm._text import Slice, bounded_batches, slices

#: Buckets of trigrams; the dimension after them counts repeated words, with the weight of so many dimensions.
TRIGRAMS = 4096
DIMS, REPEATS = TRIGRAMS + 1, 48
#: Rows of texts whose dense term vectors are held at once, and bytes of those texts.
BLOCK, SLICE = 256, 1 << 18
#: Rows and bytes of a batch: its copies outside the JVM's heap stay.
BATCH_ROWS, BATCH_BYTES = 500, 8 << 20


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned: crc32(doc_id as text) mod 4 is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def term_counts(piece: Slice) -> np.ndarray:
    """Rows by DIMS: counts of hashed byte trigrams inside each text, and of words that repeat one of the two words before them."""
    d = piece.data.astype(np.uint32)
    counts = np.zeros((piece.n, DIMS), np.float32)
    if len(d) < 3:
        return counts
    h = ((d[:-2] * np.uint32(0x9E3779B1)) ^ (d[1:-1] * np.uint32(0x85EBCA6B)) ^ (d[2:] * np.uint32(0xC2B2AE35))) * np.uint32(0x27D4EB2F)
    h = (h >> np.uint32(32 - 12)).astype(np.int64)
    row = np.repeat(np.arange(piece.n), np.diff(piece.bounds))[: len(h)]
    inside = np.arange(len(h)) + 3 <= piece.bounds[row + 1]
    counts[:, :TRIGRAMS] = np.bincount((row * TRIGRAMS + h)[inside], minlength=piece.n * TRIGRAMS).reshape(piece.n, TRIGRAMS)
    word = piece.word_hashes(lower=True)
    again = np.zeros(len(word), bool)
    for back in (1, 2):
        again[back:] |= (word[back:] == word[:-back]) & (piece.row[back:] == piece.row[:-back])
    counts[:, TRIGRAMS] = np.bincount(piece.row[again], minlength=piece.n)
    return counts


def _blocks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    for k in range(0, len(texts), BLOCK):
        for piece in slices(texts.slice(k, BLOCK), SLICE):
            yield k + piece.first, piece.n, term_counts(piece)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(DIMS, np.int64), 0
    for b in batches:
        for _, rows, counts in _blocks(b.column("text")):
            df += (counts > 0).sum(0)
            n += rows
    term = np.concatenate([[-1], np.flatnonzero(df)])
    yield pa.RecordBatch.from_arrays([pa.array(term.astype(np.int32)), pa.array(np.concatenate([[n], df[df > 0]]))], names=["term", "n"])


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    np.log1p(counts, out=counts)
    counts *= idf
    return counts


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


@dataclass
class Model:
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int
    power: int

    def score(self, counts: np.ndarray) -> np.ndarray:
        if len(set(self.labels.tolist())) < 2:
            return np.full(len(counts), self.labels.mean() if len(self.labels) else 0.5)
        latent = _unit(_weighted(counts, self.idf) @ self.axes)
        some = latent.any(1)
        near = latent @ self.vectors.T
        k = min(self.neighbours, near.shape[1])
        at = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, at, 1), 0).astype(np.float64) ** self.power
        total = weight.sum(1)
        score = (weight * self.labels[at]).sum(1) / np.where(total > 0, total, 1)
        return np.where(some, np.clip(score, 0, 1), 0.0)


def _rows_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for first, n, counts in _blocks(b.column("text")):
            yield pa.RecordBatch.from_arrays([b.column("quality").slice(first, n), pa.array([zlib.compress(c.astype(np.uint32).tobytes(), 1) for c in counts], pa.binary())], names=["quality", "terms"])


def leading(gram: np.ndarray, k: int, most: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a positive semidefinite matrix in single precision, descending, and their vectors.

    Iterates a subspace of 4 * k dimensions until the vectors are exact to single precision (`most` times at most): the library's
    decomposition takes nine times the matrix beside it, which the driver has no room for. Small matrices go to the library.
    """
    if len(gram) <= 4 * k:
        value, vector = np.linalg.eigh(gram)
        return value[::-1][:k], vector[:, ::-1][:, :k]
    q = np.linalg.qr(np.random.default_rng(0).standard_normal((len(gram), 4 * k), np.float32))[0]
    for _ in range(most):
        image = gram @ q
        value, turn = np.linalg.eigh((q.T @ image).astype(np.float64))
        value, turn = value[::-1][:k], turn[:, ::-1][:, :k].astype(np.float32)
        vector = q @ turn
        off = np.linalg.norm(image @ turn - vector * value.astype(np.float32), axis=0).max()
        if off <= 1e-6 * value[0]:
            break
        q = np.linalg.qr(image)[0]
    return value.astype(np.float32), vector


def fit(docs: DataFrame, labels: DataFrame, sample_per_label: int = 1024, latent: int = 64, neighbours: int = 25, power: int = 4) -> Model:
    """Learns from at most sample_per_label labelled rows of each label, those that come first by a hash of doc_id.

    Only rows that are not held out are learned from; doc_id only chooses rows
    and joins labels to texts.
    """
    bounded_batches(docs, BATCH_ROWS, BATCH_BYTES)
    n, df = 0, np.zeros(DIMS)
    for r in docs.select("text").mapInArrow(_frequencies, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        if r["term"] < 0:
            n = r["n"]
        else:
            df[r["term"]] = r["n"]
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    idf[TRIGRAMS:] *= np.sqrt(REPEATS)
    known = labels.where("quality in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").cast("int").alias("quality"))
    chosen = None
    for q in (0, 1):
        one = known.where(F.col("quality") == q).orderBy(F.xxhash64("_id"), "_id").limit(sample_per_label)
        chosen = one if chosen is None else chosen.unionByName(one)
    # at most 2 * sample_per_label rows of two numbers
    texts = docs.select(F.col("doc_id").alias("_id"), "text").join(F.broadcast(chosen), "_id").orderBy(F.xxhash64("_id"), "_id", "text").limit(2 * sample_per_label)
    got = texts.select("quality", "text").mapInArrow(_rows_terms, "quality int, terms binary").collect()
    if not got:
        return Model(idf, np.zeros((DIMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), neighbours, power)
    quality = np.array([r["quality"] for r in got], np.float64)

    def sample() -> np.ndarray:
        """The unit term vectors, at most 2 * sample_per_label, in blocks weighted in place."""
        x = np.empty((len(got), DIMS), np.float32)
        for i, r in enumerate(got):
            x[i] = np.frombuffer(zlib.decompress(r["terms"]), np.uint32)
        for k in range(0, len(x), BLOCK):
            norm = np.linalg.norm(_weighted(x[k : k + BLOCK], idf), axis=1, keepdims=True)
            x[k : k + BLOCK] /= np.where(norm > 0, norm, 1)
        return x

    # right singular vectors by way of the (rows x rows) Gram matrix; what lies below single precision is no axis
    x = sample()
    value, left = leading(x @ x.T, latent)
    top = value > max(1e-9, 1e-5 * float(value.max()))
    axes = (x.T @ (left[:, top] / np.sqrt(value[top]))).astype(np.float32)
    return Model(idf, axes, _unit(x @ axes), quality, neighbours, power)


def with_scores(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """docs with a double column, from the text alone; a clashing column is replaced."""
    kept = bounded_batches(docs, BATCH_ROWS, BATCH_BYTES).drop(column)
    names = kept.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = np.zeros(b.num_rows)
            for first, n, counts in _blocks(b.column("text")):
                score[first : first + n] = shared.value.score(counts)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score)], names=[*names, column])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(column, T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **more: int) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    scored = with_scores(docs.select("doc_id", "text"), fit(docs, labels, **more))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **more: int) -> DataFrame:
    """The rows of docs, all columns, whose score reaches the threshold."""
    return with_scores(docs, fit(docs, labels, **more), "_quality_score").where(F.col("_quality_score") >= threshold).drop("_quality_score")
