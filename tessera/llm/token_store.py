"""Token-ID output as Parquet lists, written in document order and read back selectively.

`write_tokens` encodes whole texts and writes (doc_id, part, local_start,
n_tokens, tokens) with Spark's own Parquet writer: version-2 pages give the
integer columns delta encoding (or dictionaries, by choice), row groups and
pages are of set sizes, and the page indexes that the writer adds let a reader
skip to a range of doc_id. `read_index` reads only metadata columns;
`read_tokens` reads token lists of a doc_id range.

Cases: a null text is an empty one (only the end id); an empty table gives
empty files' schema and no rows; rows with a null doc_id come first; repeated
doc_ids stay separate rows, in the order of the input's partitions and inside one ordered by text (so
a doc_id, or none, that many rows share is dealt over tasks); a very long text is one list, held
whole by one task; extra columns are ignored, also ones named like the output's.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tessera.llm._text import bounded_batches
from tessera.session import shared_dir

SCHEMA = "doc_id long, part int, local_start long, n_tokens long, tokens array<int>"
#: Parts of pieces that a worker keeps; when full it starts anew.
CACHE_PARTS = 1_500_000


def _gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the runs of flat with these starts and sizes: those at which, in a row, and how many each has."""
    size = size[which]
    end = np.cumsum(size, dtype=np.int32)
    at = np.repeat(start[which] - (end - size), size)
    at += np.arange(len(at), dtype=np.int32)
    return flat[at], size


class _Runs:
    """Runs of ids by number, in arrays that grow."""

    def __init__(self) -> None:
        self.flat, self.used = np.zeros(1 << 18, np.int32), 0
        self.start, self.size, self.n = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32), 0

    def append(self, ids: np.ndarray, size: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        while self.n + len(size) > len(self.start):
            self.start, self.size = np.resize(self.start, 2 * len(self.start)), np.resize(self.size, 2 * len(self.size))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[self.n : self.n + len(size)] = self.used + np.cumsum(size) - size
        self.size[self.n : self.n + len(size)] = size
        self.used, self.n = self.used + len(ids), self.n + len(size)

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _gather(self.flat, self.start, self.size, which)


class WordEncoder:
    """tokenizers' ids of whole texts, each distinct part of a piece encoded once a worker.

    The normaliser (NFC, white space, lower case) and the pre-tokeniser of the
    word-end BPE file never look across white space, so a text's ids are those
    of its pieces between blanks and line ends, in order. A piece of plain
    Latin letters and then plain punctuation is two pre-tokens, so its letters
    are looked up in lower case. Such letters are what the normaliser gives and
    one pre-token, so new ones need only the pieces of the library that follow:
    its byte alphabet and its BPE. `tests/llm` compares all this with encoding
    whole texts.
    """

    PLAIN = r"^(?P<head>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<tail>[.,!?;:*$%&#|]*)$"

    LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers as pre

        self.tok = Tokenizer.from_file(path)
        self.bare = Tokenizer(self.tok.model)
        self.bare.pre_tokenizer = pre.Sequence([pre.CharDelimiterSplit(" "), pre.ByteLevel(add_prefix_space=False, use_regex=False)])
        # every letter, and every pair of them, for a file of other rules than the word-end BPE's
        trial = [" ".join([a, *(a + b for b in self.LETTERS)]) for a in self.LETTERS]
        if any(not np.array_equal(x, y) for x, y in zip(self._ids(self.tok, trial), self._ids(self.bare, trial))):
            self.bare = self.tok
        self.closes = np.zeros(self.tok.get_vocab_size() + 1, bool)
        self.closes[[i for t, i in self.tok.get_vocab().items() if t.endswith("</w>")]] = True
        self.reset()

    def reset(self) -> None:
        self.parts: dict[str, int] = {}
        self.part_ids = _Runs()

    def _places(self, parts: list[str], plain: np.ndarray) -> np.ndarray:
        """Numbers of distinct parts, unknown ones encoded; plain: of letters alone, in lower case."""
        place = np.fromiter(map(self.parts.get, parts, repeat(-1)), np.int32, len(parts))
        new = np.flatnonzero(place < 0)
        # plain ones first, so that either kind is numbered in a row
        new = np.concatenate([new[plain[new]], new[~plain[new]]])
        place[new] = np.arange(len(self.parts), len(self.parts) + len(new))
        names, n = [parts[i] for i in new.tolist()], int(plain[new].sum())
        # these are single pre-tokens, whose last token ends with the word-end mark: many go in one text
        for k in range(0, n, 50_000):
            some = names[k : min(k + 50_000, n)]
            ids = self._ids(self.bare, [" ".join(some[i : i + 50]) for i in range(0, len(some), 50)])[0]
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != len(some):
                raise ValueError("a word of letters is not one pre-token of this tokenizer")
            self._add(some, ids, np.diff(ends, prepend=0))
        for k in range(n, len(names), 20_000):
            self._add(names[k : k + 20_000], *self._ids(self.tok, names[k : k + 20_000]))
        return place

    @staticmethod
    def _ids(tok, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts in a row, and how many each has."""
        ids = [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.int32, int(size.sum())), size

    def _add(self, parts: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        n = len(self.parts)
        self.part_ids.append(ids, size)
        self.parts.update(zip(parts, range(n, n + len(parts))))

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces in a row, and how many each has."""
        found = pc.extract_regex(pieces, pattern=self.PLAIN)
        plain = found.is_valid()
        both = np.empty(2 * len(pieces), np.int32)
        for i, part in enumerate((pc.if_else(plain, pc.utf8_lower(found.field("head")), pieces), pc.if_else(plain, found.field("tail"), ""))):
            coded = part.dictionary_encode()
            at, letters = coded.indices.to_numpy(), np.zeros(len(coded.dictionary), bool)
            if i == 0:
                letters[at] = plain.to_numpy(zero_copy_only=False)
            both[i::2] = self._places(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), letters)[at]
        ids, size = self.part_ids.take(both)
        return ids, size[::2] + size[1::2]

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each closed by end_id, and how many each has."""
        texts = pc.replace_substring(texts.cast(pa.large_string()).fill_null(""), "\n", " ")
        pieces = pc.split_pattern(texts, " ")
        bounds = pieces.offsets.to_numpy()
        coded = pieces.values.dictionary_encode()
        if len(self.parts) > CACHE_PARTS:
            self.reset()
        ids, size = self._pieces(coded.dictionary)
        flat, size = _gather(ids, np.cumsum(size, dtype=np.int32) - size, size, coded.indices.to_numpy()[bounds[0] : bounds[-1]])
        before = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        per = np.diff(before[bounds - bounds[0]])
        #: each document's ids move up by the end ids before it
        doc = np.repeat(np.arange(len(texts), dtype=np.int32), per)
        out = np.full(len(flat) + len(texts), end_id, np.int32)
        out[np.arange(len(flat), dtype=np.int32) + doc] = flat
        return out, per + 1


_ENCODERS: dict[str, WordEncoder] = {}


def _encode_part(path: str, end_id: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _ENCODERS.get(path) or _ENCODERS.setdefault(path, WordEncoder(path))
        part, at = TaskContext.get().partitionId(), 0
        for whole in batches:
            for k in range(0, whole.num_rows, rows):
                b = whole.slice(k, rows)
                ids, n = enc.encode(b.column("text"), end_id)
                offsets = np.concatenate([[0], np.cumsum(n)])
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array(np.full(len(n), part, np.int32)), pa.array(at + offsets[:-1]), pa.array(n.astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))],
                    names=["doc_id", "part", "local_start", "n_tokens", "tokens"],
                )
                at += int(offsets[-1])

    return run


def write_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    out: str | None = None,
    end_id: int = 2,
    encoding: str = "delta",
    row_group_bytes: int = 32 << 20,
    page_rows: int = 2_000,
    batch_rows: int = 1_000,
) -> str:
    """Encode documents (doc_id, text) in ascending doc_id order into Parquet files; returns their folder.

    encoding: "delta" writes the integers delta-packed, "dictionary" with a
    dictionary a row group. One range exchange by doc_id is the only shuffle.
    """
    if encoding not in ("delta", "dictionary"):
        raise ValueError("encoding is delta or dictionary")
    out = out or f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    rows = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.spark_partition_id().alias("_from"))
    ordered = rows.repartitionByRange("doc_id", "_from").sortWithinPartitions("doc_id", "_from", "text").drop("_from")
    (
        ordered.mapInArrow(_encode_part(tokenizer_path, end_id, batch_rows), SCHEMA)
        .write.option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary", str(encoding == "dictionary").lower())
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.page.row.count.limit", page_rows)
        .parquet(out)
    )
    return out


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, part, start, n_tokens, local_start) from the metadata columns alone; start counts all ids before a document.

    Only one row a file meets in the running sum over files.
    """
    meta = spark.read.schema(SCHEMA).parquet(path).select("doc_id", "part", "local_start", "n_tokens")
    ends = meta.groupBy("part").agg(F.max(F.col("local_start") + F.col("n_tokens")).alias("size"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select("part", F.coalesce(F.sum("size").over(upto), F.lit(0)).alias("before"))
    return meta.join(before, "part").select("doc_id", "part", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "local_start")


def read_tokens(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """(doc_id, part, local_start, n_tokens, tokens) of low <= doc_id <= high; the bounds reach the scan and its page indexes."""
    df = spark.read.schema(SCHEMA).parquet(path)
    if low is not None:
        df = df.where(F.col("doc_id") >= low)
    if high is not None:
        df = df.where(F.col("doc_id") <= high)
    return df


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column("tokens")
        at = lists.offsets.to_numpy()
        flat = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<u4")
        crc = pa.array([zlib.crc32(flat[s:e]) for s, e in zip(at[:-1], at[1:])], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), b.column("local_start"), pa.array(np.diff(at).astype(np.int64)), crc], names=["doc_id", "part", "local_start", "n_tokens", "ids_crc32"])


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per written document: doc_id, start, n_tokens, ids_crc32, all from the files' rows."""
    found = read_tokens(spark, path).mapInArrow(_digests, "doc_id long, part int, local_start long, n_tokens long, ids_crc32 long")
    ends = spark.read.schema(SCHEMA).parquet(path).groupBy("part").agg(F.max(F.col("local_start") + F.col("n_tokens")).alias("size"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select("part", F.coalesce(F.sum("size").over(upto), F.lit(0)).alias("before"))
    return found.join(before, "part").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
