"""SentencePiece encoding with seeded merge dropout, and lossless decoding.

Text is cut into chunks across which no vocabulary piece can reach: a word with
the blanks before it, or a run of line ends. Each chunk is merged by the model's
agenda: of all adjacent pairs that form a piece, the best one (highest score, then
leftmost) is taken first. With dropout a candidate merge is skipped for good if
a keyed hash of seed, document, number of the chunk, place and both pieces falls
below the rate. So each occurrence of a word draws for itself, but always the same
for the same seed. A worker keeps the agenda of each distinct chunk without
dropout and the candidates it meets: an occurrence that skips none of these is
merged just so. All others are merged together, one merge of each a round, but for
long chunks (text without blanks), which are merged one by one from a heap.

Unknown characters become byte pieces. A U+2581 of the text also becomes bytes,
as that character stands for a blank among the pieces; so decoding gives back
every text. Without dropout the ids are the sentencepiece library's own, but
for texts that contain U+2581.

Cases: null and empty texts have no ids and decode to the empty text; null
doc_ids are hashed as -1; rows stay as they are, repeated ones too; a very long
text, or a long one without blanks, takes time in proportion to n log n; an empty
table gives no rows; extra columns pass untouched in `encode` and `decode` (a
clashing tokens or decoded column is replaced).
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tessera.llm._text import GOLD, M1, M2, bounded_batches, mix

SPACE = "▁"
CHUNK = re.compile(r" *[^ \n]+| +|\n+")
#: Distinct chunks a worker keeps.
CACHE_CHUNKS = 200_000
#: Chunks of more characters are merged from a heap and not kept.
LONG = 256
#: Of the table that finds pairs.
SLOT_BITS = 21
#: Occurrences whose candidates are drawn at once; chunks merged side by side, and their symbols.
DRAWN = 50_000
SIDE_BY_SIDE, SYMBOLS = 10_000, 500_000


class _Slices:
    """Slices of a flat array that grows."""

    def __init__(self, dtype):
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(1 << 16, dtype), 0

    def append(self, flat: np.ndarray, size: np.ndarray) -> None:
        self.start = np.concatenate([self.start, self.used + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        if self.used + len(flat) > len(self.flat):
            self.flat = np.resize(self.flat, max(self.used + len(flat), 2 * len(self.flat)))
        self.flat[self.used : self.used + len(flat)] = flat
        self.used += len(flat)

    def take(self, code: np.ndarray) -> np.ndarray:
        """The slices of all codes in a row."""
        size = self.size[code]
        return self.flat[np.arange(size.sum()) + np.repeat(self.start[code] - (np.cumsum(size) - size), size)]


class DropoutModel:
    def __init__(self, path: str, rate: float, seed: int, cache_chunks: int = CACHE_CHUNKS):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        normal = [i for i in range(len(self.pieces)) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        if any(SPACE in self.pieces[i].lstrip(SPACE) or "\n" in self.pieces[i] for i in normal):
            raise ValueError("a piece of this model reaches across chunks")
        self.byte = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.bytes_of = [b"" if sp.is_control(i) or sp.is_unknown(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        for b, i in enumerate(self.byte):
            self.bytes_of[i] = bytes([b])
        ids = {self.pieces[i]: i for i in normal}
        self.char = {p: i for p, i in ids.items() if len(p) == 1 and p != SPACE} | {" ": ids[SPACE]}
        self.point = np.full(0x110000, -1, np.int32)
        self.point[[ord(c) for c in self.char]] = list(self.char.values())
        pairs = {}
        for p, i in ids.items():
            for k in range(1, len(p)):
                if p[:k] in ids and p[k:] in ids:
                    pairs[ids[p[:k]] * len(self.pieces) + ids[p[k:]]] = i
        self.pair_key = np.array(sorted(pairs), np.int64)
        self.pair_id = np.array([pairs[k] for k in self.pair_key.tolist()], np.int32)
        # one slot a hashed pair; the few that share one are searched for
        slot = self._slot(self.pair_key)
        self.slots = np.zeros(1 << SLOT_BITS, np.int32)
        self.slots[slot] = np.arange(len(slot))
        self.shared = np.bincount(slot, minlength=1 << SLOT_BITS) > 1
        # equal scores share a rank, so that the leftmost of their pairs comes first
        _, rank = np.unique([-sp.get_score(i) for i in self.pair_id.tolist()], return_inverse=True)
        self.pair_rank = rank.astype(np.int32)
        self.pair_of = dict(zip(self.pair_key.tolist(), range(len(self.pair_key))))
        self.rate, self.cache_chunks = rate, cache_chunks
        self.key = mix(np.array([seed], np.int64).view(np.uint64) + GOLD)[0]
        self.reset()

    def reset(self) -> None:
        """Empties the cache: a chunk's ids and candidates are slices of two flat arrays."""
        self.index: dict[str, int] = {}
        self.names: list[str] = []
        self.ids, self.candidates = _Slices(np.int32), _Slices(np.uint64)

    def _symbols(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """First symbols of all chunks in a row, and how many each has."""
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        text = "".join(chunks)
        flat = self.point[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        odd = np.flatnonzero(flat < 0)
        if len(odd):
            as_bytes = [self.byte[list(text[i].encode())] for i in odd.tolist()]
            more = np.ones(len(flat), np.int64)
            more[odd] = [len(x) for x in as_bytes]
            owner = np.repeat(np.arange(len(chunks)), size)
            out = np.repeat(flat, more)
            out[out < 0] = np.concatenate(as_bytes)
            return out, np.bincount(owner, more, len(chunks)).astype(np.int64)
        return flat, size

    def _candidate(self, key: np.ndarray, place: np.ndarray) -> np.ndarray:
        """What stands for a pair at a place in the hash of a skip."""
        return key.astype(np.int64).view(np.uint64) * GOLD + place.astype(np.uint64) + self.key

    def _dropped(self, candidate: np.ndarray, draw: np.ndarray) -> np.ndarray:
        return (mix(candidate + draw) >> np.uint64(11)).astype(np.float64) * 2.0**-53 < self.rate

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * GOLD) >> np.uint64(64 - SLOT_BITS)).view(np.int64)

    def _find(self, key: np.ndarray) -> np.ndarray:
        """Where each key is among the pairs; any place for those that are none."""
        slot = self._slot(key)
        at = self.slots[slot]
        again = self.shared[slot]
        if again.any():
            at[again] = np.minimum(np.searchsorted(self.pair_key, key[again]), len(self.pair_key) - 1)
        return at

    def _rank(self, a: np.ndarray, b: np.ndarray, place: np.ndarray, draw: np.ndarray | None) -> np.ndarray:
        """Ranks of the pairs' merges; of those that are none or dropped, more than any rank. Without draw nothing is dropped."""
        none = np.int32(2**31 - 1)
        key = a.astype(np.int64) * len(self.pieces) + b
        at = self._find(key)
        ok = (self.pair_key[at] == key) & (a >= 0) & (b >= 0)
        if self.rate > 0 and draw is not None:
            ok &= ~self._dropped(self._candidate(key, place), draw.astype(np.uint64))
        return np.where(ok, self.pair_rank[at], none)

    def merge(self, chunks: list[str], draw: np.ndarray | None, met: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The agenda of every chunk, all chunks side by side: ids in a row, and how many each has. Chunks of like length share a block.

        draw is the part of the hash that tells occurrences apart. The candidates met are added to met as arrays of (chunk, candidate).
        """
        flat, size = self._symbols(chunks)
        start = np.cumsum(size) - size
        order = np.argsort(size, kind="stable")
        parts: list[np.ndarray] = []
        count = np.zeros(len(chunks), np.int64)
        k = 0
        while k < len(order):
            end = k + max(1, min(SIDE_BY_SIDE, int(SYMBOLS // max(1, size[order[min(k + SIDE_BY_SIDE, len(order) - 1)]]))))
            rows = order[k:end]
            seen = None if met is None else []
            ids = self._merge_block(flat, start[rows], size[rows], None if draw is None else draw[rows], seen)
            if met is not None:
                met += [(rows[owner], candidate) for owner, candidate in seen]
            count[rows] = (ids >= 0).sum(1)
            parts.append(ids[ids >= 0])
            k = end
        merged = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        # from the order of lengths back to that of the chunks
        at = np.empty(len(chunks), np.int64)
        at[order] = np.cumsum(count[order]) - count[order]
        out = merged[np.repeat(at - (np.cumsum(count) - count), count) + np.arange(len(merged))]
        return out, count

    def _merge_block(self, flat: np.ndarray, start: np.ndarray, size: np.ndarray, draw: np.ndarray | None, seen: list | None) -> np.ndarray:
        n, width = len(size), max(1, int(size.max()))
        ids = np.full((n, width + 1), -1, np.int32)
        column = np.arange(width + 1)
        filled = column[None, :] < size[:, None]
        ids[filled] = flat[(start[:, None] + column[None, :])[filled]]
        live = np.arange(n)
        # a piece's place is that of its first symbol; links go to the next live piece, the last column is the end
        nxt = np.tile(np.arange(1, width + 2, dtype=np.int32), (n, 1))
        prev = np.tile(np.arange(-1, width, dtype=np.int32), (n, 1))
        place = np.broadcast_to(np.arange(width), (n, width))
        none = np.int32(2**31 - 1)

        def ranked(a: np.ndarray, b: np.ndarray, place: np.ndarray, rows: np.ndarray) -> np.ndarray:
            got = self._rank(a, b, place, None if draw is None else draw[rows])
            if seen is not None:
                ok = got != none
                seen.append((np.broadcast_to(rows, got.shape)[ok], self._candidate(a[ok].astype(np.int64) * len(self.pieces) + b[ok], place[ok])))
            return got

        rank = ranked(ids[:, :-1], ids[:, 1:], place, live[:, None])
        while len(live):
            best = rank[live].argmin(1)
            go = rank[live, best] != none
            live, best = live[go], best[go]
            if not len(live):
                break
            gone = nxt[live, best]
            new = self.pair_id[self._find(ids[live, best].astype(np.int64) * len(self.pieces) + ids[live, gone])]
            after = nxt[live, np.minimum(gone, width)]
            ids[live, best], ids[live, gone] = new, -1
            rank[live[gone < width], gone[gone < width]] = none
            nxt[live, best] = after
            ok = after <= width
            prev[live[ok], after[ok]] = best[ok]
            right = np.where(after < width, ids[live, np.minimum(after, width)], -1)
            rank[live, best] = ranked(new, right, best, live)
            before = prev[live, best]
            has = before >= 0
            rows, at = live[has], before[has]
            rank[rows, at] = ranked(ids[rows, at], new[has], at, rows)
        return ids

    def _merge_long(self, chunk: str, draw: np.uint64) -> list[int]:
        """The agenda of one chunk of any length, by a heap of (rank, place)."""
        none, pieces, limit = 2**31 - 1, len(self.pieces), (1 << 64) - 1
        flat, _ = self._symbols([chunk])
        n = len(flat)
        ranks = self._rank(flat[:-1], flat[1:], np.arange(n - 1), np.full(n - 1, draw))
        some = np.flatnonzero(ranks != none)
        heap = (ranks[some].astype(np.int64) << 32 | some).tolist()
        heapq.heapify(heap)
        ids, now, nxt, prev = flat.tolist(), [*ranks.tolist(), none], list(range(1, n + 1)), list(range(-1, n - 1))
        base, rank_of, id_of = int(self.key) + int(draw), self.pair_rank, self.pair_id
        gold, m1, m2 = int(GOLD), int(M1), int(M2)
        below = self.rate * 2.0**53

        def meet(at: int, right: int) -> None:
            key = ids[at] * pieces + ids[right]
            i = self.pair_of.get(key)
            if i is not None and below > 0:
                x = (key * gold + at + base) & limit
                x = ((x ^ (x >> 30)) * m1) & limit
                x = ((x ^ (x >> 27)) * m2) & limit
                if ((x ^ (x >> 31)) >> 11) < below:
                    i = None
            now[at] = none if i is None else int(rank_of[i])
            if i is not None:
                heapq.heappush(heap, now[at] << 32 | at)

        while heap:
            rank, at = divmod(heapq.heappop(heap), 1 << 32)
            if now[at] != rank:  # merged away, or another pair since
                continue
            right = nxt[at]
            ids[at] = int(id_of[self.pair_of[ids[at] * pieces + ids[right]]])
            ids[right], now[right], now[at] = -1, none, none
            after = nxt[at] = nxt[right]
            if after < n:
                prev[after] = at
                meet(at, after)
            if prev[at] >= 0:
                meet(prev[at], at)
        return [i for i in ids if i >= 0]

    def _learn(self, chunks: list[str]) -> None:
        new = chunks
        self.index.update(zip(new, range(len(self.names), len(self.names) + len(new))))
        self.names += new
        met: list[tuple[np.ndarray, np.ndarray]] = []
        self.ids.append(*self.merge(new, None, met if self.rate > 0 else None))
        owner = np.concatenate([o for o, _ in met]) if met else np.zeros(0, np.int64)
        candidate = np.concatenate([c for _, c in met]) if met else np.zeros(0, np.uint64)
        self.candidates.append(candidate[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(new)))

    def _skipping(self, code: np.ndarray, draw: np.ndarray) -> np.ndarray:
        """Which occurrences skip a candidate of the agenda without dropout."""
        out = np.zeros(len(code), bool)
        for k in range(0, len(code) if self.rate > 0 else 0, DRAWN):
            part = code[k : k + DRAWN]
            owner = np.repeat(np.arange(k, k + len(part)), self.candidates.size[part])
            out[owner[self._dropped(self.candidates.take(part), draw[owner])]] = True
        return out

    def encode(self, texts: list[str], doc_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has."""
        chunks = [CHUNK.findall(" " + t) if t else [] for t in texts]
        if len(self.index) > self.cache_chunks:
            self.reset()
        new = list(set(chain.from_iterable(chunks)).difference(self.index))
        if new:
            self._learn([c for c in new if len(c) <= LONG])
        long_ = [c for c in new if len(c) > LONG]
        self.index.update((c, -1) for c in long_)
        count = np.fromiter(map(len, chunks), np.int64, len(chunks))
        code = np.fromiter(map(self.index.__getitem__, chain.from_iterable(chunks)), np.int64, int(count.sum()))
        for c in long_:
            del self.index[c]
        doc = np.repeat(np.arange(len(texts)), count)
        within = np.arange(len(code)) - np.repeat(np.cumsum(count) - count, count)
        draw = mix(mix(doc_ids.view(np.uint64)[doc] + self.key) + within.astype(np.uint64))
        heaped = code < 0
        known = np.where(heaped, 0, code)
        odd = self._skipping(known, draw) & ~heaped if len(self.names) else np.zeros(len(code), bool)
        plain = ~odd & ~heaped
        size = np.zeros(len(code), np.int64)
        size[plain] = self.ids.size[code[plain]]
        ids, size[odd] = self.merge(list(map(self.names.__getitem__, code[odd].tolist())), draw[odd])
        big: list[list[int]] = []
        if heaped.any():
            every = list(chain.from_iterable(chunks))
            big = [self._merge_long(every[i], draw[i]) for i in np.flatnonzero(heaped)]
            size[heaped] = list(map(len, big))
        flat = np.empty(size.sum(), np.int32)
        flat[np.repeat(odd, size)] = ids
        flat[np.repeat(plain, size)] = self.ids.take(code[plain])
        flat[np.repeat(heaped, size)] = list(chain.from_iterable(big))
        before = np.concatenate([[0], np.cumsum(size)])
        return flat, np.diff(before[np.concatenate([[0], np.cumsum(count)])])

    def decode(self, ids: np.ndarray) -> str:
        """The text; the blank that encoding puts before it is taken off."""
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))[1:].decode()


_MODELS: dict[tuple, DropoutModel] = {}


def _model(*key) -> DropoutModel:
    return _MODELS.get(key) or _MODELS.setdefault(key, DropoutModel(*key))


def _encode(names: list[str], path: str, rate: float, seed: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path, rate, seed)
        for whole in batches:
            for k in range(0, whole.num_rows, rows):
                b = whole.slice(k, rows)
                ids, n = model.encode([t or "" for t in b.column("text").to_pylist()], np.array([-1 if i is None else i for i in b.column("doc_id").to_pylist()], np.int64))
                offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], names=[*names, "tokens"])

    return run


def encode(docs: DataFrame, model_path: str, rate: float = 0.1, seed: int = 17, batch_rows: int = 1000) -> DataFrame:
    """docs with tokens array<int>; a clashing column is replaced. No shuffle."""
    kept = bounded_batches(docs).drop("tokens")
    schema = T.StructType([*kept.schema.fields, T.StructField("tokens", T.ArrayType(T.IntegerType()))])
    return kept.mapInArrow(_encode(kept.columns, model_path, rate, seed, batch_rows), schema)


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """encoded (tokens and other columns) with decoded string."""
    kept = encoded.drop("decoded")
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(model_path, 0.0, 0)
        for b in batches:
            lists = b.column("tokens")
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([model.decode(flat[s:e]) for s, e in zip(at[:-1], at[1:])], pa.string())], names=[*names, "decoded"])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("decoded", T.StringType())]))


def _round_trip(path: str, rate: float, seed: int, rows: int, tokens: bool):
    names = ["doc_id", "n_tokens", "ids_crc32", "lossless"] + ["tokens"] * tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path, rate, seed)
        for whole in batches:
            for k in range(0, whole.num_rows, rows):
                b = whole.slice(k, rows)
                texts = [t or "" for t in b.column("text").to_pylist()]
                ids, n = model.encode(texts, np.array([-1 if i is None else i for i in b.column("doc_id").to_pylist()], np.int64))
                at = np.concatenate([[0], np.cumsum(n)])
                flat = ids.astype("<u4")
                crc = [zlib.crc32(flat[s:e]) for s, e in zip(at[:-1], at[1:])]
                same = [model.decode(ids[s:e]) == t for t, s, e in zip(texts, at[:-1], at[1:])]
                lists = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))] * tokens
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(crc, pa.int64()), pa.array(same, pa.bool_()), *lists], names=names)

    return run


def round_trip(docs: DataFrame, model_path: str, rate: float = 0.1, seed: int = 17, batch_rows: int = 125, tokens: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, lossless (the decoded ids are the text) of every row of docs, and the tokens if wanted.

    Encoding and decoding share one pass and one Python worker.
    """
    schema = "doc_id long, n_tokens long, ids_crc32 long, lossless boolean" + ", tokens array<int>" * tokens
    return bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_round_trip(model_path, rate, seed, batch_rows, tokens), schema)
