"""Chat formatting with minimum-cost role repair.

A legal conversation is a path of a small automaton: an optional system turn,
then user and assistant in turn, ending with assistant. Every input turn is
kept, relabelled, merged into the turn before it, or preceded by one inserted
empty turn; dynamic programming finds the cheapest way for the whole
conversation. Of equally cheap ways the one that, from the end backwards, uses
the smaller state before and then the earlier action in ACTIONS is taken.

Turns are range-partitioned by conversation and turn and packed in blocks, so a
conversation of any length spreads over many tasks. A block's effect is a
(min, +) matrix over the automaton's states. Conversations inside one block are
repaired at once; for longer ones the matrices of their blocks are multiplied,
first within a partition, then over partitions, and the same is done backwards
for the states chosen, so no task sees more than its blocks or a row a partition.

Every input turn gives one output row with its piece of the rendering; the
pieces of a conversation in order are the rendered conversation.

Cases: a null role or one unknown costs UNKNOWN to label; null texts are empty;
a null conv_id is a conversation of its own; turns are ordered by turn (nulls
first), then a hash of role and text, then role and text, so ties have an order
that no partitioning changes, and repeated rows are alike; a text of any length
passes whole, one row at a time; an empty table gives no rows; a table without conv_id, turn, role or
text is an error of its missing column; extra columns are
ignored, also ones named like the output's.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tessera.llm._text import bounded_batches
from tessera.session import materialise

ROLES = ("system", "user", "assistant")
#: States are 0 for the start and then the role last rendered, by its place in ROLES plus 1.
STATES = 4
LEGAL = {(0, 1), (0, 2), (1, 2), (2, 3), (3, 2)}
#: Costs: joining a turn to the one before, another role, an empty turn put before, and a role where none is known.
MERGE, RELABEL, INSERT, UNKNOWN = 2, 3, 4, 1
FAR = 1 << 40
#: Turns of a block.
BLOCK = 256


@lru_cache(None)
def moves(role: int) -> tuple[tuple[int, int, int, int, int], ...]:
    """(state before, state after, cost, inserted role or 0, merged) a turn of that role (0: unknown) allows, in the order of preference."""
    out = []
    for q in range(STATES):
        for x in range(1, STATES):
            label = 0 if x == role else (RELABEL if role else UNKNOWN)
            if (q, x) in LEGAL:
                out.append((q, x, label, 0, 0))
            if q == x:
                out.append((q, x, label + MERGE, 0, 1))
            for y in range(1, STATES):
                if (q, y) in LEGAL and (y, x) in LEGAL:
                    out.append((q, x, label + INSERT, y, 0))
    return tuple(out)


#: Empty turns that a conversation in each state needs before it may end.
ENDING = {0: (), 1: (2, 3), 2: (3,), 3: ()}


def _role(name: str | None) -> int:
    return ROLES.index(name) + 1 if name in ROLES else 0


def _matrix(role: int) -> np.ndarray:
    m = np.full((STATES, STATES), FAR, np.int64)
    for q, x, cost, _, _ in moves(role):
        m[q, x] = min(m[q, x], cost)
    return m


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The (min, +) product."""
    return np.minimum((a[..., :, None] + b[None, :, :]).min(-2), FAR)


def _effect(roles: list[int]) -> np.ndarray:
    m = np.where(np.eye(STATES, dtype=bool), 0, FAR).astype(np.int64)
    for r in roles:
        m = times(m, _matrix(r))
    return m


def _trace(roles: list[int], entry: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Costs of the states before every turn and after the last, from those before the first."""
    d, out = entry, []
    for r in roles:
        out.append(d)
        d = np.minimum((d[:, None] + _matrix(r)).min(0), FAR)
    return out, d


def _path(roles: list[int], costs: list[np.ndarray], last: np.ndarray, end: int) -> tuple[int, list[tuple]]:
    """The state before the first turn, and each turn's move, that lead to the state end."""
    out, after = [], last
    for r, before in zip(reversed(roles), reversed(costs)):
        move = min((m for m in moves(r) if m[1] == end and before[m[0]] + m[2] == after[end]), key=lambda m: m[0])
        out.append(move)
        end, after = move[0], before
    return end, out[::-1]


def _final(costs: np.ndarray) -> int:
    return int(np.argmin(costs + [INSERT * len(ENDING[q]) for q in range(STATES)]))


def _open(role: int) -> str:
    return f"<|{ROLES[role - 1]}|>\n"


CLOSE = "<|end|>\n"


def _rows(conv, turns: list[dict], path: list[tuple], at: int, ends: bool) -> Iterator[dict]:
    """Output rows of a run of turns; at: rendered turns before it."""
    for i, (t, (q, x, cost, y, merged)) in enumerate(zip(turns, path)):
        role, text = _role(t["role"]), t["text"] or ""
        piece = ""
        if merged:
            piece = "\n" + text
        else:
            piece += CLOSE if q else ""
            piece += _open(y) + CLOSE if y else ""
            piece += _open(x) + text
            at += 1 + bool(y)
        extra = ENDING[x] if ends and i == len(turns) - 1 else ()
        if ends and i == len(turns) - 1:
            piece += CLOSE + "".join(_open(z) + CLOSE for z in extra)
        action = ("merge" if merged else "insert" if y else "keep") + ("" if role == x else "+relabel")
        yield {"conv_id": conv, "turn": t["turn"], "role": t["role"], "new_role": ROLES[x - 1], "action": action, "cost": cost + INSERT * len(extra), "out_turn": at - 1, "piece": piece}


OUT = "conv_id long, turn long, role string, new_role string, action string, cost long, out_turn long, piece string"
_OUT = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("new_role", pa.string()), ("action", pa.string()), ("cost", pa.int64()), ("out_turn", pa.int64()), ("piece", pa.string())])
TURNS = "array<struct<turn:bigint,role:string,text:string>>"
PACKED = f"conv_id long, part int, seq int, whole boolean, prefix array<bigint>, effect array<bigint>, turns {TURNS}"


def _pack(block: int):
    """Blocks of a sorted partition. whole: the conversation has no turn in another block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, seen = TaskContext.get().partitionId(), 0, 0
        conv, held, cut, prefix = None, [], False, None
        rows: list[dict] = []

        def close(whole: bool) -> None:
            nonlocal seq, prefix, held
            effect = None if whole else _effect([_role(t["role"]) for t in held])
            rows.append({"conv_id": conv, "part": part, "seq": seq, "whole": whole, "prefix": None if whole else prefix.ravel().tolist(), "effect": None if whole else effect.ravel().tolist(), "turns": held})
            prefix = None if whole else times(prefix, effect)
            seq, held = seq + 1, []

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pylist(rows, schema=schema)
            rows.clear()
            return out

        schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int32()), ("whole", pa.bool_()), ("prefix", pa.list_(pa.int64())), ("effect", pa.list_(pa.int64())), ("turns", pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])))])
        for b in batches:
            for r in b.to_pylist():
                if not seen or r["conv_id"] != conv:
                    if seen:
                        # the first conversation of a partition may have begun in the one before
                        close(whole=not cut and seen > 1)
                    seen, conv, cut, prefix = seen + 1, r["conv_id"], False, _effect([])
                elif len(held) == block:
                    close(whole=False)
                    cut = True
                held.append({"turn": r["turn"], "role": r["role"], "text": r["text"]})
            if rows:
                yield flush()
        if seen:
            close(whole=False)  # the last one may go on in the next partition
        yield flush()

    return run


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    start = np.array([0, FAR, FAR, FAR], np.int64)
    for b in batches:
        rows = []
        for r in b.to_pylist():
            roles = [_role(t["role"]) for t in r["turns"]]
            costs, last = _trace(roles, start)
            _, path = _path(roles, costs, last, _final(last))
            rows += _rows(r["conv_id"], r["turns"], path, 0, True)
        yield pa.RecordBatch.from_pylist(rows, schema=_OUT)


def _entries(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one conversation's partitions: the costs of the states before each, and the state at the very end."""
    pdf = pdf.sort_values("part")
    d, out = np.array([0, FAR, FAR, FAR], np.int64), []
    for prefix, effect in zip(pdf["prefix"], pdf["effect"]):
        out.append(d.tolist())
        total = times(np.array(prefix).reshape(STATES, STATES), np.array(effect).reshape(STATES, STATES))
        d = np.minimum((d[:, None] + total).min(0), FAR)
    return pd.DataFrame({"part": pdf["part"].to_numpy(np.int32), "d": out, "final": np.full(len(pdf), _final(d), np.int32)})


def _back_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every block, for each state it may end in: the state it then began in (-1: none) and the turns it renders."""
    for b in batches:
        costs0, entry, count = [], [], []
        for r in b.to_pylist():
            roles = [_role(t["role"]) for t in r["turns"]]
            d = np.minimum((np.array(r["d"], np.int64)[:, None] + np.array(r["prefix"], np.int64).reshape(STATES, STATES)).min(0), FAR)
            costs, last = _trace(roles, d)
            e, c = [-1] * STATES, [0] * STATES
            for end in range(STATES):
                if last[end] < FAR:
                    e[end], path = _path(roles, costs, last, end)
                    c[end] = sum((not m[4]) + bool(m[3]) for m in path)
            costs0.append(d.tolist())
            entry.append(e)
            count.append(c)
        kind = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("part"), b.column("seq"), b.column("conv_id"), b.column("final"), pa.array(costs0, kind), pa.array(entry, kind), pa.array(count, kind)], names=["part", "seq", "conv_id", "final", "d", "entry", "count"])


def _part_map(pdf: pd.DataFrame) -> pd.DataFrame:
    """The map of a partition's blocks taken together."""
    entry, count = list(range(STATES)), [0] * STATES
    for e, c in zip(*(pdf.sort_values("seq", ascending=False)[k] for k in ("entry", "count"))):
        count = [n + c[q] if q >= 0 else n for q, n in zip(entry, count)]
        entry = [int(e[q]) if q >= 0 else -1 for q in entry]
    return pd.DataFrame({"part": pdf["part"].iloc[:1], "conv_id": pdf["conv_id"].iloc[:1], "final": pdf["final"].iloc[:1], "entry": [entry], "count": [count]})


def _walk(pdf: pd.DataFrame, key: str, end: int, at: int) -> pd.DataFrame:
    """States at the end of every row's stretch, and the rendered turns before it, from the last state and the first count."""
    pdf = pdf.sort_values(key)
    ends = [0] * len(pdf)
    for i in range(len(pdf) - 1, -1, -1):
        ends[i] = end
        end = int(pdf["entry"].iloc[i][end])
    n = np.array([int(c[q]) for c, q in zip(pdf["count"], ends)], np.int64)
    return pd.DataFrame({key: pdf[key].to_numpy(np.int32), "end": np.array(ends, np.int32), "at": at + np.cumsum(n) - n})


def _part_ends(pdf: pd.DataFrame) -> pd.DataFrame:
    out = _walk(pdf, "part", int(pdf["final"].iloc[0]), 0)
    out["last"] = out["part"] == out["part"].max()
    out["conv_id"] = pdf["conv_id"].iloc[0]
    return out[["conv_id", "part", "end", "at", "last"]]


def _block_ends(pdf: pd.DataFrame) -> pd.DataFrame:
    out = _walk(pdf, "seq", int(pdf["end"].iloc[0]), int(pdf["at"].iloc[0]))
    out["part"] = pdf["part"].iloc[0]
    out["last"] = (out["seq"] == out["seq"].max()) & bool(pdf["last"].iloc[0])
    return out[["part", "seq", "end", "at", "last"]]


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for r in b.to_pylist():
            roles = [_role(t["role"]) for t in r["turns"]]
            costs, last = _trace(roles, np.array(r["d"], np.int64))
            _, path = _path(roles, costs, last, r["end"])
            rows += _rows(r["conv_id"], r["turns"], path, r["at"], r["last"])
        yield pa.RecordBatch.from_pylist(rows, schema=_OUT)


def repair_roles(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, turn, role, new_role, action, cost, out_turn, piece of every row of turns (conv_id, turn, role, text)."""
    rows = bounded_batches(turns).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    # ranges and the order inside them share one key; its hash keeps whole texts out of the sample that bounds ranges
    tie = F.xxhash64("role", "text")
    ordered = rows.repartitionByRange("conv_id", "turn", tie).sortWithinPartitions("conv_id", "turn", tie, "role", "text")
    blocks = materialise(ordered.mapInArrow(_pack(block), PACKED), "turns")
    done = blocks.where("whole").select("conv_id", "turns").mapInArrow(_whole, OUT)

    long_ = blocks.where("not whole")
    # a partition's last block carries the product of those before it: one row a conversation and partition
    meta = long_.select("conv_id", "part", "seq", "prefix", "effect")
    last = meta.groupBy("conv_id", "part").agg(F.max(F.struct("seq", "prefix", "effect")).alias("m")).select("conv_id", "part", "m.prefix", "m.effect")
    entries = last.groupBy("conv_id").applyInPandas(lambda key, pdf: _entries(pdf).assign(conv_id=pd.array([key[0]] * len(pdf), "Int64"))[["conv_id", "part", "d", "final"]], "conv_id long, part int, d array<bigint>, final int")
    same = lambda a, b: a["conv_id"].eqNullSafe(b["conv_id"]) & (a["part"] == b["part"])
    known = long_.join(entries, same(long_, entries)).select(long_["conv_id"], long_["part"], "seq", "prefix", "turns", "d", "final")
    maps = materialise(known.mapInArrow(_back_maps, "part int, seq int, conv_id long, final int, d array<bigint>, entry array<bigint>, count array<bigint>"), "maps")
    parts = maps.groupBy("conv_id", "part").applyInPandas(_part_map, "part int, conv_id long, final int, entry array<bigint>, count array<bigint>")
    part_ends = parts.groupBy("conv_id").applyInPandas(_part_ends, "conv_id long, part int, end int, at long, last boolean")
    placed = maps.join(part_ends, same(maps, part_ends)).select(maps["conv_id"], maps["part"], "seq", "entry", "count", "end", "at", "last")
    block_ends = placed.groupBy("conv_id", "part").applyInPandas(_block_ends, "part int, seq int, end int, at long, last boolean")
    states = maps.select("part", "seq", "d").join(block_ends, ["part", "seq"])
    rest = long_.select("conv_id", "part", "seq", "turns").join(states, ["part", "seq"]).select("conv_id", "turns", "d", "end", "at", "last").mapInArrow(_finish, OUT)
    return done.unionByName(rest)
