"""Stateful stream operators that judge the rows of a key in the order of their times.

Rows wait in state until the watermark has passed them, so rows that come out of order within
the watermark's delay are judged as if they had not; what waits is bounded by the delay. Keys
are dealt over buckets, each with one state, since a visit to a state costs far more than a
row; a task holds one bucket's waiting rows and memory at a time. State lives in the state
store (RocksDB, which these processors need) and in the checkpoint, so a restarted query goes
on where it stopped (with the same number of buckets).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import zip_longest

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Rows in an entry of a list state.
ENTRY = 10_000

#: Entries of a bucket's memory, one a visit, beyond twice those needed, before it is written anew.
ENTRIES = 16

#: Buckets over which keys are dealt.
BUCKETS = 1024


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that keyed processors need, for the session's queries started from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class _Rows:
    """Rows of a bucket in a list state, many an entry: an entry a row would cost more than the row."""

    def __init__(self, handle: StatefulProcessorHandle, name: str):
        self.state = handle.getListState(name, "rows string")

    def read(self) -> list[list]:
        found = [json.loads(e[0]) for e in self.state.get()]
        out = [r for rows in found for r in rows]
        self.scattered = len(found) >= ENTRIES + 2 * len(out) // ENTRY
        return out

    def append(self, rows: list) -> None:
        # one by one, so that no message holds more than an entry
        for k in range(0, len(rows), ENTRY):
            self.state.appendValue((json.dumps(rows[k : k + ENTRY]),))

    def put(self, rows: list) -> None:
        self.state.clear()
        self.append(rows)


class _InOrder(StatefulProcessor):
    """Hands rows (key, microseconds, tie breaker, ...) that the watermark has passed to `judge`, in the order of the second and third.

    What a subclass remembers of its keys is a dict by key, which `learn` makes of records (key, ...), oldest first, and
    `records` puts back into such; `judge` changes it and returns the rows found and the records that are new.
    """

    names = ["us", "o"]

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting, self.memory, self.last = (_Rows(handle, n) for n in ("waiting", "memory", "last"))
        self.wake = handle.getValueState("wake", "ms long")

    def learn(self, records: list) -> dict:
        raise NotImplementedError

    def records(self, memory: dict) -> list:
        raise NotImplementedError

    def judge(self, rows: list, memory: dict) -> tuple[list, list]:
        raise NotImplementedError

    def handleInputRows(self, bucket, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for some in rows:
            own = list(some.astype(object).where(some.notna(), None).itertuples(index=False, name=None))
            self.waiting.append(own)
            first = min([int(r[1]) for r in own] + ([] if first is None else [first]))
        if first is not None:
            # a bucket has one timer, for the first of all that it waits for
            ms, now = -(-first // 1000), self.wake.get()
            if now is None or ms < now[0]:
                if now is not None:
                    self.handle.deleteTimer(now[0])
                self._wake_at(ms)
        return iter(())

    def _wake_at(self, ms: int) -> None:
        self.handle.registerTimer(ms)
        self.wake.update((ms,))

    def handleExpiredTimer(self, bucket, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        passed = now * 1000
        rows = self.waiting.read()
        later = [r for r in rows if r[1] > passed]
        due = sorted((r for r in rows if r[1] <= passed), key=lambda r: r[1:3])
        if due:
            self.waiting.put(later)
        memory = self.learn(self.memory.read())
        out, new = self.judge(due, memory)
        gone, wake = [], [-(-min(int(r[1]) for r in later) // 1000)] if later else []
        if self.idle_ms is not None:
            last, busy = dict(self.last.read()), {r[0] for r in rows}
            gone = [k for k, us in last.items() if k not in busy and us + self.idle_ms * 1000 <= passed]
            for k in gone:
                del last[k]
                memory.pop(k, None)
            last |= {r[0]: int(r[1]) for r in due}
            if due or gone:
                self.last.put(list(last.items()))
            # what this timer left is up to a later one: a timer of now would go with it
            wake += [max(now + 1, min(last.values()) // 1000 + self.idle_ms)] if last else []
        if gone or (new and self.memory.scattered):
            self.memory.put(self.records(memory))
        else:
            self.memory.append(new)
        if wake:
            self._wake_at(min(wake))
        else:
            self.wake.clear()
        if out:
            yield pd.DataFrame(out, columns=self.names)

    def close(self) -> None:
        pass


class _ClosedSet(_InOrder):
    """Rows of (key, microseconds, order, url, pair) whose url and pair were not kept before for the key."""

    def learn(self, records: list) -> dict:
        seen = {}
        for key, *keys in records:
            for old, k in zip(seen.setdefault(key, (set(), set())), keys):
                if k:
                    old.add(k)
        return seen

    def records(self, memory: dict) -> list:
        return [(key, *keys) for key, seen in memory.items() for keys in zip_longest(*seen)]

    def judge(self, rows: list, memory: dict) -> tuple[list, list]:
        out, new = [], []
        for key, us, o, url, pair in rows:
            urls, pairs = memory.setdefault(key, (set(), set()))
            if url in urls or pair in pairs:
                continue
            out.append((us, o))
            if url:
                urls.add(url)
            if pair:
                pairs.add(pair)
            if url or pair:
                new.append((key, url, pair))
        return out, new


class _Sampler(_InOrder):
    """Rows of (key, microseconds, order) at or after the key's next tick, which moves on by one period a row taken."""

    def __init__(self, idle_ms: int | None, start_us: int, period_us: int):
        super().__init__(idle_ms)
        self.start_us, self.period_us = start_us, period_us

    def learn(self, records: list) -> dict:
        return {key: n for key, n in records}

    def records(self, memory: dict) -> list:
        return list(memory.items())

    def judge(self, rows: list, memory: dict) -> tuple[list, list]:
        out, changed = [], set()
        for key, us, o in rows:
            n = memory.get(key, 0)
            if us - self.start_us >= n * self.period_us:
                memory[key] = n + 1
                changed.add(key)
                out.append((us, o))
        return out, [(key, memory[key]) for key in changed]


def _run(stream: DataFrame, key: str, ts: str, delay: str, columns: list[Column], make: Callable[[], _InOrder], buckets: int) -> DataFrame:
    use_rocksdb(stream.sparkSession)
    # text, since a null would make doubles of long keys
    text = F.col(key).cast("string")
    bucket = F.pmod(F.xxhash64(text), F.lit(buckets)).alias("bucket")
    # no watermark passes a row without a time
    rows = stream.where(F.col(ts).isNotNull()).withWatermark(ts, delay).select(bucket, F.col(ts), text.alias("key"), F.unix_micros(ts).alias("us"), *columns)
    names = [c for c in rows.columns if c not in ("bucket", ts)]
    found = rows.groupBy("bucket").transformWithStateInPandas(_Named(make(), names), "us long, o long", "append", "EventTime")
    return found.select(F.timestamp_micros("us").alias("ts"), F.col("o").alias("order"))


class _Named(StatefulProcessor):
    """A processor that sees the named columns alone."""

    def __init__(self, inner: _InOrder, names: list[str]):
        self.inner, self.names = inner, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.inner.init(handle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        return self.inner.handleInputRows(key, (r[self.names] for r in rows), timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return self.inner.handleExpiredTimer(key, timerValues, expiredTimerInfo)

    def close(self) -> None:
        self.inner.close()


def closed_set(stream: DataFrame, key: str, ts: str, order: str, url: Column, pair: Column, delay: str, idle_seconds: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """(ts, order) of a key's rows whose url and whose pair were both not kept before, in the order of ts and order (a unique number).

    Empty and null urls and pairs never match. Keys are told apart by their text. With idle_seconds, a key's sets are forgotten
    once the watermark is that far beyond its last row. A task holds the sets of one of `buckets` at a time, and a trigger
    reads those of every bucket that has rows due.
    """
    return _run(stream, key, ts, delay, [F.col(order).cast("long").alias("o"), url.cast("string").alias("url"), pair.cast("string").alias("pair")], lambda: _ClosedSet(idle_seconds and idle_seconds * 1000), buckets)


def tick_sampler(stream: DataFrame, key: str, ts: str, order: str, start_us: int, period_us: int, delay: str, idle_seconds: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """(ts, order) of the rows that a sampler takes whose next tick, at first start_us, moves on by one period a row taken, never more."""
    return _run(stream, key, ts, delay, [F.col(order).cast("long").alias("o")], lambda: _Sampler(idle_seconds and idle_seconds * 1000, start_us, period_us), buckets)
