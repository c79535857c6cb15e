"""Folds over the rows of a key in their order, where each step depends on the ones before.

Rows are sorted inside partitions and walked batch by batch; what is held is a batch and the fold's own state of one
key (the keys it has taken, the best row so far), never a key's rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, types as T


def filtered(df: DataFrame, by: str, order: Sequence[Column | str], columns: Sequence[str], start: Callable[[], Callable[..., object]], drop: Sequence[str] = (), added: T.StructField | None = None) -> DataFrame:
    """The rows of df that a fold keeps, without the columns of drop.

    start() gives a new fold for every key; it is called with the columns' values of each row in order and returns
    what the row's added column holds, or a true value, for rows to keep, else None or False.
    """
    kept = [f for f in df.schema if f.name not in drop]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, *([added] if added else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, step = object(), None
        for b in batches:
            found = []
            for key, *values in zip(*(b.column(c).to_pylist() for c in (by, *columns))):
                if key != at:
                    at, step = key, start()
                found.append(step(*values))
            mask = pa.array([x is not None and x is not False for x in found], pa.bool_())
            out = [b.column(c).filter(mask) for c in names]
            if added:
                out.append(pa.array([x for x in found if x is not None and x is not False], schema_type))
            yield pa.RecordBatch.from_arrays(out, names=[*names, *([added.name] if added else [])])

    schema_type = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[added.dataType.simpleString()] if added else None
    return df.repartition(by).sortWithinPartitions(by, *order).mapInArrow(run, schema)


def reduced(df: DataFrame, by: str, order: Sequence[Column | str], columns: Sequence[str], better: Callable[[tuple, tuple], bool], result: str) -> DataFrame:
    """(by, result) of the row of every key that is left when each row in order takes the place of the best so far if better(row, best); rows are tuples of columns."""
    schema = T.StructType([df.schema[by], df.schema[result]])
    wanted = list(columns).index(result)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, best, types = None, None, None
        for b in batches:
            types = [b.column(by).type, b.column(result).type]
            keys, values = [], []
            for key, *row in zip(*(b.column(c).to_pylist() for c in (by, *columns))):
                if best is not None and key != at:
                    keys.append(at)
                    values.append(best[wanted])
                    best = None
                at = key
                if best is None or better(tuple(row), best):
                    best = tuple(row)
            yield pa.RecordBatch.from_arrays([pa.array(keys, types[0]), pa.array(values, types[1])], names=[by, result])
        if best is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], types[0]), pa.array([best[wanted]], types[1])], names=[by, result])

    return df.repartition(by).sortWithinPartitions(by, *order).mapInArrow(run, schema)
