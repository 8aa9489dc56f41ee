"""Sums of vectors by key, in Arrow tasks.

Every task adds up what it holds in one table of bounded size, so a hot key leaves it as
one row. Rows of a key then come together sorted and are added up in a stream. There
is no column per component, so any dimension works alike.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

#: bytes of sums a task holds before it hands them on
TABLE_BYTES = 32 << 20

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no copy of this package


class _Sums:
    """Sums and row counts by key, in the order keys come."""

    def __init__(self):
        self.index: dict[tuple, int] = {}
        self.sums, self.counts = np.zeros((0, 0)), np.zeros(0, np.int64)

    def add(self, keys: list[tuple], rows: np.ndarray, counts: np.ndarray) -> None:
        ids = np.fromiter((self.index.setdefault(k, len(self.index)) for k in keys), np.int64, len(keys))
        if len(self.sums) < len(self.index):
            room = max(2 * len(self.sums), len(self.index))
            grown = np.zeros((room, rows.shape[1]))
            grown[: len(self.sums)] = self.sums.reshape(-1, rows.shape[1])
            self.sums, self.counts = grown, np.concatenate([self.counts, np.zeros(room - len(self.counts), np.int64)])
        order = ids.argsort(kind="stable")
        starts = np.flatnonzero(np.append(True, np.diff(ids[order]) != 0))
        at = ids[order][starts]
        self.sums[at] += np.add.reduceat(rows[order], starts, axis=0)
        self.counts[at] += np.add.reduceat(counts[order], starts)

    def take(self, fields: list[pa.Field], vec: str, keep_last: bool) -> pa.RecordBatch:
        """All sums, or all but those of the last key, which go on."""
        n = len(self.index) - keep_last
        keys = list(self.index)
        dim = self.sums.shape[1]
        lists = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * dim, pa.array(self.sums[:n].ravel()))
        out = pa.RecordBatch.from_arrays([*[pa.array([k[i] for k in keys[:n]], f.type) for i, f in enumerate(fields)], pa.array(self.counts[:n]), lists],
                                         [*[f.name for f in fields], "n", vec])
        last, sums, counts = keys[n:], self.sums[n : n + 1].copy(), self.counts[n : n + 1].copy()
        self.__init__()
        if keep_last:
            self.add(last, sums, counts)
        return out


def _added(keys: list[str], vec: str, in_order: bool):
    """Adds up a partition; ``in_order`` means that rows of a key come one after another, with their counts."""
    def run(batches):
        held, fields = _Sums(), []
        for batch in batches:
            if not batch.num_rows:
                continue
            fields = [batch.schema.field(k) for k in keys]
            columns = [batch.column(k).to_pylist() for k in keys]
            rows = batch.column(vec).flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(batch.num_rows, -1)
            counts = batch.column("n").to_numpy() if in_order else np.ones(batch.num_rows, np.int64)
            held.add(list(zip(*columns)) if keys else [()] * batch.num_rows, rows, counts)
            if held.sums.nbytes > TABLE_BYTES:
                yield held.take(fields, vec, keep_last=in_order)
        if held.index:
            yield held.take(fields, vec, keep_last=False)
    return run


def vector_sums(df: DataFrame, keys: list[str], vec: str, combine: bool = True) -> DataFrame:
    """``(keys.., n, vec)``: the number and the sum, in double precision, of the vectors of each key.

    Vectors have one length; null ones do not count. Without keys, or without rows, there
    is one row, or none. Without ``combine`` rows go to their key as they are, for input whose
    tasks hold a key once.
    """
    schema = StructType([*[df.schema[k] for k in keys], StructField("n", LongType()), StructField(vec, ArrayType(DoubleType()))])
    parts = df.filter(F.col(vec).isNotNull()).select(*keys, vec)
    if combine:
        parts = parts.mapInArrow(_added(keys, vec, False), schema)
    else:
        parts = parts.select(*keys, F.lit(1).cast("bigint").alias("n"), vec)
    together = parts.repartition(*keys).sortWithinPartitions(*keys) if keys else parts.repartition(1)
    return together.mapInArrow(_added(keys, vec, True), schema)
