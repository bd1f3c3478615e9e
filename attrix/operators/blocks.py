"""Rows packed into blocks for iterative fits.

A fit that sweeps the same rows many times reads them as blocks of a few thousand rows: one matrix a block instead of one
Python object a row. Blocks are written to the shared folder once and kept by the executors from then on; a lost executor
reads its blocks again. A sweep sends a bounded value to every block and adds up fixed-size sums, per partition first and
then in a tree, so neither the driver nor one task sees more than a few partitions' sums at once. Where only a choice made from
large sums is wanted, ``reduced`` makes it on the executors: what the driver gets doesn't grow with the partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir

BLOCK_ROWS = 2048
#: Rows of a partition, so that small tables don't pay for many tasks a sweep.
PARTITION_ROWS = 1 << 16
#: Up to so many partitions a sweep's sums are added in one step.
FLAT = 32

_SCHEMA = "n int, x binary, other binary"


def _packed(batches: Iterator[pa.RecordBatch], width: int, others: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def block() -> pa.RecordBatch:
        nonlocal held, size
        x, other = (np.concatenate(part) for part in zip(*held))
        held, size = [], 0
        return pa.RecordBatch.from_pydict({"n": pa.array([len(x)], pa.int32()), "x": [x.tobytes()], "other": [other.tobytes()]})

    for batch in batches:
        flat = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        x = flat.reshape(batch.num_rows, width)
        other = np.column_stack([batch.column(1 + k).to_numpy(zero_copy_only=False).astype(np.float64) for k in range(others)])
        for at in range(0, len(x), BLOCK_ROWS):
            held.append((x[at:at + BLOCK_ROWS], other[at:at + BLOCK_ROWS]))
            size += len(held[-1][0])
            if size >= BLOCK_ROWS:
                yield block()
    if held:
        yield block()


def packed_rows(df: DataFrame, features: str, others: Sequence[str], width: int, rows: int | None = None) -> RDD:
    """(matrix, columns) of every block: ``features`` (an array of ``width`` doubles) and the numeric columns ``others``.

    A null element or value is NaN. The blocks are stored in the shared folder and kept in the executors' memory and disk;
    call ``unpersist`` on the result when done.
    """
    spark = df.sparkSession
    narrow = df.select(F.col(features).alias("x"), *[F.col(c).cast("double").alias(f"o{k}") for k, c in enumerate(others)])
    parts = None if rows is None else max(1, -(-rows // PARTITION_ROWS))
    n = len(others)
    shared_dir(spark)
    blocks = (narrow.coalesce(1) if parts == 1 else narrow).mapInArrow(lambda it: _packed(it, width, n), _SCHEMA)
    if parts is not None and parts > 1:
        blocks = blocks.repartition(parts)  # whole blocks, dealt out evenly: a sweep takes as long as its longest task
    blocks = blocks.checkpoint()
    return blocks.rdd.map(lambda r: (np.frombuffer(r["x"]).reshape(r["n"], width), np.frombuffer(r["other"]).reshape(r["n"], n))
                          ).persist(StorageLevel.MEMORY_AND_DISK)


def total(blocks: RDD, sums: Callable) -> np.ndarray | None:
    """The sum of ``sums(block)`` (arrays of one shape) over all blocks, None without blocks."""
    parts = blocks.mapPartitions(lambda it: _added(sums(b) for b in it))
    if parts.getNumPartitions() <= FLAT:
        got = list(_added(iter(parts.collect())))
    else:
        got = [parts.map(lambda a: (True, a)).treeAggregate((False, 0.0), _combine, _combine)]
        got = [got[0][1]] if got[0][0] else []
    return got[0] if got else None


def reduced(blocks: RDD, sums: Callable, finish: Callable, pieces: int) -> list:
    """``finish(k, part)`` of the ``pieces`` runs of rows of the sum of ``sums(block)`` over all blocks, in order; [] without blocks.

    A piece is added up in one task, ``FLAT`` partitions' parts at a time and in their order, so that a repeated sweep gives
    the same bits. Runs are those of ``np.array_split``.
    """
    def cut(at: int, it: Iterator) -> Iterator:
        for whole in _added(sums(b) for b in it):
            for k, part in enumerate(np.array_split(whole, pieces)):
                yield (k, at // FLAT), (at, part)

    def joined(parts) -> np.ndarray:
        return reduce(lambda a, b: a + b, (v for _, v in sorted(parts, key=lambda p: p[0])))

    groups = -(-blocks.getNumPartitions() // FLAT)
    tasks = min(pieces * max(1, groups), 2 * blocks.context.defaultParallelism)
    parts = blocks.mapPartitionsWithIndex(cut).groupByKey(tasks).mapValues(joined)
    while groups > 1:
        parts = parts.map(lambda kv: ((kv[0][0], kv[0][1] // FLAT), (kv[0][1], kv[1]))).groupByKey(tasks).mapValues(joined)
        groups = -(-groups // FLAT)
    return [v for _, v in sorted(parts.map(lambda kv: (kv[0][0], finish(kv[0][0], kv[1]))).collect(), key=lambda kv: kv[0])]


def _combine(a: tuple, b: tuple) -> tuple:
    if not (a[0] and b[0]):
        return b if b[0] else a
    return True, a[1] + b[1]


def _added(values: Iterator) -> Iterator:
    first = next(values, None)
    if first is not None:
        yield reduce(lambda a, b: a + b, values, first)
