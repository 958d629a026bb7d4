"""Sums of fixed-size arrays over all partitions of a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def partition_sums(docs: DataFrame, sums: Callable[[Iterator[pa.RecordBatch]], np.ndarray], size: int, block: int = 12_288, fan_in: int = 64) -> np.ndarray:
    """The sum over the partitions of ``docs`` of ``sums(batches)``, a float array of ``size`` cells.

    Each task sums its whole partition. The tasks' arrays are cut into blocks and added up ``fan_in`` at a time, in as
    many rounds as that takes, so that no task holds more than ``fan_in`` blocks. The result has a fixed size.
    """
    blocks = -(-size // block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(blocks * block)
        total[:size] = sums(batches)
        part = TaskContext.get().partitionId()
        columns = [pa.array(range(blocks), pa.int32()), pa.array([part] * blocks, pa.int32()), pa.array([b.tobytes() for b in total.reshape(blocks, -1)], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["block", "part", "sums"])

    def merge(key, table):
        total = sum(np.frombuffer(x.as_py()) for x in table.column("sums"))
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    schema = "block int, part int, sums binary"
    partial = docs.mapInArrow(run, schema)
    parts = max(1, docs.rdd.getNumPartitions())
    while parts > 1:
        partial = partial.withColumn("part", F.floor(F.col("part") / fan_in).cast("int")).groupBy("block", "part").applyInArrow(merge, schema)
        parts = -(-parts // fan_in)
    out = np.zeros(blocks * block)
    for row in partial.collect():
        out[row["block"] * block : (row["block"] + 1) * block] += np.frombuffer(row["sums"])
    return out[:size]
