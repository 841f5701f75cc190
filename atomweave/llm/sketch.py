"""Count sketches of fixed size: one counter per hash bucket, summed over all rows of all tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Counters in one row of a sketch table.
CHUNK = 1 << 14


def chunks(counts: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """The chunks of a counter array that are not all zero."""
    for i in range(0, len(counts), CHUNK):
        if (part := counts[i : i + CHUNK]).any():
            yield i // CHUNK, part.astype("<i8").tobytes()


def _sum(table: pa.Table) -> pa.Table:
    total = np.zeros(CHUNK, np.int64)
    for blob in table["counts"].to_pylist():
        total += np.frombuffer(blob, "<i8")
    return pa.table({"chunk": table["chunk"].slice(0, 1).cast(pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})


def merged(parts: DataFrame, bits: int) -> np.ndarray:
    """Sum ``(chunk, counts)`` rows to one array of ``2**bits`` counters: 8 bytes each whatever the number of rows.

    Rows are first summed in groups of a task's size, so no task reads every part of a chunk of a large run.
    """
    step = parts.withColumn("g", F.pmod(F.xxhash64("counts"), F.lit(16)))
    step = step.groupBy("chunk", "g").applyInArrow(_sum, "chunk int, counts binary")
    out = np.zeros(max(1 << bits, CHUNK), np.int64)
    for row in step.groupBy("chunk").applyInArrow(_sum, "chunk int, counts binary").collect():
        out[row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] = np.frombuffer(row["counts"], "<i8")
    return out[: 1 << bits]


def id_table(ids: DataFrame, bits: int = 20) -> np.ndarray:
    """One flag per hash bucket that holds one of the 64-bit ids in the only column: a filter without false negatives."""

    def flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(max(1 << bits, CHUNK), np.int64)
        for batch in batches:
            counts[bucket(batch.column(0).drop_null().to_numpy(zero_copy_only=False), bits)] = 1
        for chunk, blob in chunks(counts):
            yield pa.record_batch({"chunk": pa.array([chunk], pa.int32()), "counts": pa.array([blob], pa.binary())})

    return merged(ids.mapInArrow(flags, "chunk int, counts binary"), bits) > 0


def bucket(ids: np.ndarray, bits: int) -> np.ndarray:
    from atomweave.llm.text import mix

    return (mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


Kernel = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
