"""Exchanges between batches of rows and partitions of a hash space, a few large rows instead of one a word.

A batch is a slice of a partition as it is read, named by partition and number.  Its keys go to the
partitions of a hash space as packed arrays, and the answers come back to the batch, which is read
again and joined with them.  So the rows that Spark shuffles are blocks of bounded size, and a
frequent key costs one entry a batch at most.  Reading must be repeatable: each batch's digest
travels with its rows, and a mismatch raises an error instead of giving wrong results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import U64, buffers, mix, slices

#: Bytes of text in a batch, and of all texts for each partition of a hash space.  A batch has a row for each partition, so
#: S bytes of text make S / BATCH_BYTES * S / PART_BYTES rows.  Both are bounded by a worker's memory: some 30 bytes for each
#: byte of a batch, and 7 for each byte of a partition.
BATCH_BYTES, PART_BYTES = 2 << 20, 32 << 20


def numbered(batches: Iterator[pa.RecordBatch], column: str, most: int = BATCH_BYTES) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Slices with their batch numbers."""
    at = TaskContext.get().partitionId() << 32
    for k, b in enumerate(slices(batches, column, most)):
        yield at | k, b


def digest(b: pa.RecordBatch, column: str) -> int:
    """A number that tells whether two readings gave the same texts in the same order."""
    data, off = buffers(b.column(column))
    full = data[: len(data) // 8 * 8].view(U64) if len(data) else np.zeros(0, U64)
    x = np.concatenate([mix(full * U64(3) + np.arange(len(full), dtype=U64)), mix(off.astype(U64))]).sum(dtype=U64)
    return int(np.asarray(x, U64).view(np.int64))


def pack(sorted_values: np.ndarray) -> bytes:
    """Ascending unsigned integers as differences, byte plane by byte plane (small differences compress)."""
    d = np.diff(sorted_values, prepend=sorted_values.dtype.type(0))
    return d.view(np.uint8).reshape(-1, d.itemsize).T.tobytes()


def unpack(data: bytes, kind=np.uint32) -> np.ndarray:
    width = np.dtype(kind).itemsize
    d = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()
    return np.cumsum(d, dtype=kind)


def place(h: np.ndarray, parts: int) -> np.ndarray:
    """Partition (upper half) and 32-bit value (lower half) of hashes, as one sortable number."""
    return (((h >> U64(32)) * U64(parts)) & U64(0xFFFFFFFF00000000)) | (h & U64(0xFFFFFFFF))


def by_part(keys: np.ndarray, parts: int) -> np.ndarray:
    """Bounds of each partition in ascending placed keys."""
    return np.searchsorted(keys, np.arange(parts + 1, dtype=U64) << U64(32))


def stored(df: DataFrame, column: str) -> DataFrame:
    """batch, digest, rows: every batch as one row, compressed."""

    def run(batches):
        for k, b in numbered(batches, column):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_batch(b)
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([digest(b, column)]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["batch", "digest", "rows"])

    return df.mapInArrow(run, "batch long, digest long, rows binary")


def restored(left: pa.Table, right: pa.Table) -> pa.RecordBatch:
    """The rows of a batch, after the check of what came back for it."""
    if left.num_rows != 1 or set(right.column("digest").to_pylist()) - set(left.column("digest").to_pylist()):
        raise RuntimeError("the input gave other batches when it was read again; write it as a table first")
    t = pa.ipc.open_stream(pa.BufferReader(left.column("rows")[0].as_buffer())).read_all().combine_chunks()
    return t.to_batches()[0]


def parts_for(df: DataFrame, column: str, bytes_each: int = PART_BYTES, most: int | None = None) -> int:
    """Partitions of the hash space: by the size of the texts, and twice Spark's own number at least.

    ``most`` is for work that reads a partition as a stream and so needs no bound on its size.
    """
    spark = df.sparkSession
    total = df.agg(F.sum(F.octet_length(column))).first()[0] or 0
    parts = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // bytes_each))
    return parts if most is None else min(parts, most)
