"""Global dictionaries of distinct words: positions stay with their batch, each word travels once a batch.

``spell`` cuts texts into words and writes a table with two kinds of rows.  A batch row (``p`` = -1) has the
rows of a batch of texts and, for every word position in them, the number of the word in the batch's own list
(frequent words have small numbers, so the packed positions compress well).  A word row has the batch's
words that fall into partition ``p`` of the hash space.  A word that fills a third of a corpus is one entry a
batch, and no key collects more than the batches' entries of one partition.  What is found for a partition's
words comes back to the batches by ``answered``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .batches import numbered
from .scratch import written
from .words import U64

#: Bytes of text in a batch: of a written table, and of an exchange of words as text.
SLICE, EXCHANGED = 8 << 20, 4 << 20
SCHEMA = "p int, batch long, a binary, b binary, c binary"
WIDE_SCHEMA = SCHEMA.replace("p int", "p long")


def squeeze(values: np.ndarray) -> bytes:
    """An array, byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if len(values) else b""


def spread(data: bytes, kind) -> np.ndarray:
    if not data:
        return np.zeros(0, kind)
    n, width = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    raw = pa.decompress(data[8:], decompressed_size=n * width, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).view(kind).ravel()


def rows_out(b: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(b)
    return sink.getvalue().to_pybytes()


def rows_in(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(pa.py_buffer(data)).read_all().combine_chunks().to_batches()[0]


def record(p: int, batch: int, a: bytes, b: bytes, c: bytes) -> tuple:
    return p, batch, a, b, c


def records(rows: list[tuple], key: pa.DataType = pa.int32()) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
    kinds = (key, pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["p", "batch", "a", "b", "c"])


def by_partition(keys: np.ndarray, parts: int) -> list[tuple[int, np.ndarray]]:
    """(partition, indices of its keys) of hashed keys."""
    p = ((keys >> U64(32)) * U64(parts) >> U64(32)).astype(np.int64)
    order = np.argsort(p, kind="stable")
    cut = np.flatnonzero(np.diff(p[order])) + 1
    return [(int(p[g[0]]), g) for g in np.split(order, cut) if len(g)]


def spell(docs: DataFrame, cut: Callable[[pa.RecordBatch, int], list[tuple]], column: str = "text", size: int = SLICE) -> DataFrame:
    """The written table; ``cut`` makes the records of one batch."""

    def run(batches):
        for k, b in numbered(batches, column, size):
            yield records(cut(b, k))

    return written(docs.mapInArrow(run, SCHEMA), "lexicon")


def exchanged(docs: DataFrame, cut: Callable[[pa.RecordBatch, int], list[tuple]], column: str = "text") -> DataFrame:
    """The same rows in one exchange by ``p`` instead of a table; for a batch row, p is -1 less its number.

    Who answers the words and who waits for the answers both group by ``p``, without a filter that could be pushed down, so Spark
    reuses the exchange.
    """

    def run(batches):
        for k, b in numbered(batches, column, EXCHANGED):
            yield records([(-1 - k if p < 0 else p, *rest) for p, *rest in cut(b, k)], pa.int64())

    return docs.mapInArrow(run, WIDE_SCHEMA).repartition("p")


def answered(batch_rows: DataFrame, answers: DataFrame, finish: Callable[[tuple, list[tuple]], pa.Table], schema: str) -> DataFrame:
    """``finish`` of every batch row and the answers to its words; both sides have SCHEMA."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        own, back = ([tuple(r.values()) for r in t.to_pylist()] for t in (left, right))
        if len(own) != 1:
            raise RuntimeError(f"{len(own)} rows of one batch")
        return finish(own[0], back)

    return batch_rows.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(run, schema)
