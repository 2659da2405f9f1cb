"""Repeated passages (operator 2): fixed-block anchors.

Every document's words are cut into blocks of ``BLOCK`` words that do not overlap; these are the
index.  Any window of ``WINDOW`` >= 2 * BLOCK - 1 words holds a whole block of each document in which
it occurs, so a window that two documents share has, in either document, a rolling run of BLOCK words
that equals an indexed block of the other.  All rolling runs probe the index, as 32-bit values in a
partition of the hash space (values that agree by chance only cost work).  Around the hits, windows
are extended to whole WINDOW-word runs, known by two independent 64-bit hashes; for each the least
doc_id is found, and overlapping removed windows join up to the maximal exact repeats.

Groups are never expanded: a run sends one entry for each batch of documents.  A window comes back to a
batch only if another has it in a smaller document than all of this batch's: then it goes from all of
them, so no id comes back.  Text is shuffled once, compressed, by batch.

Defined results: null and empty texts and texts of fewer than WINDOW words lose nothing.  Rows that
share a doc_id don't remove from each other.  A null doc_id counts as larger than all others.  An empty
table gives an empty table.  Other columns stay as they are; one that has the name of a result gives way to it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import by_part, digest, numbered, pack, parts_for, place, restored, stored, unpack
from .lexicon import spread, squeeze
from .words import U64, Words

BLOCK, WINDOW = 25, 50
_LAST = np.iinfo(np.int64).max


def _ids(b: pa.RecordBatch, id_col: str) -> np.ndarray:
    return b.column(id_col).cast(pa.int64()).fill_null(_LAST).to_numpy(zero_copy_only=False)


def _probes(w: Words, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and placed keys of rolling blocks, which of them are indexed, and the words' hashes."""
    h = w.hashes()
    at, block = w.windows(h, BLOCK)
    fixed = (at - w.off[w.doc()[at]]) % BLOCK == 0
    return at, place(block, parts), fixed, h


def _shared(left: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of left are among the ascending keys."""
    if not len(keys):
        return np.zeros(len(left), bool)
    return keys[np.minimum(np.searchsorted(keys, left), len(keys) - 1)] == left


class Windows:
    """Distinct pairs of hashes, ascending, and the least id of each."""

    def __init__(self, first: np.ndarray, second: np.ndarray, ids: np.ndarray):
        order = np.lexsort((ids, second, first))
        a, b = first[order], second[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        self.first, self.second, self.least = a[new], b[new], ids[order][new]
        #: of each given pair, its place among the distinct ones
        self.at = np.empty(len(a), np.int64)
        self.at[order] = np.cumsum(new) - 1

    def find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Places of pairs that are there."""
        at = np.searchsorted(self.first, first)
        while len(wrong := np.flatnonzero(self.second[at] != second)):  # first hashes that agree by chance
            at[wrong] += 1
        return at


def _first(window: np.ndarray, bits: int) -> np.ndarray:
    return window >> U64(64 - bits) << U64(64 - bits)


def shared_windows(docs: DataFrame, batches: DataFrame, id_col: str, text_col: str, bits: int = 64) -> DataFrame:
    """batch, digest, keys, second: windows of a batch that occur in another batch, in a smaller document than any of its own.

    ``batches``: what ``stored`` makes of docs, dealt by batch.  A window that two batches share has a hit wherever it occurs, so the least id that a batch sends for it is that of all its documents.
    ``bits`` of windows' first hashes are kept: less than 64 only to test what chance does.
    """
    parts = parts_for(docs, text_col)

    def probe(rows):
        for k, b in numbered(rows, text_col):
            _, keys, fixed, _ = _probes(Words(b.column(text_col)), parts)
            index, all_ = np.unique(keys[fixed]), np.unique(keys)
            ib, pb = by_part(index, parts), by_part(all_, parts)
            low, full = U64(0xFFFFFFFF), np.flatnonzero(np.diff(pb))
            yield pa.RecordBatch.from_pydict({
                "p": pa.array(full, pa.int32()), "batch": pa.array(np.full(len(full), k)), "digest": pa.array(np.full(len(full), digest(b, text_col))),
                "probes": pa.array([pack((all_[pb[p] : pb[p + 1]] & low).astype(np.uint32)) for p in full], pa.binary()),
                "blocks": pa.array([pack((index[ib[p] : ib[p + 1]] & low).astype(np.uint32)) for p in full], pa.binary()),
            })

    def hit(t: pa.Table) -> pa.Table:
        probes, blocks = ([unpack(x) for x in t.column(c).to_pylist()] for c in ("probes", "blocks"))
        values, owner = np.concatenate(blocks), np.repeat(np.arange(len(blocks)), [len(x) for x in blocks])
        order = np.argsort(values, kind="stable")
        index, first, count = np.unique(values[order], return_index=True, return_counts=True)
        single = np.where(count > 1, -1, owner[order][first])
        hits = []
        for k, v in enumerate(probes):
            there = _shared(v, index)
            v = v[there]
            hits.append(pack(v[single[np.searchsorted(index, v)] != k]))
        out = pa.table({"batch": t.column("batch"), "digest": t.column("digest"), "p": t.column("p"), "hits": pa.array(hits, pa.binary())})
        return out.filter(pa.array([len(x) > 0 for x in hits]))

    hits = docs.mapInArrow(probe, "p int, batch long, digest long, probes binary, blocks binary").groupBy("p").applyInArrow(hit, "batch long, digest long, p int, hits binary")

    def extend(left: pa.Table, right: pa.Table) -> pa.Table:
        b = restored(left, right)
        w, ids = Words(b.column(text_col)), _ids(b, id_col)
        at, keys, fixed, h = _probes(w, parts)
        far = [(U64(p) << U64(32)) | unpack(x).astype(U64) for p, x in zip(right.column("p").to_pylist(), right.column("hits").to_pylist(), strict=True)]
        doc = w.doc()
        found = _shared(keys, np.sort(np.concatenate(far))) if far else np.zeros(len(keys), bool)
        near_keys, near_docs = keys[fixed], doc[at[fixed]]
        order = np.lexsort((near_docs, near_keys))
        k, d = near_keys[order], near_docs[order]
        first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, int)
        index, lo, hi = k[first], d[first], d[np.r_[first[1:], len(k)] - 1] if len(k) else d
        there = _shared(keys, index)
        where = np.searchsorted(index, keys[there])
        found[there] |= (lo[where] != doc[at[there]]) | (hi[where] != doc[at[there]])
        total = np.zeros(len(h) + WINDOW + 1, np.int64)
        total[at[found] + 1] = 1
        total = np.cumsum(total)
        start, window = w.windows(h, WINDOW)
        near = total[start + WINDOW - BLOCK + 1] > total[start]
        own = Windows(_first(window[near], bits), w.second_windows(start[near], WINDOW), ids[doc[start[near]]])
        bounds = np.searchsorted(own.first >> U64(32), (np.arange(parts + 1, dtype=U64) << U64(32)) // U64(parts))
        bounds[-1] = len(own.first)
        full = np.flatnonzero(np.diff(bounds))
        n, name = len(full), left.column("batch")[0].as_py()
        cut = [slice(bounds[p], bounds[p + 1]) for p in full]
        return pa.table({
            "p": pa.array(full, pa.int32()), "batch": pa.array(np.full(n, name)), "digest": pa.array(np.full(n, left.column("digest")[0].as_py())),
            "keys": pa.array([pack(own.first[c]) for c in cut], pa.binary()), "second": pa.array([own.second[c].tobytes() for c in cut], pa.binary()), "least": pa.array([squeeze(own.least[c]) for c in cut], pa.binary()),
        })

    windows = batches.groupBy("batch").cogroup(hits.groupBy("batch")).applyInArrow(extend, "p int, batch long, digest long, keys binary, second binary, least binary")

    def settle(t: pa.Table) -> pa.Table:
        first, second = _unpacked(t)
        least = [spread(x, np.int64) for x in t.column("least").to_pylist()]
        n = [len(x) for x in first]
        all_ = Windows(np.concatenate(first), np.concatenate(second), np.concatenate(least))
        best = np.split(all_.least[all_.at], np.cumsum(n)[:-1])
        less = [b < o for b, o in zip(best, least, strict=True)]
        out = pa.table({
            "batch": t.column("batch"), "digest": t.column("digest"),
            "keys": pa.array([pack(x[m]) for x, m in zip(first, less, strict=True)], pa.binary()), "second": pa.array([x[m].tobytes() for x, m in zip(second, less, strict=True)], pa.binary()),
        })
        return out.filter(pa.array([bool(m.any()) for m in less]))

    return windows.groupBy("p").applyInArrow(settle, "batch long, digest long, keys binary, second binary")


def _unpacked(t: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray]]:
    return [unpack(x, U64) for x in t.column("keys").to_pylist()], [np.frombuffer(x, U64) for x in t.column("second").to_pylist()]


#: Columns that are added.
RESULTS = ("n_words", "n_removed", "kept_text")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> DataFrame:
    """Rows of docs with n_words, n_removed and kept_text (the words that stay, joined by single spaces), which replace columns of these names."""
    docs = docs.drop(*RESULTS)
    # both cogroups read this one exchange: the same plan below the grouping, so Spark reuses it
    batches = stored(docs, text_col).repartition("batch")
    back = shared_windows(docs, batches, id_col, text_col, bits)
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        b = restored(left, right)
        w, ids = Words(b.column(text_col)), _ids(b, id_col)
        start, window = w.windows(w.hashes(), WINDOW)
        own = ids[w.doc()[start]]
        all_ = Windows(_first(window, bits), w.second_windows(start, WINDOW), own)
        lost = np.zeros(len(all_.first), bool)
        for k, second in zip(*_unpacked(right), strict=True):
            lost[all_.find(k, second)] = True
        gone = start[lost[all_.at] | (all_.least[all_.at] < own)]
        cover = np.zeros(len(w.starts) + 1, np.int32)
        np.add.at(cover, gone, 1)
        np.add.at(cover, gone + WINDOW, -1)
        removed = np.cumsum(cover)[:-1] > 0
        before = np.concatenate([[0], np.cumsum(removed)])
        n_removed = before[w.off[1:]] - before[w.off[:-1]]
        raw, texts = bytes(w.data), []
        for i in range(w.n):
            parts = raw[w.text_off[i] : w.text_off[i + 1]].split()
            if n_removed[i]:
                parts = [x for x, r in zip(parts, removed[w.off[i] : w.off[i + 1]].tolist(), strict=True) if not r]
            texts.append(b" ".join(parts).decode())
        out = pa.Table.from_batches([b])
        for name, values in (("n_words", pa.array(w.counts())), ("n_removed", pa.array(n_removed)), ("kept_text", pa.array(texts, pa.string()))):
            out = out.append_column(name, values)
        return out

    return batches.groupBy("batch").cogroup(back.groupBy("batch")).applyInArrow(finish, schema)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """docs with the repeated words cut from its texts; a text that loses nothing stays byte for byte."""
    names = {c: f"{c}_" * 9 for c in docs.columns if c in RESULTS}  # kept under other names meanwhile
    out = remove_repeats(docs.withColumnsRenamed(names), id_col, text_col).withColumn(text_col, F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col(text_col))).drop(*RESULTS)
    if length_col:
        out = out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType))
    return out.withColumnsRenamed({v: k for k, v in names.items()}).select(docs.columns)
