"""Ranked lexical search over an index of document shards (operator 13).

A term is a maximal run of ASCII letters, digits and bytes from 0x80 on, A-Z lower-cased.  ``index`` cuts a table into shards of
``SHARD_BYTES`` of text as it is read and writes each as one row: a directory of its distinct terms, ascending by hash, and their
postings in CSR form, each with the document's place in the shard and its impact, an integer that only needs the table's number of
documents and terms.  ``search`` counts in how many documents each term of the queries is, from the directories alone, which gives
the terms' weights, and then scores term at a time: a shard's documents have one dense accumulator, to which a term's postings add
weight times impact.  The best k of a shard are selected around the k-th score, so ties go by document, and the shards' best are
merged in two levels.

Terms are known by 96 bits of two hashes.  Queries are taken in blocks of some ``QUERY_BYTES``, by a hash of their ids: a block's
terms and weights go to all tasks, whatever the number of queries, and each block reads the index once.  Nothing else grows in the
driver.  The index has a row a shard, so the frequent term of a third of all documents is one list a shard.

Defined results: null and empty texts and texts without a term are no documents (N doesn't count them) and are never found.  A row
is a document: rows of one id are found each for itself.  A null doc_id is found too, behind equal scores with an id.  Rows of one
item_id are one item with the terms of all of them; null is an item_id like others.  Items without a term or without a hit give no
row.  Other columns are ignored, whatever their names.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import numbered
from .lexicon import spread, squeeze
from .scratch import written
from .words import U64, Words, buffers, slices

SHARD_BYTES, QUERY_BYTES = 4 << 20, 4 << 20
#: Groups in which the shards' best are merged first.
LEVEL = 64
#: The ranking's constants: share of a document's length in its norm, in percent; the scales of weights and impacts.
LENGTH_SHARE, WEIGHT_SCALE, IMPACT_SCALE, TF_SCALE, NORM_SCALE = 75, 1000, 1_000_000_000, 1000, 8

_TERM = np.full(256, 0x20, np.uint8)
for _first, _last in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
    _TERM[_first : _last + 1] = np.arange(_first, _last + 1)
_TERM[0x41:0x5B] = np.arange(0x61, 0x7B)


class Index(NamedTuple):
    """shards: shard, docs (ids by place), terms, check, off, at, impact; documents with a term; terms with repeats."""

    shards: DataFrame
    documents: int
    terms: int


def terms(column: pa.Array) -> Words:
    """The terms of texts, as words of bytes where all that separates terms is a space."""
    data, off = buffers(column)
    spaced = pa.Array.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(off), pa.py_buffer(_TERM[data])])
    return Words(spaced)


def totals(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """Documents with a term, and all terms with repeats."""

    def run(batches):
        n = all_ = 0
        for b in slices(batches, "text"):
            counts = terms(b.column("text")).counts()
            n, all_ = n + int((counts > 0).sum()), all_ + int(counts.sum())
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([all_])], ["n", "terms"])

    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "n long, terms long")
    return tuple(x or 0 for x in rows.agg(F.sum("n"), F.sum("terms")).first())


def norms(lengths: np.ndarray, documents: int, all_terms: int) -> np.ndarray:
    """Each document's m, in exact integers."""
    top = LENGTH_SHARE * documents
    if int(lengths.max(initial=0)) * top < 2**63:
        share = lengths * top // max(all_terms, 1)
    else:
        share = np.array([n * top // max(all_terms, 1) for n in lengths.tolist()], np.int64)
    return 100 - LENGTH_SHARE + share


def shard_row(number: int, b: pa.RecordBatch, documents: int, all_terms: int) -> pa.RecordBatch:
    w = terms(b.column("text"))
    h, check, doc = w.hashes(), (w.second_hashes() >> U64(32)).astype(np.uint32), w.doc()
    order = np.argsort(h, kind="stable")  # documents stay ascending in a term
    if ((h[order][1:] == h[order][:-1]) & (check[order][1:] != check[order][:-1])).any():
        order = np.lexsort((check, h))
    h, check, doc = h[order], check[order], doc[order]
    other = np.ones(len(h), bool)
    other[1:] = (h[1:] != h[:-1]) | (check[1:] != check[:-1])
    first = other.copy()
    first[1:] |= doc[1:] != doc[:-1]
    start = np.flatnonzero(first)
    tf = np.diff(np.append(start, len(h)))
    at = doc[start]
    term = np.flatnonzero(other)
    m = norms(w.counts(), documents, all_terms)
    impact = IMPACT_SCALE * tf // (TF_SCALE * tf + NORM_SCALE * m[at])
    off = np.searchsorted(start, np.append(term, len(h)))
    binary = (squeeze(np.diff(h[term], prepend=U64(0))), squeeze(check[term]), squeeze(np.diff(off).astype(np.uint32)), squeeze(at.astype(np.uint32)), squeeze(impact.astype(np.uint32)))
    ids = pa.array([b.column("id").to_pylist()], pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array([number]), ids, *(pa.array([x], pa.binary()) for x in binary)], ["shard", "docs", "terms", "check", "off", "at", "impact"])


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    documents, all_terms = totals(docs, text_col)

    def run(batches):
        for k, b in numbered(batches, "text", SHARD_BYTES):
            yield shard_row(k, b, documents, all_terms)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    shards = rows.mapInArrow(run, "shard long, docs array<long>, terms binary, check binary, off binary, at binary, impact binary")
    return Index(written(shards, "shards"), documents, all_terms)


class Block(NamedTuple):
    """A block of queries: its distinct terms ascending, and for each item the terms it has and how often."""

    terms: np.ndarray
    check: np.ndarray
    items: list[tuple[int | None, np.ndarray, np.ndarray]]


def block_of(rows: list[tuple[int | None, str | None]]) -> Block:
    w = terms(pa.array([t for _, t in rows], pa.large_string()))
    h, check = w.hashes(), (w.second_hashes() >> U64(32)).astype(np.uint32)
    order = np.lexsort((check, h))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (check[order][1:] != check[order][:-1])
    slot = np.zeros(len(h), np.int64)
    slot[order] = np.cumsum(new) - 1
    of_item: dict[int | None, list[np.ndarray]] = {}
    for (item, _), lo, hi in zip(rows, w.off[:-1], w.off[1:], strict=True):
        of_item.setdefault(item, []).append(slot[lo:hi])
    items = [(item, *np.unique(np.concatenate(parts), return_counts=True)) for item, parts in of_item.items()]
    return Block(h[order][new], check[order][new], [x for x in items if len(x[1])])


def found(block: Block, directory: np.ndarray, check: np.ndarray) -> np.ndarray:
    """The place of each of the block's terms in a shard's directory; -1 if it isn't there."""
    out = np.full(len(block.terms), -1)
    lo, hi = np.searchsorted(directory, block.terms, "left"), np.searchsorted(directory, block.terms, "right")
    for step in range(int((hi - lo).max(initial=0))):  # more than once only where two terms share 64 bits
        at = np.minimum(lo + step, len(directory) - 1)
        out[(lo + step < hi) & (check[at] == block.check)] = at[(lo + step < hi) & (check[at] == block.check)]
    return out


def _directory(b: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, checks and posting bounds of a shard's terms."""
    raw = [b.column(c)[i].as_py() for c in ("terms", "check", "off")]
    sizes = spread(raw[2], np.uint32).astype(np.int64)
    return np.cumsum(spread(raw[0], U64), dtype=U64), spread(raw[1], np.uint32), np.concatenate([[0], np.cumsum(sizes)])


def frequencies(shards: DataFrame, block: Block) -> np.ndarray:
    """In how many documents each of the block's terms is."""

    def run(batches):
        df = np.zeros(len(block.terms), np.int64)
        for b in batches:
            for i in range(b.num_rows):
                directory, check, off = _directory(b, i)
                at = found(block, directory, check)
                df[at >= 0] += np.diff(off)[at[at >= 0]]
        have = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(have), pa.array(df[have])], ["slot", "df"])

    out = np.zeros(len(block.terms), np.int64)
    for slot, n in shards.select("terms", "check", "off").mapInArrow(run, "slot long, df long").groupBy("slot").agg(F.sum("df")).collect():
        out[slot] = n
    return out


def weight(documents: int, df: int) -> int:
    return math.floor(WEIGHT_SCALE * math.log((2 * documents + 2) / (2 * df + 1)))


def best(score: np.ndarray, doc: np.ndarray, null: np.ndarray, k: int) -> np.ndarray:
    """The k rows of the highest scores; those equal to the k-th go by document, null last."""
    if len(score) <= k:
        return np.arange(len(score))
    kth = score[np.argpartition(score, len(score) - k)[len(score) - k :]].min()
    above, level = np.flatnonzero(score > kth), np.flatnonzero(score == kth)
    level = level[np.lexsort((doc[level], null[level]))]
    return np.concatenate([above, level[: k - len(above)]])


def _scored(batches: Iterator[pa.RecordBatch], block: Block, weights: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    held: dict[int, list[np.ndarray]] = {}
    shard = 0
    for b in batches:
        for i in range(b.num_rows):
            shard = b.column("shard")[i].as_py()
            directory, check, off = _directory(b, i)
            at, impact = (spread(b.column(c)[i].as_py(), np.uint32).astype(np.int64) for c in ("at", "impact"))
            ids = b.column("docs")[i].values
            null, ids = np.asarray(ids.is_null()), ids.fill_null(0).to_numpy(zero_copy_only=False)
            place = found(block, directory, check)
            scores = np.zeros(len(ids), np.int64)
            for n, (_, slots, times) in enumerate(block.items):
                here = place[slots] >= 0
                if not here.any():
                    continue
                scores[:] = 0
                for p, gain in zip(place[slots[here]].tolist(), (weights[slots[here]] * times[here]).tolist(), strict=True):
                    scores[at[off[p] : off[p + 1]]] += gain * impact[off[p] : off[p + 1]]
                hit = np.flatnonzero(scores)
                rows = [scores[hit], ids[hit], null[hit]]
                keep = best(*rows, k)
                rows = [x[keep] for x in rows]
                if n in held:
                    rows = [np.concatenate(x) for x in zip(held[n], rows, strict=True)]
                    keep = best(*rows, k)
                    rows = [x[keep] for x in rows]
                held[n] = rows
    count = np.array([len(r[0]) for r in held.values()], np.int64)
    whole = [np.concatenate([r[c] for r in held.values()]) if held else np.zeros(0, np.int64) for c in range(3)]
    item = pa.array([block.items[n][0] for n in held], pa.int64()).take(pa.array(np.repeat(np.arange(len(held)), count)))
    doc = pa.array(whole[1].astype(np.int64), mask=whole[2].astype(bool))
    yield pa.RecordBatch.from_arrays([item, pa.array(np.full(len(item), shard)), doc, pa.array(whole[0].astype(np.int64))], ["item", "shard", "doc", "score"])


def search(index: Index, queries: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item with a score above 0."""
    rows = queries.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // QUERY_BYTES))
    out = None
    for n in range(blocks):
        block = block_of([tuple(r) for r in rows.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == n).collect()])
        weights = np.array([weight(index.documents, d) for d in frequencies(index.shards, block).tolist()], np.int64)

        def run(batches, block=block, weights=weights):
            return _scored(batches, block, weights, k)

        part = index.shards.drop("shards").mapInArrow(run, "item long, shard long, doc long, score long")
        out = part if out is None else out.unionByName(part)
    order = [F.desc("score"), F.asc_nulls_last("doc")]
    groups = out.withColumn("group", F.pmod(F.xxhash64("shard"), F.lit(LEVEL)))
    near = groups.withColumn("rank", F.row_number().over(Window.partitionBy("item", "group").orderBy(*order))).where(F.col("rank") <= k)
    last = near.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    return last.select(F.col("item").alias("item_id"), F.col("rank").cast("int").alias("rank"), F.col("doc").alias("doc_id"), "score")
