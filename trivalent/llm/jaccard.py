"""N-gram Jaccard join with adaptive multi-match prefixes (operator 11).

A document's set holds the 64-bit hashes of its distinct runs of three words (A-Z lower-cased); with fewer words, of its whole
sequence.  Two sets of likeness 0.9 or more share at least t = ceil(0.9 n) elements, n being the size of either.  So if all sets are
put in one order, rarest first, the first n - t + l elements of both hold at least l common ones, for every l: the longer the prefix,
the more elements must agree before a pair is worth checking.  Each set takes the l whose estimated cost is least: the elements that it
carries, and the candidates that its prefix may have, at most one for every l sets that it meets, times the size of the sets to be
compared.  Two sets are candidates if their prefixes share as many elements as the smaller l of both.  To meet at all it is enough to
post the first n - t + 1 elements, and of these only the ones that another set has.

In how many sets an element is, is counted over the whole table: each batch of texts sends its distinct elements once to the
partitions of the hash space, by 32 bits in each, and gets their counts back as eighth-bit logarithms.  A count may be too large by
elements that share those bits, never too small; any order that all sets agree on gives the same links.

Equal sets, known by 128 bits of the SHA-256 of all their elements, are one class and cost a row each from then on.  First every class
is checked with at most two of the least classes of its prefix elements, which ties most groups together in linear work.  Then classes
of *different* components that share a prefix element are compared in blocks of some ``BLOCK`` rows and ``BLOCK_ELEMENTS`` elements,
dealt by bands of set sizes too, by counting what their prefixes share; a pair is taken in the bucket of its first shared element
only.  Pairs are never emitted: a block emits the rows that need their sets, and then a link fewer than it has rows at most.  Every
link is confirmed on the full sets.

Defined results: null and empty texts and texts without a word have an empty set, link with nothing and form their own component.
Rows with equal doc_id are one document to the graph: each of their texts links, and they share a component.  A null doc_id stays
alone, with a null component.  Other columns are ignored, whatever their names.  An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import pack, parts_for, unpack
from .components import components
from .lexicon import SCHEMA, answered, by_partition, record, records, rows_in, rows_out, spell, spread, squeeze
from .neardup import _groups, shingle_sets
from .scratch import written
from .words import U64, slices, sums

WORDS, PERCENT = 3, 90
#: The values of l that a set chooses among.
LENGTHS = (1, 2, 4, 8, 16, 32, 64, 128)
BLOCK, BLOCK_ELEMENTS = 1024, 1 << 20


def _levels(counts: np.ndarray) -> np.ndarray:
    """Eighth-bit binary logarithms; 0 is an element of one set alone."""
    return np.minimum(np.rint(8 * np.log2(np.maximum(counts, 1))), 255).astype(np.uint8)


class _Batch:
    """The sets of a batch of texts and, for every partition of the hash space, its distinct elements there by their lower halves."""

    def __init__(self, b: pa.RecordBatch, parts: int):
        self.sets, self.off = (np.concatenate(x) for x in self._joined(b))
        self.distinct, self.inverse, self.counts = np.unique(self.sets, return_inverse=True, return_counts=True)
        low = self.distinct.astype(np.uint32)
        self.parts = {p: at[np.argsort(low[at], kind="stable")] for p, at in by_partition(self.distinct, parts)}
        self.low = low

    @staticmethod
    def _joined(b: pa.RecordBatch) -> tuple[list[np.ndarray], list[np.ndarray]]:
        sets, offs, before = [np.zeros(0, U64)], [np.zeros(1, np.int64)], 0
        for x in slices([b], "text"):
            s, off = shingle_sets(x.column("text"), WORDS)
            sets.append(s)
            offs.append(off[1:] + before)
            before += len(s)
        return sets, offs


def _counted_rows(t: pa.Table) -> pa.Table:
    """One partition: in how many sets each batch's elements are, as levels in the order in which the batch sent them."""
    values = [unpack(x) for x in t.column("a").to_pylist()]
    sent = [spread(x, np.uint32) for x in t.column("b").to_pylist()]
    _, at = np.unique(np.concatenate(values), return_inverse=True)
    level = _levels(np.bincount(at, np.concatenate(sent)))[at]
    ends = np.cumsum([len(v) for v in values])
    rows = [record(p, batch, squeeze(x), b"", b"") for p, batch, x in zip(t.column("p").to_pylist(), t.column("batch").to_pylist(), np.split(level, ends[:-1]), strict=True)]
    return pa.Table.from_batches([records(rows)])


def least_shared(n: np.ndarray) -> np.ndarray:
    """How many elements a set of n has in common with any set that it links to, at least."""
    return (PERCENT * n + 99) // 100


def prefixes(elements: np.ndarray, off: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each set's l, how many elements it posts, the sizes of the prefixes and the prefixes in the common order; level: of each element.

    Elements of one set alone are left out: nobody can share them.
    """
    n = np.diff(off)
    doc = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((elements, level, doc))
    elements, level = elements[order], level[order]
    before = np.concatenate([[0], np.cumsum(np.exp2(level / 8) - 1)])
    t = least_shared(n)
    best, l_of = np.full(len(n), np.inf), np.ones(len(n), np.int64)
    for k in LENGTHS:
        size = np.minimum(n - t + k, n)
        met = before[off[:-1] + size] - before[off[:-1]]
        cost = np.where(k <= np.maximum(t, 1), size + met * n / k, np.inf)
        l_of = np.where(cost < best, k, l_of)
        best = np.minimum(best, cost)
    place = np.arange(len(elements)) - off[:-1][doc]
    keep = (place < (n - t + l_of)[doc]) & (level > 0)
    posted = keep & (place < (n - t + 1)[doc])
    return l_of, sums(posted, off), sums(keep, off), elements[keep]


def _digests(sets: np.ndarray, off: np.ndarray) -> list[bytes | None]:
    raw, at = memoryview(sets).cast("B"), (8 * off).tolist()
    return [hashlib.sha256(raw[lo:hi]).digest()[:16] if hi > lo else None for lo, hi in zip(at[:-1], at[1:], strict=True)]


def table(docs: DataFrame) -> DataFrame:
    """id, n, set (the class), l, posted, prefix: a row for each row of docs (id, text)."""
    parts = parts_for(docs, "text")

    def cut(b: pa.RecordBatch, k: int) -> list[tuple]:
        own = _Batch(b, parts)
        rows = [record(-1, k, rows_out(b), b"", b"")]
        return rows + [record(p, k, pack(own.low[at]), squeeze(own.counts[at].astype(np.uint32)), b"") for p, at in own.parts.items()]

    def finish(row: tuple, back: list[tuple]) -> pa.Table:
        b = rows_in(row[2])
        own = _Batch(b, parts)
        level = np.zeros(len(own.distinct), np.uint8)
        for p, _, data, _, _ in back:
            level[own.parts[p]] = spread(data, np.uint8)
        l_of, posted, size, kept = prefixes(own.sets, own.off, level[own.inverse])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(kept.view(np.int64)))
        cols = [b.column("id"), pa.array(np.diff(own.off)), pa.array(_digests(own.sets, own.off), pa.binary()), pa.array(l_of.astype(np.int32)), pa.array(posted.astype(np.int32)), lists]
        return pa.Table.from_arrays(cols, ["id", "n", "set", "l", "posted", "prefix"])

    rows = spell(docs, cut)
    counted = rows.where("p >= 0").groupBy("p").applyInArrow(_counted_rows, SCHEMA)
    return answered(rows.where("p < 0"), counted, finish, "id long, n long, set binary, l int, posted int, prefix array<long>")


def _element_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text"):
        sets, off = shingle_sets(b.column("text"), WORDS)
        raw, at = memoryview(sets).cast("B"), (8 * off).tolist()
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(_digests(sets, off), pa.binary()), pa.array([bytes(raw[lo:hi]) for lo, hi in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["id", "set", "elements"])


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common > 0 and 100 * common >= PERCENT * (len(x) + len(y) - common)


def _star_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of hubs with their members; rows come by hub and slot, the hub's own set first."""
    hub: np.ndarray | None = None
    for b in batches:
        a, found = [], []
        for name, member, own, data in zip(*(b.column(c).to_pylist() for c in ("hub", "set", "own", "elements")), strict=True):
            elements = np.frombuffer(data, U64)
            if own:
                hub = elements
            elif alike(hub, elements):
                a.append(name)
                found.append(member)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(found, pa.binary())], ["a", "b"])


_BLOCK_KEY = ["token", "band", "i", "j"]


def _flat(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Values as numbers from 0, and offsets of the lists."""
    off = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    return np.unique(np.concatenate(lists), return_inverse=True)[1], off


def _counted(values: np.ndarray, off: np.ndarray, mark: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """How many marked values each of the rows has; no row is empty."""
    n = np.diff(off)[rows]
    at = np.repeat(off[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return np.add.reduceat(mark[values[at]], np.cumsum(n) - n, dtype=np.int64)


def _candidates(t: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """(row, rows of other components that its prefix agrees with enough) of one block of a bucket, each pair in one bucket only."""
    comp, part, n, l_of, own = (t.column(c).to_numpy() for c in ("comp", "part", "n", "l", "own_band"))
    token, band, i, j = (t.column(c)[0].as_py() for c in _BLOCK_KEY)
    lists = [np.asarray(x, np.int64) for x in t.column("prefix").to_pylist()]
    values, off = _flat(lists)
    mark = np.zeros(int(values.max()) + 1, bool)
    right = np.flatnonzero(part == j)
    for x in np.flatnonzero(part == i):
        others = right[comp[right] != comp[x]]
        others = others[others > x] if i == j else others
        others = others[np.maximum(own[others], own[x]) == band]
        others = others[100 * np.minimum(n[others], n[x]) >= PERCENT * np.maximum(n[others], n[x])]
        if not len(others):
            continue
        mine = values[off[x] : off[x + 1]]
        mark[mine] = True
        others = others[_counted(values, off, mark, others) >= np.minimum(l_of[others], l_of[x])]
        mark[mine] = False
        first = mine[: int(np.flatnonzero(lists[x] == token)[0])]
        if len(first) and len(others):
            mark[first] = True
            others = others[_counted(values, off, mark, others) == 0]
            mark[first] = False
        if len(others):
            yield x, others


def _cross_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each block of sorted rows that have another to be checked with."""
    for t in _groups(batches, _BLOCK_KEY):
        keep = np.zeros(t.num_rows, bool)
        for x, others in _candidates(t):
            keep[x] = True
            keep[others] = True
        yield from t.filter(pa.array(keep)).to_batches()


def _settle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each block of sorted rows with their sets; rows that are tied already are passed over."""
    for t in _groups(batches, _BLOCK_KEY):
        names = t.column("set").to_pylist()
        sets, off = _flat([np.frombuffer(x, U64) for x in t.column("elements").to_pylist()])
        mark, n = np.zeros(int(sets.max()) + 1, bool), np.diff(off)
        _, comp = np.unique(t.column("comp").to_numpy(), return_inverse=True)
        a, b = [], []
        for x, others in _candidates(t):
            others = others[comp[others] != comp[x]]
            if not len(others):
                continue
            mark[sets[off[x] : off[x + 1]]] = True
            common = _counted(sets, off, mark, others)
            mark[sets[off[x] : off[x + 1]]] = False
            for o in others[100 * common >= PERCENT * (n[x] + n[others] - common)]:
                if comp[o] != comp[x]:
                    comp[comp == comp[o]] = comp[x]
                    a.append(names[x])
                    b.append(names[o])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])


def _stars(pairs: DataFrame, elements: DataFrame) -> DataFrame:
    """Links (a, b) of hubs and members; pairs: hub, set.  A hub's set goes once to every ``BLOCK`` of its members."""
    slots = pairs.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("slots"))
    dealt = pairs.join(slots, "hub").select("hub", "set", F.pmod(F.xxhash64("set"), "slots").cast("int").alias("slot"), F.lit(False).alias("own"))
    own = slots.select("hub", F.col("hub").alias("set"), F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"), F.lit(True).alias("own"))
    rows = dealt.unionByName(own).join(elements, "set").select("hub", "slot", "own", "set", "elements")
    return rows.repartition("hub", "slot").sortWithinPartitions("hub", "slot", F.desc("own")).mapInArrow(_star_rows, "a binary, b binary")


def link_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id: one row for each row of docs."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows_of = written(table(docs), "prefixes")
    full = rows_of.where("n > 0 and id is not null")
    classes = written(full.groupBy("set").agg(F.min("id").alias("rep"), *(F.first(c).alias(c) for c in ("n", "l", "posted", "prefix"))), "classes")
    reps = classes.select("set", "rep")
    same = full.select("id", "set").join(reps, "set").where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    posted = classes.select("set", "n", F.explode(F.slice("prefix", F.lit(1), F.col("posted"))).alias("token"))
    buckets = posted.groupBy("token").agg(F.count("*").alias("m"), F.min(F.struct("set", "n")).alias("hub")).where("m > 1").select("token", "hub")
    members = written(posted.join(buckets, "token"), "members")
    needed = members.select("set").distinct().join(reps, "set")
    # a row's text is its class's only if its set is: rows of one id may have other texts; rep is the least id, so id <= rep finds it
    own = docs.join(needed.select(F.col("rep").alias("id")).distinct(), "id", "left_semi").mapInArrow(_element_rows, "id long, set binary, elements binary")
    elements = written(own.join(needed, "set").where("id <= rep").select("set", "elements").dropDuplicates(["set"]), "elements")
    # hubs: at most two for each class, of a size that can link
    fits = F.lit(100) * F.least("n", "hub.n") >= F.lit(PERCENT) * F.greatest("n", "hub.n")
    hubs = members.where((F.col("set") != F.col("hub.set")) & fits).groupBy("set", F.col("hub.set").alias("hub")).agg(F.count("*").alias("shared"))
    best = hubs.groupBy("set").agg(F.array_distinct(F.array(F.max_by("hub", "shared"), F.min("hub"))).alias("hubs"))
    pairs = written(best.select(F.explode("hubs").alias("hub"), "set"), "pairs")
    by_rep = lambda links: links.join(reps.select(F.col("set").alias("a"), F.col("rep").alias("ra")), "a").join(reps.select(F.col("set").alias("b"), F.col("rep").alias("rb")), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    found = components(by_rep(_stars(pairs, elements)))
    # what the hubs did not tie: buckets of several components, by bands of sizes; those outside the largest against all
    own = F.floor(F.log("n") / -math.log(PERCENT / 100) * 0.999).cast("int")
    comp_of = reps.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("set", F.coalesce("component", "rep").alias("comp"))
    labelled = members.join(comp_of, "set").select("token", "set", "n", "comp", own.alias("own_band")).withColumn("band", F.explode(F.array("own_band", F.col("own_band") + 1)))
    sizes = labelled.groupBy("token", "band", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("w")).groupBy("token", "band")
    mixed = sizes.agg(F.count("*").alias("k"), F.sum("c").alias("m"), F.sum("w").alias("w"), F.max(F.struct("c", "w", "comp")).alias("top")).where("k > 1")
    blocks = lambda rows, total: F.ceil(F.greatest(rows / BLOCK, total / BLOCK_ELEMENTS)).cast("int")
    mixed = mixed.select("token", "band", F.col("top.comp").alias("main"), blocks(F.col("top.c"), F.col("top.w")).alias("mp"), blocks(F.col("m") - F.col("top.c"), F.col("w") - F.col("top.w")).alias("op"))
    rows = labelled.join(mixed, ["token", "band"])
    is_main, dealt = F.col("comp") == F.col("main"), F.xxhash64("set")
    rows = rows.withColumn("part", F.when(is_main, F.pmod(dealt, "mp")).otherwise(F.col("mp") + F.pmod(dealt, "op")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.when(is_main, F.col("mp")).otherwise(F.lit(0)), F.col("mp") + F.col("op") - 1)))
    rows = rows.select("token", "band", F.greatest("part", "other").alias("i"), F.least("part", "other").alias("j"), "set", "n", "comp", "own_band", "part")
    rows = rows.join(classes.select("set", "l", "prefix"), "set").select(*_BLOCK_KEY, "set", "n", "comp", "own_band", "part", "l", "prefix")
    in_blocks = lambda df: df.repartition(*_BLOCK_KEY).sortWithinPartitions(*_BLOCK_KEY, "set")
    crossed = in_blocks(rows).mapInArrow(_cross_rows, rows.schema)
    more = in_blocks(crossed.join(elements, "set")).mapInArrow(_settle_rows, "a binary, b binary")
    whole = components(found.select(F.col("component").alias("a"), F.col("id").alias("b")).unionByName(by_rep(more)).unionByName(same))
    return rows_of.select("id", F.col("n").alias("n_shingles")).join(whole, "id", "left").select("id", "n_shingles", F.coalesce("component", "id").alias("component_id"))
