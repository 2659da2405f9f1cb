"""MinHash near-duplicates (operator 1).

A document's set holds the 64-bit hashes of its distinct runs of five words (A-Z lower-cased); with
fewer words, of its whole sequence.  Sets are sketched by rounds of hashed bin placement: in each of
the first T rounds an element falls into a random bin with a value that grows with the round, and in
T more rounds into bin 0, 1, ... in turn; a set stops after the round that filled its last bin.  So
every coordinate is filled after 2T rounds at most, most sets need one, and the share of equal
coordinates estimates the Jaccard likeness as well as T independent hash functions do.

Equal sets, known by the SHA-256 of all their elements, become one class first, so that groups of copies
cost a row each.  Classes that share a band of ROWS coordinates are candidates (a pair at 0.75 shares none of 32 bands with probability
5e-6).  First each class is checked against at most two of the least classes of its buckets, which
ties most groups together in linear work; then only pairs of *different* components in a bucket are
compared by sketch, in blocks of some ``BLOCK`` rows and ``BLOCK_WORDS`` elements, and those whose estimate is over the threshold less
five deviations are checked in the same blocks.  Pairs are never emitted: a block emits the rows that need
their texts, and then a link fewer than it has rows at most.  Every link is confirmed on the full sets.

Sketches, texts and links are those of classes, so rows of one doc_id with other texts are compared by each of them.

Defined results: null and empty texts and texts without a word have an empty set, link with nothing
and form their own component.  Rows with equal doc_id are one document to the graph: each of their texts links, and they share a
component.  A null doc_id stays alone, with a null component.  Other columns are ignored, whatever their
names.  An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import written
from .words import U64, Words, mix, slices

WORDS, PERCENT = 5, 75
ROWS, BANDS = 4, 32
T = ROWS * BANDS
BLOCK, BLOCK_WORDS = 1024, 1 << 20
#: Five standard deviations of the estimate at the threshold.
MARGIN = 5 * (0.75 * 0.25 / T) ** 0.5
_FULL = U64(2**64 - 1)


def shingle_sets(column: pa.Array, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingle hashes, ascending, and the texts' offsets."""
    w = Words(column, lower=True)
    h = w.hashes()
    at, grams = w.windows(h, k)
    counts = w.counts()
    short = np.flatnonzero((counts > 0) & (counts < k))
    doc = np.concatenate([w.doc()[at], short])
    grams = np.concatenate([grams, w.whole(h)[short]])
    order = np.lexsort((grams, doc))
    doc, grams = doc[order], grams[order]
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (grams[1:] != grams[:-1])
    doc, grams = doc[first], grams[first]
    return grams, np.searchsorted(doc, np.arange(w.n + 1))


def sketch(elements: np.ndarray, off: np.ndarray, t: int = T) -> np.ndarray:
    """Fast similarity sketches of sets, n x t; rows of empty sets are all ones."""
    n = len(off) - 1
    out = np.full(n * t, _FULL)
    doc = np.repeat(np.arange(n), np.diff(off))
    top, bits = U64(int(t - 1).bit_length()), U64(52)
    for r in range(2 * t):
        if not len(doc):
            break
        g = mix(elements + U64((0x9E3779B97F4A7C15 * (r + 1)) % 2**64))
        value = (g >> (U64(64) - bits)) | (U64(r) << bits)
        bins = (g & ((U64(1) << top) - U64(1))).astype(np.int64) % t if r < t else r - t
        np.minimum.at(out, doc * t + bins, value)
        open_ = (out.reshape(n, t) == _FULL).any(axis=1)[doc]
        elements, doc = elements[open_], doc[open_]
    return out.reshape(n, t)


def _classes(sets: np.ndarray, off: np.ndarray) -> list[bytes]:
    """What each set is known by: half of the SHA-256 of its elements."""
    raw, at = memoryview(sets).cast("B"), (8 * off).tolist()
    return [hashlib.sha256(raw[lo:hi]).digest()[:16] for lo, hi in zip(at[:-1], at[1:], strict=True)]


def _own_texts(batches):
    """Of texts that came with a class by their id, the first in a task that is of it."""
    seen: set[int] = set()
    for b in slices(batches, "text"):
        same = []
        for own, wanted, c in zip(_classes(*shingle_sets(b.column("text"))), b.column("set").to_pylist(), b.column("c").to_pylist(), strict=True):
            same.append(own == wanted and c not in seen)
            if same[-1]:
                seen.add(c)
        yield pa.RecordBatch.from_arrays([b.column("c"), b.column("text")], ["c", "text"]).filter(pa.array(same, pa.bool_()))


def _text_rows(batches):
    """Texts by the classes of their sets."""
    for b in slices(batches, "text"):
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(_classes(*shingle_sets(b.column("text"))), pa.binary()), b.column("text")], ["id", "set", "text"])


def _class_texts(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """c, text: one text of each class; needed: c, set, rep.

    A row's text is its class's only if its set is, since rows of one id may have other texts.  Where an id is the least one of one class
    alone, texts go by id; where it is of several, by their sets.
    """
    owners = written(needed.join(needed.groupBy("rep").agg(F.count("*").alias("of")), "rep"), "owners")
    one = owners.where("of = 1").select(F.col("rep").alias("id"), "set", "c")
    # texts of other ids go before the exchange; the merge keeps rows of one id together for what follows
    alone = docs.join(one.select("id"), "id", "left_semi").join(one.hint("merge"), "id").withColumn("h", F.xxhash64("text")).dropDuplicates(["id", "h"])
    out = alone.select("c", "set", "text").mapInArrow(_own_texts, "c long, text string")
    several = owners.where("of > 1")
    if several.isEmpty():
        return out
    own = docs.join(several.select(F.col("rep").alias("id")).distinct(), "id", "left_semi").mapInArrow(_text_rows, "id long, set binary, text string")
    return out.unionByName(own.join(several, "set").where("id <= rep").select("c", "text").dropDuplicates(["c"]))


def _sketch_rows(batches):
    for b in slices(batches, "text"):
        sets, off = shingle_sets(b.column("text"))
        n = np.diff(off)
        s = sketch(sets, off)
        spread = mix(s)
        bands = np.zeros((len(n), BANDS), U64)
        for r in range(ROWS):
            bands = mix(bands + spread[:, r::ROWS] * U64(2 * r + 1))
        full = n > 0
        yield pa.RecordBatch.from_arrays(
            [
                b.column("id"),
                pa.array(n),
                pa.array(_classes(sets, off), pa.binary()),
                pa.array([x if f else None for x, f in zip(bands.view(np.int64), full, strict=True)], pa.list_(pa.int64())),
                pa.array([x.tobytes() if f else None for x, f in zip((spread & U64(255)).astype(np.uint8), full, strict=True)], pa.binary()),
                pa.array([x.tobytes() if f else None for x, f in zip(bands, full, strict=True)], pa.binary()),
            ],
            ["id", "n", "set", "bands", "sketch", "packed"],
        )


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_sketch_rows, "id long, n long, set binary, bands array<long>, sketch binary, packed binary")


def _verify_rows(batches):
    for b in slices(slices(batches, "ta"), "tb"):
        sa, oa = shingle_sets(b.column("ta"))
        sb, ob = shingle_sets(b.column("tb"))
        ok = np.zeros(b.num_rows, bool)
        for i in range(b.num_rows):
            x, y = sa[oa[i] : oa[i + 1]], sb[ob[i] : ob[i + 1]]
            common = len(np.intersect1d(x, y, assume_unique=True))
            ok[i] = common > 0 and 100 * common >= PERCENT * (len(x) + len(y) - common)
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(ok))


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes whose full sets are alike; texts: c, text.  The side with hot keys, a, is joined last and can be split."""
    tb = pairs.join(texts.select(F.col("c").alias("b"), F.col("text").alias("tb")), "b")
    both = tb.join(texts.select(F.col("c").alias("a"), F.col("text").alias("ta")), "a")
    return both.select("a", "b", "ta", "tb").mapInArrow(_verify_rows, "a long, b long")


def _groups(batches, key: list[str]):
    """Tables of one key each, of batches sorted by key."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([held, t]).combine_chunks() if held is not None else t
        if not t.num_rows:
            continue
        cols = [t.column(k).to_numpy() for k in key]
        cut = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1
        edges = [0, *cut.tolist(), t.num_rows]
        for lo, hi in zip(edges[:-2], edges[1:-1], strict=True):
            yield t.slice(lo, hi - lo)
        held = t.slice(edges[-2])
    if held is not None and held.num_rows:
        yield held


def _alike(t: pa.Table):
    """(row, rows of other components whose sketches are alike enough) of one block of a bucket.

    A pair is taken in the first band that it shares, so in one bucket only.
    """
    comp, part = (t.column(c).to_numpy() for c in ("comp", "part"))
    i, j, band = (t.column(c)[0].as_py() for c in ("i", "j", "band"))
    s = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(t.num_rows, T)
    keys = np.frombuffer(b"".join(t.column("keys").to_pylist()), np.int64).reshape(t.num_rows, BANDS)
    right = np.flatnonzero(part == j)
    for x in np.flatnonzero(part == i):
        others = right[(comp[right] != comp[x]) & ((right > x) if i == j else True)]
        if len(others):
            others = others[(s[others] == s[x]).mean(axis=1) >= PERCENT / 100 - MARGIN]
            others = others[~(keys[others, :band] == keys[x, :band]).any(axis=1)]
            if len(others):
                yield x, others


_BLOCK_KEY = ["band", "key", "i", "j"]


def _cross_rows(batches):
    """The rows of each block of sorted rows that have another to be checked with."""
    for t in _groups(batches, _BLOCK_KEY):
        keep = np.zeros(t.num_rows, bool)
        for x, others in _alike(t):
            keep[x] = True
            keep[others] = True
        yield from t.filter(pa.array(keep)).to_batches()


def _sets(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """shingle_sets of a table, a slice of its texts at a time."""
    parts = [shingle_sets(b.column("text")) for b in slices(t.to_batches(), "text")]
    before = np.cumsum([0, *(len(s) for s, _ in parts)])
    return np.concatenate([s for s, _ in parts]), np.concatenate([[0], *(off[1:] + n for (_, off), n in zip(parts, before, strict=False))])


def _settle_rows(batches):
    """Links of each block of sorted rows with texts, checked on full sets; rows that are tied already are passed over."""
    for t in _groups(batches, _BLOCK_KEY):
        names = t.column("c").to_numpy()
        sets, off = _sets(t)
        _, sets = np.unique(sets, return_inverse=True)
        mark, n = np.zeros(int(sets.max(initial=0)) + 1, bool), np.diff(off)
        _, comp = np.unique(t.column("comp").to_numpy(), return_inverse=True)
        a_out, b_out = [], []
        for x, others in _alike(t):
            others = others[comp[others] != comp[x]]
            if not len(others):
                continue
            mark[sets[off[x] : off[x + 1]]] = True
            at = np.concatenate([np.arange(off[o], off[o + 1]) for o in others])
            common = np.add.reduceat(mark[sets[at]], np.cumsum(n[others]) - n[others], dtype=np.int64)
            mark[sets[off[x] : off[x + 1]]] = False
            for o in others[100 * common >= PERCENT * (n[x] + n[others] - common)]:
                if comp[o] != comp[x]:
                    comp[comp == comp[o]] = comp[x]
                    a_out.append(names[x])
                    b_out.append(names[o])
        yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["a", "b"])


def link_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id: one row for each row of docs."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    table = written(sketches(docs, "id").withColumn("r", F.monotonically_increasing_id()), "sketches")
    full = table.where("n > 0 and id is not null")
    # equal sets: one class; its place in the graph is its least id, its number that of a row of this id
    least = full.groupBy("set").agg(F.min(F.struct("id", "r")).alias("at"))
    reps = written(least.select("set", F.col("at.id").alias("rep"), F.col("at.r").alias("c")), "classes")
    same_id = full.select("id", "set").join(reps, "set").where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    unique = full.join(reps.select(F.col("c").alias("r")), "r", "left_semi").withColumnRenamed("r", "c")
    banded = unique.select("c", "n", F.posexplode("bands").alias("band", "key"))
    buckets = banded.groupBy("band", "key").agg(F.count("*").alias("m"), F.min("c").alias("hub")).where("m > 1")
    members = written(banded.join(buckets, ["band", "key"]), "buckets")
    texts = written(_class_texts(docs, members.select("c").distinct().join(reps, "c")), "texts")
    hubs = members.where("c <> hub").groupBy("c", "hub").agg(F.count("*").alias("shared"))
    best = hubs.groupBy("c").agg(F.array_distinct(F.array(F.max_by("hub", "shared"), F.min("hub"))).alias("hubs"))
    pairs = written(best.select(F.explode("hubs").alias("a"), F.col("c").alias("b")), "pairs")
    rep_of = lambda side: reps.select(F.col("c").alias(side), F.col("rep").alias(f"rep_{side}"))
    by_rep = lambda links: links.join(rep_of("a"), "a").join(rep_of("b"), "b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    links = written(by_rep(verify(pairs, texts)), "verified")
    found = components(links)
    # what the hubs did not tie: in a bucket of several components, those outside its largest against all
    comp_of = reps.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("c", F.coalesce("component", "rep").alias("comp"))
    labelled = members.join(comp_of, "c").select("band", "key", "c", "n", "comp")
    sizes = labelled.groupBy("band", "key", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("w")).groupBy("band", "key")
    mixed = sizes.agg(F.count("*").alias("k"), F.sum("c").alias("m"), F.sum("w").alias("w"), F.max(F.struct("c", "w", "comp")).alias("top")).where("k > 1")
    blocks_of = lambda rows, elements: F.ceil(F.greatest(rows / BLOCK, elements / BLOCK_WORDS)).cast("int")
    mixed = mixed.select("band", "key", F.col("top.comp").alias("main"), blocks_of(F.col("top.c"), F.col("top.w")).alias("mp"), blocks_of(F.col("m") - F.col("top.c"), F.col("w") - F.col("top.w")).alias("op"))
    rows = labelled.join(mixed, ["band", "key"]).withColumn("is_main", F.col("comp") == F.col("main"))
    dealt = F.xxhash64("c")
    rows = rows.withColumn("part", F.when(F.col("is_main"), F.pmod(dealt, "mp")).otherwise(F.col("mp") + F.pmod(dealt, "op")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.when(F.col("is_main"), F.col("mp")).otherwise(F.lit(0)), F.col("mp") + F.col("op") - 1)))
    rows = rows.select("band", "key", "c", "comp", "part", F.greatest("part", "other").alias("i"), F.least("part", "other").alias("j"))
    rows = rows.join(unique.select("c", "sketch", F.col("packed").alias("keys")), "c").select(*_BLOCK_KEY, "c", "comp", "part", "sketch", "keys")
    blocks = lambda df: df.repartition(*_BLOCK_KEY).sortWithinPartitions(*_BLOCK_KEY, "c")
    crossed = blocks(rows).mapInArrow(_cross_rows, rows.schema)
    more = blocks(crossed.join(texts, "c")).mapInArrow(_settle_rows, "a long, b long")
    whole = components(found.select(F.col("component").alias("a"), F.col("id").alias("b")).unionByName(by_rep(more)).unionByName(same_id))
    return table.select("id", F.col("n").alias("n_shingles")).join(whole, "id", "left").select("id", "n_shingles", F.coalesce("component", "id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of docs without those that have a near duplicate of smaller id; columns as they were."""
    gone = link_components(docs, id_col, text_col).where("id <> component_id").select(F.col("id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti").select(docs.columns)
