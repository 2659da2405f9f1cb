"""Conversation prefix trie, built compressed (operator 12).

Conversations are sequences of turns, a turn being known by 128 bits of the SHA-256 of its role and text.  Equal sequences become
one row with their number and least id.  The distinct ones are sorted by a range exchange; where neighbours part is a branch point,
where a sequence ends an end or leaf point, and only these points (and the root) become nodes of the Patricia tree, each with the
edge that leads to it.  Ranges are walked one by one with a stack.  A node whose sequences lie in several ranges is on the path of
a range's first or last row, so these rows are told which of their prefixes are points of other ranges; then every range gives
its share of each node's sums, and the shares are added by node.  A node's own edge counts in the range where the node begins.

All aggregates are computed on the compressed tree.  Nodes inside an edge have one child and their members' number, least id and
leaves as the edge's lower end has them; their saved tokens follow from suffix sums of the edge's text sizes, when the edges are
expanded at the very end.

Copies of one conversation, a common first turn and a node with a third of all children cost rows and no collected group: members
are added before they are shuffled, and the digest of an end's ids is fed from a sorted stream.  A conversation is one row of 48
bytes a turn, texts don't travel.

Defined results: rows with a null conv_id are no conversation's.  Null roles and texts are empty.  Turns go by ``turn``, null first;
equal turns by role, then by their hash; repeated rows are turns as often as they are there.  An empty table has no nodes; any other
has the root.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written

#: Conversations whose ids are apart by less than this may share their head, of fewer turns than that.
FAMILY, HEAD = 5, 9
EMPTY = hashlib.sha256(b"").hexdigest()


def turns(rows: DataFrame) -> DataFrame:
    """conv_id, turns: each conversation's turns in order, as structs with t (hash) and size (bytes of the text)."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    known = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)
    own = rows.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").alias("turn"), role.alias("role"), known.alias("t"), F.octet_length(text).cast("long").alias("size")).alias("turn"))
    return own.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns")).withColumn("turns", F.transform("turns", lambda x: F.struct(x["t"].alias("t"), x["size"].alias("size"))))


def rebuilt(conversations: DataFrame, family: int = FAMILY, head: int = HEAD) -> DataFrame:
    """Every conversation with the first turns of its family's first one in place of its own; conversations: conv_id, turns."""
    h = F.crc32(F.col("conv_id").cast("string")) % head
    own = conversations.select("conv_id", "turns", (F.col("conv_id") - F.col("conv_id") % family).alias("base"), h.cast("int").alias("h"))
    heads = conversations.select(F.col("conv_id").alias("base"), F.slice("turns", 1, head - 1).alias("first"))
    begin = F.slice(F.coalesce("first", F.slice("turns", 1, 0)), F.lit(1), F.col("h"))
    rest = F.slice("turns", F.col("h") + 1, F.size("turns"))
    return own.join(heads, "base", "left").select("conv_id", F.concat(begin, rest).alias("turns"))


def _key(seq: Column) -> Column:
    """The name of the node at the end of a sequence."""
    return F.substring(F.sha2(F.array_join(seq, ""), 256), 1, 32)


def names(seq: list[str], depths: list[int]) -> list[str]:
    """The names of a sequence's prefixes of these depths, ascending."""
    h, at, out = hashlib.sha256(), 0, []
    for d in depths:
        h.update("".join(seq[at:d]).encode())
        at = d
        out.append(h.copy().hexdigest()[:32])
    return out


def shared(x: list[str] | None, y: list[str] | None) -> int:
    """The length of the common prefix."""
    n = min(len(x or ()), len(y or ()))
    return next((d for d in range(n) if x[d] != y[d]), n)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows with their range, their place there and what they share with the row before."""
    part, row, seq = TaskContext.get().partitionId(), 0, None
    for b in batches:
        seqs = b.column("seq").to_pylist()
        before = [shared(x, y) for x, y in zip([seq, *seqs[:-1]], seqs, strict=True)] if seqs else []
        seq = seqs[-1] if seqs else seq
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seqs), part, np.int32)), pa.array(np.arange(row, row + len(seqs))), *b.columns, pa.array(before, pa.int32())], ["part", "row", *b.schema.names, "before"])
        row += len(seqs)


def _points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The names of the points where rows end and where they part from the row before."""
    for b in batches:
        keys: set[str] = set()
        for s, d in zip(b.column("seq").to_pylist(), b.column("before").to_pylist(), strict=True):
            keys.update(names(s, [d, len(s)]))
        yield pa.RecordBatch.from_arrays([pa.array(sorted(keys), pa.string())], ["key"])


def _end_prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every prefix of a range's first and last row; ``seam`` where it ends what two ranges share."""
    for b in batches:
        for r in b.to_pylist():
            seams = [shared(r["first"], r["prior"]), shared(r["final"], r["next"])]
            out = []
            for side, seam in zip(("first", "final"), seams, strict=True):
                depths = list(range(len(r[side]) + 1))
                out += [(r["part"], side == "final", d, k, d == seam, *seams) for d, k in zip(depths, names(r[side], depths), strict=True)]
            cols = [list(c) for c in zip(*out, strict=True)]
            kinds = [pa.int32(), pa.bool_(), pa.int32(), pa.string(), pa.bool_(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["part", "final", "d", "key", "seam", "from_prior", "to_next"])


def _told(rows: DataFrame) -> DataFrame:
    """part, from_prior, to_next, of_first, of_final: what each range shares with its neighbours and the points on its end rows' paths."""
    ends = rows.groupBy("part").agg(F.min_by("seq", "row").alias("first"), F.max_by("seq", "row").alias("final"))
    in_order = Window.orderBy("part")  # a row a range: few, whatever the table
    ends = ends.select("part", "first", "final", F.lag("final").over(in_order).alias("prior"), F.lead("first").over(in_order).alias("next"))
    prefixes = written(ends.mapInArrow(_end_prefixes, "part int, final boolean, d int, key string, seam boolean, from_prior int, to_next int"), "seams")
    points = rows.select("seq", "before").mapInArrow(_points, "key string").unionByName(prefixes.where("seam").select("key"))
    known = prefixes.join(points, "key", "left_semi")
    of = lambda side: F.collect_list(F.when(side, F.col("d")))
    return known.groupBy("part").agg(F.min("from_prior").alias("from_prior"), F.min("to_next").alias("to_next"), of(~F.col("final")).alias("of_first"), of(F.col("final")).alias("of_final"))


class _Open:
    """A node of the path that is being walked, with its sums so far; it begins in this range if it is deeper than ``floor``."""

    __slots__ = ("depth", "key", "edge", "floor", "n", "least", "leaves", "ends", "children", "gross", "once")

    def __init__(self, depth: int, key: str, edge: list[int], floor: int):
        self.depth, self.key, self.edge, self.floor = depth, key, edge, floor
        self.n = self.leaves = self.ends = self.children = self.gross = self.once = 0
        self.least = None

    def add(self, n: int, least: int) -> None:
        self.n += n
        self.least = least if self.least is None else min(self.least, least)


class _Walk:
    """One range, row by row.  A node is closed when a row shares less than its depth, and its sums go to its parent."""

    def __init__(self, from_prior: int, to_next: int, of_first: list[int], of_final: list[int]):
        self.path = [_Open(0, names([], [0])[0], [], 0)]
        self.from_prior, self.to_next, self.of_first, self.of_final = from_prior, to_next, of_first, of_final
        self.seq: list[str] = []
        self.out: list[tuple] = []
        self.fresh = True

    def _emit(self, v: _Open, above: _Open | None) -> None:
        below = [*np.cumsum(v.edge[:-1][::-1]).tolist()[::-1], 0] if v.edge else []  # the sizes from each depth to the last but one
        size = v.edge[-1] if v.edge else 0
        self.out.append((v.key, v.depth, above and above.key, above and above.depth, below, size, v.n, v.least, v.leaves, v.ends, v.children, v.gross, v.once))

    def _split(self, i: int, depth: int) -> None:
        """Puts a point at ``depth`` into the edge of the path's node ``i``."""
        v, top = self.path[i], self.path[i - 1].depth
        self.path.insert(i, _Open(depth, names(self.seq, [depth])[0], v.edge[: depth - top], v.floor))
        v.edge = v.edge[depth - top :]

    def close(self, stop: int) -> None:
        """Closes nodes deeper than ``stop``; there is a node of that depth then, if there was a path so deep."""
        while self.path[-1].depth > stop:
            if self.path[-2].depth < stop:
                self._split(len(self.path) - 1, stop)
            v, above = self.path.pop(), self.path[-1]
            begins, volume = v.depth > v.floor, sum(v.edge)
            above.add(v.n, v.least)
            above.leaves += v.leaves
            above.children += begins
            above.gross += v.gross + v.n * volume
            above.once += v.once + begins * volume
            self._emit(v, above)

    def row(self, seq: list[str], sizes: list[int], n: int, least: int, before: int, last: bool) -> None:
        if not self.fresh:
            self.path[-1].leaves += before < self.path[-1].depth
            self.close(before)
        self.seq = seq
        told = set(self.of_first if self.fresh else ()) | set(self.of_final if last else ())
        floor = self.from_prior if self.fresh else 0
        for d in sorted(told & set(range(1, self.path[-1].depth))):
            i = next(k for k, v in enumerate(self.path) if v.depth >= d)
            if self.path[i].depth > d:
                self._split(i, d)
        top = self.path[-1].depth
        new = sorted({d for d in (*told, len(seq)) if d > top})
        for d, key in zip(new, names(seq, new), strict=True):
            self.path.append(_Open(d, key, sizes[self.path[-1].depth : d], floor))
        self.path[-1].add(n, least)
        self.path[-1].ends += n
        self.fresh = False

    def finish(self) -> None:
        self.path[-1].leaves += self.to_next < self.path[-1].depth
        self.close(0)
        self._emit(self.path.pop(), None)


NODE = "key string, depth int, parent string, above int, below array<long>, size long, n long, least long, leaves long, ends long, children long, gross long, once long"


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each range's share of its nodes; a range comes as what it is told and then its rows in order."""
    kinds = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.list_(pa.int64()), *[pa.int64()] * 8]

    def flush(out: list[tuple]) -> pa.RecordBatch:
        cols = [list(c) for c in zip(*out, strict=True)] if out else [[]] * len(kinds)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [f.split()[0] for f in NODE.split(", ")])

    walk, left = None, 0
    for b in batches:
        cols = (b.column(c).to_pylist() for c in ("row", "seq", "sizes", "n", "least", "before", "from_prior", "to_next", "of_first", "of_final", "rows"))
        for row, seq, sizes, n, least, before, from_prior, to_next, of_first, of_final, rows in zip(*cols, strict=True):
            if row < 0:
                walk, left = _Walk(from_prior, to_next, of_first, of_final), rows
                continue
            left -= 1
            walk.row(seq, sizes, n, least, before, not left)
            if not left:
                walk.finish()
                yield flush(walk.out)
        if walk is not None and walk.out:
            yield flush(walk.out)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, digest of its ids, of rows sorted by key and id."""
    key, h = None, None
    for b in batches:
        out = []
        for k, c in zip(b.column("key").to_pylist(), b.column("conv_id").to_pylist(), strict=True):
            if k != key:
                if h is not None:
                    out.append((key, h.hexdigest()))
                key, h = k, hashlib.sha256(str(c).encode())
            else:
                h.update(b",%d" % c)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.string()), pa.array([d for _, d in out], pa.string())], ["key", "digest"])
    if h is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([h.hexdigest()])], ["key", "digest"])


def patricia(members: DataFrame) -> DataFrame:
    """The compressed tree, a row a node with its sums; members: conv_id, key (of the whole sequence), seq, sizes."""
    distinct = members.groupBy("key").agg(F.first("seq").alias("seq"), F.first("sizes").alias("sizes"), F.count("*").alias("n"), F.min("conv_id").alias("least"))
    ranges = distinct.select("seq", "sizes", "n", "least").repartitionByRange("seq").sortWithinPartitions("seq")
    rows = written(ranges.mapInArrow(_neighbours, "part int, row long, seq array<string>, sizes array<long>, n long, least long, before int"), "sequences")
    told = _told(rows).join(rows.groupBy("part").agg(F.count("*").alias("rows")), "part").withColumn("row", F.lit(-1).cast("long"))
    stream = rows.unionByName(told, allowMissingColumns=True).repartition("part").sortWithinPartitions("part", "row")
    shares = stream.mapInArrow(_walked, NODE)
    one = [F.first(c).alias(c) for c in ("depth", "parent", "above", "below", "size")]
    sums = [F.sum(c).alias(c) for c in ("n", "leaves", "ends", "children", "gross", "once")]
    return shares.groupBy("key").agg(*one, *sums, F.min("least").alias("least"))


def nodes(rows: DataFrame) -> DataFrame:
    """All nodes of the trie of the rebuilt conversations; rows: conv_id, turn, role, text."""
    seqs = rebuilt(turns(rows)).select("conv_id", F.transform("turns", lambda x: x["t"]).alias("seq"), F.transform("turns", lambda x: x["size"]).alias("sizes"))
    members = written(seqs.withColumn("key", _key(F.col("seq"))), "conversations")
    tree = written(patricia(members), "patricia")
    digests = members.select("key", "conv_id").repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(_digests, "key string, digest string")
    parents = tree.select(F.col("key").alias("parent"), F.col("least").alias("parent_least"))
    full = tree.join(digests, "key", "left").join(parents, "parent", "left")
    # an edge's nodes, the lower end last; the root has no edge
    at = full.select("*", F.posexplode_outer("below").alias("i", "tail"))
    depth = F.coalesce(F.col("above") + 1 + F.col("i"), F.lit(0))
    low = depth == F.col("depth")
    saved = (F.col("n") - 1) * (F.col("size") + F.coalesce("tail", F.lit(0))) + F.col("gross") - F.col("once")
    return at.select(
        F.col("least").alias("conv_id"),
        depth.cast("long").alias("depth"),
        F.when(F.col("i") == 0, F.col("parent_least")).when(F.col("i") > 0, F.col("least")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(low, F.col("children")).otherwise(1).alias("n_children"),
        F.greatest("leaves", F.lit(1)).alias("n_leaves"),
        saved.alias("saved_tokens"),
        F.when(low, F.coalesce("digest", F.lit(EMPTY))).otherwise(EMPTY).alias("ends_sha256"),
    )
