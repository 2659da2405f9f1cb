"""Best-fit packing (operator 8) by length histogram.

Documents become pieces of at most ``CAPACITY`` tokens; only longer documents are cut.  The plan is made
over the histogram of piece lengths, not over pieces: lengths are taken in descending order, and all
pieces of a length go to the open sequences with the least room that suffices, a run of equal sequences
at a time.  So the plan has a number of entries that the capacity bounds, however many pieces there
are.  An entry gives the ranks ``lo`` to ``hi`` of a length to consecutive sequences, ``per`` to each,
at ``offset``.  Pieces take their slots by a join on (length, rank in the length).  Ranks are counted in
blocks of pieces, so that a length that most pieces have is no single task's work.

Token ids come from a public tokenizer whose path is a parameter.  White space separates its words, so
each distinct word of a task is encoded once and a document is put together from its words' ids; a tokenizer that
does not cut there is refused when it is loaded.

Defined results: null and empty texts are the end id alone; rows with equal or null ids are packed each
for itself; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import bisect
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written
from .words import U64, Words, slices

CAPACITY = 4096
END_ID = 1
#: Pieces whose ranks one task counts, of a length.
BLOCK = 1 << 13
#: Words that a Python worker remembers, and bytes of text that are worked on at once.
REMEMBERED, SLICE = 1 << 21, 2 << 20


_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?")] = True




class WordIds:
    """Ids of words by their hashes; a word is encoded once and remembered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.cuts_marks = self._rules(path)
        self.clear()

    def _rules(self, path: str) -> bool:
        """Whether the tokenizer cuts before closing marks; one that doesn't cut at white space can't be used word by word."""
        ids = lambda x: self.tokenizer.encode(x, add_special_tokens=False).ids
        probes = ("ab", "Wort", "x1", "mañana", "é,è", "(a)", "don't", "…")
        if any(ids(f"{a}{s}{b}") != ids(a) + ids(b) for a in probes for b in probes[::3] for s in (" ", "\n", "\t  ")):
            raise ValueError(f"{path} does not cut texts at white space")
        return all(ids(a + chr(m)) == ids(a) + ids(chr(m)) for a in ("ab", "Z", "x1", "éa", "7") for m in np.flatnonzero(_MARK))

    def clear(self) -> None:
        self.keys, self.at = np.zeros(0, U64), np.zeros(0, np.int64)
        self.n, self.start, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        start = len(self.ids) + np.cumsum(n) - n
        at = len(self.n) + np.arange(len(ids))
        self.ids = np.concatenate([self.ids, np.fromiter((x for y in ids for x in y), np.uint32, int(n.sum()))])
        self.n, self.start = np.concatenate([self.n, n]), np.concatenate([self.start, start])
        place = np.searchsorted(self.keys, keys)  # new keys ascend as well
        self.keys, self.at = np.insert(self.keys, place, keys), np.insert(self.at, place, at)

    def encode(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and the texts' offsets in them."""
        starts, ends, off = split_marks(w) if self.cuts_marks else (w.starts, w.ends, w.off)
        keys, first, back = np.unique(w.byte_hash(starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) > REMEMBERED:
            self.clear()
        at = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != keys[inside]
        if new.any():
            raw = bytes(w.data)
            self._learn(keys[new], [raw[s:e].decode() for s, e in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
            at = np.searchsorted(self.keys, keys)
        entry = self.at[at][back]
        n = self.n[entry]
        total = np.concatenate([[0], np.cumsum(n)])
        take = np.arange(total[-1]) + np.repeat(self.start[entry] - total[:-1], n)
        return self.ids[take], total[off]


def split_marks(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, with one closing mark after an ASCII letter or digit as a word of its own; offsets of texts.

    The tokenizer cuts there as well, so the ids stay the same and there are fewer distinct words.
    """
    last = w.data[w.ends - 1] if len(w.ends) else np.zeros(0, np.uint8)
    before = w.data[np.maximum(w.ends - 2, 0)] if len(w.ends) else last
    cut = _MARK[last] & _LETTER[before] & (w.ends - w.starts > 1)
    n = 1 + cut
    place = np.cumsum(n) - n
    starts, ends = np.empty(int(n.sum()), np.int64), np.empty(int(n.sum()), np.int64)
    starts[place], ends[place] = w.starts, w.ends - cut
    starts[place[cut] + 1], ends[place[cut] + 1] = w.ends[cut] - 1, w.ends[cut]
    return starts, ends, np.concatenate([place, [len(starts)]])[w.off]


_encoders: dict[str, WordIds] = {}


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """id, piece, start, length, ids_crc32 (and ids): a row for each piece of each row of docs."""

    def run(batches):
        if tokenizer not in _encoders:
            _encoders[tokenizer] = WordIds(tokenizer)
        for b in slices(batches, "text", SLICE):
            ids, off = _encoders[tokenizer].encode(Words(b.column("text")))
            rows, piece, start, length, crc, kept = [], [], [], [], [], []
            for i in range(b.num_rows):
                own = np.append(ids[off[i] : off[i + 1]], np.uint32(end_id)).astype("<u4")
                for k, s in enumerate(range(0, len(own), capacity)):
                    part = own[s : s + capacity]
                    rows.append(i), piece.append(k), start.append(s), length.append(len(part)), crc.append(zlib.crc32(part))
                    if with_ids:
                        kept.append(part)
            out = [b.column("id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            if with_ids:
                out.append(pa.array(kept, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(out, [id_col, "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Entries (length, lo, hi, sequence, per, offset): rank r of a length, lo <= r < hi, goes to
    sequence + (r - lo) // per, at offset + (r - lo) % per * length."""
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens: runs (first sequence, number)
    free: list[int] = []  # ascending keys of room
    entries, next_sequence = [], 0

    def add(r: int, first: int, n: int) -> None:
        if n and r:
            if r not in room:
                room[r] = []
                bisect.insort(free, r)
            room[r].append((first, n))

    for length in sorted(histogram, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} tokens doesn't fit {capacity}")
        rank, left = 0, histogram[length]
        while left:
            at = bisect.bisect_left(free, length)
            if at < len(free):
                r = free[at]
                first, n = room[r].pop()
                if not room[r]:
                    del room[r], free[at]
            else:
                r, first, n = capacity, next_sequence, -(-left // (capacity // length))
                next_sequence += n
            per = r // length
            whole = min(n, left // per)
            if whole:
                entries.append((length, rank, rank + whole * per, first, per, capacity - r))
                rank, left = rank + whole * per, left - whole * per
                add(r - per * length, first, whole)
            if whole < n and left:  # one sequence takes what is left, fewer than per
                entries.append((length, rank, rank + left, first + whole, per, capacity - r))
                add(r - left * length, first + whole, 1)
                rank, left, whole = rank + left, 0, whole + 1
            add(r, first + whole, n - whole)
    return entries


def ranks(rows: DataFrame, order: list[Column], block: int = BLOCK) -> tuple[DataFrame, dict[int, int]]:
    """rows with ``rank`` in their length from 0, and the histogram of lengths (as many entries as the capacity)."""
    histogram = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}
    spark = rows.sparkSession
    blocks = spark.createDataFrame([(k, -(-n // block)) for k, n in histogram.items()], "length long, blocks long")
    dealt = rows.join(F.broadcast(blocks), "length").withColumn("block", F.pmod(F.xxhash64(*order), "blocks")).drop("blocks")
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("length", "block").count().select("length", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "block").orderBy(*order)) - 1
    return dealt.withColumn("own", own).join(counts, ["length", "block"]).withColumn("rank", F.col("own") + F.col("before")).drop("own", "before", "block"), histogram


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """pieces() with sequence_id and offset."""
    rows = written(pieces(docs, tokenizer, id_col, text_col, capacity, end_id), "pieces")
    ranked, histogram = ranks(rows, [F.col(id_col), F.col("piece"), F.col("ids_crc32")])
    # entries are bounded by the capacity: see plan()
    slots = docs.sparkSession.createDataFrame(plan(histogram, capacity), "length long, lo long, hi long, sequence long, per long, at long")
    placed = ranked.join(F.broadcast(slots), (ranked["length"] == slots["length"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))).drop(slots["length"])
    step = F.col("rank") - F.col("lo")
    return placed.select(id_col, "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.floor(step / F.col("per"))).alias("sequence_id"), (F.col("at") + step % F.col("per") * F.col("length")).alias("offset"))
