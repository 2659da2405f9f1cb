"""Which rows of a bucket are beaten by a better one that agrees with them, judged in blocks.

A block is the rows of one key, or two parts of a large one; small blocks are judged together.  Only pairs inside a block whose ranks
can decide are made, best candidates first and some at a time: a row that is beaten asks no more, and what a test refuses is not tested
again, so lists are compared for few pairs.  Only the ids of beaten rows leave a block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Rows of a part of a large bucket; rows at which small buckets are judged together.
ROWS, TOGETHER = 4096, 512
#: Candidates that a row is compared with at first; pairs that are held at once.
FIRST, PAIRS = 64, 1 << 19
KEY = ("key", "i", "j")


def shared(lists: pa.ListArray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function of two arrays of rows: how many values each pair shares; the values of a row are distinct.

    Values that one row alone has are left out.  Rows are bit sets or, of many values, short lists of numbers.
    """
    n = lists.value_lengths().to_numpy(zero_copy_only=False)
    _, at, count = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
    row, common = np.repeat(np.arange(len(n)), n), count > 1
    keep = common[at]
    row, at = row[keep], (np.cumsum(common) - 1)[at[keep]]
    words, longest = -(-int(common.sum()) // 64), int(np.bincount(row, minlength=1).max())
    if words <= longest * longest:
        bits = np.zeros((words, len(n)), np.uint64)
        np.bitwise_or.at(bits, (at >> 6, row), np.uint64(1) << (at & 63).astype(np.uint64))
        return lambda x, y: sum((np.bitwise_count(b[x] & b[y]) for b in bits), np.zeros(len(x), np.int32))
    place = np.arange(len(row)) - np.searchsorted(row, row)
    mine, theirs = (np.full((longest, len(n)), none, np.int32) for none in (-1, -2))
    mine[place, row] = theirs[place, row] = at
    return lambda x, y: sum(((a[x] == b).sum(axis=0, dtype=np.int32) for b in [theirs[:, y]] for a in mine), np.zeros(len(x), np.int32))


def heads(t: pa.Table) -> np.ndarray:
    """Numbers in the order of what ranks begin with: dated rows, earlier, shorter titles."""
    head = [t.column(c).cast(pa.float64()).fill_null(0).to_numpy() for c in ("length", "at", "undated")]
    order = np.lexsort(head)
    new = np.logical_or.reduce([h[order][1:] != h[order][:-1] for h in head])
    out = np.zeros(t.num_rows, np.int64)
    out[order[1:]] = np.cumsum(new)
    return out


def before(t: pa.Table, head: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function of two arrays of rows: whether y's rank comes before x's; y's head is not after x's.  Then numbers as numbers, all else as text."""
    _, name = np.unique(np.array([x.encode() for x in t.column("video_id").to_pylist()], object), return_inverse=True)
    number, none = t.column("number").fill_null(0).to_numpy(), np.asarray(t.column("number").is_null())

    def judged(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = name[x] != name[y]
        tied = np.flatnonzero(head[y] == head[x])
        x, y = x[tied], y[tied]
        numbers = ~none[x] & ~none[y] & (number[x] != number[y])
        out[tied] = np.where(numbers, number[y] < number[x], name[y] < name[x])
        return out

    return judged


def candidates(t: pa.Table, head: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first, number): the rows of each part by their heads, and for each row where its candidates begin in that order and how many they are.

    The candidates of a row are those of its own part, or, in a block of two parts, those of the other, whose heads are not after its own.
    """
    key = [t.column(c).to_numpy() for c in reversed(KEY)]
    part, high = t.column("part").to_numpy(), t.column("i").to_numpy()
    order = np.lexsort([head, part, *key])
    new = np.zeros(t.num_rows, bool)
    new[:1] = True
    new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in key])
    group = np.empty(t.num_rows, np.int64)  # two for each block: its lower part and its higher one
    group[order] = 2 * (np.cumsum(new) - 1)
    upper = part == high
    own = key[0] == high
    group += upper & ~own
    at = group * (int(head.max(initial=0)) + 1)
    placed = (at + head)[order]
    other = np.where(own, group, group ^ 1) * (int(head.max(initial=0)) + 1)
    first = np.searchsorted(placed, other)
    return order, first, np.searchsorted(placed, other + head, side="right") - first


def beaten(t: pa.Table, least: dict[str, int], reach: int | None) -> np.ndarray:
    """Rows of some whole blocks that a better row of their block agrees with: in ``least`` values of each list, in quality and duration."""
    head = heads(t)
    order, first, number = candidates(t, head)
    quality, duration = t.column("quality").to_numpy(), t.column("duration").to_numpy()
    tests = [lambda x, y: quality[x] == quality[y]] if (quality[1:] != quality[:-1]).any() else []
    if reach is not None:
        tests.append(lambda x, y: np.abs(duration[x] - duration[y]) <= reach)
    of_list = lambda c: lambda x, y, of=shared(t.column(c).combine_chunks()): of(x, y) >= least[c]
    lengths = {c: len(t.column(c).combine_chunks().flatten()) for c in least}
    tests += [of_list(c) for c in sorted(least, key=lambda c: (c == "artists", lengths[c]))]  # short lists first; the key has an artist
    tests.append(before(t, head))
    out = np.zeros(t.num_rows, bool)
    done, step = 0, FIRST
    while len(asking := np.flatnonzero(~out & (number > done))):
        n = np.minimum(number[asking], done + step) - done
        ends = np.cumsum(n)
        at = 0
        while at < len(asking):  # as many rows as make some pairs
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
            rows, some = asking[at:to], n[at:to]
            x = np.repeat(rows, some)
            y = order[np.repeat(first[rows] + done - (np.cumsum(some) - some), some) + np.arange(len(x))]
            for test in tests:
                ok = test(x, y)
                x, y = x[ok], y[ok]
            out[x] = True
            at = to
        done, step = done + step, 2 * step
    return out


def judge(batches: Iterator[pa.RecordBatch], least: dict[str, int], reach: int | None) -> Iterator[pa.RecordBatch]:
    """video_id of beaten rows; rows come sorted by KEY."""
    held: list[pa.Table] = []

    def out(t: pa.Table) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([t.column("video_id").combine_chunks().filter(pa.array(beaten(t, least, reach)))], ["video_id"])

    for b in batches:
        if not b.num_rows:
            continue
        t = pa.concat_tables([*held, pa.Table.from_batches([b])]).combine_chunks()
        cols = [t.column(c).to_numpy() for c in KEY]
        ends = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1
        at = 0
        while True:  # whole keys, as many as make a block
            k = np.searchsorted(ends, at + TOGETHER)
            if k == len(ends):
                break
            yield out(t.slice(at, int(ends[k]) - at))
            at = int(ends[k])
        held = [t.slice(at)]
    if held and held[0].num_rows:
        yield out(held[0])
