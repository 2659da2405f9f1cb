"""Word positions and hashes of Arrow text columns, computed with numpy for a whole slice at a time.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D.  Hashes are 64 bits wide; they are
made from prefix sums, so the hash of any run of words costs one subtraction.  All functions take
null texts as empty and keep the order of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text that are worked on at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20
#: Powers of a base that are kept for the next slice.
KEPT_POWERS = 4 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
CODE_POINT = np.ones(256, bool)  # bytes that begin a code point
CODE_POINT[0x80:0xC0] = False

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE, _WORD_BASE = 0x9E3779B97F4A7C15 | 5, 0xD6E8FEB86659FD93 | 5
#: The same for a second hash that doesn't follow from the first.
_BYTE_2 = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE_2, _WORD_BASE_2 = 0xC2B2AE3D27D4EB4F | 5, 0x165667B19E3779F9 | 5
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _pow(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        both = []
        for b in (base, pow(base, -1, 2**64)):
            p = np.full(size, b, U64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        have = (both[0], both[1])
        if size <= KEPT_POWERS:
            _powers[base] = have
    return have[0][:n], have[1][:n]


def prefix(values: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * _pow(base, len(values))[0], out=out[1:])
    return out


def span_hash(pre: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    inv = _pow(base, len(pre))[1]
    return mix((pre[ends] - pre[starts]) * inv[starts] + (ends - starts).astype(U64) * U64(0xA24BAED4963EE407))


def bytes_hash(pieces: list[bytes]) -> np.ndarray:
    """One hash for each string of bytes."""
    n = np.fromiter(map(len, pieces), np.int64, len(pieces))
    end = np.cumsum(n)
    return span_hash(prefix(_BYTE[np.frombuffer(b"".join(pieces), np.uint8)], _BASE), end - n, end, _BASE)


class Words:
    """Words of the texts of one slice.

    data: all bytes; text_off: byte offsets of texts (n+1); starts, ends: byte ranges of words;
    off: word offsets of texts (n+1).
    """

    def __init__(self, column: pa.Array, lower: bool = False):
        data, self.text_off = buffers(column)
        self.data = LOWER[data] if lower else data
        self.n = len(self.text_off) - 1
        inside = ~SPACE[self.data]
        first = np.zeros(len(data) + 1, bool)
        first[self.text_off] = True
        begin = inside.copy()
        begin[1:] &= ~inside[:-1] | first[1:-1]
        end = inside
        end[:-1] &= ~inside[1:] | first[1:-1] if len(end) else end[:-1]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.off = np.searchsorted(self.starts, self.text_off)
        self._pre = None

    @property
    def byte_prefix(self) -> np.ndarray:
        if self._pre is None:
            self._pre = prefix(_BYTE[self.data], _BASE)
        return self._pre

    def byte_hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the byte ranges."""
        return span_hash(self.byte_prefix, starts, ends, _BASE)

    def hashes(self) -> np.ndarray:
        """One hash for each word."""
        return self.byte_hash(self.starts, self.ends)

    def second_hashes(self) -> np.ndarray:
        """Another hash for each word, from other byte values and another base."""
        return span_hash(prefix(_BYTE_2[self.data], _BASE_2), self.starts, self.ends, _BASE_2)

    def counts(self) -> np.ndarray:
        return np.diff(self.off)

    def doc(self) -> np.ndarray:
        """Index of each word's text."""
        return np.repeat(np.arange(self.n), self.counts())

    def windows(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First word of every run of k words of one text, and the runs' hashes."""
        left = np.repeat(self.off[1:], self.counts()) - np.arange(len(hashes))
        at = np.flatnonzero(left >= k)
        return at, span_hash(prefix(hashes, _WORD_BASE), at, at + k, _WORD_BASE)

    def second_windows(self, at: np.ndarray, k: int) -> np.ndarray:
        """Second hashes of the runs of k words that begin at the words ``at``."""
        return span_hash(prefix(self.second_hashes(), _WORD_BASE_2), at, at + k, _WORD_BASE_2)

    def whole(self, hashes: np.ndarray) -> np.ndarray:
        """Hash of each text's whole word sequence."""
        return span_hash(prefix(hashes, _WORD_BASE), self.off[:-1], self.off[1:], _WORD_BASE)

    def per_text(self, mask: np.ndarray) -> np.ndarray:
        """Sum over each text of a value for each byte."""
        return sums(mask, self.text_off)


def sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a text column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    off = np.frombuffer(offsets, width)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each holds at most so many bytes of text, or one row."""
    for batch in batches:
        off = buffers(batch.column(column))[1]
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi


def repeats(group: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks over rows: another row has the same (group, key); an earlier one has.  Rows come by group."""
    order = np.lexsort((key, group))
    g, k = group[order], key[order]
    same = (g[1:] == g[:-1]) & (k[1:] == k[:-1])
    any_, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    later[order[1:][same]] = True
    any_[order[1:][same]] = True
    any_[order[:-1][same]] = True
    return any_, later
