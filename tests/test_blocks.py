"""Blocks of duplicates: who is beaten, against all pairs, and how much is compared and held for it."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from trivalent.operators import blocks

SCHEMA = pa.schema(
    [("key", pa.int64()), *((c, pa.int32()) for c in ("i", "j", "part")), ("video_id", pa.string()), ("number", pa.int64()), ("undated", pa.bool_()), ("at", pa.float64()), ("length", pa.int64()), ("quality", pa.int64()), ("duration", pa.int64())]
    + [(c, pa.list_(pa.int64())) for c in ("artists", "tags", "words")]
)


def _row(rng, k, r, parts):
    number = 1000 * k + r if rng.random() < 0.7 else None
    return {
        "key": 7 * k - 5, "part": rng.randrange(parts), "video_id": str(number) if number is not None else f"{rng.randrange(9)}x{r}-{k}", "number": number,
        "undated": rng.random() < 0.3, "at": rng.randrange(4) + 0.5, "length": rng.randrange(2), "quality": rng.randrange(2), "duration": rng.randrange(20),
        "artists": rng.sample(range(3), rng.randrange(1, 3)), "tags": rng.sample(range(12), rng.randrange(7)), "words": rng.sample(range(40), 8),
    }


def _before(y, x):
    """Whether y comes first."""
    a, b = ((r["undated"], r["at"], r["length"]) for r in (y, x))
    if a != b:
        return a < b
    if None not in (x["number"], y["number"]) and x["number"] != y["number"]:
        return y["number"] < x["number"]
    return y["video_id"].encode() < x["video_id"].encode()


@pytest.mark.parametrize(("first", "pairs"), [(64, 1 << 19), (1, 5), (3, 1000)])
def test_against_all_pairs(monkeypatch, first, pairs):
    monkeypatch.setattr(blocks, "FIRST", first)
    monkeypatch.setattr(blocks, "PAIRS", pairs)
    monkeypatch.setattr(blocks, "TOGETHER", 50)
    rng = random.Random(first)
    dealt, expected = [], set()
    least = {"artists": 1, "tags": 2, "words": 2}
    for k in range(12):
        parts = rng.choice([1, 1, 2, 3])
        rows = [_row(rng, k, r, parts) for r in range(rng.randrange(1, 60))]
        dealt += [{**r, "i": max(r["part"], o), "j": min(r["part"], o)} for r in rows for o in range(parts)]
        agrees = lambda x, y: x["quality"] == y["quality"] and abs(x["duration"] - y["duration"]) <= 5 and all(len({*x[c]} & {*y[c]}) >= n for c, n in least.items())
        expected |= {x["video_id"] for x in rows for y in rows if x is not y and agrees(x, y) and _before(y, x)}
    dealt.sort(key=lambda r: (r["key"], r["i"], r["j"]))
    t = pa.Table.from_pylist(dealt, schema=SCHEMA)
    got = {v for b in blocks.judge(iter(t.to_batches(max_chunksize=17)), least, 5) for v in b.column(0).to_pylist()}
    assert got == expected and expected


def test_few_pairs_and_little_memory_for_a_large_bucket(monkeypatch):
    """Where the best rows beat the others, a bucket costs its rows, and it never holds a matrix of all pairs."""
    n, compared = 4000, []

    def counted(lists, own=blocks.shared):
        of = own(lists)

        def pairs(x, y):
            compared.append(len(x))
            return of(x, y)

        return pairs

    monkeypatch.setattr(blocks, "shared", counted)
    rows = [{"key": 1, "i": 0, "j": 0, "part": 0, "video_id": str(k), "number": k, "undated": False, "at": float(k), "length": 1, "quality": 1, "duration": 0, "artists": [1], "tags": [k % 9, 100 + k], "words": [k % 7, 50, 60]} for k in range(n)]
    t = pa.Table.from_pylist(rows, schema=SCHEMA)
    tracemalloc.start()
    out = blocks.beaten(t, {"artists": 1, "tags": 1, "words": 2}, None)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.flatnonzero(~out).tolist() == list(range(9))
    assert sum(compared) < 200 * n and peak < 100 << 20
