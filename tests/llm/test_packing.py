"""Operator 8: ids against the tokenizer, plans against what must hold."""

import zlib
from collections import Counter

import numpy as np
import pytest
from fixtures import SCHEMA, documents, texts
from hypothesis import given, settings
from hypothesis import strategies as st

from trivalent.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def best_fit(histogram, capacity):
    """Sequences of best-fit decreasing, piece by piece."""
    room: list[int] = []
    for k in sorted(histogram, reverse=True):
        for _ in range(histogram[k]):
            fits = [i for i, r in enumerate(room) if r >= k]
            if fits:
                room[min(fits, key=lambda i: room[i])] -= k
            else:
                room.append(capacity - k)
    return len(room)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 300), min_size=1, max_size=40))
def test_plan(histogram):
    capacity, used, given_ = 40, Counter(), Counter()
    taken: dict[int, list[tuple[int, int]]] = {}
    for length, lo, hi, seq, per, at in packing.plan(histogram, capacity):
        for r in range(lo, hi):
            s, o = seq + (r - lo) // per, at + (r - lo) % per * length
            taken.setdefault(s, []).append((o, length))
            used[s] += length
        given_[length] += hi - lo
    assert given_ == Counter(histogram)
    for s, places in taken.items():
        ends = [0, *np.cumsum([n for _, n in sorted(places)]).tolist()]
        assert [o for o, _ in sorted(places)] == ends[:-1] and used[s] <= capacity
    assert len(taken) == best_fit(histogram, capacity)


def test_plan_is_bounded():
    small, large = ({k: n * (k % 17 + 1) for k in range(1, 4097)} for n in (3, 3_000_000))
    assert len(packing.plan(large)) < 3 * len(packing.plan(small)) < 200_000


def test_whole_table(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    expected = Counter()
    for doc, text in texts():
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        for k, s in enumerate(range(0, len(ids), 512)):
            part = ids[s : s + 512]
            expected[doc, k, s, len(part), zlib.crc32(np.array(part, "<u4"))] += 1
    got = packing.pack(documents(spark), PATH, capacity=512).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == expected
    by_seq: dict[int, list] = {}
    for r in got:
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_seq.values():
        assert [o for o, _ in sorted(places)] == [0, *np.cumsum([n for _, n in sorted(places)]).tolist()][:-1] and sum(n for _, n in places) <= 512
    assert packing.pack(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_hot_length_in_blocks(spark, monkeypatch):
    df = spark.createDataFrame([(k, "word word") for k in range(3000)], "doc_id long, text string")
    rows, histogram = packing.ranks(packing.pieces(df, PATH), ["doc_id"], block=100)
    assert histogram == {3: 3000} and sorted(r["rank"] for r in rows.collect()) == list(range(3000))


def test_ids(spark):
    out = packing.pieces(spark.createDataFrame([(1, "A bit, of <|endoftext|> text")], "doc_id long, text string"), PATH, with_ids=True).first()
    assert zlib.crc32(np.array(out["ids"], "<u4")) == out["ids_crc32"] and out["length"] == len(out["ids"])
