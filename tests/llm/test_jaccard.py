"""Operator 11 against sets of shingles compared pair by pair."""

import random

import numpy as np
import pytest
from fixtures import SCHEMA, documents, texts, words

from trivalent.llm import jaccard


def shingles(text):
    w = words(text, lower=True)
    return {tuple(w)} if 0 < len(w) < 3 else {tuple(w[i : i + 3]) for i in range(len(w) - 2)}


def brute(rows):
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            linked = x and 100 * len(x & sets[j]) >= 90 * len(x | sets[j])
            if rows[i][0] is not None and rows[j][0] is not None and (linked or rows[i][0] == rows[j][0]):
                parent[top(i)] = top(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[top(i)] = min(least.get(top(i), doc), doc)
    return sorted(((d, len(s), None if d is None else least[top(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def got(df):
    return sorted(((r["id"], r["n_shingles"], r["component_id"]) for r in jaccard.link_components(df).collect()), key=str)


def edited(rng, base, edits, unused):
    w = list(base)
    for _ in range(rng.randint(0, edits)):
        w[rng.randrange(len(w))] = f"x{rng.randrange(unused)}"
    return " ".join(w)


def test_brute_force(spark):
    assert got(documents(spark)) == brute(texts())


def test_empty_table(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []


def test_many_near_copies_in_small_blocks(spark, monkeypatch):
    rng = random.Random(5)
    bases = [[f"w{b}_{i}" for i in range(80)] for b in range(3)]
    rows = [(k, edited(rng, bases[k % 3], 3, 9)) for k in range(150)]
    rows += [(200 + k, " ".join([*bases[0][:40], *(f"v{k}_{i}" for i in range(30))])) for k in range(40)]  # a shared passage, no link
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


@pytest.mark.parametrize("flip", (False, True))
def test_rows_of_one_id_link_by_each_of_their_texts(spark, flip):
    a, b = [f"a{i}" for i in range(60)], [f"b{i}" for i in range(60)]
    rows = [(1, " ".join(a)), (5, " ".join([*a, "x"])), (5, " ".join(b)), (9, " ".join([*b, "y"]))]
    rows = rows[::-1] if flip else rows
    assert got(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)) == brute(rows)


def test_prefixes_share_as_many_elements_as_the_smaller_length():
    """Every linked pair of random sets is a candidate by its prefixes, whatever the levels say."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    sets = []
    for _ in range(200):
        n = int(rng.integers(1, 120))
        own = base[: max(1, n - int(rng.integers(0, 4)))]
        sets.append(np.unique(np.concatenate([own, rng.integers(0, 2**63, int(rng.integers(0, 4)), dtype=np.uint64)])))
    off = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    elements = np.concatenate(sets)
    level = (elements % np.uint64(97)).astype(np.uint8)
    level = np.maximum(level, 8)
    l_of, posted, size, kept = jaccard.prefixes(elements, off, level)
    assert (l_of > 1).any() and (l_of == 1).any()
    parts = np.split(kept, np.cumsum(size)[:-1])
    lists, sent = [set(x.tolist()) for x in parts], [set(x[:k].tolist()) for x, k in zip(parts, posted, strict=True)]
    linked = 0
    for i, x in enumerate(sets):
        for j in range(i):
            if jaccard.alike(x, sets[j]):
                linked += 1
                assert len(lists[i] & lists[j]) >= min(l_of[i], l_of[j]) and sent[i] & sent[j]
    assert linked > 100


def test_elements_of_one_set_alone_are_not_posted(spark):
    rows = [(k, "one two three four") for k in range(8)] + [(100, "four five six"), (101, None)]
    got_ = jaccard.table(spark.createDataFrame(rows, "id long, text string").repartition(5)).collect()
    assert {r["id"]: (r["n"], r["posted"], len(r["prefix"])) for r in got_} == {**{k: (2, 1, 1) for k in range(8)}, 100: (1, 0, 0), 101: (0, 0, 0)}
