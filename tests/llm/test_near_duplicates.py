"""Operator 1 against sets of shingles compared pair by pair."""

import pytest
from fixtures import SCHEMA, documents, texts, words

from trivalent.llm import neardup


def shingles(text):
    w = words(text, lower=True)
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            linked = x and 100 * len(x & sets[j]) >= 75 * len(x | sets[j])
            if rows[i][0] is not None and rows[j][0] is not None and (linked or rows[i][0] == rows[j][0]):
                parent[top(i)] = top(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[top(i)] = min(least.get(top(i), doc), doc)
    return sorted(((d, len(s), None if d is None else least[top(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def test_brute_force(spark):
    got = neardup.link_components(documents(spark)).collect()
    assert sorted(((r["id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute(texts())


def test_many_near_copies_in_small_blocks(spark, monkeypatch):
    import random

    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for k in range(120):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(60)] = f"x{rng.randrange(9)}"
        rows.append((k, " ".join(w)))
    monkeypatch.setattr(neardup, "BLOCK", 16)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = neardup.link_components(df).collect()
    assert sorted(((r["id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute(rows)


def test_keeps_one(spark):
    docs = documents(spark)
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert 3 in ids and not ids & set(range(40, 60)) and {0, 66, 67, None} <= ids
    assert neardup.link_components(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("flip", (False, True))
def test_rows_of_one_id_link_by_each_of_their_texts(spark, flip):
    a, b = [f"a{i}" for i in range(60)], [f"b{i}" for i in range(60)]
    rows = [(1, " ".join(a)), (5, " ".join([*a, "x"])), (5, " ".join(b)), (9, " ".join([*b, "y"]))]
    rows = rows[::-1] if flip else rows
    got = neardup.link_components(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert sorted(((r["id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute(rows)
