"""Operator 13 against scores computed one by one."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from fixtures import LOWER, SCHEMA, documents, texts

from trivalent.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(rows, items, k=10):
    docs = [(d, Counter(terms(t))) for d, t in rows if terms(t)]
    n, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    queries = {}
    for item, text in items:
        queries.setdefault(item, Counter()).update(terms(text))
    out = []
    for item, query in queries.items():
        scored = []
        for doc, count in docs:
            m = 25 + 75 * sum(count.values()) * n // total
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * count[t] // (1000 * count[t] + 8 * m)) for t, q in query.items() if t in count)
            if s:
                scored.append((-s, doc is None, doc))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


def got(spark, docs, items, **more):
    queries = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in search.search(search.index(docs), queries, **more).select("item_id", "rank", "doc_id", "score").collect()), key=str)


def items_of(rows):
    return [(k, " ".join((t or "").split()[2:14])) for k, (_, t) in enumerate(rows)] + [(900, None), (901, "--- "), (902, "unheard of"), (None, "the same row"), (903, "the the SAME same id"), (903, "and no id again"), (904, "déß Ünïcode x")]


@pytest.mark.parametrize("size", (search.SHARD_BYTES, 500))
def test_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(search, "SHARD_BYTES", size)
    items = items_of(texts())
    expected = brute(texts(), items)
    assert got(spark, documents(spark), items) == expected and len(expected) > 300


def test_queries_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "QUERY_BYTES", 2000)
    items = items_of(texts())
    assert got(spark, documents(spark), items, k=3) == brute(texts(), items, 3)


def test_ties_go_by_document(spark):
    rows = [(k * 7 % 101, "same words here") for k in range(101)] + [(None, "same words here"), (-4, "other text at all")]
    items = [(1, "words"), (2, "other words")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert got(spark, df, items) == brute(rows, items)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert got(spark, docs, [(1, "a")]) == [] and got(spark, documents(spark), []) == []


def test_selection_at_the_last_place():
    score, doc = np.array([5, 9, 5, 5, 1, 5]), np.array([8, 1, 3, 0, 2, 6])
    null = np.array([False, False, False, True, False, False])
    assert sorted(search.best(score, doc, null, 3).tolist()) == [1, 2, 5]
    assert sorted(search.best(score, doc, null, 5).tolist()) == [0, 1, 2, 3, 5]


def test_long_documents_of_many_have_exact_norms():
    lengths = np.array([1, 10**8, 3], np.int64)
    assert search.norms(lengths, 10**11, 10**14).tolist() == [25 + 75 * n * 10**11 // 10**14 for n in (1, 10**8, 3)]


def test_terms_of_one_hash_are_told_apart(monkeypatch):
    from trivalent.llm.words import Words

    monkeypatch.setattr(Words, "hashes", lambda self: np.zeros(len(self.starts), np.uint64))
    b = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["x y x", "y"])], ["id", "text"])
    row = search.shard_row(0, b, 2, 4)
    directory, check, off = search._directory(row, 0)
    block = search.block_of([(1, "y x z")])
    at = search.found(block, directory, check)
    assert sorted(np.diff(off)[at[at >= 0]].tolist()) == [1, 2] and (at < 0).sum() == 1
