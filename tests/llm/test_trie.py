"""Operator 12 against a dictionary of all prefixes."""

import hashlib
import random
import zlib

import pytest

from trivalent.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(x, key=lambda x: x[:3])] for c, x in own.items()}
    seqs = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        seqs[c] = tuple(own.get(base, [])[:h] + x[h:])
    members = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    children = {s: 0 for s in members}
    for s in members:
        if s:
            children[s[:-1]] += 1
    leaves, saved = {s: 0 for s in members}, {s: 0 for s in members}
    for s, m in members.items():
        for d in range(len(s) + 1):
            leaves[s[:d]] += children[s] == 0
            saved[s[:d]] += (len(m) - 1) * len(s[-1][1].encode()) if s else 0
    ends = lambda s: ",".join(map(str, sorted(c for c, x in seqs.items() if x == s)))
    return sorted(((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), children[s], leaves[s], saved[s], hashlib.sha256(ends(s).encode()).hexdigest()) for s, m in members.items()), key=str)


def got(df):
    cols = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted((tuple(r[c] for c in cols) for r in trie.nodes(df).collect()), key=str)


def random_rows(seed, n, ids, words, longest=9):
    """Conversations of few different turns, so that many share prefixes and some are equal."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(ids, n):
        for k in range(rng.randint(1, longest)):
            rows.append((c, k, "user" if k % 2 == 0 else "assistant", rng.choice(words)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "ranges"), ((1, 7), (2, 12), (3, 4)))
def test_brute_force_over_many_ranges(spark, seed, ranges):
    rows = random_rows(seed, 60, range(-40, 120), ["a", "b"] if seed < 3 else ["a", "bb", "ünï", ""], 9 if seed > 1 else 4)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_odd_rows(spark):
    rows = [(0, None, None, None), (0, 1, "user", "x"), (0, 1, "assistant", "x"), (1, 5, "user", "alone"), (3, 2, "user", "y"), (3, 2, "user", "y"), (None, 0, "user", "nobody's"), (10, 0, "", ""), (11, 0, None, None), (-3, 1, "user", "z" * 5000)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(df) == brute(rows)
    extra = df.selectExpr("*", "1 AS key", "2 AS seq", "3 AS n", "4 AS part", "5 AS depth", "'z' AS turns", "7 AS row", "8 AS base")
    assert got(extra) == brute(rows)
    assert got(df.limit(0)) == []


def test_one_family_without_turns_is_a_root(spark):
    """Conversation 4 has no base and fewer turns than its head."""
    assert zlib.crc32(b"4") % 9 > 1
    rows = [(4, 0, "user", "gone")]
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows) == [(4, 0, None, 1, 0, 1, 0, hashlib.sha256(b"4").hexdigest())]


def test_long_conversation_and_hot_first_turn(spark):
    rows = [(5, k, "user", f"t{k % 7}") for k in range(3000)]
    rows += [(5 * c, k, "user", "hello" if k == 0 else f"{c % 11} {k}") for c in range(2, 300) for k in range(3)]
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(5)) == brute(rows)
