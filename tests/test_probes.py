"""The canary and the breaker against their definitions, step by step."""

import random

from trivalent.operators import worksets


def stops(kinds):
    last, n = None, 0
    for pos, k in enumerate(kinds):
        n = n + 1 if k is not None and k == last else int(k is not None)
        last = k
        if n == 3:
            return pos, k
    return None, None


def probes(oks):
    oks = oks[:10]
    need, tried, read = min(3, max(1, -(-len(oks) * 6 // 10))), 0, 0
    for ok in oks:
        if read == need:
            break
        tried, read = tried + 1, read + ok
    return tried, read, need, read >= need


def test_breaker(spark):
    rng = random.Random(4)
    cases = [[], ["a"], ["a", "a", None, "a"], ["a", "b", "a", "b"], ["a", "a", "b", "b", "b"], ["a"] * 5]
    cases += [[rng.choice(["a", "b", None]) for _ in range(30)] for _ in range(6)]
    for kinds in cases:
        rows = list(enumerate(kinds))
        rng.shuffle(rows)
        assert tuple(worksets.tripped(spark.createDataFrame(rows, "pos long, kind string")).first()) == stops(kinds), kinds


def test_canary(spark):
    rng = random.Random(5)
    cases = [[], [True], [False], [False] * 12 + [True] * 3, [True] * 12, [True, False, True], [False, True]]
    cases += [[rng.random() < 0.4 for _ in range(rng.randrange(1, 14))] for _ in range(6)]
    for oks in cases:
        rows = list(enumerate(oks))
        rng.shuffle(rows)
        assert tuple(worksets.canary(spark.createDataFrame(rows, "pos long, ok boolean")).first()) == probes(oks), oks
