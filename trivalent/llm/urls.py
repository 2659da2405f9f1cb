"""URL filters (operator 4): a cascade of Bloom filters with exact answers.

A rule is (host, path prefix, action); it fits its host and all subdomains.  The keys of a url are all
pairs of a host suffix (cut at dots, of as many labels as rules have at most) and a path prefix of one of the
lengths that rules have, so the distinct keys of all urls are the complete universe in which rules are looked up;
it is written once, with two 64-bit hashes for each key.  A cascade for a
set of listed keys is built over that universe: level 1 encodes the listed keys, level 2 the other
keys of the universe that level 1 passes by mistake, level 3 the listed keys that level 2 passes, and
so on until no mistakes are left.  Membership of any key of the universe is then exact, without a
join: it is decided by the parity of the level that first says no.  There is one cascade for each
action.  Which keys are others is told by their texts, not by hashes.

Size: level 1 has at least log2(universe / listed) * 1.44 bits a listed key, so the keys that it
passes by mistake are about as many as the listed ones, and each further level halves.  Thus a cascade
has O(listed * log(universe / listed)) bits: bounded by the rule list, of which it is a function, and
checked against ``MAX_BYTES`` before it is sent to executors.

Defined results: a null url or one without ``://`` has an empty host and path, no rule and the
method's verdict (allow).  Rows are judged each for itself; repeated rows repeat.  Of the rules that
fit, the longest host and then the longest path wins by total length of ``host + path``; equal rules
may not be given with both actions.  An empty table gives an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import written
from .words import U64, mix

#: (host, path, action)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Verdict where no rule fits.
OTHERWISE = "allow"
MAX_BYTES = 64 << 20


def _rest(url: Column, pattern: str) -> Column:
    """What follows the first ``://``, through a pattern; empty where there is none."""
    after = F.substr(url, F.locate("://", url) + F.lit(3))
    return F.when(F.coalesce(F.locate("://", url) > 0, F.lit(False)), F.regexp_extract(after, pattern, 1)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(_rest(url, r"(?s)\A([^/?#]*)"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return _rest(url, r"(?s)\A[^/?#]*([^?#]*)")


class Cascade:
    """Bloom filters in levels; ``has`` is exact for the keys of the universe that it was built over."""

    def __init__(self, rate: float):
        self.first_rate = rate
        self.levels: list[tuple[np.ndarray, int, int]] = []  # words, bits, hash functions

    def add(self, keys: np.ndarray) -> None:
        rate = self.first_rate if not self.levels else 0.5
        k = max(1, round(-math.log2(rate)))
        bits = max(64, math.ceil(len(keys) * k / math.log(2)))
        words = np.zeros(bits // 64 + 1, U64)
        for p in self._places(keys, len(self.levels), bits, k):
            np.bitwise_or.at(words, p // 64, U64(1) << (p % 64).astype(U64))
        self.levels.append((words, bits, k))
        if self.size > MAX_BYTES:
            raise ValueError(f"the cascade takes {self.size} bytes; the limit is {MAX_BYTES}")

    @staticmethod
    def _places(keys: np.ndarray, level: int, bits: int, k: int):
        """k places for each key, a row of two hashes."""
        salt = U64((0x9E3779B97F4A7C15 * (level + 1)) % 2**64)
        a = mix(keys[:, 0] ^ salt)
        b = mix(mix(keys[:, 1] + salt) ^ keys[:, 0]) | U64(1)
        for i in range(k):
            yield ((a + U64(i) * b) % U64(bits)).astype(np.int64)

    def passes(self, keys: np.ndarray, level: int) -> np.ndarray:
        words, bits, k = self.levels[level]
        ok = np.ones(len(keys), bool)
        for p in self._places(keys, level, bits, k):
            ok &= (words[p // 64] >> (p % 64).astype(U64)) & U64(1) > 0
        return ok

    @property
    def size(self) -> int:
        return sum(w.nbytes for w, _, _ in self.levels)

    def has(self, keys: np.ndarray) -> np.ndarray:
        inside = np.full(len(keys), len(self.levels) % 2 == 1)
        open_ = np.arange(len(keys))
        for level in range(len(self.levels)):
            ok = self.passes(keys[open_], level)
            inside[open_[~ok]] = level % 2 == 1
            open_ = open_[ok]
        return inside


#: Levels after which a cascade is given up: two keys have the same two hashes.
MOST_LEVELS = 64
SEEDS = (11, 12)


def hashes_of(key: Column) -> Column:
    """Two hashes with seeds of their own."""
    return F.array(*(F.xxhash64(F.lit(seed), key) for seed in SEEDS))


def _matrix(hashes) -> np.ndarray:
    return np.array([list(h) for h in hashes], np.int64).reshape(-1, len(SEEDS)).view(U64)


def keys_of(host: Column, path: Column, lengths: list[int], labels: int) -> Column:
    """The distinct keys of a url, the longest first."""
    suffixes = F.array(*(F.substring_index(host, ".", -(k + 1)) for k in range(labels)))
    fitting = F.filter(F.array(*(F.lit(n) for n in lengths)).cast("array<int>"), lambda n: n <= F.length(path))
    keys = F.flatten(F.transform(suffixes, lambda x: F.transform(fitting, lambda n: F.concat(x, F.substr(path, F.lit(1), n)))))
    ranked = F.sort_array(F.transform(F.array_distinct(keys), lambda k: F.struct((-F.length(k)).alias("n"), k.alias("key"))))
    return F.when(host != "", F.transform(ranked, lambda r: r["key"])).otherwise(F.array().cast("array<string>"))


def universe(urls: DataFrame) -> DataFrame:
    """key, a, b (its hashes): the distinct keys of all urls (keys: array<string>), written once."""
    distinct = urls.select(F.explode("keys").alias("key")).distinct()
    return written(distinct.select("key", *(F.xxhash64(F.lit(seed), "key").alias(c) for seed, c in zip(SEEDS, "ab", strict=True))), "universe")


def build(keys: DataFrame, listed: list[str]) -> Cascade:
    """A cascade for the listed keys over a universe."""
    spark = keys.sparkSession
    ours = spark.createDataFrame([(k,) for k in sorted(set(listed))], "key string")
    inside = _matrix(r["h"] for r in ours.select(hashes_of(F.col("key")).alias("h")).collect())
    others, size = keys.join(ours, "key", "left_anti"), max(1, keys.count())
    cascade = Cascade(min(0.5, max(1e-9, len(inside) / size)))

    def passed(top: int) -> np.ndarray:
        """Other keys that pass levels 0, ... top: about as many as listed ones at the first level, and half as many at each that follows."""

        def run(batches):
            for pdf in batches:
                h = pdf[["a", "b"]].to_numpy(np.int64).view(U64)
                ok = np.ones(len(h), bool)
                for level in range(top + 1):
                    ok[ok] = cascade.passes(h[ok], level)
                yield pdf[ok]

        bound = MAX_BYTES // 16
        rows = others.select("a", "b").mapInPandas(run, "a long, b long").limit(bound + 1).collect()
        if len(rows) > bound:
            raise ValueError(f"over {bound} keys pass by mistake; the rule list is too long for {MAX_BYTES} bytes")
        return _matrix(rows)

    cascade.add(inside)
    while len(cascade.levels) < MOST_LEVELS:
        outside = passed(len(cascade.levels) - 1)
        if not len(outside):
            return cascade
        cascade.add(outside)
        inside = inside[cascade.passes(inside, len(cascade.levels) - 1)]
        if not len(inside):
            return cascade
        cascade.add(inside)
    raise ValueError("two keys of the universe have the same hashes")


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, otherwise: str = OTHERWISE) -> DataFrame:
    """id, host, path, rule and verdict, a row for each row of pages."""
    slim = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    urls = slim.select("id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    keyed = {h + p: a for h, p, a in rules}
    if len(keyed) < len(set(rules)):
        raise ValueError("two rules have the same host and path")
    lengths, labels = sorted({len(p) for _, p, _ in rules}), max((h.count(".") + 1 for h, _, _ in rules), default=1)
    urls = urls.withColumn("keys", keys_of(F.col("host"), F.col("path"), lengths, labels))
    every = universe(urls)
    cascades = {a: build(every, [k for k, x in keyed.items() if x == a]) for a in sorted(set(keyed.values()))}
    actions = list(cascades)

    def run(batches):
        for pdf in batches:
            n = pdf["hashes"].map(len).to_numpy(np.int64)
            h = _matrix(x for row in pdf["hashes"] for x in row)
            start, row = np.cumsum(n) - n, np.repeat(np.arange(len(pdf)), n)
            place, action = np.zeros(len(pdf), np.int32), np.full(len(pdf), -1)
            # keys come longest first: the last assignment of the reversed order is the longest
            inside = np.stack([cascades[a].has(h) for a in actions]) if len(h) else np.zeros((len(actions), 0), bool)
            hit = np.flatnonzero(inside.any(axis=0))[::-1]
            place[row[hit]], action[row[hit]] = hit - start[row[hit]] + 1, inside[:, hit].argmax(axis=0)
            yield pdf.drop(columns="hashes").assign(place=place, verdict=[actions[a] if a >= 0 else otherwise for a in action])

    kind = pages.schema[id_col].dataType.simpleString()
    judged = urls.select("*", F.transform("keys", hashes_of).alias("hashes")).mapInPandas(run, f"id {kind}, host string, path string, keys array<string>, place int, verdict string")
    return judged.select(F.col("id").alias(id_col), "host", "path", F.when(F.col("place") > 0, F.try_element_at("keys", F.col("place"))).alias("rule"), "verdict")
