"""Operator 3: edited texts by brute force, and the algebra of fingerprints."""

import hashlib
import math
import re

import xxhash
from fixtures import SCHEMA, documents, texts
from pyspark.sql import functions as F

from trivalent.llm import fingerprint as fp


def ordered(rows):
    """Descending ids, null ids last, rows of one id by the unsigned hash of their texts."""
    return sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), xxhash.xxh64(r[1].encode(), seed=42).intdigest(), r[1]))


def vector(text):
    """Lanes from their definition."""
    units = [u for u in re.split(r"\n|(?<=[.!?]) +", text) if u]
    seed = lambda k: xxhash.xxh64(k.to_bytes(4, "little"), seed=42).intdigest()
    a, b = ([xxhash.xxh64(u.encode(), seed=seed(k)).intdigest() for u in units] for k in (1, 2))
    dense = [sum(x & (2**32 - 1) for x in a), sum(x >> 32 for x in a), sum(x & (2**32 - 1) for x in b), sum(x >> 32 for x in b)]
    sparse = [sum((x >> 8) & 0xFFFF for x in a if x & 15 == j and (x >> 32) & (2**k - 1) == 0) % 2**16 for j in range(fp.LANES) for k in range(fp.LEVELS)]
    return [x % 2**32 for x in dense] + sparse


def likeness(v, w):
    if v == w:
        return 1.0
    shares = []
    for k in range(fp.LEVELS):
        lanes = [(v[fp.DENSE + j * fp.LEVELS + k], w[fp.DENSE + j * fp.LEVELS + k]) for j in range(fp.LANES)]
        used = [x for x in lanes if x != (0, 0)]
        if used:
            shares.append((len(used), sum(x == y for x, y in used)))
    if not shares:
        return 0.0
    used, same = next((s for s in shares if s[0] <= fp.CROWDED), shares[-1])
    full = lambda n: math.log(1 - min(n, fp.LANES - 0.5) / fp.LANES)
    return max(0.0, 1 - full(used - same) / full(used))


def expected(rows):
    rows = ordered(rows)
    out = []
    for (doc, t), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        v, e, n = vector(t), vector(edited), vector(after)
        out.append((str(doc), len(t), hashlib.sha256(edited.encode()).hexdigest(), "".join(f"{x:0{8 if i < fp.DENSE else 4}x}" for i, x in enumerate(v)), round(likeness(v, e), 9), round(likeness(v, n), 9)))
    return sorted(out)


def found(df):
    return sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"], r["fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in df.collect())


def test_whole_result_by_brute_force(spark):
    assert found(fp.judge(documents(spark))) == expected(texts())


def test_shared_ids_are_cut_as_well(spark, monkeypatch):
    """A third of all rows with one id, a third with none: small buckets, more of them than one quantile has, and both ways to the copies."""
    monkeypatch.setattr(fp, "BUCKET_BYTES", 16)
    rows = [(7, f"text {k} of one id. And more") for k in range(300)] + [(None, f"text {k} of none") for k in range(300)] + [(k * 3, f"text {k}") for k in range(-100, 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(fp.judge(df)) == expected(rows)
    parts = fp.with_next(df, "doc_id", "text").where("not copy").groupBy("bucket").count()
    assert parts.where("count > 120").count() == 0 and parts.count() > 40
    monkeypatch.setattr(fp, "MOST_COPIES", 0)
    assert found(fp.judge(df)) == expected(rows)


def test_clustered_ids_are_cut_as_well(spark, monkeypatch):
    """Runs of ids that lie far apart, as with a shard's number in the upper bits: buckets are as small as those of ids in one run."""
    monkeypatch.setattr(fp, "BUCKET_BYTES", 32)
    monkeypatch.setattr(fp, "QUANTILES", 4)
    rows = [(shard * 10**12 + k, f"text {shard} {k}. And so on") for shard in range(-20, 20) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    most = lambda: fp.with_next(df, "doc_id", "text").where("not copy").groupBy("bucket").count().agg(F.max("count")).first()[0]
    assert found(fp.judge(df)) == expected(rows) and most() <= 6
    # fewer quantiles than buckets: the rest is cut evenly
    monkeypatch.setattr(fp, "FINE", 32)
    assert found(fp.judge(df)) == expected(rows)


def test_ranks(spark):
    values = [-5, 0, 0, 3, 3, 3, 10]
    for n in range(len(values) + 1):
        row = spark.range(1).select(*(fp.rank(F.array(*map(F.lit, values[:n])).cast("array<int>"), 7, F.lit(v)) for v in range(-7, 13))).first()
        assert list(row) == [sum(x <= v for x in values[:n]) for v in range(-7, 13)]


def test_algebra(spark):
    v = lambda t: fp.vector(F.lit(t))
    row = spark.range(1).select(
        fp.as_hex(v("One a. Two b.\nThree c.")).alias("x"), fp.as_hex(v("Three c.\nTwo b.\nOne a.")).alias("y"), fp.as_hex(fp.plus(v("One a. Two b."), v("Three c."))).alias("z"),
        fp.as_hex(fp.minus(v("One a. Two b.\nThree c."), v("Three c."))).alias("less"), fp.as_hex(v("One a. Two b.")).alias("rest"), fp.likeness(v("a"), v("a")).alias("same"), fp.likeness(v(""), v("b")).alias("none"), fp.as_hex(v("One a. One a.")).alias("twice"),
    ).first()
    assert row["x"] == row["y"] == row["z"] and row["less"] == row["rest"] and row["twice"] != row["rest"]
    assert (row["same"], row["none"]) == (1.0, 0.0)


def test_likeness_follows_common_paragraphs(spark):
    text = lambda a, b: "\n".join(f"paragraph number {i} of them" for i in range(a, b))
    near, far = spark.range(1).select(fp.likeness(fp.vector(F.lit(text(0, 200))), fp.vector(F.lit(text(20, 220)))), fp.likeness(fp.vector(F.lit(text(0, 200))), fp.vector(F.lit(text(150, 350))))).first()
    assert near > 0.5 > far


def test_likeness_of_long_texts(spark):
    text = lambda a, n: "\n".join(f"sentence {i} of a long text" for i in range(a, a + n))
    for n in (1_000, 5_000, 20_000):
        # a third replaced: half of all sentences of the two texts are in both
        pairs = [(text(k * 10**6, n), text(k * 10**6 + n // 3, n)) for k in range(12)]
        rows = spark.createDataFrame(pairs, "a string, b string").select(fp.likeness(fp.vector(F.col("a")), fp.vector(F.col("b"))).alias("half"), fp.likeness(fp.vector(F.col("a")), fp.vector(F.reverse("b"))).alias("none")).collect()
        assert abs(sum(r["half"] for r in rows) / len(rows) - 0.5) < 0.2, n
        assert sum(r["none"] for r in rows) / len(rows) < 0.2, n


def test_empty_table(spark):
    assert fp.judge(spark.createDataFrame([], SCHEMA)).count() == 0
