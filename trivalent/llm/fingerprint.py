"""Document fingerprints (operator 3): a homomorphic hash of the multiset of a text's paragraphs.

A paragraph (a line; lines are cut further after sentence ends, so that one long line is several) is
hashed to a wide vector, and a document's fingerprint is the sum of its paragraphs' vectors, each lane
modulo a power of two.  So fingerprints don't depend on the order of paragraphs, and a paragraph is
added or taken away by adding or subtracting its vector (``plus``, ``minus``).  Lanes:

* 4 dense lanes modulo 2**32, of two hashes with seeds of their own, for equality;
* LEVELS x LANES sparse lanes modulo 2**16: level k holds the paragraphs whose hash ends in k zero
  bits, each in one lane.  From the lanes in use and the lanes that differ, in the first level that
  is not crowded (the last in use, if all are; LEVELS are enough for 10**8 paragraphs), follow the
  numbers of paragraphs in either text and in only one of them, as in linear counting; the likeness
  of two fingerprints is one less their ratio.

Everything is DataFrame expressions.  The order is by id, descending, null ids last; rows of one id in order of a hash of
their texts, then of the texts.  The next document is found with one exchange of the texts: ids are cut into buckets by bounded
quantiles, each quantile by up to ``FINE`` quantiles of its own, so that it doesn't matter where the ids cluster, and what is more than
those evenly; ids that many rows share by the hash; a window runs in each bucket, and each bucket gets a copy of the
document that comes next after its last.  Which these are comes from the buckets' first ids and hashes, an
aggregate without texts, in which a window runs over the buckets of each quantile and one over the quantiles.  The copies
(a row a bucket of 8 MB of text) are found by a broadcast up to ``MOST_COPIES`` of them, and beyond by a join of both sides.

Defined results: a null text is empty; empty texts have the zero vector; an empty table gives an empty table; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written

LEVELS, LANES = 24, 16
CROWDED = 12
DENSE = 4
#: Quantiles of the ids, quantiles in each of them at most, and bytes of text in a bucket.
QUANTILES, FINE, BUCKET_BYTES = 256, 1024, 8 << 20
#: Copies that are broadcast (32 bytes each), bytes of text in a partition, and ids that are cut by their texts' hashes.
MOST_COPIES, PART_BYTES, HOT_IDS = 1 << 20, 64 << 20, 1024


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def vector(text: Column) -> Column:
    """array<bigint> of DENSE + LEVELS * LANES lanes."""
    units = F.filter(F.split(F.coalesce(text, F.lit("")), r"\n|(?<=[.!?]) +"), lambda u: u != F.lit(""))
    return let(F.transform(units, lambda u: F.struct(F.xxhash64(F.lit(1), u).alias("a"), F.xxhash64(F.lit(2), u).alias("b"))), vector_of_hashes)


def vector_of_hashes(hashes: Column) -> Column:
    """Of structs of a paragraph's two hashes."""

    def total(values: Column, value, bits: int) -> Column:
        return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: (a + value(x)).bitwiseAND(F.lit(2**bits - 1)))

    low, high = (lambda c: lambda x: x[c].bitwiseAND(F.lit(2**32 - 1))), (lambda c: lambda x: F.shiftrightunsigned(x[c], 32))
    dense = F.array(*(total(hashes, part(c), 32) for c in ("a", "b") for part in (low, high)))
    h = F.transform(hashes, lambda x: x["a"])
    masks = F.array(*(F.lit(2**k - 1).cast("bigint") for k in range(LEVELS)))

    def lane(ours: Column) -> Column:
        level = lambda mask: F.filter(ours, lambda x: F.shiftright(x, 32).bitwiseAND(mask) == 0)
        return F.transform(masks, lambda mask: total(level(mask), lambda x: F.shiftright(x, 8).bitwiseAND(F.lit(2**16 - 1)), 16))

    lanes = F.sequence(F.lit(0), F.lit(LANES - 1)).cast("array<bigint>")
    by_lane = F.flatten(F.transform(F.transform(lanes, lambda j: F.filter(h, lambda x: x.bitwiseAND(F.lit(LANES - 1)) == j)), lane))
    return F.concat(dense, by_lane)


def _modulus(i: Column) -> Column:
    return F.when(i < DENSE, F.lit(2**32 - 1)).otherwise(F.lit(2**16 - 1))


def plus(a: Column, b: Column) -> Column:
    return F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda z, i: (z["a"] + z["b"]).bitwiseAND(_modulus(i)))


def minus(a: Column, b: Column) -> Column:
    return F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda z, i: (z["a"] - z["b"]).bitwiseAND(_modulus(i)))


def as_hex(v: Column) -> Column:
    return F.lower(F.array_join(F.transform(v, lambda x, i: F.lpad(F.hex(x), F.when(i < DENSE, F.lit(8)).otherwise(F.lit(4)), F.lit("0"))), ""))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: 1 for equal vectors; near 0 for texts without common paragraphs."""
    zipped = F.zip_with(a, b, lambda x, y: F.when((x == 0) & (y == 0), F.lit(0)).when(x == y, F.lit(1)).otherwise(F.lit(2)))

    def of(z: Column) -> Column:
        # lane j of level k is at DENSE + j * LEVELS + k
        level = lambda k: F.transform(F.sequence(F.lit(0), F.lit(LANES - 1)), lambda j: F.get(z, DENSE + j * LEVELS + k))
        share = lambda v: F.struct(F.size(F.filter(v, lambda s: s > 0)).alias("used"), F.size(F.filter(v, lambda s: s == 1)).alias("same"))
        return let(F.filter(F.transform(F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), level), share), lambda s: s["used"] > 0), best)

    def best(shares: Column) -> Column:
        calm = F.get(F.filter(shares, lambda s: s["used"] <= CROWDED), F.lit(0))
        full = lambda lanes: F.log(1 - F.least(lanes, F.lit(LANES - 0.5)) / LANES)  # noqa: E731  expected paragraphs in so many lanes, but for a factor
        return let(F.coalesce(calm, F.get(shares, F.size(shares) - 1)), lambda s: F.greatest(F.lit(0.0), 1 - full(s["used"] - s["same"]) / full(s["used"])))

    return F.when(a == b, F.lit(1.0)).otherwise(F.coalesce(let(zipped, of), F.lit(0.0)))


def rank(sorted_values: Column, most: int, value: Column) -> Column:
    """How many of an ascending array of at most ``most`` values aren't above value, by halving steps."""
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(most.bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda done, step: done + F.when(F.get(sorted_values, done + step - 1) <= value, step).otherwise(F.lit(0)))


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text and next_text (of the next smaller id; after the smallest, of the largest); rows that are only copies have ``copy`` set."""
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    quantiles = F.percentile_approx("id", [(i + 1) / QUANTILES for i in range(QUANTILES - 1)], 10_000)
    stats = slim.agg(F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("bytes"), F.min("id").alias("lo"), F.max("id").alias("hi"), quantiles.alias("q")).first()
    size, wide = stats["bytes"] or 0, int(spark.conf.get("spark.sql.shuffle.partitions"))
    # ids of a thousandth of all rows: HOT_IDS of them at most
    hot = [r["id"] for r in slim.groupBy("id").count().where(F.col("count") > max(1, stats["rows"] // HOT_IDS)).select("id").collect()]
    inner = -(-max(4 * wide, size // BUCKET_BYTES) // QUANTILES)
    fine = min(FINE, inner)
    pieces = -(-inner // fine)
    inner = fine * pieces
    own = [i for i in hot if i is not None]
    bounds = [0, 1] if stats["lo"] is None else sorted({stats["lo"], *(stats["q"] or []), *own, *(i + 1 for i in own), stats["hi"] + 1})
    known = F.array(*(F.lit(b).cast("bigint") for b in bounds))
    hashed = F.xxhash64("text")
    tie = F.when(F.col("id").isNull() | F.col("id").isin(own), hashed).otherwise(F.lit(0)) if hot else F.lit(0).cast("long")
    # places from the end of the order: quantile 0 has the null ids; in an id's own quantile hashes count from the end as well
    share_of_hash = F.shiftrightunsigned(F.col("tie"), 11) / F.lit(float(1 << 53))
    at = F.when(F.col("id").isNull(), F.lit(0)).otherwise(F.size(F.filter(known, lambda q: q <= F.col("id"))))
    # as many rows as quantiles, whatever the input is; written, since quantiles may differ when they are computed again
    cuts = written(slim.where(F.col("id").isNotNull() & ~F.col("id").isin(own)).withColumn("quantile", at).groupBy("quantile").agg(F.percentile_approx("id", [(i + 1) / fine for i in range(fine - 1)], 10_000).alias("cuts")), "cuts") if fine > 1 else None
    cell = F.coalesce(rank(F.col("cuts"), fine, F.col("id")), F.lit(0)) if fine > 1 else F.lit(0)
    low = F.coalesce(F.get("cuts", F.col("cell") - 1), F.get(known, F.col("quantile") - 1)) if fine > 1 else F.get(known, F.col("quantile") - 1)
    high = F.coalesce(F.get("cuts", F.col("cell")), F.get(known, F.col("quantile"))) if fine > 1 else F.get(known, F.col("quantile"))
    within = lambda share, parts: F.least(F.greatest(F.floor(share * parts), F.lit(0)), F.lit(parts - 1))
    evenly = F.col("cell") * pieces + within((F.col("id") - low) / (high - low), pieces)
    cut = F.when(F.col("id").isNull() | F.col("id").isin(own), within(1 - share_of_hash, inner)).otherwise(evenly) if hot else F.when(F.col("id").isNull(), F.lit(0)).otherwise(evenly)

    def place(df: DataFrame) -> DataFrame:
        df = df.withColumn("quantile", at)
        df = df.join(F.broadcast(cuts), "quantile", "left") if fine > 1 else df
        return df.withColumn("cell", cell).withColumn("bucket", F.col("quantile").cast("bigint") * inner + cut).drop("cell", "cuts")

    # the unsigned order of hashes is that of their halves
    halves = lambda c: (F.shiftrightunsigned(c, 32).alias("high"), F.shiftrightunsigned(F.shiftleft(c, 32), 32).alias("low"))
    first = F.struct(F.col("id").isNull().alias("none"), (-F.col("id")).alias("back"), *halves(F.col("tie")), F.col("tie").alias("tie"))
    keyed = place(slim.withColumn("tie", tie))
    tops = keyed.groupBy("quantile", "bucket").agg(F.min(first).alias("first"))
    # of each bucket, the next above it that is not empty: in its quantile, or the least of the next quantile
    ends = tops.groupBy("quantile").agg(F.min("bucket").alias("least"), F.max("bucket").alias("most"))
    ends = ends.withColumn("above", F.lead("least").over(Window.orderBy("quantile"))).withColumn("lowest", F.min("least").over(Window.partitionBy()))
    up = tops.withColumn("up", F.lead("bucket").over(Window.partitionBy("quantile").orderBy("bucket"))).join(F.broadcast(ends), "quantile")
    # the first of the order comes after the last: its bucket is the highest, its copy goes to the lowest
    up = up.withColumn("wraps", F.col("up").isNull() & F.col("above").isNull())
    extra = up.select((-F.col("first.back")).alias("id"), F.col("first.tie").alias("tie"), F.coalesce("up", "above", "lowest").alias("target"), "wraps")
    few = (len(bounds) + 1) * inner <= MOST_COPIES
    same = (F.col("k.id").eqNullSafe(F.col("x.id"))) & (F.col("k.tie") == F.col("x.tie"))
    ghosts = keyed.alias("k").join((F.broadcast(extra) if few else extra).alias("x"), same).select("k.id", "k.text", "k.tie", F.col("x.target").alias("bucket"), "x.wraps", F.lit(True).alias("copy"))
    rows = keyed.select("id", "text", "tie", "bucket", F.lit(False).alias("wraps"), F.lit(False).alias("copy")).unionByName(ghosts)
    dealt = rows.repartition(max(wide, -(-size // PART_BYTES)), "bucket")
    order = Window.partitionBy("bucket").orderBy("wraps", F.col("id").desc_nulls_last(), *halves(F.col("tie")), "text")
    return dealt.withColumn("next_text", F.lead("text").over(order))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = with_next(docs, id_col, text_col).where("not copy")
    cut = F.floor(F.length("text") / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substr("text", F.lit(1), F.length("text") - cut), F.substr(F.coalesce("next_text", F.lit("")), F.lit(1), cut)))
    rows = rows.select("id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), vector(F.col("text")).alias("v"), vector(F.col("edited")).alias("e"), vector(F.coalesce("next_text", "text")).alias("next_v"))
    return rows.select(F.col("id").alias(id_col), "n_chars", "edited_sha256", as_hex(F.col("v")).alias("fingerprint"), as_hex(F.col("e")).alias("edited_fingerprint"), likeness(F.col("v"), F.col("e")).alias("near_edited"), likeness(F.col("v"), F.col("next_v")).alias("near_next"))
