"""Duplicates: which rows are redundant beside a better row of the same artist.

Candidates share an artist token and pass the enabled criteria in a fixed order, and the first that is not known or not
met decides.  A row is TRUE if a candidate of better rank passes, else null if some candidate could not be judged, else
FALSE.

Rows are not paired one by one.  Where at most one list is compared and one shared value is enough, a candidate passes if it agrees
in a key: the artist, the quality, the value.  Then whether a better one passes follows from the least ranks of each key, which are an
aggregate with partial sums before the shuffle; with durations, these are taken by second first, and seconds are joined with those in
reach.  Where more must be shared, rows are posted under the rarest values of one list and compared in blocks (``_hits_of_blocks``):
a row has as many keys as its artists times that list, never the product of its lists.  Whether one could not be judged follows from
counts by the keys of the criteria before the one that is not known, which are artists and categories at most.  An artist of a third
of all rows costs rows, and blocks of those that share a rare value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.details import artist_tokens, lowered_values, quality_fingerprint
from ..functions.text import title_words, utf16_length
from ..sources.scratch import written
from . import blocks


def descriptors(catalogue: DataFrame) -> DataFrame:
    """id, rank and what rows are compared by; catalogue has columns of VIDEOS and ``detail``."""
    d = F.col("detail")
    listing = dates.listing_range(lambda c: F.col(c) if c in catalogue.columns else F.lit(None).cast("string" if c.endswith("text") else "long"))
    shown = dates.display_resolve(d["status"], d["exact_upload_date"], listing)
    title = F.trim(F.coalesce("title", F.lit("")))
    # dated first, then earlier, shorter title, smaller number, id
    rank = F.struct(shown["sort"].isNull().alias("undated"), shown["sort"].alias("at"), utf16_length(title).alias("length"), F.col("video_id").try_cast("long").alias("number"), F.col("video_id").alias("id"))
    duration = F.coalesce("duration_sec", F.lit(0)).cast("long")
    return catalogue.select(
        "video_id",
        rank.alias("rank"),
        artist_tokens(d).alias("artists"),
        F.when(duration >= 0, duration).alias("duration"),
        quality_fingerprint(d).alias("quality"),
        lowered_values(d, "categories").alias("categories"),
        lowered_values(d, "tags").alias("tags"),
        title_words(title).alias("words"),
    )


def compare(x, y, options: dict) -> Column:
    """TRUE, FALSE or null of a pair; x and y give the column of a name on either side."""
    shared = lambda c: F.size(F.array_intersect(x(c), y(c)))
    missing = lambda c: x(c).isNull() | y(c).isNull()
    unknown = F.lit(None).cast("boolean")
    steps: list[tuple[Column, Column]] = []
    if options["matchingDuration"]:
        steps += [(missing("duration"), unknown), (F.abs(x("duration") - y("duration")) > options["matchingDurationSecDifference"], F.lit(False))]
    if options["matchingQuality"]:
        steps += [(missing("quality"), unknown), (x("quality") != y("quality"), F.lit(False))]
    if options["matchingCategory"]:
        steps += [(missing("categories"), unknown), (~F.arrays_overlap(x("categories"), y("categories")), F.lit(False))]
    if options["matchingTag"]:
        steps += [(missing("tags"), unknown), (shared("tags") < options["matchingTagCount"], F.lit(False))]
    if options["matchingTitleWords"]:
        steps.append((shared("words") < options["matchingTitleWordCount"], F.lit(False)))
    out = F.lit(True)
    for test, result in reversed(steps):
        out = F.when(test, result).otherwise(out)
    return out


def _criteria(options: dict) -> list[tuple[str, Column | None, Column]]:
    """(name, whether it is not known, its keys) of the criteria that are on and compare values, in order."""
    out = []
    if options["matchingQuality"]:
        out.append(("quality", F.col("quality").isNull(), F.array("quality")))
    if options["matchingCategory"]:
        out.append(("category", F.col("categories").isNull(), F.array_distinct("categories")))
    if options["matchingTag"]:
        out.append(("tag", F.col("tags").isNull(), F.array_distinct("tags")))
    if options["matchingTitleWords"]:
        out.append(("words", None, F.array_distinct("words")))
    return out


def _keyed(rows: DataFrame, criteria: list, *more: str) -> DataFrame:
    """A row for each artist and key of the criteria."""
    out = rows.select("*", F.explode("artists").alias("token"))
    for name, _, keys in criteria:
        out = out.withColumn(f"k_{name}", F.explode(keys))
    return out.select("token", *(f"k_{name}" for name, _, _ in criteria), *more)


def _near(at_seconds: DataFrame, keys: list[str], by: int, aggregates: list[Column]) -> DataFrame:
    """The aggregates of all seconds within reach of each second that a key has; at_seconds has a row for each."""
    band = by + 1
    own = at_seconds.select(*keys, "duration", F.explode(F.array(*(F.floor(F.col("duration") / band) + k for k in (-1, 0, 1)))).alias("band"))
    other = at_seconds.withColumn("band", F.floor(F.col("duration") / band)).withColumnRenamed("duration", "theirs")
    return own.join(other, [*keys, "band"]).where(F.abs(F.col("duration") - F.col("theirs")) <= by).groupBy(*keys, "duration").agg(*aggregates)


def _first(rank: Column, numbered: bool | None) -> Column:
    """The least rank as a struct, of ids that are numbers, that are none, or of all in order of their ids."""
    triple = F.struct(rank["undated"].alias("undated"), rank["at"].alias("at"), rank["length"].alias("length"))
    tail = F.struct(rank["number"].alias("number"), rank["id"].alias("id")) if numbered else F.struct(rank["id"].alias("id"))
    return F.min(F.struct(triple.alias("triple"), tail.alias("tail")) if numbered is None else F.when(rank["number"].isNotNull() if numbered else rank["number"].isNull(), F.struct(triple.alias("triple"), tail.alias("tail"))))


_KINDS = (("by_number", True), ("by_text", False), ("by_id", None))


def _beaten(rank: Column) -> Column:
    """Whether the best ranks of a key hold one that comes before a rank: ``_before`` for the whole key."""
    triple = F.struct(rank["undated"].alias("undated"), rank["at"].alias("at"), rank["length"].alias("length"))
    tied = lambda c: F.coalesce(F.col(c)["triple"] == triple, F.lit(False))
    n, t, i = (F.col(c)["tail"] for c, _ in _KINDS)
    number = rank["number"]
    of_number = (tied("by_number") & ((n["number"] < number) | ((n["number"] == number) & (n["id"] < rank["id"])))) | (tied("by_text") & (t["id"] < rank["id"]))
    of_text = tied("by_id") & (i["id"] < rank["id"])
    return (F.col("by_id")["triple"] < triple) | F.when(number.isNotNull(), of_number).otherwise(of_text)


def _hits(d: DataFrame, options: dict) -> DataFrame:
    """video_id of rows that a better one passes."""
    criteria = _criteria(options)
    keys = ["token", *(f"k_{name}" for name, _, _ in criteria)]
    if options["matchingDuration"]:
        d = d.where("duration is not null")
    rows = _keyed(d, criteria, "video_id", "rank", "duration")
    best = [_first(F.col("rank"), kind).alias(c) for c, kind in _KINDS]
    if options["matchingDuration"]:
        of_key = _near(rows.groupBy(*keys, "duration").agg(*best), keys, options["matchingDurationSecDifference"], [F.min(c).alias(c) for c, _ in _KINDS])
        return rows.join(of_key, [*keys, "duration"]).where(_beaten(F.col("rank"))).select("video_id").distinct()
    return rows.join(rows.groupBy(*keys).agg(*best), keys).where(_beaten(F.col("rank"))).select("video_id").distinct()


#: The lists of a row whose shared values are counted: (option, its count's option, column).
_COUNTED = (("matchingCategory", None, "categories"), ("matchingTag", "matchingTagCount", "tags"), ("matchingTitleWords", "matchingTitleWordCount", "words"))


def _least(options: dict) -> dict[str, int]:
    """How many values of each list must be shared, of the criteria that are on."""
    return {c: options[count] if count else 1 for on, count, c in _COUNTED if options[on]}


def rarest(rows: DataFrame, column: str, n: int) -> DataFrame:
    """rows with ``prefix``: the values of a list without its n - 1 most frequent ones.

    Two rows that share n values share one of these: values are in one order, rarest first, and whoever shares n has at least one
    before its last n - 1.  Frequencies are over all rows; equal lists are sorted once.
    """
    if n < 2:
        return rows.withColumn("prefix", F.col(column))
    lists = rows.select(F.col(column).alias("list")).distinct()
    values = lists.select("list", F.explode("list").alias("value"))
    often = rows.select(F.explode(column).alias("value")).groupBy("value").agg(F.count("*").alias("often"))
    in_order = values.join(often, "value").groupBy("list").agg(F.sort_array(F.collect_list(F.struct("often", "value"))).alias("order"))
    prefix = in_order.select("list", F.transform(F.slice("order", F.lit(1), F.size("order") - (n - 1)), lambda x: x["value"]).alias("prefix"))
    return rows.join(prefix, F.col(column) == F.col("list")).drop("list")


def _best_of_equals(rows: DataFrame, by: list[str]) -> DataFrame:
    """Of rows that are equal in all that is compared, those that come first among the numbers, the texts or all: three at most."""
    best = rows.groupBy(*by).agg(*(_first(F.col("rank"), kind).alias(c) for c, kind in _KINDS))
    first = [F.when(F.col(c).isNotNull(), F.struct(F.col(c)["triple"].alias("triple"), F.col(c)["tail"]["id"].alias("id"))) for c, _ in _KINDS]
    kept = best.select(*by, F.explode(F.array_distinct(F.filter(F.array(*first), lambda x: x.isNotNull()))).alias("row"))
    return kept.select(*by, F.col("row.id").alias("video_id"), F.col("row.id").try_cast("long").alias("number"), "row.triple.*")


def _posted(kept: DataFrame, column: str, n: int, reach: int | None) -> DataFrame:
    """A row for each artist and value of the prefix (and for each of two bands of durations), by ``key``.

    Rows of one band of durations or of two that touch meet in the upper band.
    """
    out = rarest(kept, column, n).withColumn("token", F.explode("artists")).withColumn("value", F.explode("prefix")).drop("prefix")
    band = F.floor(F.col("duration") / ((reach or 0) + 1))
    out = out.withColumn("band", F.lit(0).cast("long") if reach is None else F.explode(F.array(band, band + 1)))
    return out.withColumn("key", F.xxhash64("token", "value", "quality", "band")).drop("token", "value", "band")


def _hits_of_blocks(d: DataFrame, options: dict) -> DataFrame:
    """video_id of rows that a better one passes, where several lists, or more than one value of a list, must be shared.

    Rows that are equal in all that is compared pass each other, so all but the best of them are hits at once.  What is left is posted
    under its artists and the rarest values of *one* list, the one whose buckets make the fewest comparisons, and compared in the
    buckets, those of many rows in salted blocks.  A bucket's key is a hash: what it mixes up is told apart by the comparison.
    """
    least = _least(options)
    reach = options["matchingDurationSecDifference"] if options["matchingDuration"] else None
    able = F.lit(True) if reach is None else F.col("duration").isNotNull()
    if options["matchingQuality"]:
        able &= F.col("quality").isNotNull()
    for c, n in least.items():
        able &= F.coalesce(F.size(F.array_distinct(c)) >= n, F.lit(False))
    lists = ["artists", *least]
    rows = d.where(able).select(
        "video_id",
        "rank",
        *(F.sort_array(F.array_distinct(c)).alias(c) for c in lists),
        (F.xxhash64("quality") if options["matchingQuality"] else F.lit(0).cast("long")).alias("quality"),
        (F.col("duration") if reach is not None else F.lit(0).cast("long")).alias("duration"),
    )
    kept = written(_best_of_equals(rows, [*lists, "quality", "duration"]), "best")
    column = min(least, key=lambda c: _comparisons(_posted(kept, c, least[c], reach))) if len(least) > 1 else next(iter(least))
    posted = _posted(kept, column, least[column], reach)
    buckets = posted.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key", F.ceil(F.col("m") / blocks.ROWS).cast("int").alias("parts"))
    dealt = posted.join(buckets, "key").withColumn("part", F.pmod(F.xxhash64("video_id"), "parts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    hashed = [F.transform(c, lambda v: F.xxhash64(v)).alias(c) for c in lists]
    dealt = dealt.select("key", F.greatest("part", "other").alias("i"), F.least("part", "other").alias("j"), "part", "video_id", "number", "undated", "at", "length", "quality", "duration", *hashed)
    counts = {"artists": 1, **least}
    beaten = dealt.repartition(*blocks.KEY).sortWithinPartitions(*blocks.KEY).mapInArrow(lambda batches: blocks.judge(batches, counts, reach), "video_id string")
    return rows.select("video_id").join(kept.select("video_id"), "video_id", "left_anti").unionByName(beaten).distinct()


def _comparisons(posted: DataFrame) -> int:
    sizes = posted.groupBy("key").agg(F.count("*").alias("m"))
    return sizes.agg(F.sum(F.col("m").cast("decimal(20,0)") * F.col("m"))).first()[0] or 0


def _unknown(d: DataFrame, options: dict) -> DataFrame:
    """video_id of rows with a candidate that could not be judged."""
    out = d.sparkSession.createDataFrame([], "video_id string")
    timed, by = options["matchingDuration"], options["matchingDurationSecDifference"]
    if timed:
        blank = _keyed(d.where("duration is null"), [], "video_id").select("token").distinct()
        out = out.unionByName(_keyed(d, [], "video_id").join(blank, "token", "left_semi").select("video_id"))
        d = d.where("duration is not null")
    criteria = _criteria(options)
    for k, (_, missing, _) in enumerate(criteria):
        if missing is None:
            continue
        before = criteria[:k]
        keys = ["token", *(f"k_{name}" for name, _, _ in before)]
        rows = _keyed(d.withColumn("missing", missing), before, "video_id", "duration", "missing")
        # a row that is not known itself needs another candidate; ids that a key has twice are one
        counts = [F.count("*").alias("n"), F.count_if("missing").alias("m")]
        if timed:
            keys_at = [*keys, "duration"]
            n = _near(rows.distinct().groupBy(*keys_at).agg(*counts), keys, by, [F.sum("n").alias("n"), F.sum("m").alias("m")])
        else:
            keys_at = keys
            n = rows.distinct().groupBy(*keys).agg(*counts)
        out = out.unionByName(rows.join(n, keys_at).where(F.when(F.col("missing"), F.col("n") > 1).otherwise(F.col("m") > 0)).select("video_id"))
    return out.distinct()


def verdicts(catalogue: DataFrame, options: dict) -> DataFrame:
    """video_id and verdict, a row for each row of the catalogue.

    What rows are compared by is written once: hits and unknown ones read it several times.
    """
    d = written(descriptors(catalogue), "descriptors")
    least = _least(options)
    counted = len(least) > 1 or max(least.values(), default=1) > 1
    known = (F.size("artists") > 0) & (F.col("duration").isNotNull() if options["matchingDuration"] else F.lit(True))
    with_artist = d.where(F.size("artists") > 0)
    hits = (_hits_of_blocks if counted else _hits)(with_artist, options).select("video_id", F.lit(True).alias("hit"))
    unknown = _unknown(with_artist, options).select("video_id", F.lit(True).alias("unknown"))
    verdict = F.when(~F.coalesce(known, F.lit(False)), None).when(F.col("hit"), True).when(F.col("unknown"), None).otherwise(False)
    return d.select("video_id", "artists", "duration").join(hits, "video_id", "left").join(unknown, "video_id", "left").select("video_id", verdict.cast("boolean").alias("verdict"))


def _before(x: Column, y: Column) -> Column:
    """Whether rank x comes first: structs compare field by field; missing numbers don't decide."""
    number = F.coalesce(x["number"] < y["number"], x["id"] < y["id"])
    same_number = (x["number"] == y["number"]) | x["number"].isNull() | y["number"].isNull()
    last = F.when(same_number, x["id"] < y["id"]).otherwise(number)
    length = F.when(x["length"] != y["length"], x["length"] < y["length"]).otherwise(last)
    at = F.when(~x["undated"] & ~y["undated"] & (x["at"] != y["at"]), x["at"] < y["at"]).otherwise(length)
    return F.when(x["undated"] != y["undated"], y["undated"]).otherwise(at)


def representatives(catalogue: DataFrame, by: list[str]) -> DataFrame:
    """The best row's id of each group of ``by`` columns: one aggregate, no window."""
    ranked = descriptors(catalogue).select("video_id", "rank")
    key = F.struct(*(F.col("rank")[k] for k in ("undated", "at", "length", "number", "id")))
    return catalogue.select("video_id", *by).join(ranked, "video_id").groupBy(*by).agg(F.min_by("video_id", key).alias("representative"), F.count("*").alias("members"))
