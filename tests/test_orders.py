"""Numbering of large tables, overlaps, id changes and duplicates against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from trivalent.operators import duplicates, merging, ordering
from trivalent.sources import catalogue
from trivalent.sources.scratch import written

N = 2_000_000


def exact(df, expected, n):
    r = written(df, "checked").agg(F.count("*").alias("n"), F.count_distinct("ord").alias("d"), F.max("ord").alias("m"), F.count_if(F.col("ord") != expected).alias("wrong")).first()
    assert (r["n"], r["d"], r["m"], r["wrong"]) == (n, n, n - 1, 0)


@pytest.fixture(scope="module")
def shuffled(spark):
    """k from 0 in no order, with a wide column."""
    return written(spark.range(N).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("wide")).orderBy(F.xxhash64("k")), "shuffled")


def test_numbers_of_many_rows(spark, shuffled):
    exact(ordering.numbered(shuffled, "k"), F.col("k"), N)
    exact(ordering.numbered(shuffled.select((-F.col("k")).alias("back")), "back"), F.lit(N - 1) + F.col("back"), N)
    exact(ordering.numbered(shuffled.select(F.struct((F.col("k") % 3).alias("a"), "k").alias("key")), "key").where("key.a = 0"), (F.col("key.k") / 3).cast("long"), -(-N // 3))


def test_orders_of_many_rows(spark, shuffled):
    ids = shuffled.select(F.col("k").alias("pos"), F.col("k").cast("string").alias("id"))
    merged = ordering.merge_prefix(ids.where("pos % 2 = 0"), ids)
    k = F.col("id").cast("long")
    exact(merged.select(F.col("pos").alias("ord"), "id"), F.when(k % 2 == 0, k / 2).otherwise(F.lit(N // 2) + (k - 1) / 2).cast("long"), N)
    videos = shuffled.select(F.col("k").cast("string").alias("video_id"), F.when(F.col("k") % 2 == 0, F.col("k").cast("int")).alias("native_page"), F.lit(1).alias("native_order"))
    none = spark.createDataFrame([], "page_number int, status string, video_ids array<string>")
    v = F.col("video_id").cast("long")
    exact(ordering.native_order(none, videos).where(v % 2 == 0), (v / 2).cast("long"), N // 2)
    run = ordering.ordered_overlap(ids.where("pos >= 1000000"), ids, 6).first()
    assert tuple(run) == (1_000_000, 1_000_000, 1_000_000)


def test_overlap_against_loops(spark):
    rng = random.Random(3)
    for _ in range(6):
        a, b = rng.sample(range(30), 20), rng.sample(range(30), 22)
        a[5:12], b[3:10] = (x := list(range(100, 107))), x
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                    n += 1
                best = max(best, (n, -i, -j))
        frame = lambda ids: spark.createDataFrame([(k, str(x)) for k, x in enumerate(ids)], "pos int, id string")
        got = ordering.ordered_overlap(frame(a), frame(b), 2).first()
        assert (got["run"], -got["scan_index"], -got["old_index"]) == best
        assert ordering.ordered_overlap(frame(a), frame(b), 21).count() == 0


def test_id_changes_against_loops(spark):
    rng = random.Random(5)
    have = {str(i) for i in range(10)}
    changes = [(str(rng.randrange(20)), rng.choice(["add", "remove", "toggle", "toggle"]), s) for s in range(200)]
    state = set(have)
    for i, what, _ in changes:
        add = what == "add" or (what == "toggle" and i not in state)
        (state.add if add else state.discard)(i)
    rng.shuffle(changes)
    got = merging.change_ids(spark.createDataFrame([(i,) for i in have], "video_id string"), spark.createDataFrame(changes, "video_id string, action string, seq long"))
    assert {r["video_id"] for r in got.collect()} == state


def _video(rng, i):
    detail = None if i % 13 == 0 else ("complete", 6, (i % 11 != 0, True, i % 7 != 0, i % 7 != 0), [f"a{rng.randrange(3)}" for _ in range(rng.randrange(3))], [f"t{rng.randrange(5)}" for _ in range(4)], [f"c{rng.randrange(2)}"], f"2024-01-{1 + i % 20:02d}" if i % 3 else None, [(f"{rng.choice([480, 720])}p",)] if i % 5 else [])
    return str(i) if i % 4 else f"x{i}", " ".join(rng.choice(["red", "blue", "bolt", "nut", "gear"]) for _ in range(4)), None if i % 17 == 0 else rng.randrange(60), None, None, None, None, detail


OPTIONS = [
    {}, {"matchingDurationSecDifference": 5}, {"matchingDurationSecDifference": 5, "matchingQuality": True, "matchingCategory": True}, {"matchingDuration": False, "matchingTag": True, "matchingTagCount": 2},
    {"matchingDuration": False, "matchingTag": True, "matchingTagCount": 3, "matchingTitleWords": True, "matchingTitleWordCount": 2}, {"matchingDurationSecDifference": 30, "matchingTitleWords": True, "matchingTitleWordCount": 3}, {"matchingDuration": False},
    {"matchingDurationSecDifference": 9, "matchingQuality": True, "matchingCategory": True, "matchingTag": True, "matchingTitleWords": True}, {"matchingDurationSecDifference": 0, "matchingTag": True, "matchingTagCount": 4},
]


def test_duplicates_against_pairs(spark):
    """Every option against a comparison of all pairs of an artist."""
    from trivalent.plans import rules

    rng = random.Random(11)
    schema = "video_id string, title string, duration_sec long, relative_upload_text string, relative_upload_observed_at long, listing_upload_earliest_at long, listing_upload_latest_at long, detail struct<status:string,schema_version:int,entity_trust:struct<artist:boolean,uploader:boolean,tags:boolean,categories:boolean>,artists:array<string>,tags:array<string>,categories:array<string>,exact_upload_date:string,formats:array<struct<resolution:string>>>"
    null = F.lit(None).cast("string")
    c = spark.createDataFrame([_video(rng, i) for i in range(150)], schema).withColumn("detail", F.col("detail").withField("artist", null).withField("artist_refs", F.array().cast("array<struct<key:string,name:string,url:string>>")).withField("formats", F.transform("detail.formats", lambda f: F.struct(null.alias("name"), null.alias("format"), null.alias("quality"), f["resolution"].alias("resolution")))))
    c = written(c, "videos")
    for raw in OPTIONS:
        o = rules.duplicate_options(raw)
        got = {r["video_id"]: r["verdict"] for r in duplicates.verdicts(c, o).collect()}
        assert got == {r["video_id"]: r["verdict"] for r in _all_pairs(c, o).collect()}, raw


def _all_pairs(c, o):
    d = duplicates.descriptors(c)
    known = (F.size("artists") > 0) & (F.col("duration").isNotNull() if o["matchingDuration"] else F.lit(True))
    a, b = d.where(known).alias("a"), d.where(F.size("artists") > 0).alias("b")
    pairs = a.join(b, F.arrays_overlap("a.artists", "b.artists") & (F.col("a.video_id") != F.col("b.video_id")))
    passed = duplicates.compare(lambda x: F.col(f"a.{x}"), lambda x: F.col(f"b.{x}"), o)
    found = pairs.groupBy(F.col("a.video_id").alias("video_id")).agg(F.coalesce(F.bool_or(passed & duplicates._before(F.col("b.rank"), F.col("a.rank"))), F.lit(False)).alias("hit"), F.bool_or(passed.isNull()).alias("unknown"))
    verdict = F.when(~F.coalesce(known, F.lit(False)), None).when(F.coalesce("hit", F.lit(False)), True).when(F.coalesce("unknown", F.lit(False)), None).otherwise(False)
    return d.join(found, "video_id", "left").select("video_id", verdict.cast("boolean").alias("verdict"))


def test_hot_artist(spark):
    """An artist of all of 30,000 rows: work grows with rows, not with pairs."""
    from trivalent.plans import rules

    d = F.struct(F.lit("complete").alias("status"), F.lit(6).alias("schema_version"), F.struct(*(F.lit(True).alias(x) for x in ("artist", "uploader", "tags", "categories"))).alias("entity_trust"), F.array(F.lit("A")).alias("artists"), F.lit("A").alias("artist"), F.array(F.lit("t")).alias("tags"), F.array(F.lit("c")).alias("categories"), F.lit(None).cast("string").alias("exact_upload_date"), F.array().cast("array<struct<name:string,format:string,quality:string,resolution:string>>").alias("formats"), F.array().cast("array<struct<key:string,name:string,url:string>>").alias("artist_refs"))
    c = spark.range(30_000).select(F.col("id").cast("string").alias("video_id"), F.lit("same title").alias("title"), F.lit(60).cast("long").alias("duration_sec"), F.lit(None).cast("string").alias("relative_upload_text"), *(F.lit(None).cast("long").alias(x) for x in ("relative_upload_observed_at", "listing_upload_earliest_at", "listing_upload_latest_at")), d.alias("detail"))
    for raw in ({"matchingDuration": False, "matchingTitleWords": True, "matchingTitleWordCount": 2}, {"matchingCategory": True}):
        out = duplicates.verdicts(c, rules.duplicate_options(raw))
        assert [r["video_id"] for r in out.where("not verdict").collect()] == ["0"] and out.where("verdict").count() == 29_999


def _wide(spark, n, artists=1):
    """Rows of 12 words, 20 tags and 3 categories."""
    d = F.struct(F.lit("complete").alias("status"), F.lit(6).alias("schema_version"), F.struct(*(F.lit(True).alias(x) for x in ("artist", "uploader", "tags", "categories"))).alias("entity_trust"), F.array(F.concat(F.lit("A"), (F.col("id") % artists).cast("string"))).alias("artists"), F.lit(None).cast("string").alias("artist"), F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: F.concat(F.lit("t"), F.pmod(F.xxhash64("id", i), F.lit(900)).cast("string"))).alias("tags"), F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.concat(F.lit("c"), F.pmod(F.xxhash64("id", i), F.lit(30)).cast("string"))).alias("categories"), F.lit(None).cast("string").alias("exact_upload_date"), F.array().cast("array<struct<name:string,format:string,quality:string,resolution:string>>").alias("formats"), F.array().cast("array<struct<key:string,name:string,url:string>>").alias("artist_refs"))
    title = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.concat(F.lit("w"), F.pmod(F.xxhash64(F.col("id") - F.col("id") % 3, i), F.lit(5000) + i * 0).cast("string"))), " ")
    return spark.range(n).select(F.col("id").cast("string").alias("video_id"), title.alias("title"), (F.col("id") % 600).alias("duration_sec"), F.lit(None).cast("string").alias("relative_upload_text"), *(F.lit(None).cast("long").alias(x) for x in ("relative_upload_observed_at", "listing_upload_earliest_at", "listing_upload_latest_at")), d.alias("detail"))


def test_keys_of_a_row_are_those_of_one_list(spark):
    d = duplicates.descriptors(_wide(spark, 200))
    rows = written(d.select("video_id", "artists", "tags", "words", F.lit(0).cast("long").alias("quality"), "duration"), "wide")
    for column, n in (("words", 4), ("tags", 2)):
        sizes = duplicates._posted(rows, column, n, 5).groupBy("video_id").count().agg(F.max("count")).first()[0]
        assert sizes <= 40


def test_hot_artist_of_wide_rows(spark):
    """100,000 rows of one artist that share words, tags and categories; every third row begins a group of equal titles."""
    from trivalent.plans import rules

    c = written(_wide(spark, 100_000), "wide")
    out = duplicates.verdicts(c, rules.duplicate_options({"matchingDuration": False, "matchingTitleWords": True, "matchingTitleWordCount": 8}))
    assert {r["verdict"]: r["count"] for r in out.groupBy("verdict").count().collect()} == {True: 66_666, False: 33_334}


def test_catalogue_join_and_state(spark):
    v, d = spark.createDataFrame([("1",), ("2",)], "video_id string"), spark.createDataFrame([("2", "complete"), ("3", "failed"), (None, "x")], "video_id string, status string")
    assert [tuple(r) for r in catalogue.joined(v, d).select("video_id", "detail.status").orderBy("video_id").collect()] == [("1", None), ("2", "complete")]
    assert catalogue.one(v, d, "2").count() == 1 and catalogue.one(v, d, "3").count() == 0
    s = catalogue.overlaid({"scan_status": "paused", "details_state": {"total": 5}}, {"indexed_count": 3, "details_state": {"completed": 2}})
    assert (s["scan_status"], s["indexed_count"], s["details_state"]["total"], s["details_state"]["completed"], s["details_state"]["status"]) == ("paused", 3, 5, 2, "idle")
