"""Deep pages, facets in one scan, changes between versions and what is kept up by them."""

import random

import pytest
from pyspark.sql import functions as F

from trivalent.operators import facets, order_index, ordering
from trivalent.plans import queries
from trivalent.plans.compile import Context, evaluate
from trivalent.plans.fixture import NOW, catalogue, event_ids
from trivalent.sources import changes, tables
from trivalent.sources.tables import Store

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("state", ({"field": "views"}, {"field": "title"}, {"field": "duration", "direction": "asc"}))
def test_every_page_is_that_of_the_full_sort(spark, tmp_path, state):
    rows = catalogue(spark, SF).select("video_id", "title", "views", "duration_sec", "ord")
    index = order_index.build(rows, f"file://{tmp_path}/i", state, 30)
    full = [r["video_id"] for r in rows.orderBy(*ordering.order_by(state)).collect()]
    assert index.total == len(full) and len(index.sizes) > 3
    for number in (1, 2, 5, -(-index.total // 24), 10_000):
        first = (ordering.clamp_page(number, index.total, 24) - 1) * 24
        assert [r["video_id"] for r in index.page(number, 24).collect()] == full[first : first + 24]
    again = order_index.OrderIndex(spark, f"file://{tmp_path}/i")
    assert [r["video_id"] for r in again.rows(25, 70).collect()] == full[25:95]


def test_a_deep_page_reads_its_ranges_only(spark, tmp_path):
    rows = spark.range(200_000).select(F.col("id").cast("string").alias("video_id"), F.xxhash64("id").alias("views"), F.col("id").alias("ord"))
    index = order_index.build(rows, f"file://{tmp_path}/i", {"field": "views"}, 1000)
    number = 200_000 // 24 - 3
    page = index.page(number, 24)
    held = sum(index.sizes[k] for k in index.ranges((number - 1) * 24, 24))
    assert held < 0.02 * index.total and len(page.inputFiles()) == len(index.ranges((number - 1) * 24, 24))
    want = rows.orderBy(*ordering.order_by({"field": "views"})).offset((number - 1) * 24).limit(24)
    assert [r["video_id"] for r in page.collect()] == [r["video_id"] for r in want.collect()]


def test_an_empty_index(spark, tmp_path):
    index = order_index.build(spark.createDataFrame([], "video_id string, views long, ord long"), f"file://{tmp_path}/i", {"field": "views"})
    assert index.total == 0 and index.page(3, 24).count() == 0


DOCUMENTS = [
    {},
    {**queries.quick(views={"value": "100000"}, favorited={}), **queries.detailed(tags={"value": ["red", "Brand#1"]}), **queries.advanced(queries.rule("quality", "gte", "720p"), queries.rule("tags", None, "red", connector="or"), {"kind": "group", "connector": "and", "items": [queries.rule("categories", None, "STANDARD"), queries.rule("hdAvailable", connector="or")]})},
    queries.advanced(queries.rule("artist", "contains", "1"), queries.rule("artist", "contains", "2", connector="or", polarity="exclude")),
]


@pytest.mark.parametrize("document", DOCUMENTS)
def test_facets_in_one_scan_are_those_of_each_field(spark, document):
    rows, context = catalogue(spark, SF), Context(now=NOW, favorites=event_ids(spark, SF, "purchase"))
    got = {(r["field"], r["value"], r["count"]) for r in facets.all_faceted(rows, document, list(queries.ALL_FACETS), context).collect()}
    assert got == {(f, r["value"], r["count"]) for f in queries.ALL_FACETS for r in facets.faceted(rows, document, f, context).collect()}


def test_one_scan_of_the_tables(spark):
    scans = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")
    rows = catalogue(spark, SF)
    assert scans(facets.all_faceted(rows, DOCUMENTS[2], list(queries.ALL_FACETS))) == scans(rows)


def random_change(rng, spark, n):
    rows = [(str(rng.randrange(600)), f"{rng.choice('abc')} {rng.choice('xyz')}", rng.randrange(500)) for _ in range(n)]
    return spark.createDataFrame(list({r[0]: r for r in rows}.values()), "video_id string, title string, views long")


def test_counts_and_verdicts_kept_by_changes_are_those_of_all_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "BUCKET_ROWS", 20)
    rng = random.Random(4)
    store = Store(spark, f"file://{tmp_path}/s")
    version = store.commit({"videos": random_change(rng, spark, 500)})
    words = lambda row: F.split(row["title"], " ")
    verdict = lambda v: store.read("videos", v).select("video_id", ((F.col("views") > 250) & F.col("title").startswith("a")).alias("verdict"))
    counts, result = changes.counted(store.read("videos", version), F.split("title", " ")), verdict(version)
    for k in range(4):
        incoming = random_change(rng, spark, 12)
        gone = store.read("videos").select("video_id").limit(2) if k % 2 else incoming.select("video_id").limit(0)
        step = lambda old, incoming=incoming, gone=gone: old.join(incoming.select("video_id").unionByName(gone), "video_id", "left_anti").select(old.columns).unionByName(incoming)
        after = store.commit(changes={"videos": (incoming.select("video_id").unionByName(gone), step)})
        feed = changes.feed(store, "videos", version, after)
        counts = changes.recounted(counts, feed, words)
        result = changes.patched(result, feed, verdict(after))
        version = after
    whole = lambda df: sorted(map(tuple, df.collect()))
    assert whole(counts) == whole(changes.counted(store.read("videos"), F.split("title", " ")))
    assert whole(result) == whole(verdict(version))
    assert changes.feed(store, "videos", version, version).count() == 0


def test_a_feed_reads_touched_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "BUCKET_ROWS", 20)
    store = Store(spark, f"file://{tmp_path}/s")
    a = store.commit({"videos": spark.range(640).select(F.col("id").cast("string").alias("video_id"), F.lit("t").alias("title"))})
    b = store.commit(changes={"videos": (spark.createDataFrame([("5",)], "video_id string"), lambda old: old.withColumn("title", F.when(F.col("video_id") == "5", F.lit("new")).otherwise(F.col("title"))))})
    feed = changes.feed(store, "videos", a, b)
    assert len(feed.inputFiles()) == 2 and [(r["key"], r["old"]["title"], r["new"]["title"]) for r in feed.collect()] == [("5", "t", "new")]
    c = store.commit({"videos": store.read("videos").where("video_id < '3'")})
    assert changes.feed(store, "videos", b, c).where("new is not null").count() == 0


def test_evaluate_is_unchanged_without_documents(spark):
    assert evaluate(catalogue(spark, SF), {}).where("not verdict or verdict is null").count() == 0
