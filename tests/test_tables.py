"""Versioned tables in buckets: what a commit writes, who is refused, what readers see, what is kept."""

import os
import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from trivalent import schema
from trivalent.sources import tables
from trivalent.sources.tables import Overtaken, Store
from trivalent.streaming import ingest

NOW = 1_700_000_000_000


def videos(spark, ids, **values):
    like = spark.createDataFrame([], schema.VIDEOS).schema
    return ids.select(*(values.get(f.name, F.col(f.name) if f.name in ids.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in like))


def listed(spark, n):
    return videos(spark, spark.range(n).select(F.col("id").cast("string").alias("video_id")), title=F.concat(F.lit("title "), F.col("video_id")), first_seen_at=F.lit(1))


def feed(spark, ids, page=1):
    rows = [(str(i), f"new {i}", page, k, None) for k, i in enumerate(ids)]
    return spark.createDataFrame(rows, "video_id string, title string, native_page int, native_order int, reason string")


def size(path):
    return sum(f.stat().st_size for f in Path(path).rglob("*.parquet"))


@pytest.fixture
def store(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "BUCKET_ROWS", 20)
    s = Store(spark, f"file://{tmp_path}/s")
    s.commit({"videos": listed(spark, 1500), "pages": spark.createDataFrame([], schema.PAGES), "details": spark.createDataFrame([], schema.DETAILS)})
    return s


def test_a_commit_of_one_page_writes_its_buckets(spark, store, tmp_path):
    data = tmp_path / "s" / "data"
    before = {p.name for p in data.iterdir()}
    whole = size(data)
    ingest.commit_pages(store, feed(spark, [7, 8, 6001]), "s1", NOW)
    (new,) = {p.name for p in data.iterdir()} - before
    assert size(data / new / "videos") < whole / 10
    got = {r["video_id"]: (r["title"], r["first_seen_at"]) for r in store.read("videos").collect()}
    assert len(got) == 1501 and got["7"] == ("new 7", 1) and got["6001"] == ("new 6001", NOW) and got["9"] == ("title 9", 1)
    assert store.state()["tables"]["videos"]["count"] == 128 and store.state()["tables"]["videos"]["rows"] == 1501
    assert [r["title"] for r in store.lookup("videos", "8").collect()] == ["new 8"] and store.lookup("videos", "none").count() == 0
    assert store.read("videos", 1).where("video_id = '7'").first()["title"] == "title 7"


def test_stage_appends_a_file(spark, store, tmp_path):
    for k in range(3):
        ingest.stage(store, feed(spark, [k], k), "s")
    ingest.stage(store, feed(spark, [9], 9), "other")
    assert [r["id"] for r in ingest.staged(store, "s").orderBy("pos").collect()] == ["0", "1", "2"]
    folders = [p for p in (tmp_path / "s" / "data").iterdir() if (p / "stage").exists()]
    assert len(folders) == 4 and all(p.name == "stage" for f in folders for p in f.iterdir())


def test_a_table_that_grows_gets_more_buckets(spark, store):
    store.commit({"videos": listed(spark, 10)})
    assert store.state()["tables"]["videos"]["count"] == 1
    ingest.commit_pages(store, feed(spark, range(200)), "s", NOW)
    t = store.state()["tables"]["videos"]
    assert t["count"] == 16 and t["rows"] == 200 and store.read("videos").count() == 200


def test_a_bucket_that_is_emptied_goes(spark, store):
    bucket = store._touched(store.state()["tables"]["videos"], spark.createDataFrame([("3",)], "video_id string"))
    keys = store.read("videos").where(tables.bucket("video_id", 128) == int(bucket[0])).select("video_id")
    store.commit(changes={"videos": (keys, lambda old: old.limit(0))})
    assert len(store.state()["tables"]["videos"]["at"]) == 127 and store.lookup("videos", "3").count() == 0
    with pytest.raises(ValueError, match="didn't name"):
        store.commit(changes={"videos": (keys, lambda old: listed(spark, 50))})


def _rename(name):
    return lambda old: old.withColumn("title", F.when(F.col("video_id") == name, F.lit("changed")).otherwise(F.col("title")))


def test_disjoint_writers_land_and_others_are_refused(spark, store):
    of = lambda name: (spark.createDataFrame([(name,)], "video_id string"), _rename(name))
    base = store.version()
    entry = store.state()["tables"]["videos"]
    a, b = "1", next(str(k) for k in range(2, 50) if store._touched(entry, spark.createDataFrame([(str(k),)], "video_id string")) != store._touched(entry, spark.createDataFrame([("1",)], "video_id string")))
    store.commit(changes={"videos": of(a)}, expected=base, rebase=True)
    store.commit(changes={"videos": of(b)}, expected=base, rebase=True)
    assert {r["video_id"] for r in store.read("videos").where("title = 'changed'").collect()} == {a, b}
    with pytest.raises(Overtaken, match="since"):
        store.commit(changes={"videos": of(a)}, expected=base, rebase=True)
    with pytest.raises(Overtaken, match="since"):
        store.commit({"videos": listed(spark, 3)}, expected=base, rebase=True)
    with pytest.raises(Overtaken, match="since"):
        store.restore(1, expected=base)


def test_readers_see_whole_states_during_commits(spark, store):
    """A reader in a loop, and a pointer that is never half written."""
    faults, stop, reads = [], threading.Event(), []

    def read():
        other = Store(spark, store.path)
        while not stop.is_set():
            try:
                state = other.state()
                reads.append(len(state["tables"]["videos"]["at"]))
                assert all(os.path.isdir(p.removeprefix("file://")) for p in state["tables"]["videos"]["at"].values())
            except Exception as e:  # noqa: BLE001
                faults.append(e)

    thread = threading.Thread(target=read)
    thread.start()
    for k in range(12):
        store.commit(appends={"log": spark.range(k, k + 1)})
    for k in range(38):
        store._publish(f"versions/{store.version() + 1}", store.state())
    stop.set()
    thread.join()
    assert not faults and len(reads) > 12 and store.version() == 51 and store.read("log").count() == 12


def test_one_of_two_writers_of_a_version_is_told(store):
    assert store._publish("versions/9", {"tables": {}, "meta": {"first": 1}, "touched": {}})
    assert not store._publish("versions/9", {"tables": {}, "meta": {"second": 1}, "touched": {}})
    assert store.state(9)["meta"] == {"first": 1} and not list(Path(store.path.removeprefix("file://"), "drafts").glob("[!.]*"))


def test_cleaning_keeps_pinned_baselines(spark, store, tmp_path):
    store.pin("baseline", 1)
    for k in range(6):
        ingest.commit_pages(store, feed(spark, [k], k + 1), "s", NOW + k)
    orphan = tmp_path / "s" / "data" / "0123failed"
    spark.range(3).write.parquet(f"file://{orphan}")
    assert store.clean(keep=2) == ([2, 3, 4, 5], 0)  # all data is young
    gone, folders = store.clean(keep=2, grace_ms=0)
    named = {p.removeprefix("file://") for v in (1, 6, 7) for t in store.state(v)["tables"].values() for p in t["at"].values()}
    there = {str(f.parent) for f in (tmp_path / "s" / "data").rglob("*.parquet")}
    assert gone == [] and folders > 2 and not orphan.exists() and there <= named
    assert store.read("videos").where("title like 'new%'").count() == 6
    assert store.restore(1) == 8 and store.read("videos").where("title like 'new%'").count() == 0 and store.read("videos").count() == 1500
    with pytest.raises(ValueError, match="pinned"):
        store.pin("baseline", 8)
    store.unpin("baseline")
    assert store.pins() == {} and store.clean(keep=1, grace_ms=0)[0] == [1, 6, 7]
    assert store.read("videos").count() == 1500


def test_buckets_of_large_tables_grow(monkeypatch):
    """More rows are larger buckets and more of them, not ever more directories of few rows."""
    assert [tables.buckets_for(n) for n in (0, 2000, 2001, 100_000, 128_000)] == [1, 1, 2, 64, 64]
    assert tables.buckets_for(1_200_000) == 256 and tables.buckets_for(7_200_000) == 512
    assert all(tables.buckets_for(4 * n) <= 2 * tables.buckets_for(n) for n in (10**6, 10**7, 10**8))


def test_an_outgrown_table_is_dealt_to_new_buckets_at_once(spark, store, tmp_path):
    """The rows of a change that outgrows a table are never dealt to its old buckets, of which an empty table has one."""
    data = tmp_path / "s" / "data"
    store.commit({"videos": listed(spark, 10)})
    before = {p.name for p in data.iterdir()}
    made = []
    change = lambda old: (made.append(old.count()), old.where("false").unionByName(listed(spark, 300)))[1]
    v = store.commit(changes={"videos": (listed(spark, 300).select("video_id"), change)})
    (new,) = {p.name for p in data.iterdir()} - before
    assert {p.name: len([*p.glob("_bucket=*")]) for p in (data / new).iterdir()} == {"videos-rows": 0, "videos-grown": 16}
    t = store.state()["tables"]["videos"]
    assert made == [10] and t["count"] == 16 and t["rows"] == store.read("videos").count() == 300 and store.state(v)["touched"]["videos"] is None
    assert store.lookup("videos", "299").count() == 1


def test_an_outgrown_table_keeps_the_buckets_that_were_not_touched(spark, store):
    store.commit({"videos": listed(spark, 40)})
    t = store.state()["tables"]["videos"]
    assert t["count"] == 2
    more = spark.range(1000, 1400).select(F.col("id").cast("string").alias("video_id")).where(tables.bucket("video_id", 2) == 1)
    n = more.count()
    store.commit(changes={"videos": (more, lambda old: old.unionByName(videos(spark, more)))})
    t = store.state()["tables"]["videos"]
    assert n > 160 and t["rows"] == store.read("videos").count() == 40 + n and t["count"] == tables.buckets_for(40 + n)
    assert store.read("videos").where("title is not null").count() == 40
    other = spark.range(2000, 6000).select(F.col("id").cast("string").alias("video_id"))
    with pytest.raises(ValueError, match="didn't name"):
        key = other.where(tables.bucket("video_id", t["count"]) == 1)
        store.commit(changes={"videos": (key.unionByName(key).unionByName(key).unionByName(key).unionByName(key), lambda old: videos(spark, other))})
