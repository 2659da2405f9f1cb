"""A version in buckets: joined without an exchange, the same rows, whole or not there, cleaned with its version."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from trivalent.sources import catalogue, layout
from trivalent.sources.tables import Store

VIDEOS, DETAILS = "video_id string, title string, views long", "video_id string, status string, tags array<string>, trust struct<artist:boolean,tags:boolean>"


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s")
    k = F.col("id").cast("string")
    v = spark.range(900).select(k.alias("video_id"), F.concat(F.lit("t"), k).alias("title"), (F.col("id") % 5).alias("views"))
    v = v.unionByName(spark.createDataFrame([(None, "no id", 1)], VIDEOS))
    d = spark.range(0, 1200, 3).select(k.alias("video_id"), F.lit("complete").alias("status"), F.array(k).alias("tags"), F.struct(F.lit(True).alias("artist"), F.lit(None).cast("boolean").alias("tags")).alias("trust"))
    s.commit({"videos": v, "details": d.unionByName(spark.createDataFrame([(None, "failed", None, None)], DETAILS))})
    return s


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_join_has_no_exchange(spark, store):
    assert layout.lay_out(store, bucket_rows=100) == 16
    got = layout.stored(store)
    text = plan(got)
    assert "Exchange" not in text and "SortMergeJoin" in text and "SelectedBucketsCount: 16 out of 16" in text
    assert rows(got) == rows(catalogue.stored(store)) and got.count() == 901
    assert got.where("video_id is null").first()["detail"] is None
    # what is grouped by the id afterwards stays in the buckets too
    assert "Exchange" not in plan(got.groupBy("video_id").agg(F.max("views")))
    files = [p.name for p in Path(layout._spec(store, 1)["at"]["videos"].removeprefix("file:")).glob("*.parquet")]
    assert len(files) == len({f.split("_")[1].split(".")[0] for f in files})  # a file a bucket


def test_one_bucket_of_an_id_is_read(spark, store):
    layout.lay_out(store, bucket_rows=100)
    df = layout.table(store, "videos").where("video_id = '77'")
    assert [r["title"] for r in df.collect()] == ["t77"]
    assert df.rdd.getNumPartitions() == 1 and layout.table(store, "videos").rdd.getNumPartitions() > 1


def test_another_session_reads_the_same_buckets(spark, store):
    layout.lay_out(store, bucket_rows=100)
    before = rows(layout.stored(store))
    for name in layout.TABLES:
        mark = layout._spec(store, 1)["at"][name].split("/")[-2]
        spark.sql(f"DROP TABLE layout_{mark}_{name}")
    got = layout.stored(store)
    assert rows(got) == before and "Exchange" not in plan(got)


def test_first_layout_counts_and_none_is_refused(spark, store, tmp_path):
    with pytest.raises(ValueError, match="isn't laid out"):
        layout.stored(store)
    assert layout.lay_out(store, bucket_rows=100) == 16 and layout.lay_out(store, bucket_rows=1) == 16
    # a version that came later has none of its own
    store.commit({"videos": store.read("videos").where("video_id = '5'")})
    assert layout.stored(store, 1).count() == 901
    with pytest.raises(ValueError, match="isn't laid out"):
        layout.stored(store)
    assert layout.lay_out(store, bucket_rows=100) == 1 and layout.stored(store).count() == 1


def test_unfinished_layout_is_none(spark, store, monkeypatch):
    def failing(name, content):
        raise OSError("the writer was lost")

    monkeypatch.setattr(store, "_publish", failing)
    with pytest.raises(OSError, match="lost"):
        layout.lay_out(store, bucket_rows=100)
    monkeypatch.undo()
    assert layout._spec(store, 1) is None
    assert layout.lay_out(store, bucket_rows=450) == 4 and layout.stored(store).count() == 901


def test_cleaning_keeps_layouts_of_kept_versions(spark, store, tmp_path):
    layout.lay_out(store, bucket_rows=450)
    store.pin("base", 1)
    store.commit({"videos": store.read("videos").where("views = 1")})
    layout.lay_out(store, bucket_rows=450)
    for _ in range(2):
        store.commit(meta={"x": 1})
    later = 10**15
    gone, removed = store.clean(keep=1, grace_ms=0, now_ms=later)
    assert gone == [2, 3] and store._numbers("layouts") == [1] and removed >= 1
    assert layout.stored(store, 1).count() == 901
    layout.forget(store, 1)
    store.clean(keep=1, grace_ms=0, now_ms=later)
    with pytest.raises(ValueError, match="isn't laid out"):
        layout.stored(store, 1)
    assert catalogue.stored(store, 1).count() == 901
    assert json.loads((tmp_path / "s" / "versions" / "1").read_text())["tables"]


def test_empty_tables(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/e")
    s.commit({"videos": spark.createDataFrame([], VIDEOS), "details": spark.createDataFrame([], DETAILS)})
    assert layout.lay_out(s) == 1 and layout.stored(s).collect() == []
