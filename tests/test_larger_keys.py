"""Queries over keys that only larger tables have, against their SQL."""

import duckdb
import pytest
from compare import SF, TABLES, agree

from trivalent.plans import ingest_queries
from trivalent.plans.queries import QUERIES, SQL
from trivalent.sources import layout


@pytest.fixture
def moved(tmp_path):
    """The small tables with rows of part more, whose keys are moved up."""

    def make(*shifts: int) -> str:
        for t in TABLES:
            rows = f"SELECT * FROM '{SF}/{t}.parquet'"
            if t == "part":
                rows = " UNION ALL ".join([rows, *(f"SELECT * REPLACE (p_partkey + {n} AS p_partkey) FROM '{SF}/part.parquet'" for n in shifts)])
            duckdb.sql(f"COPY ({rows}) TO '{tmp_path}/{t}.parquet'")
        return str(tmp_path)

    return make


def test_counts_beyond_a_megabyte(spark, moved):
    sf = moved(1 << 20)
    agree(QUERIES["counts_of_feeds"](spark, sf), SQL["counts_of_feeds"], sf)


def test_details_of_unknown_ids(spark, moved):
    """The key 919000 is a row's own, without complete details; complete details of an id that no row has must not meet it."""
    sf = moved(919_000)
    agree(QUERIES["import_replace"](spark, sf), SQL["import_replace"], sf)


def test_facet_keeps_its_own_fields_rules():
    """Values of another field are counted under all filters, those of the sidebar too."""
    assert "brand#1" in SQL["facet_of_other_field"]


def test_layouts_grow_by_large_buckets(spark, moved, monkeypatch):
    """Larger tables have larger buckets, not ever more of few rows."""
    seen = []
    monkeypatch.setattr(layout, "lay_out", lambda store, bucket_rows, own=layout.lay_out: seen.append(own(store, bucket_rows=bucket_rows)))
    for shifts in ((), tuple(1000 * k for k in range(1, 100))):
        ingest_queries._laid_out(spark, moved(*shifts))
    assert seen[0] <= seen[1] <= 32


def test_a_backup_is_several_files(spark):
    """Compressed files are read by a task each, so a backup of one would be imported by one task."""
    at = ingest_queries._exported(spark, SF, "several")
    assert all(spark.read.text(f"{at}/{t}").select("_metadata.file_path").distinct().count() > 1 for t in ("videos", "details", "history"))
