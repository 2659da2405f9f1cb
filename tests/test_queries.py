"""Every query of the catalogue against its SQL."""

import pytest
from compare import SF, agree

from trivalent.plans.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    agree(QUERIES[name](spark, SF), SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["video_id", "title", "views"]
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ("whole_smart_order", "whole_anchor_order", "whole_recent_order"))
def test_sequences_have_every_row(spark, name):
    assert QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/part.parquet").count()


def test_manifests_have_every_row(spark):
    from pyspark.sql import functions as F

    from trivalent.plans.queries import _all_pages

    assert _all_pages(spark, SF).agg(F.sum(F.size("video_ids"))).first()[0] == spark.read.parquet(f"{SF}/part.parquet").count() + 1
