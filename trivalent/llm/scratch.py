"""Written tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..sources.scratch import folder, written

__all__ = ["folder", "partitions", "written"]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
