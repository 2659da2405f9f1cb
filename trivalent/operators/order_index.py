"""Deep pages: a sorted copy of a table in ranges, and how many rows each range has.

``build`` deals rows by ranges of a sort (ties in native order, unknown values last) and writes every range, sorted, as a directory of
its own, each row with its place there.  A page's rows are in the one or two ranges that the sums of the ranges' sizes name; their
places are a filter that reaches the scan, so page 50,000 costs what page 1 does.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ordering import clamp_page, order_by, page_size

#: Rows of a range, about.
RANGE_ROWS = 50_000
_RANGE, _PLACE = "_range", "_place"


class OrderIndex:
    """Pages of one sort; ``sizes`` has a number for each range."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._schema = spark.read.parquet(f"{self.path}/columns").schema
        sizes = {r[0]: r[1] for r in spark.read.parquet(f"{self.path}/sizes").collect()}
        self._ranges = sorted(sizes)
        self.sizes = [sizes[r] for r in self._ranges]
        self._before = [0, *accumulate(self.sizes)]

    @property
    def total(self) -> int:
        return self._before[-1]

    def ranges(self, first: int, count: int) -> list[int]:
        """The places, among the ranges, of those that hold rows first to first + count - 1."""
        last = min(first + count, self.total) - 1
        return [] if first > last else list(range(bisect_right(self._before, first) - 1, bisect_right(self._before, last)))

    def rows(self, first: int, count: int) -> DataFrame:
        """Rows from a number on, in order."""
        out = None
        for k in self.ranges(first, count):
            part = self.spark.read.schema(self._schema).parquet(f"{self.path}/rows/{_RANGE}={self._ranges[k]}")
            low = first - self._before[k]
            part = part.where((F.col(_PLACE) >= low) & (F.col(_PLACE) < low + count)).withColumn(_RANGE, F.lit(k))
            out = part if out is None else out.unionByName(part)
        if out is None:
            return self.spark.createDataFrame([], self._schema).drop(_PLACE)
        return out.orderBy(_RANGE, _PLACE).drop(_RANGE, _PLACE)

    def page(self, number: int, size: int) -> DataFrame:
        size = page_size(size)
        return self.rows((clamp_page(number, self.total, size) - 1) * size, size)


def build(rows: DataFrame, path: str, state: dict | None = None, range_rows: int | None = None) -> OrderIndex:
    """The index of rows (with ``ord`` and what the sort reads) at a path that all executors share."""
    spark = rows.sparkSession
    count = max(1, -(-rows.count() // (range_rows or RANGE_ROWS)))
    keys = order_by(state)
    ranged = rows.repartitionByRange(count, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    placed = ranged.withColumn(_RANGE, F.shiftright("_at", 33).cast("int")).withColumn(_PLACE, F.col("_at").bitwiseAND(F.lit(2**33 - 1))).drop("_at")
    placed.write.partitionBy(_RANGE).parquet(f"{path}/rows")
    spark.createDataFrame([], placed.drop(_RANGE).schema).write.parquet(f"{path}/columns")
    spark.read.schema(placed.schema).parquet(f"{path}/rows").groupBy(_RANGE).agg(F.count("*").alias("n")).coalesce(1).write.parquet(f"{path}/sizes")
    return OrderIndex(spark, path)
