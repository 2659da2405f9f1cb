"""What changed between two versions of a table, and results kept up by it.

A version's pointer names the directory of each bucket, so buckets that both versions name alike hold the same rows and are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import Store


def feed(store: Store, name: str, since: int, until: int | None = None) -> DataFrame:
    """key, old, new: the rows that differ, as structs; old is null for a row that came, new for one that went.

    Rows of equal key and values are no change.  A table that was laid out anew in between is compared whole.
    """
    a, b = store.state(since)["tables"][name], store.state(until)["tables"][name]
    if a["key"] is None or a["key"] != b["key"]:
        raise ValueError(f"{name} has no key in both versions")
    key, same = a["key"], a["count"] == b["count"]
    only = sorted({k for k in {*a["at"], *b["at"]} if a["at"].get(k) != b["at"].get(k)}) if same else None
    x, y = (store._frame(t, only) for t in (a, b))
    old = x.select(F.col(key).alias("key"), F.struct(*x.columns).alias("old"))
    new = y.select(F.col(key).alias("key"), F.struct(*y.columns).alias("new"))
    both = old.join(new, "key", "full_outer")
    return both.where(~F.col("old").eqNullSafe(F.col("new")))


def counted(rows: DataFrame, values: Column) -> DataFrame:
    """value, count: how many rows have each value; values: an array, of which each value counts once a row."""
    return rows.select(F.explode(F.array_distinct(values)).alias("value")).groupBy("value").agg(F.count("*").alias("count"))


def recounted(counts: DataFrame, changes: DataFrame, values) -> DataFrame:
    """counts (value, count) after changes; ``values`` makes the array of a row from its struct.

    Rows that went count down, rows that came count up, and only changed rows are read.
    """
    signed = lambda side, sign: changes.where(F.col(side).isNotNull()).select(F.explode(F.array_distinct(values(F.col(side)))).alias("value"), F.lit(sign).cast("long").alias("count"))
    moved = signed("old", -1).unionByName(signed("new", 1)).groupBy("value").agg(F.sum("count").alias("count")).where("count <> 0")
    return counts.unionByName(moved).groupBy("value").agg(F.sum("count").alias("count")).where("count > 0")


def patched(result: DataFrame, changes: DataFrame, evaluated: DataFrame, key: str = "video_id") -> DataFrame:
    """A result of the old version (a row a key) made that of the new one; evaluated: the result over the new version.

    Only keys of the changes are taken from ``evaluated``, whose filters by key reach its joins; so it must judge each row by itself.
    """
    moved = changes.select(F.col("key").alias(key)).distinct()
    return result.join(moved, key, "left_anti").unionByName(evaluated.join(moved, key, "left_semi").select(result.columns))
