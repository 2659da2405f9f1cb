"""Facets: the values of a field and in how many rows each is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.details import entity_values, is_trusted, raw_values


def values(rows: DataFrame, field: str) -> DataFrame:
    """value, count: each row counts once for a value; spellings that differ in case stay apart."""
    return rows.select(F.explode(found(field)).alias("value")).groupBy("value").agg(F.count("*").alias("count"))


def found(field: str) -> Column:
    """A row's values of a field, null where they are not known."""
    d = F.col("detail")
    return entity_values(d, field) if field in ("artist", "uploader") else F.array_distinct(F.filter(F.transform(raw_values(d, field), lambda v: F.trim(v)), lambda v: v != ""))


def covered(rows: DataFrame, field: str) -> DataFrame:
    """One row: how many rows can be counted for the field."""
    return rows.agg(F.count_if(is_trusted(F.col("detail"), field)).alias("covered"))


def search(vocabulary: DataFrame, query: str = "", limit: int = 60) -> DataFrame:
    """The most frequent values that contain the query, whatever its case; ties in order of the values."""
    q = query.strip().lower()
    kept = vocabulary.where(F.lower("value").contains(q)) if q else vocabulary
    return kept.orderBy(F.desc("count"), F.collate("value", "UNICODE"), "value").limit(max(1, limit))


def faceted(catalogue: DataFrame, filters: dict, field: str, context=None) -> DataFrame:
    """A field's values over the rows that match the filter without what it says of the field itself."""
    from ..plans.compile import evaluate
    from ..plans.rules import without_facet

    return values(evaluate(catalogue, without_facet(filters, field), context).where("verdict"), field)


def all_faceted(catalogue: DataFrame, filters: dict, fields: list[str], context=None) -> DataFrame:
    """field, value, count: ``faceted`` of several fields in one scan and one aggregate."""
    from ..plans.compile import evaluate_without

    judged = evaluate_without(catalogue, filters, fields, context)
    named = lambda f: F.transform(found(f), lambda v: F.struct(F.lit(f).alias("field"), v.alias("value")))
    listed = [F.when(F.col("verdicts")[f], named(f)) for f in fields]
    none = F.array().cast("array<struct<field:string,value:string>>")
    return judged.select(F.explode(F.concat(*(F.coalesce(x, none) for x in listed))).alias("at")).groupBy("at.field", "at.value").agg(F.count("*").alias("count"))
