"""Whole queries: filter, count, sort, page."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import clamp_page, page
from .compile import Context, evaluate


@dataclass
class Result:
    rows: DataFrame
    page: int
    matches: int
    unknown: int


def verdict_counts(evaluated: DataFrame) -> DataFrame:
    """One row: matches, unknown, total."""
    return evaluated.agg(F.count_if("verdict").alias("matches"), F.count_if(F.col("verdict").isNull()).alias("unknown"), F.count("*").alias("total"))


def matching(catalogue: DataFrame, filters: dict, context: Context | None = None) -> DataFrame:
    """Rows whose verdict is TRUE; use this when the unknown rows need not be counted: filters reach the scan."""
    return evaluate(catalogue, filters, context).where("verdict").drop("verdict")


def run(catalogue: DataFrame, filters: dict, sort: dict | None = None, number: int = 1, size: int = 24, context: Context | None = None) -> Result:
    """A page of the sorted matches, and the counts, which clamp the page."""
    evaluated = evaluate(catalogue, filters, context)
    counts = verdict_counts(evaluated).first()
    at = clamp_page(number, counts["matches"], size)
    return Result(page(evaluated.where("verdict"), at, size, sort), at, counts["matches"], counts["unknown"])
