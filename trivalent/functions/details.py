"""Fields of a detail: what is known, what is trusted.

A detail is a struct column, null where there is none.  A field of a detail that is not complete, and an entity
field that is not trusted, is null, which every predicate takes for UNKNOWN.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let
from .text import unique_ci

#: Schema version from which entities can be trusted, and the one below which details are outdated.
TRUSTED_SCHEMA, CURRENT_SCHEMA = 5, 6
ENTITY_FIELDS = ("artist", "uploader", "tags", "categories")
PLURAL = {"artist": "artists", "uploader": "uploaders"}


def is_complete(detail: Column) -> Column:
    return F.coalesce(detail["status"] == "complete", F.lit(False))


def is_trusted(detail: Column, field: str | None = None) -> Column:
    ok = is_complete(detail) & F.coalesce(detail["schema_version"] >= TRUSTED_SCHEMA, F.lit(False))
    return ok & F.coalesce(detail["entity_trust"][field], F.lit(False)) if field else ok


def available(detail: Column, value: Column) -> Column:
    return F.when(is_complete(detail), value)


def entity_values(detail: Column, field: str) -> Column:
    """Trimmed values, the first spelling of each; null if the field isn't trusted."""
    listed = detail[PLURAL.get(field, field)]
    if field in PLURAL:
        single = detail[field]
        listed = F.when(F.size(listed) > 0, listed).when(F.coalesce(single, F.lit("")) != "", F.array(single)).otherwise(F.array().cast("array<string>"))
    values = unique_ci(F.coalesce(listed, F.array().cast("array<string>")))
    return F.when(is_trusted(detail, field), values)


def raw_values(detail: Column, field: str) -> Column:
    """The values as stored, for rules that compare them exactly; empty if missing, null if not trusted."""
    return F.when(is_trusted(detail, field), F.coalesce(detail[field], F.array().cast("array<string>")))


def qualities(detail: Column) -> Column:
    """Distinct heights of all formats, largest first; null if none is known."""
    texts = F.flatten(F.transform(detail["formats"], lambda f: F.array(f["resolution"], f["quality"], f["name"])))
    heights = F.transform(texts, lambda t: F.regexp_extract(F.lower(t), r"(?:^|\b)(\d{3,5})p(?:\b|$)", 1).try_cast("int"))
    known = F.array_distinct(F.filter(heights, lambda h: h > 0))
    return F.when(is_complete(detail), let(known, lambda k: F.when(F.size(k) > 0, F.sort_array(k, asc=False))))


def quality_fingerprint(detail: Column) -> Column:
    return F.array_join(qualities(detail), ",")


def artist_tokens(detail: Column) -> Column:
    """What two rows must share to be compared: references if there are any, else names; never one of each."""
    lowered = lambda values: F.array_distinct(F.filter(F.transform(values, lambda v: F.lower(F.trim(F.coalesce(v, F.lit(""))))), lambda v: v != ""))
    refs = lowered(F.transform(F.coalesce(detail["artist_refs"], F.array().cast("array<struct<key:string,name:string,url:string>>")), lambda r: r["key"]))
    names = lowered(entity_values(detail, "artist"))
    tagged = F.when(F.size(refs) > 0, F.transform(refs, lambda v: F.concat(F.lit("ref:"), v))).otherwise(F.transform(names, lambda v: F.concat(F.lit("name:"), v)))
    return F.when(is_trusted(detail, "artist"), tagged)


def lowered_values(detail: Column, field: str) -> Column:
    return F.array_distinct(F.transform(entity_values(detail, field), lambda v: F.lower(v)))
