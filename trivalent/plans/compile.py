"""A filter document as one BOOLEAN Column: TRUE, FALSE, and null for UNKNOWN.

The catalogue has the columns of VIDEOS and the struct ``detail``; side tables become flag columns by left
joins that are made only if the document asks for them.  Groups are folded from the left, without precedence
of AND; what is off is left out; nothing on is TRUE.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.details import available, entity_values, is_trusted, qualities, raw_values
from ..functions.numbers import compact_literal, number_literal
from ..functions.text import text_match
from ..operators.duplicates import verdicts
from . import rules

NUMBERS = {"duration": "duration_sec", "views": "views", "rating": "rating_percent", "ratingVotes": "rating_votes"}


@dataclass
class Context:
    """Side inputs. An id set that isn't there is UNKNOWN; ``strict_nulls`` makes a missing number fail instead of counting as 0."""

    now: int = 0
    seen: DataFrame | None = None
    favorites: DataFrame | None = None
    membership: DataFrame | None = None
    strict_nulls: bool = False


def unknown() -> Column:
    return F.lit(None).cast("boolean")


def compare(actual: Column, operator: str, value: float | None, value_to: float | None = None) -> Column:
    """FALSE where a side is no number."""
    if value is None or (operator == "between" and value_to is None):
        return F.lit(False)
    test = {"equals": actual == value, "gt": actual > value, "gte": actual >= value, "lt": actual < value, "lte": actual <= value}.get(operator)
    return F.coalesce(actual.between(value, value_to) if operator == "between" else F.lit(False) if test is None else test, F.lit(False))


def _numeric(name: str, config: dict, default: str, context: Context) -> Column:
    scale = rules.DURATION_UNITS.get(config.get("unit"), 1) if name == "duration" else 1
    if name in ("views", "ratingVotes"):
        parse = lambda v: (compact_literal(v) or 0.0) * scale  # noqa: E731  no number counts as 0 here
    else:
        parse = lambda v: None if number_literal(v) is None else number_literal(v) * scale
    actual = F.col(NUMBERS[name])
    actual = actual if context.strict_nulls else F.coalesce(actual, F.lit(0).cast("double"))
    return compare(actual, config.get("operator") or default, parse(config.get("value")), parse(config.get("valueTo")))


def upload_range() -> Column:
    return dates.resolve(F.col("detail.status"), F.col("detail.exact_upload_date"), dates.listing_range(F.col))


def membership(include: bool) -> Column:
    d = F.col("detail")
    refs = F.coalesce(d["artist_refs"], F.array().cast("array<struct<key:string,name:string,url:string>>"))
    none = (F.size(entity_values(d, "artist")) == 0) & (F.size(refs) == 0)
    return F.when(~is_trusted(d, "artist"), F.lit(True) if include else unknown()).when(none, False).otherwise(F.col("_member"))


def rule_column(rule: dict, context: Context) -> Column:
    """A rule's verdict, after its polarity; a rule that is off is TRUE."""
    if not rule["enabled"]:
        return F.lit(True)
    name, op, value, options = rule["field"], rule.get("operator"), rule.get("value"), rule.get("options") or {}
    d = F.col("detail")
    if name in rules.REGISTERED:
        out = rules.REGISTERED[name](rule, context)
    elif name in NUMBERS:
        out = _numeric(name, rule, "equals", context)
    elif name == "hdAvailable":
        out = F.coalesce("hd_available", F.lit(False))
    elif name == "favorited":
        out = F.col("_favorite")
    elif name == "seenVideos":
        out = F.when(F.coalesce("video_id", F.lit("")) == "", False).otherwise(F.col("_seen"))
    elif name == "subscriptionsOnly":
        out = membership(options.get("includeWithoutDetails") is True)
    elif name == "uploadDate":
        out = dates.date_match(upload_range(), op or "on", value, rule.get("valueTo"), rule.get("unit"), context.now)
    elif name == "quality":
        best = F.array_max(qualities(d))
        wanted = int(str(value)[:-1]) if str(value) in rules.QUALITIES else None
        out = F.when(best.isNotNull(), compare(best, op, wanted))
    elif name == "duplicates":
        out = F.col(_duplicates_column(rule))
    elif name in ("tags", "categories"):
        out = F.array_contains(raw_values(d, name), F.lit(str(value)))
    elif name in ("artist", "uploader"):
        values = entity_values(d, name)
        if op == "amountOf":
            out = F.when(values.isNotNull(), compare(F.size(values), rule["countComparator"], float(value)))
        elif op == "is":
            out = F.exists(values, lambda v: F.lower(v) == str(value).lower())
        else:
            out = F.exists(values, lambda v: text_match(v, op or "contains", value, options))
    elif name == "description":
        out = available(d, text_match(F.coalesce(d["description"], F.lit("")), op or "contains", value, options))
    else:
        out = text_match(F.coalesce(name, F.lit("")), op or "contains", value, options)
    return ~out if rule["polarity"] == "exclude" else out


def items_column(items: list[dict], leaf: Callable[[dict], Column]) -> Column:
    """The fold of a list of rules and groups; leaf gives a rule's column."""
    out = None
    for i in items:
        if i["enabled"]:
            v = items_column(i["items"], leaf) if i["kind"] == "group" else leaf(i)
            out = v if out is None else out | v if i["connector"] == "or" else out & v
    return F.lit(True) if out is None else out


def simple_columns(n: dict, context: Context) -> dict[str, Column]:
    """The column of each quick and detailed filter that is on."""
    out: dict[str, Column] = {}
    for name, e in n["quick"].items():
        if not e["enabled"]:
            continue
        if name == "hideSeenVideos":
            out[name] = F.coalesce(~F.col("_seen"), F.lit(True))
        elif name == "favorited":
            out[name] = F.col("_favorite")
        else:
            config = e["value"] if isinstance(e["value"], dict) else {"value": e["value"]}
            out[name] = text_match(F.coalesce("title", F.lit("")), config.get("operator") or "contains", config.get("value"), config.get("options")) if name == "title" else _numeric(name, config, "gte", context)
    for name, e in n["detailed"].items():
        if not e["enabled"]:
            continue
        if name == "subscriptionsOnly":
            out[name] = membership(e["value"]["options"]["includeWithoutDetails"])
        elif name == "uploadDate":
            out[name] = dates.date_match(upload_range(), e["value"].get("operator") or "on", e["value"].get("value"), e["value"].get("valueTo"), e["value"].get("unit"), context.now)
        else:
            have = F.transform(entity_values(F.col("detail"), name) if name in ("artist", "uploader") else raw_values(F.col("detail"), name), lambda v: F.lower(v))
            tests = [F.array_contains(have, F.lit(v.lower())) for v in e["value"]]
            out[name] = reduce((lambda a, b: a & b) if e["matchMode"] == "all" else (lambda a, b: a | b), tests)
    return out


def all_of(columns: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns, F.lit(True))


def filter_column(filters: dict, context: Context) -> Column:
    n = rules.normalize(filters)
    simple = all_of(simple_columns(n, context).values())
    return simple & items_column(n["advanced"]["items"], lambda rule: rule_column(rule, context)) if n["advanced"]["enabled"] else simple


def _duplicates_column(rule: dict) -> str:
    o = rules.duplicate_options(rule.get("options"))
    return "_duplicates_" + "_".join(str(int(v)) for v in o.values())


def _flag(df: DataFrame, ids: DataFrame | None, name: str) -> DataFrame:
    """Whether video_id is among the ids; null if there is no set. Spark broadcasts the ids if they are few."""
    if ids is None:
        return df.withColumn(name, unknown())
    have = ids.select(F.col(ids.columns[0]).cast("string").alias("video_id")).where("video_id is not null").distinct().withColumn(name, F.lit(True))
    return df.join(have, "video_id", "left").withColumn(name, F.coalesce(name, F.lit(False)))


def _members(df: DataFrame, members: DataFrame | None) -> DataFrame:
    """Whether an artist's reference key or name is in the membership table (key, name)."""
    if members is None:
        return df.withColumn("_member", unknown())
    d = F.col("detail")
    keys = F.transform(F.coalesce(d["artist_refs"], F.array().cast("array<struct<key:string,name:string,url:string>>")), lambda r: F.concat(F.lit("k:"), F.lower(r["key"])))
    names = F.transform(entity_values(d, "artist"), lambda v: F.concat(F.lit("n:"), F.lower(F.trim(v))))
    wanted = members.select(F.explode(F.array(F.concat(F.lit("k:"), F.lower("key")), F.concat(F.lit("n:"), F.lower(F.trim("name"))))).alias("_token")).where("_token is not null").distinct()
    tokens = df.select("video_id", F.explode(F.array_distinct(F.concat(keys, names))).alias("_token"))
    hit = tokens.join(wanted, "_token", "left_semi").select("video_id").distinct().withColumn("_member", F.lit(True))
    return df.join(hit, "video_id", "left").withColumn("_member", F.coalesce("_member", F.lit(False)))


def with_side_tables(catalogue: DataFrame, n: dict, context: Context) -> DataFrame:
    """catalogue with the columns that a normalised document's rules read of other tables."""
    df = catalogue
    if rules.uses(n, "favorited"):
        df = _flag(df, context.favorites, "_favorite")
    if rules.uses(n, "seenVideos", "hideSeenVideos"):
        df = _flag(df, context.seen, "_seen")
    if rules.uses(n, "subscriptionsOnly"):
        df = _members(df, context.membership)
    made: set[str] = set()
    for i, on in rules.walk(n["advanced"]["items"]) if n["advanced"]["enabled"] else []:
        if on and i.get("field") == "duplicates" and (c := _duplicates_column(i)) not in made:
            made.add(c)
            df = df.join(verdicts(catalogue, i["options"]).withColumnRenamed("verdict", c), "video_id", "left")
    return df


def evaluate(catalogue: DataFrame, filters: dict, context: Context | None = None) -> DataFrame:
    """catalogue with ``verdict``."""
    context = context or Context()
    n = rules.normalize(filters)
    return with_side_tables(catalogue, n, context).withColumn("verdict", filter_column(n, context)).select(*catalogue.columns, "verdict")


def evaluate_without(catalogue: DataFrame, filters: dict, fields: list[str], context: Context | None = None) -> DataFrame:
    """catalogue with ``verdicts``, a map of each field to the verdict of the document without what it says of the field.

    Every rule is a column once, of one scan and one join of each side table; a field's verdict is another fold of these columns.
    """
    context = context or Context()
    n = rules.normalize(filters)
    df = with_side_tables(catalogue, n, context)
    leaves: dict[str, Column] = {f"_simple_{name}": c for name, c in simple_columns(n, context).items()}
    name_of = lambda rule: "_rule_" + json.dumps({k: v for k, v in rule.items() if k not in ("id", "connector")}, sort_keys=True, default=str)
    for i, on in rules.walk(n["advanced"]["items"]) if n["advanced"]["enabled"] else []:
        if on and i["kind"] == "rule":
            leaves[name_of(i)] = rule_column(i, context)
    at = {name: f"_leaf_{k}" for k, name in enumerate(leaves)}
    judged = df.select(*catalogue.columns, *(c.alias(at[name]) for name, c in leaves.items()))

    def fold(field: str) -> Column:
        m = rules.normalize(rules.without_facet(n, field))
        simple = all_of(F.col(at[f"_simple_{name}"]) for name in simple_columns(m, context))
        return simple & items_column(m["advanced"]["items"], lambda rule: F.col(at[name_of(rule)])) if m["advanced"]["enabled"] else simple

    verdicts_ = F.create_map(*(c for f in fields for c in (F.lit(f), fold(f).cast("boolean"))))
    return judged.select(*catalogue.columns, verdicts_.alias("verdicts"))
