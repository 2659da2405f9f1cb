"""The catalogue's queries over the star-schema tables, each with its SQL for DuckDB where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, details, numbers, text, urls
from ..operators import duplicates, facets, merging, order_index, ordering, worksets
from ..sources import backup, catalogue as stored, html
from ..sources.scratch import folder
from . import rules
from .compile import Context, evaluate
from . import fixture
from .fixture import NOW, ORACLE, catalogue, event_ids, flat, members, table
from .query import matching, verdict_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def context(spark: SparkSession, sf_dir: str, filters: dict) -> Context:
    get = lambda kind, *names: event_ids(spark, sf_dir, kind) if rules.uses(filters, *names) else None
    return Context(now=NOW, seen=get("view", "seenVideos", "hideSeenVideos"), favorites=get("purchase", "favorited"), membership=members(spark, sf_dir) if rules.uses(filters, "subscriptionsOnly") else None)


def verdict(name: str, filters: dict, sql: str | None, missing: bool = False) -> None:
    """A query of one document's verdicts; sql: the BOOLEAN expression over ORACLE's c. missing: without side tables."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ctx = Context(now=NOW) if missing else context(spark, sf_dir, filters)
        return evaluate(catalogue(spark, sf_dir), filters, ctx).select("video_id", "verdict")

    QUERIES[f"verdict_{name}"] = run
    if sql:
        SQL[f"verdict_{name}"] = f"{ORACLE} SELECT video_id, CAST(({sql}) AS BOOLEAN) AS verdict FROM c"


def advanced(*items: dict) -> dict:
    return {"advanced": {"enabled": True, "items": list(items)}}


def rule(field: str, operator: str | None = None, value: object = None, **more) -> dict:
    return {"field": field, "operator": operator, "value": value, **more}


def quick(**entries) -> dict:
    return {"quick": {k: {"enabled": True, "value": v} for k, v in entries.items()}}


def detailed(**entries) -> dict:
    return {"detailed": {k: {"enabled": True, **v} for k, v in entries.items()}}


# predicates ---------------------------------------------------------------------------------------------

verdict("title_contains", advanced(rule("title", "contains", "RED")), "contains(lower(title), 'red')")
verdict("title_contains_cased", advanced(rule("title", "contains", "Brand", options={"caseSensitive": True})), "contains(title, 'Brand')")
verdict("title_equals", advanced(rule("title", "equals", "red bolt")), "lower(title) = 'red bolt'")
verdict("title_starts_with", advanced(rule("title", "startsWith", "B")), "starts_with(lower(title), 'b')")
verdict("title_ends_with", advanced(rule("title", "endsWith", "]")), "ends_with(title, ']')")
verdict("title_wildcard", advanced(rule("title", "wildcard", "*e? b*")), r"regexp_matches(lower(title), '^.*e. b.*$')")
verdict("title_regex", advanced(rule("title", "regex", r"^[a-m]+ .*\d\]?$")), r"regexp_matches(lower(title), '^[a-m]+ .*\d\]?$')")
verdict("title_regex_invalid", advanced(rule("title", "regex", "[z-a")), "true")
verdict("title_whole_word", advanced(rule("title", "contains", "brand", options={"wholeWord": True})), r"regexp_matches(lower(title), '(^|[^\pL\pN\pM_])brand($|[^\pL\pN\pM_])')")
verdict("title_any_word", advanced(rule("title", "contains", "green  gear", options={"matchAnyWord": True})), "contains(lower(title), 'green') OR contains(lower(title), 'gear')")
verdict("title_comma_terms", advanced(rule("title", "contains", " red b,, nut ,", options={"separateByCommas": True})), "contains(lower(title), 'red b') OR contains(lower(title), 'nut')")
verdict("title_exclude", advanced(rule("title", "contains", "blue", polarity="exclude")), "NOT contains(lower(title), 'blue')")
verdict("description_contains", advanced(rule("description", "contains", "steel")), "CASE WHEN done THEN contains(lower(description), 'steel') END")
verdict("description_regex_exclude", advanced(rule("description", "regex", "^eco|steel", polarity="exclude")), "CASE WHEN done THEN NOT regexp_matches(lower(description), '^eco|steel') END")
verdict("numeric_equals", advanced(rule("rating", "equals", "50")), "coalesce(rating_percent, 0) = 50")
verdict("numeric_gt", advanced(rule("views", "gt", "500K")), "coalesce(views, 0) > 500000")
verdict("numeric_gte", advanced(rule("ratingVotes", "gte", "2,500")), "coalesce(rating_votes, 0) >= 2500")
verdict("numeric_lt", advanced(rule("rating", "lt", 20)), "coalesce(rating_percent, 0) < 20")
verdict("numeric_lte", advanced(rule("views", "lte", "0.1m")), "coalesce(views, 0) <= 100000")
verdict("numeric_between", advanced(rule("views", "between", "10k", valueTo="200K")), "coalesce(views, 0) BETWEEN 10000 AND 200000")
verdict("null_as_zero", quick(views={"operator": "lte", "value": "100"}), "coalesce(views, 0) <= 100")
verdict("compact_literal_quirk", quick(views={"operator": "gte", "value": "many"}), "true")
verdict("duration_minutes", advanced(rule("duration", "gte", "20", unit="minutes")), "coalesce(duration_sec, 0) >= 1200")
verdict("duration_hours_between", advanced(rule("duration", "between", "0.25", valueTo="0.5", unit="hours")), "coalesce(duration_sec, 0) BETWEEN 900 AND 1800")
verdict("duration_quick_default", quick(duration={"value": "1500", "unit": "seconds"}), "coalesce(duration_sec, 0) >= 1500")
verdict("boolean_hd", advanced(rule("hdAvailable")), "coalesce(hd_available, false)")
verdict("entity_is", advanced(rule("artist", "is", "supplier#5")), "CASE WHEN ta THEN list_contains(list_transform(artists, lambda x: lower(x)), 'supplier#5') END")
verdict("entity_contains", advanced(rule("artist", "contains", "7")), "CASE WHEN ta THEN len(list_filter(artists, lambda x: contains(x, '7'))) > 0 END")
verdict("entity_starts_with", advanced(rule("uploader", "startsWith", "USER 1")), "CASE WHEN ta THEN starts_with(lower(uploader), 'user 1') END")
verdict("entity_regex", advanced(rule("uploader", "regex", "[05]$")), "CASE WHEN ta THEN regexp_matches(uploader, '[05]$') END")
verdict("artist_amount", advanced(rule("artist", "amountOf", "1", countComparator="gt")), "CASE WHEN ta THEN len(artists) > 1 END")
verdict("tag_case_sensitive", advanced(rule("tags", None, "Brand#1")), "CASE WHEN tt THEN list_contains(tags, 'Brand#1') END")
verdict("tag_other_case", advanced(rule("tags", None, "brand#1")), "CASE WHEN tt THEN list_contains(tags, 'brand#1') END")
verdict("category_exclude", advanced(rule("categories", None, "ECONOMY", polarity="exclude")), "CASE WHEN tt THEN category <> 'ECONOMY' END")
verdict("entity_any", detailed(tags={"value": ["BRAND#1", "red"]}), "CASE WHEN tt THEN list_has_any(list_transform(tags, lambda x: lower(x)), ['brand#1', 'red']) END")
verdict("entity_all", detailed(tags={"value": ["BRAND#1", "red"], "matchMode": "all"}), "CASE WHEN tt THEN list_has_all(list_transform(tags, lambda x: lower(x)), ['brand#1', 'red']) END")
verdict("entity_artists_any", detailed(artist={"value": ["Supplier#3", "SUPPLIER#11"]}), "CASE WHEN ta THEN list_has_any(list_transform(artists, lambda x: lower(x)), ['supplier#3', 'supplier#11']) END")
verdict("quality_equals", advanced(rule("quality", "equals", "1080p")), "quality = 1080")
verdict("quality_gte", advanced(rule("quality", "gte", "720p")), "quality >= 720")
verdict("quality_lt_exclude", advanced(rule("quality", "lt", "720p", polarity="exclude")), "NOT (quality < 720)")

_OBSERVED = "make_timestamp(relative_upload_observed_at * 1000)"
_MONTHS = lambda n: f"(epoch_us({_OBSERVED} - INTERVAL ({n}) MONTH) // 1000)"
_LOW = f"""CASE p.k WHEN 1 THEN o - 60000 WHEN 2 THEN o - (ord % 20 + 1) * 86400000 WHEN 3 THEN o - 2 * 604800000 WHEN 4 THEN {_MONTHS("ord % 30 + 1")} WHEN 5 THEN {_MONTHS("36")} END"""
_HIGH = f"""CASE p.k WHEN 1 THEN o WHEN 2 THEN o - (ord % 20) * 86400000 WHEN 3 THEN o - 604800000 WHEN 4 THEN {_MONTHS("ord % 30")} WHEN 5 THEN {_MONTHS("24")} END"""
DATED = f"""{ORACLE}, p AS (SELECT c.*, ord % 6 AS k, relative_upload_observed_at AS o FROM c),
listing AS (SELECT p.*, {_LOW} AS low, {_HIGH} AS high, epoch_ms(CAST(exact_upload_date AS TIMESTAMP)) AS day FROM p),
r AS (SELECT *, CASE WHEN done AND day IS NOT NULL THEN day ELSE low END AS a, CASE WHEN done AND day IS NOT NULL THEN day + 86399999 ELSE high END AS b,
      CASE WHEN done AND day IS NOT NULL THEN CASE WHEN low IS NOT NULL AND greatest(day, low) <= least(day + 86399999, high) THEN greatest(day, low) + (least(day + 86399999, high) - greatest(day, low)) / 2
           ELSE day + 43200000 END ELSE low + (high - low) / 2 END AS shown FROM listing)
"""


def verdict_date(name: str, config: dict, yes: str, no: str) -> None:
    filters = advanced({"field": "uploadDate", **config})
    verdict(name, filters, None)
    SQL[f"verdict_{name}"] = f"{DATED} SELECT video_id, CASE WHEN a IS NULL THEN NULL WHEN {yes} THEN true WHEN {no} THEN false END AS verdict FROM r"


def _day(d: str) -> str:
    return f"epoch_ms(TIMESTAMP '{d}')"


verdict_date("date_on", {"operator": "on", "value": "2001-06-01"}, f"a >= {_day('2001-06-01')} AND b < {_day('2001-06-02')}", f"b < {_day('2001-06-01')} OR a >= {_day('2001-06-02')}")
verdict_date("date_between", {"operator": "between", "value": "2001-03-01", "valueTo": "2001-10-31"}, f"a >= {_day('2001-03-01')} AND b < {_day('2001-11-01')}", f"b < {_day('2001-03-01')} OR a >= {_day('2001-11-01')}")
verdict_date("date_after", {"operator": "after", "value": "2001-09-15"}, f"a >= {_day('2001-09-16')}", f"b < {_day('2001-09-16')}")
verdict_date("date_before", {"operator": "before", "value": "2001-09-15"}, f"b < {_day('2001-09-15')}", f"a >= {_day('2001-09-15')}")
verdict_date("date_within_days", {"operator": "within", "value": "30", "unit": "days"}, f"a >= {NOW - 30 * 86400000}", f"b < {NOW - 30 * 86400000}")
verdict_date("date_within_months", {"operator": "within", "value": 9, "unit": "months"}, f"a >= {_day('2001-03-01')}", f"b < {_day('2001-03-01')}")
verdict_date("date_within_years", {"operator": "within", "value": "1.5", "unit": "years"}, f"a >= {_day('2000-06-01')}", f"b < {_day('2000-06-01')}")
verdict("date_detailed", detailed(uploadDate={"value": {"operator": "after", "value": "2001-01-01"}}), None)
SQL["verdict_date_detailed"] = f"{DATED} SELECT video_id, CASE WHEN a IS NULL THEN NULL WHEN a >= {_day('2001-01-02')} THEN true WHEN b < {_day('2001-01-02')} THEN false END AS verdict FROM r"

_SEEN = "video_id IN (SELECT CAST(user_id AS VARCHAR) FROM events WHERE event_type = 'view')"
_FAVORITE = "video_id IN (SELECT CAST(user_id AS VARCHAR) FROM events WHERE event_type = 'purchase')"
verdict("favorited", advanced(rule("favorited")), _FAVORITE)
verdict("favorited_unavailable", quick(favorited=True), "CAST(NULL AS BOOLEAN)", missing=True)
verdict("seen_exclude", advanced(rule("seenVideos", polarity="exclude")), f"NOT {_SEEN}")
verdict("seen_unavailable", advanced(rule("seenVideos")), "CAST(NULL AS BOOLEAN)", missing=True)
verdict("hide_seen", quick(hideSeenVideos=True), f"NOT {_SEEN}")
verdict("hide_seen_unavailable", quick(hideSeenVideos=True), "true", missing=True)
_MEMBER = "list_has_any(list_append(list_transform(artists, lambda x: lower(x)), 'k:' || coalesce(artist_ref, '')), (SELECT list(x) FROM (SELECT lower(s_name) AS x FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT 'k:' || s_suppkey FROM supplier WHERE s_suppkey % 2 = 0)))"
_NO_ARTIST = "len(artists) = 0 AND artist_ref IS NULL"
verdict("membership", advanced(rule("subscriptionsOnly")), f"CASE WHEN ta THEN CASE WHEN {_NO_ARTIST} THEN false ELSE {_MEMBER} END END")
verdict("membership_with_unknown", detailed(subscriptionsOnly={"value": {"options": {"includeWithoutDetails": True}}}), f"CASE WHEN NOT coalesce(ta, false) THEN true WHEN {_NO_ARTIST} THEN false ELSE {_MEMBER} END")
verdict("membership_unavailable", advanced(rule("subscriptionsOnly")), f"CASE WHEN ta AND {_NO_ARTIST} THEN false END", missing=True)

# expressions ----------------------------------------------------------------------------------------------

_RED, _HD = "contains(lower(title), 'red')", "hd_available"
verdict("fold_left_assoc", advanced(rule("title", "contains", "red"), rule("hdAvailable", connector="or"), rule("quality", "gte", "720p", connector="and")), f"({_RED} OR {_HD}) AND quality >= 720")
verdict("fold_first_connector", advanced(rule("title", "contains", "red", connector="or"), rule("hdAvailable", connector="and")), f"{_RED} AND {_HD}")
verdict("fold_group", advanced(rule("title", "contains", "red"), {"kind": "group", "connector": "and", "items": [rule("hdAvailable"), rule("quality", "gte", "720p", connector="or")]}), f"{_RED} AND ({_HD} OR quality >= 720)")
verdict("fold_empty_group", advanced(rule("title", "contains", "red"), {"kind": "group", "connector": "or", "items": [rule("hdAvailable", enabled=False)]}), f"{_RED} OR true")
verdict("fold_disabled", advanced(rule("title", "contains", "red", enabled=False), rule("hdAvailable", connector="or")), _HD)
verdict("fold_unknown_exclude", advanced(rule("tags", None, "red", polarity="exclude"), rule("title", "contains", "red", connector="or")), f"(CASE WHEN tt THEN NOT list_contains(tags, 'red') END) OR {_RED}")
verdict("nothing_enabled", {}, "true")
verdict("quick_and_advanced", {**quick(title={"value": "red"}, rating={"operator": "gte", "value": 40}), **advanced(rule("quality", "gte", "720p"), rule("artist", "contains", "1", connector="or"))}, f"{_RED} AND coalesce(rating_percent, 0) >= 40 AND (quality >= 720 OR CASE WHEN ta THEN len(list_filter(artists, lambda x: contains(x, '1'))) > 0 END)")

FLAGSHIP = {**quick(title={"operator": "contains", "value": "red"}, duration={"operator": "gte", "value": 5, "unit": "minutes"}), **advanced(rule("quality", "gte", "720p"))}
_FLAGSHIP = "contains(lower(title), 'red') AND coalesce(duration_sec, 0) >= 300 AND quality >= 720"


@query(f"{ORACLE}, v AS (SELECT ({_FLAGSHIP}) AS verdict FROM c) SELECT count(*) FILTER (WHERE verdict) AS matches, count(*) FILTER (WHERE verdict IS NULL) AS unknown, count(*) AS total FROM v")
def match_unknown_counts(spark, sf_dir):
    return verdict_counts(evaluate(catalogue(spark, sf_dir), FLAGSHIP, Context(now=NOW)))


@query(f"{ORACLE} SELECT video_id, title, views FROM c WHERE {_FLAGSHIP} ORDER BY views DESC NULLS LAST, ord LIMIT 24")
def sort_page(spark, sf_dir):
    return ordering.page(matching(catalogue(spark, sf_dir), FLAGSHIP, Context(now=NOW)), 1, 24, {"field": "views"}).select("video_id", "title", "views")


@query(f"{ORACLE} SELECT video_id, rating_percent FROM c WHERE hd_available ORDER BY rating_percent ASC NULLS LAST, ord LIMIT 48 OFFSET 48")
def sort_page_two(spark, sf_dir):
    return ordering.page(matching(catalogue(spark, sf_dir), advanced(rule("hdAvailable"))), 2, 48, {"field": "rating", "direction": "asc"}).select("video_id", "rating_percent")


@query(f"{DATED} SELECT video_id, CAST(shown AS DOUBLE) AS shown FROM r ORDER BY shown DESC NULLS LAST, ord LIMIT 72")
def sort_upload_date(spark, sf_dir):
    return ordering.page(catalogue(spark, sf_dir), 1, 72).select("video_id", ordering.sort_key("uploadDate").alias("shown"))


@query(f"{ORACLE}, t AS (SELECT video_id, title, ord FROM c WHERE hd_available) SELECT video_id, title FROM t ORDER BY lower(title), ord LIMIT 24")
def sort_title(spark, sf_dir):
    return ordering.page(matching(catalogue(spark, sf_dir), advanced(rule("hdAvailable"))), 1, 24, {"field": "title"}).select("video_id", "title")


# facets ------------------------------------------------------------------------------------------------------

_FACET = lambda values, where="true": f"{ORACLE}, f AS (SELECT unnest(list_distinct({values})) AS value FROM c WHERE {where}) SELECT value, count(*) AS count FROM f GROUP BY value"


@query(_FACET("tags"))
def facet_tags(spark, sf_dir):
    return facets.values(catalogue(spark, sf_dir), "tags")


@query(_FACET("artists"))
def facet_artists(spark, sf_dir):
    return facets.values(catalogue(spark, sf_dir), "artist")


@query(f"{ORACLE} SELECT count(*) FILTER (WHERE tt) AS covered FROM c")
def facet_covered(spark, sf_dir):
    return facets.covered(catalogue(spark, sf_dir), "tags")


@query(_FACET("tags") + " HAVING contains(lower(value), 'r') ORDER BY count DESC, value LIMIT 10")
def facet_search(spark, sf_dir):
    return facets.search(facets.values(catalogue(spark, sf_dir), "tags"), " R ", 10)


SELF_FACET = {**detailed(tags={"value": ["Brand#1"]}), **advanced(rule("tags", None, "red"), rule("quality", "gte", "720p"))}


@query(_FACET("tags", "quality >= 720"))
def facet_without_self(spark, sf_dir):
    return facets.faceted(catalogue(spark, sf_dir), SELF_FACET, "tags", Context(now=NOW))


@query(_FACET("[category]", "tt AND quality >= 720 AND list_contains(list_transform(tags, lambda x: lower(x)), 'brand#1') AND list_contains(tags, 'red')"))
def facet_of_other_field(spark, sf_dir):
    return facets.faceted(catalogue(spark, sf_dir), SELF_FACET, "categories", Context(now=NOW))


@query(_FACET("[category]", "tt AND quality >= 720 AND list_contains(tags, 'red')"))
def facet_of_other_field_by_rules(spark, sf_dir):
    """By rules alone, which leave rows."""
    return facets.faceted(catalogue(spark, sf_dir), advanced(rule("tags", None, "red"), rule("quality", "gte", "720p")), "categories", Context(now=NOW))


ALL_FACETS = ("artist", "uploader", "tags", "categories")
_KEPT = "quality >= 720 AND coalesce(views, 0) >= 100000"
_RED = "list_contains(tags, 'red')"
_FIELD_SQL = {"artist": ("artists", _RED), "uploader": ("CASE WHEN ta THEN [uploader] END", _RED), "tags": ("tags", "true"), "categories": ("CASE WHEN tt THEN [category] END", _RED)}


@query(f"{ORACLE}, f AS (" + " UNION ALL ".join(f"SELECT '{n}' AS field, unnest(list_distinct({v})) AS value FROM c WHERE {_KEPT} AND {w}" for n, (v, w) in _FIELD_SQL.items()) + ") SELECT field, value, count(*) AS count FROM f GROUP BY field, value")
def facets_of_all_fields(spark, sf_dir):
    """Facets of four fields, each without its own rule, in one scan."""
    filters = advanced(rule("quality", "gte", "720p"), rule("views", "gte", 100_000), rule("tags", None, "red"))
    return facets.all_faceted(catalogue(spark, sf_dir), filters, list(ALL_FACETS), Context(now=NOW))


@query(f"{ORACLE}, s AS (SELECT video_id, title, views, row_number() OVER (ORDER BY views DESC NULLS LAST, ord) AS place FROM c) SELECT video_id, title, views, (place - 1) % 48 AS place FROM s WHERE (place - 1) // 48 = ((SELECT count(*) FROM c) - 1) // 48 - 1")
def deep_page(spark, sf_dir):
    """The last page but one of all rows by an order index: only the ranges that hold it are read."""
    index = order_index.build(catalogue(spark, sf_dir).select("video_id", "title", "views", "ord"), f"{folder(spark)}/order-{uuid.uuid4().hex}", {"field": "views"}, 500)
    rows = index.page(-(-index.total // 48) - 1, 48)
    return rows.withColumn("place", F.monotonically_increasing_id()).select("video_id", "title", "views", (F.row_number().over(Window.orderBy("place")) - 1).cast("long").alias("place"))


# duplicates ----------------------------------------------------------------------------------------------------

_WORDS = r"list_distinct(regexp_extract_all(lower(regexp_replace(title, '\[[^\]]*\]', ' ', 'g')), '[\pL\pN]+(?:[''’_-][\pL\pN]+)*'))"


def _duplicates_sql(checks: str, band: int | None) -> str:
    """checks: WHEN ... THEN ... over x and y, in order."""
    near = f"AND (b.dur IS NULL OR abs(a.dur - b.dur) <= {band})" if band is not None else ""
    known = "dur IS NOT NULL" if band is not None else "true"
    return f"""{DATED}, d AS (SELECT video_id, CAST(video_id AS BIGINT) AS id, coalesce(duration_sec, 0) AS dur, quality, list_transform(tags, lambda t: lower(t)) AS tags, CASE WHEN tt THEN [lower(category)] END AS cats,
    tokens AS artists, shown, length(trim(title)) AS tl, {_WORDS} AS words FROM r),
k AS (SELECT *, row_number() OVER (ORDER BY shown ASC NULLS LAST, tl, id) AS rk FROM d),
e AS (SELECT video_id, dur, unnest(artists) AS tok FROM k),
pairs AS (SELECT DISTINCT a.video_id AS x, b.video_id AS y FROM e a JOIN e b ON a.tok = b.tok AND a.video_id <> b.video_id {near} WHERE {known.replace('dur', 'a.dur')}),
m AS (SELECT pairs.x, y.rk < x.rk AS better, CASE {checks} ELSE true END AS ok FROM pairs JOIN k x ON x.video_id = pairs.x JOIN k y ON y.video_id = pairs.y),
g AS (SELECT x, bool_or(ok AND better) AS hit, bool_or(ok IS NULL) AS unk FROM m GROUP BY x)
SELECT k.video_id, CASE WHEN artists IS NULL OR len(artists) = 0 OR NOT ({known}) THEN CAST(NULL AS BOOLEAN) WHEN g.hit THEN true WHEN g.unk THEN NULL ELSE false END AS verdict FROM k LEFT JOIN g ON g.x = k.video_id"""


_QUALITY = "WHEN x.quality IS NULL OR y.quality IS NULL THEN NULL WHEN x.quality <> y.quality THEN false"
_TAGS = "WHEN x.tags IS NULL OR y.tags IS NULL THEN NULL WHEN len(list_intersect(x.tags, y.tags)) < {n} THEN false"
for _name, _options, _sql in (
    ("duplicates_duration", {"matchingDurationSecDifference": 60}, _duplicates_sql("WHEN false THEN false", 60)),
    ("duplicates_wide", {"matchingDurationSecDifference": 900, "matchingQuality": True}, _duplicates_sql(_QUALITY, 900)),
    ("duplicates_words", {"matchingDuration": False, "matchingTitleWords": True, "matchingTitleWordCount": 2}, _duplicates_sql("WHEN len(list_intersect(x.words, y.words)) < 2 THEN false", None)),
    ("duplicates_category", {"matchingDuration": False, "matchingCategory": True, "matchingTitleWords": True}, _duplicates_sql("WHEN x.cats IS NULL OR y.cats IS NULL THEN NULL WHEN NOT list_has_any(x.cats, y.cats) THEN false WHEN len(list_intersect(x.words, y.words)) < 1 THEN false", None)),
    ("duplicates_full", {"matchingDurationSecDifference": 120, "matchingQuality": True, "matchingTag": True}, _duplicates_sql(f"{_QUALITY} {_TAGS.format(n=1)}", 120)),
):
    verdict(_name, advanced({"field": "duplicates", "options": _options}), None)
    QUERIES[_name] = QUERIES.pop(f"verdict_{_name}")
    SQL[_name] = _sql


#: Options of rows with ten words more, fifteen tags and three categories: three words, two tags and a category must be shared.
_MANY = {"matchingDuration": False, "matchingCategory": True, "matchingTag": True, "matchingTagCount": 2, "matchingTitleWords": True, "matchingTitleWordCount": 3}
_MANY_SQL = _duplicates_sql(
    "WHEN x.cats IS NULL OR y.cats IS NULL THEN NULL WHEN NOT list_has_any(x.cats, y.cats) THEN false WHEN x.tags IS NULL OR y.tags IS NULL THEN NULL WHEN len(list_intersect(x.tags, y.tags)) < 2 THEN false WHEN len(list_intersect(x.words, y.words)) < 3 THEN false", None
)
_MANY_SQL = _MANY_SQL.replace(DATED, f"""{DATED}, many AS (SELECT * REPLACE (title || ' ' || array_to_string(list_transform(range(10), lambda i: 'w' || ((ord // 3 * 31 + i * i * 17) % 1009)), ' ') AS title,
    CASE WHEN tt THEN list_transform(range(15), lambda i: 't' || ((ord * 7 + i * i * 13) % 499)) END AS tags) FROM r)""").replace("CASE WHEN tt THEN [lower(category)] END AS cats", "CASE WHEN tt THEN list_transform(range(3), lambda i: 'c' || ((ord + i * 11) % 37)) END AS cats").replace("AS words FROM r)", "AS words FROM many)")


@query(_MANY_SQL)
def duplicates_many_values(spark, sf_dir):
    """Rows of many words, tags and categories, of all of which some must be shared."""
    rows = catalogue(spark, sf_dir)
    values = lambda first, last, make: F.transform(F.sequence(F.lit(first), F.lit(last)), lambda i: make(i.cast("long")))
    words = values(0, 9, lambda i: F.concat(F.lit("w"), ((F.floor(F.col("ord") / 3) * 31 + i * i * 17) % 1009).cast("string")))
    tags = values(0, 14, lambda i: F.concat(F.lit("t"), ((F.col("ord") * 7 + i * i * 13) % 499).cast("string")))
    categories = values(0, 2, lambda i: F.concat(F.lit("c"), ((F.col("ord") + i * 11) % 37).cast("string")))
    rows = rows.withColumn("title", F.concat("title", F.lit(" "), F.array_join(words, " "))).withColumn("detail", F.when(F.col("detail").isNotNull(), F.col("detail").withField("tags", tags).withField("categories", categories)))
    return duplicates.verdicts(rows, rules.duplicate_options(_MANY)).select("video_id", "verdict")


@query(f"{DATED}, t AS (SELECT *, CAST(video_id AS BIGINT) AS id, row_number() OVER (PARTITION BY title ORDER BY shown ASC NULLS LAST, length(trim(title)), CAST(video_id AS BIGINT)) AS n, count(*) OVER (PARTITION BY title) AS members FROM r) SELECT title, video_id AS representative, members FROM t WHERE n = 1")
def representatives(spark, sf_dir):
    return duplicates.representatives(catalogue(spark, sf_dir), ["title"])


# scans, orders, sequences -------------------------------------------------------------------------------------


def _manifest(size: int, part: int) -> str:
    """SQL of the numbers that follow from all rows: n, pages of so many, and the failed page, the first after 1/part of them."""
    return f"p AS (SELECT count(*) AS n, (count(*) + {size - 1}) // {size} AS pages, (count(*) + {size - 1}) // {size} // {part} + 1 AS bad FROM part)"


def _pages(spark, sf_dir, size: int = 48, part: int = 3) -> DataFrame:
    """Manifests of all rows; one page failed, the second after it has the first id of the page before it as well."""
    bad = -(-table(spark, sf_dir, "part").count() // size) // part + 1
    at = flat(spark, sf_dir).select("video_id", "ord", (F.floor(F.col("ord") / size) + 1).cast("int").alias("page_number"))
    ids = at.groupBy("page_number").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "video_id"))), lambda x: x["video_id"]).alias("video_ids"))
    ids = ids.withColumn("video_ids", F.when(F.col("page_number") == bad + 2, F.array_append("video_ids", F.lit(str(bad * size)))).otherwise(F.col("video_ids")))
    return ids.withColumn("status", F.when(F.col("page_number") == bad, "failed").otherwise("complete")).withColumn("session_id", F.lit("s"))


@query(f"""WITH {_manifest(48, 3)}, l AS (SELECT p_partkey AS k, CAST(p_partkey AS VARCHAR) AS video_id, p_partkey // 48 + 1 <> bad AS listed FROM part, p)
SELECT video_id, row_number() OVER (ORDER BY NOT listed, CASE WHEN listed THEN k END, CASE WHEN k % 3 = 0 THEN NULL ELSE k % 10 END NULLS LAST, video_id) - 1 AS ord FROM l""")
def native_order(spark, sf_dir):
    return ordering.native_order(_pages(spark, sf_dir), _placed_videos(spark, sf_dir))


def _placed_videos(spark, sf_dir) -> DataFrame:
    return flat(spark, sf_dir).select("video_id", F.when(F.col("ord") % 3 == 0, None).otherwise(F.col("ord") % 10).cast("int").alias("native_page"), F.lit(1).alias("native_order"))


@query(f"""WITH {_manifest(48, 3)}, l AS (SELECT p_partkey AS k, CAST(p_partkey AS VARCHAR) AS video_id, p_partkey // 48 + 1 <> bad AS listed FROM part, p)
SELECT video_id, row_number() OVER (ORDER BY NOT listed, CASE WHEN listed THEN k END, CASE WHEN k % 3 = 0 THEN NULL ELSE k % 10 END NULLS LAST, video_id) - 1 AS ord FROM l ORDER BY ord LIMIT 24 OFFSET 48""")
def native_page_scan(spark, sf_dir):
    return ordering.native_page(ordering.native_order(_pages(spark, sf_dir), _placed_videos(spark, sf_dir)), 3, 24)


def _sequence(spark, sf_dir, where: str = "true", at: str = "ord") -> DataFrame:
    """pos, id of rows of the table; where and at may name n, the number of all rows."""
    rows = flat(spark, sf_dir).withColumn("n", F.lit(table(spark, sf_dir, "part").count()))
    return rows.where(where).select(F.expr(at).cast("long").alias("pos"), F.col("video_id").alias("id"))


# a listing of which the last three eighths were not scanned, and an old order without its first quarter
_SCANNED, _OLD, _OLD_AT = "ord < n div 8 * 5", "ord >= n div 4", "ord - n div 4"
_PART = "n AS (SELECT count(*) AS n FROM part), k AS (SELECT p_partkey AS k, CAST(p_partkey AS VARCHAR) AS id, n FROM part, n)"
_RUNS = """, m AS (SELECT s.pos AS i, o.pos AS j, s.pos - row_number() OVER (PARTITION BY s.pos - o.pos ORDER BY s.pos) AS island FROM s JOIN o USING (id))
SELECT min(i)::INTEGER AS scan_index, min(j)::INTEGER AS old_index, count(*)::INTEGER AS run FROM m GROUP BY i - j, island ORDER BY run DESC, scan_index, old_index LIMIT 1"""


@query(f"WITH {_PART}, s AS (SELECT k AS pos, id FROM k WHERE k < n // 8 * 5), o AS (SELECT k - n // 4 AS pos, id FROM k WHERE k >= n // 4){_RUNS}")
def ordered_overlap(spark, sf_dir):
    scanned, old = _sequence(spark, sf_dir, _SCANNED), _sequence(spark, sf_dir, _OLD, _OLD_AT)
    return ordering.ordered_overlap(scanned, old, 6).select(*(F.col(c).cast("int").alias(c) for c in ("scan_index", "old_index", "run")))


@query(f"WITH {_PART}, s AS (SELECT k AS pos, id FROM k WHERE k % 50 <> 7), o AS (SELECT k - k // 50 AS pos, id FROM k WHERE k % 50 <> 0){_RUNS}")
def overlap_of_many_runs(spark, sf_dir):
    """A listing and an old order that differ at many places: runs of one length, of which the first counts."""
    scanned, old = _sequence(spark, sf_dir, "ord % 50 <> 7"), _sequence(spark, sf_dir, "ord % 50 <> 0", "ord - ord div 50")
    return ordering.ordered_overlap(scanned, old, 6).select(*(F.col(c).cast("int").alias(c) for c in ("scan_index", "old_index", "run")))


@query(f"WITH {_PART}, b AS (SELECT id, min((src, pos)) AS first_at FROM (SELECT 0 AS src, n - k AS pos, id FROM k WHERE 2 * k >= n UNION ALL SELECT 1, k, id FROM k WHERE k % 2 = 0) GROUP BY id) SELECT row_number() OVER (ORDER BY first_at) - 1 AS pos, id FROM b")
def prefix_merge(spark, sf_dir):
    return ordering.merge_prefix(_sequence(spark, sf_dir, "2 * ord >= n", "n - ord"), _sequence(spark, sf_dir, "ord % 2 = 0"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, p_partkey // 48 + 1 AS page, p_partkey % 48 + 1 AS place FROM part")
def repaginate(spark, sf_dir):
    return ordering.repaginate(_sequence(spark, sf_dir), 48)


@query(f"WITH {_manifest(48, 3)} SELECT (bad - 1)::INTEGER AS n FROM p")
def contiguous_pages(spark, sf_dir):
    return ordering.contiguous_prefix(_pages(spark, sf_dir)).select(F.col("n").cast("int").alias("n"))


@query(f"WITH {_manifest(48, 3)} SELECT (pages - 1)::BIGINT AS done, bad::BIGINT AS next_page FROM p")
def resume_plan(spark, sf_dir):
    return ordering.resume_plan(_pages(spark, sf_dir), "s")


@query(f"WITH {_PART} SELECT id, row_number() OVER (ORDER BY k) - 1 AS pos FROM k")
def smart_order(spark, sf_dir):
    order, _ = ordering.smart_order(_sequence(spark, sf_dir, _SCANNED), _sequence(spark, sf_dir, _OLD, _OLD_AT), 6, table(spark, sf_dir, "part").count(), False)
    return order


@query(f"WITH {_PART} SELECT id, row_number() OVER (ORDER BY k) - 1 AS pos FROM k")
def anchor_order(spark, sf_dir):
    order, _ = ordering.anchor_order(_sequence(spark, sf_dir, _SCANNED), _sequence(spark, sf_dir, _OLD, _OLD_AT), table(spark, sf_dir, "part").count())
    return order


@query(f"WITH {_PART} SELECT id, row_number() OVER (ORDER BY k) - 1 AS pos FROM k WHERE k < n // 8 * 5")
def recent_order(spark, sf_dir):
    """A scan of the whole live depth: what it doesn't have is gone."""
    scanned = _sequence(spark, sf_dir, _SCANNED)
    order, _ = ordering.recent_order(scanned, _sequence(spark, sf_dir, _OLD), 5, 5, scanned.count())
    return order


# the same over the whole table: the old sequence is all rows, rotated by a third of their number

_ROTATED = "n AS (SELECT count(*) AS n FROM part), s AS (SELECT p_partkey AS k, p_partkey AS pos FROM part), o AS (SELECT p_partkey AS k, (p_partkey - n // 3 + n) % n AS pos FROM part, n)"


def _merged_sql(scanned: str, old: str) -> str:
    return f"WITH {_ROTATED}, b AS (SELECT k, min((src, pos)) AS first_at FROM (SELECT 0 AS src, s.* FROM s, n WHERE {scanned} UNION ALL SELECT 1, o.* FROM o WHERE {old}) GROUP BY k) SELECT CAST(k AS VARCHAR) AS id, row_number() OVER (ORDER BY first_at) - 1 AS pos FROM b"


def _rotated(spark, sf_dir) -> tuple[DataFrame, DataFrame, int]:
    """All rows in order, all rows rotated, and their number."""
    n = table(spark, sf_dir, "part").count()
    rows = _sequence(spark, sf_dir, "true")
    return rows, rows.select(F.pmod(F.col("pos") - n // 3, F.lit(max(n, 1))).alias("pos"), "id"), n


@query(f"""WITH {_ROTATED}, m AS (SELECT s.pos AS i, o.pos AS j, s.pos - row_number() OVER (PARTITION BY s.pos - o.pos ORDER BY s.pos) AS island FROM s JOIN o USING (k))
SELECT min(i)::INTEGER AS scan_index, min(j)::INTEGER AS old_index, count(*)::INTEGER AS run FROM m GROUP BY i - j, island ORDER BY run DESC, scan_index, old_index LIMIT 1""")
def whole_overlap(spark, sf_dir):
    scanned, old, _ = _rotated(spark, sf_dir)
    return ordering.ordered_overlap(scanned, old, 6).select(*(F.col(c).cast("int").alias(c) for c in ("scan_index", "old_index", "run")))


@query(_merged_sql("k % 3 = 0", "k % 2 = 0"))
def whole_prefix_merge(spark, sf_dir):
    scanned, old, _ = _rotated(spark, sf_dir)
    return ordering.merge_prefix(scanned.where("cast(id as long) % 3 = 0"), old.where("cast(id as long) % 2 = 0"))


@query(_merged_sql("k < n // 3", "true"))
def whole_smart_order(spark, sf_dir):
    order, _ = ordering.smart_order(*(r := _rotated(spark, sf_dir))[:2], 6, r[2], False)
    return order


@query(_merged_sql("k < n // 3", "true"))
def whole_anchor_order(spark, sf_dir):
    order, _ = ordering.anchor_order(*_rotated(spark, sf_dir))
    return order


@query(_merged_sql("true", "false"))
def whole_recent_order(spark, sf_dir):
    scanned, old, n = _rotated(spark, sf_dir)
    order, _ = ordering.recent_order(scanned, old, -(-n // 24), -(-n // 24), n)
    return order


@query(f"{ORACLE} SELECT video_id, title FROM c JOIN (SELECT DISTINCT CAST(user_id AS VARCHAR) AS video_id FROM events WHERE event_type = 'purchase') USING (video_id)")
def lookup_many(spark, sf_dir):
    return merging.prune(catalogue(spark, sf_dir), event_ids(spark, sf_dir, "purchase")).select("video_id", "title")


def _looked_up(spark, sf_dir, key: str) -> DataFrame:
    ids = table(spark, sf_dir, "events").select(F.expr(key).alias("at"), F.col("user_id").cast("string").alias("video_id"))
    placed = ordering.numbered(ids, "at").select((F.col("ord") + 1).alias("pos"), "video_id")
    return placed.join(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("video_id"), F.col("p_name").alias("name")), "video_id").select("pos", "video_id", "name")


@query("WITH ids AS (SELECT row_number() OVER (ORDER BY event_id DESC) AS pos, CAST(user_id AS VARCHAR) AS video_id FROM events) SELECT pos, video_id, p_name AS name FROM ids JOIN part ON CAST(p_partkey AS VARCHAR) = video_id")
def lookup_ordered(spark, sf_dir):
    """Rows of all events' ids, latest first."""
    return _looked_up(spark, sf_dir, "-event_id")


@query(f"{ORACLE} SELECT video_id, title, CASE WHEN ord % 10 <> 0 THEN status END AS status FROM c WHERE ord = (SELECT count(*) // 2 FROM part)")
def lookup_one(spark, sf_dir):
    key = str(table(spark, sf_dir, "part").count() // 2)
    return stored.one(fixture.videos(spark, sf_dir), fixture.details(spark, sf_dir), key).select("video_id", "title", F.col("detail.status").alias("status"))


@query(f"{ORACLE} SELECT video_id, CASE WHEN ord % 10 <> 0 THEN status END AS status, CASE WHEN ord % 10 <> 0 THEN schema_version END AS schema_version FROM c")
def catalogue_rows(spark, sf_dir):
    """Listing rows with their details, or none."""
    return catalogue(spark, sf_dir).select("video_id", "detail.status", "detail.schema_version")


# worksets and states ---------------------------------------------------------------------------------------------


def _videos_details(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    c = flat(spark, sf_dir)
    videos = c.select("video_id", "ord", "title", F.lit(1).cast("long").alias("first_seen_at"), F.col("ord").alias("last_seen_at"), F.col("ord").alias("listing_updated_at"))
    error = F.when(F.col("ord") % 19 == 0, F.struct(F.lit("HTTP").alias("code"), F.lit("gone").alias("message"), F.when(F.col("ord") % 2 == 0, 404).otherwise(500).alias("http_status")))
    d = c.select("video_id", "status", "schema_version", "description", (F.col("ord") * 10).alias("fetched_at"), F.lit(None).cast("long").alias("attempted_at"), (F.col("ord") * 11 % 5000).alias("last_attempt_at"), (F.col("ord") % 4).cast("int").alias("failure_count"), F.lit(None).cast("struct<code:string,message:string,http_status:int>").alias("last_error"), error.alias("last_attempt_error"))
    return videos, d


for _mode, _where in (("missing", "NOT done"), ("failed", "status = 'failed'"), ("refreshFailed", "done AND ord % 19 = 0"), ("refresh", "done"), ("outdated", "done AND schema_version < 6")):

    def _workset(spark, sf_dir, mode=_mode):
        return worksets.select_targets(*_videos_details(spark, sf_dir), mode, cutoff=4000)

    _key = "workset_" + {"refreshFailed": "refresh_failed"}.get(_mode, _mode)
    QUERIES[_key] = _workset
    SQL[_key] = f"{ORACLE} SELECT video_id, ord FROM c WHERE {_where} AND greatest(ord * 10, ord * 11 % 5000) < 4000"


@query(f"{ORACLE} SELECT video_id, ord FROM c WHERE NOT done ORDER BY ord LIMIT 50")
def workset_limited(spark, sf_dir):
    return worksets.select_targets(*_videos_details(spark, sf_dir), "missing", limit=50)


@query(f"{ORACLE} SELECT status, count(*) AS n FROM c GROUP BY status")
def status_counts(spark, sf_dir):
    return worksets.status_counts(*_videos_details(spark, sf_dir))


@query(f"{ORACLE} SELECT count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE done AND ord % 19 = 0) AS failed_refresh, count(*) FILTER (WHERE done AND schema_version < 5) AS outdated FROM c")
def maintenance_counts(spark, sf_dir):
    return worksets.maintenance_counts(*_videos_details(spark, sf_dir))


@query(f"{ORACLE} SELECT count(*) FILTER (WHERE done AND schema_version < 6) AS outdated FROM c")
def outdated_count(spark, sf_dir):
    return worksets.outdated_count(_videos_details(spark, sf_dir)[1])


@query("SELECT CASE WHEN p_partkey % 2 = 0 THEN 404 ELSE 500 END AS http_status, count(*) AS n FROM part WHERE p_partkey % 19 = 0 GROUP BY 1")
def failure_histogram(spark, sf_dir):
    d = _videos_details(spark, sf_dir)[1].where("last_attempt_error is not null").select(F.col("last_attempt_error.http_status").alias("http_status"))
    return worksets.histogram(d, "http_status")


@query("SELECT count(*) AS n, CASE WHEN 2 * count(*) FILTER (WHERE p_partkey % 2 = 0) >= count(*) THEN 'gone' ELSE 'server' END AS class FROM part WHERE p_partkey % 19 = 0")
def failure_majority(spark, sf_dir):
    d = _videos_details(spark, sf_dir)[1].where("last_attempt_error is not null").select(F.col("last_attempt_error.http_status").alias("s"))
    return worksets.majority(d, [("gone", F.col("s") == 404), ("server", F.col("s") >= 500)])


@query("SELECT count(*) FILTER (WHERE p_size > 45) AS invalid, count(*) AS total, count(*) FILTER (WHERE p_size > 45) >= 25 OR (count(*) FILTER (WHERE p_size > 45) >= 3 AND count(*) FILTER (WHERE p_size > 45) * 20 >= count(*)) AS systemic FROM part")
def systemic_preflight(spark, sf_dir):
    return worksets.systemic_preflight(table(spark, sf_dir, "part"), F.col("p_size") > 45)


@query("SELECT count(*)::INTEGER AS n, count(*) BETWEEN 1 AND 2 AS isolated FROM part WHERE p_partkey % 38 = 0")
def gone_only(spark, sf_dir):
    d = _videos_details(spark, sf_dir)[1].where("last_attempt_error.http_status = 404").select("last_attempt_error.http_status")
    return worksets.gone_only(d, d.count()).select(F.col("n").cast("int").alias("n"), "isolated")


_KIND = "CASE WHEN p_size % 4 = 0 THEN 'structure' WHEN p_size % 4 = 1 THEN 'authentication' END"


@query(f"WITH k AS (SELECT p_partkey AS pos, {_KIND} AS kind FROM part), r AS (SELECT pos, kind, lag(kind) OVER o AS a, lag(kind, 2) OVER o AS b FROM k WINDOW o AS (ORDER BY pos)) SELECT min(pos) AS stopped_at, arg_min(kind, pos) AS kind FROM r WHERE kind = a AND kind = b")
def breaker(spark, sf_dir):
    """Where a run over all rows stops: three systemic failures of one kind in a row."""
    return worksets.tripped(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("pos"), F.expr(_KIND).alias("kind")))


@query("WITH f AS (SELECT p_size % 3 = 0 AS ok, row_number() OVER (ORDER BY p_partkey) AS i FROM part), g AS (SELECT *, coalesce(sum(ok::INT) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f WHERE i <= 10), n AS (SELECT least(3, greatest(1, ceil(count(*) * 0.6)))::INTEGER AS required FROM g) SELECT count(*)::INTEGER AS attempted, count(*) FILTER (WHERE ok)::INTEGER AS verified, any_value(required) AS required, count(*) FILTER (WHERE ok) >= any_value(required) AS passed FROM g, n WHERE before < required")
def canary(spark, sf_dir):
    """The first targets' outcomes (ten are the feature), and whether the rest follows."""
    return worksets.canary(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), (F.col("p_size") % 3 == 0).alias("ok")))


@query("SELECT CAST(user_id AS VARCHAR) AS video_id, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 1")
def repeated_ids(spark, sf_dir):
    return worksets.repeated_ids(table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("video_id")))


@query(f"WITH {_manifest(48, 3)} SELECT n AS videos, pages::BIGINT AS pages, (pages - 1)::BIGINT AS complete_pages, 0::BIGINT AS lost, 'partial' AS state FROM p")
def catalogue_state(spark, sf_dir):
    return worksets.catalogue_state(flat(spark, sf_dir), _pages(spark, sf_dir))


@query("SELECT count(DISTINCT user_id) AS n FROM events WHERE CAST(user_id AS VARCHAR) NOT IN (SELECT CAST(p_partkey AS VARCHAR) FROM part WHERE p_partkey % 2 = 0)")
def new_ids(spark, sf_dir):
    ids = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("video_id"))
    return worksets.new_ids(ids, flat(spark, sf_dir).where("ord % 2 = 0"))


@query("SELECT count(*) AS n, sum(p_size) / count(*) AS ms_each, sum(p_size) / count(*) * 10 AS ms_left FROM part")
def timing(spark, sf_dir):
    return worksets.timing(table(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("ms")), 10)


# merging ---------------------------------------------------------------------------------------------------------


@query("SELECT CAST(p_partkey AS VARCHAR) AS video_id, CASE WHEN p_partkey % 3 = 0 THEN 'new' ELSE p_name END AS title, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 2 = 0 THEN 1 WHEN p_partkey % 3 = 0 THEN 7 ELSE 1 END AS first_seen_at, CASE WHEN p_partkey % 3 = 0 THEN 7 ELSE 2 END AS last_seen_at FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0")
def upsert_listing(spark, sf_dir):
    p = flat(spark, sf_dir)
    old = table(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").cast("string").alias("video_id"), F.col("p_name").alias("title"), F.lit(1).alias("first_seen_at"), F.lit(2).alias("last_seen_at"))
    new = p.where("ord % 3 = 0").select("video_id", F.explode(F.array(F.struct(F.lit(1).alias("at"), F.lit("old").alias("title")), F.struct(F.lit(2).alias("at"), F.lit("new").alias("title")))).alias("x")).select("video_id", "x.*")
    return merging.upsert_listing(old, new, 7, "at")


def _two_details(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    d = _videos_details(spark, sf_dir)[1].select("video_id", "status", "description", "fetched_at", "attempted_at", "last_attempt_at", "failure_count", F.col("last_attempt_error.code").alias("last_attempt_error"))
    n = F.col("video_id").cast("long")
    b = d.where(n % 4 != 0).withColumn("status", F.when(n % 3 == 0, "failed").otherwise("complete")).withColumn("description", F.when(n % 2 == 0, "other"))
    return d.where(n % 3 != 1), b.withColumn("fetched_at", F.when(n % 5 == 2, n * 10 - 1).otherwise(n * 10 + 1)).withColumn("last_attempt_at", n * 7 % 6000).withColumn("failure_count", (n % 6).cast("int"))


_TWO = """WITH n AS (SELECT p_partkey AS k, CAST(p_partkey AS VARCHAR) AS video_id, p_type || ', ' || p_name AS text FROM part),
a AS (SELECT video_id, CASE WHEN k % 5 = 0 THEN 'missing' WHEN k % 5 = 1 THEN 'failed' ELSE 'complete' END AS status, text AS description, k * 10 AS fetched_at, k * 11 % 5000 AS last_attempt_at, k % 4 AS failure_count, CASE WHEN k % 19 = 0 THEN 'HTTP' END AS last_attempt_error FROM n WHERE k % 3 <> 1),
b AS (SELECT video_id, CASE WHEN k % 3 = 0 THEN 'failed' ELSE 'complete' END AS status, CASE WHEN k % 2 = 0 THEN 'other' END AS description, CASE WHEN k % 5 = 2 THEN k * 10 - 1 ELSE k * 10 + 1 END AS fetched_at, k * 7 % 6000 AS last_attempt_at, k % 6 AS failure_count, CASE WHEN k % 19 = 0 THEN 'HTTP' END AS last_attempt_error FROM n WHERE k % 4 <> 0)"""


@query(_TWO + """, j AS (SELECT a.video_id IS NULL AS na, b.video_id IS NULL AS nb, a.status = 'complete' AS da, b.status = 'complete' AS db, greatest(a.fetched_at, a.last_attempt_at) AS la, greatest(b.fetched_at, b.last_attempt_at) AS lb, a, b FROM a FULL JOIN b ON a.video_id = b.video_id),
w AS (SELECT *, CASE WHEN na THEN true WHEN nb THEN false WHEN da <> db THEN db WHEN da THEN b.fetched_at >= a.fetched_at ELSE lb >= la END AS bf, NOT na AND NOT nb AND da = db AS ov, CASE WHEN na THEN true WHEN nb THEN false ELSE lb >= la END AS bl FROM j)
SELECT coalesce(a.video_id, b.video_id) AS video_id, CASE WHEN bf THEN b.status ELSE a.status END AS status, CASE WHEN bf THEN CASE WHEN ov THEN coalesce(b.description, a.description) ELSE b.description END ELSE CASE WHEN ov THEN coalesce(a.description, b.description) ELSE a.description END END AS description,
CASE WHEN bf THEN b.fetched_at ELSE a.fetched_at END AS fetched_at, CASE WHEN bl THEN b.last_attempt_at ELSE a.last_attempt_at END AS last_attempt_at, CASE WHEN bl THEN coalesce(b.last_attempt_error, a.last_attempt_error) ELSE coalesce(a.last_attempt_error, b.last_attempt_error) END AS last_attempt_error, greatest(coalesce(a.failure_count, 0), coalesce(b.failure_count, 0)) AS failure_count FROM w""")
def merge_details(spark, sf_dir):
    return merging.merge_details(*_two_details(spark, sf_dir)).drop("attempted_at")


@query(_TWO + " SELECT coalesce(a.video_id, b.video_id) AS video_id, CASE WHEN coalesce(b.fetched_at, 0) >= coalesce(a.fetched_at, 0) THEN coalesce(b.description, a.description) ELSE coalesce(a.description, b.description) END AS description FROM a FULL JOIN b ON a.video_id = b.video_id")
def merge_by_key(spark, sf_dir):
    return merging.merge_by_key(*_two_details(spark, sf_dir), "video_id", ("fetched_at",)).select("video_id", "description")


@query("SELECT true AS repeated, (SELECT count(DISTINCT user_id) FROM events WHERE event_type = 'view') = (SELECT count(DISTINCT user_id) FROM events) AS parts, (SELECT min(user_id) FROM events) IS NULL AS less")
def idset_same(spark, sf_dir):
    """Whether two id sets have the same members: repeats and order don't count, one member less does."""
    ids = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("video_id"), "event_type", "user_id")
    least = ids.agg(F.min("user_id")).first()[0]
    row = (merging.same_ids(ids, ids.unionByName(ids)), merging.same_ids(ids, ids.where("event_type = 'view'")), merging.same_ids(ids, ids.where(F.col("user_id") != least)))
    return spark.createDataFrame([row], "repeated boolean, parts boolean, less boolean")


@query("SELECT DISTINCT CAST(user_id AS VARCHAR) AS video_id FROM events WHERE event_type IN ('view', 'purchase')")
def idset_union(spark, sf_dir):
    return merging.union_ids(event_ids(spark, sf_dir, "view"), event_ids(spark, sf_dir, "purchase"))


@query("""WITH v AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'view'), t AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT CAST(coalesce(v.user_id, t.user_id) AS VARCHAR) AS video_id FROM v FULL JOIN t USING (user_id) WHERE (v.user_id IS NOT NULL) <> (coalesce(n, 0) % 2 = 1)""")
def idset_toggle(spark, sf_dir):
    changes = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("user_id").cast("string").alias("video_id"), F.lit("toggle").alias("action"), F.col("event_id").alias("seq"))
    return merging.change_ids(event_ids(spark, sf_dir, "view"), changes)


@query(f"{ORACLE} SELECT count(*) AS videos, count(*) FILTER (WHERE done) AS complete, count(*) FILTER (WHERE done AND schema_version < 6) AS outdated, count(*) FILTER (WHERE done) / count(*) AS coverage FROM c")
def state_counts(spark, sf_dir):
    return merging.synchronized_counts(*_videos_details(spark, sf_dir))


def _state(spark, sf_dir, where: str) -> dict[str, DataFrame]:
    v, d = _videos_details(spark, sf_dir)
    h = v.where(where).select(F.col("video_id").alias("id"), F.lit("scan").alias("kind"), F.col("ord").alias("finished_at"))
    return {"videos": v.where(where), "details": d, "history": h}


for _name, _ready, _complete, _where in (("merge_preserve", True, True, "p_partkey % 2 = 0"), ("merge_adopt", False, True, "p_partkey % 3 = 0"), ("merge_union", False, False, "p_partkey % 2 = 0 OR p_partkey % 3 = 0")):

    def _merged(spark, sf_dir, ready=_ready, complete=_complete):
        out = merging.plan_merge(_state(spark, sf_dir, "ord % 2 = 0"), _state(spark, sf_dir, "ord % 3 = 0"), ready, complete)
        return out["videos"].join(out["details"].select("video_id", "status"), "video_id").select("video_id", "status")

    QUERIES[_name] = _merged
    SQL[_name] = f"SELECT CAST(p_partkey AS VARCHAR) AS video_id, CASE WHEN p_partkey % 5 = 0 THEN 'missing' WHEN p_partkey % 5 = 1 THEN 'failed' ELSE 'complete' END AS status FROM part WHERE {_where}"


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, p_partkey AS finished_at FROM part ORDER BY p_partkey DESC LIMIT 12")
def recent_history(spark, sf_dir):
    return merging.recent_history(_state(spark, sf_dir, "true")["history"], 12).select("id", "finished_at")


@query("SELECT o_custkey AS k, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first FROM orders GROUP BY 1")
def first_occurrence(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("first"), "o_orderdate")
    return merging.first_per_key(rows, "k", "o_orderdate", "first").select("k", "first")


@query("SELECT o_custkey AS k, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last FROM orders GROUP BY 1")
def last_occurrence(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("last"), "o_orderdate")
    return merging.last_per_key(rows, "k", "o_orderdate", "last").select("k", "last")


# functions -------------------------------------------------------------------------------------------------------


@query(r"SELECT doc_id, nullif(trim(regexp_replace(text, '\s+', ' ', 'g')), '') AS clean FROM documents")
def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.clean_text(F.col("text")).alias("clean"))


@query(f"{ORACLE} SELECT video_id, list_sort({_WORDS}) AS words FROM c")
def title_words(spark, sf_dir):
    return flat(spark, sf_dir).select("video_id", F.sort_array(text.title_words(F.col("title"))).alias("words"))


@query("""WITH s AS (SELECT p_partkey AS k, p_retailprice AS p FROM part) SELECT k, CAST(floor(p * 1000 + 0.5) AS BIGINT) AS thousands, CASE WHEN k % 150 <= 100 THEN CAST(k % 150 AS DOUBLE) END AS percent,
CASE WHEN k % 75 <= 59 THEN (k % 12) * 60 + k % 75 END AS seconds FROM s""")
def parsed_numbers(spark, sf_dir):
    k = F.col("p_partkey")
    two = F.lpad((k % 75).cast("string"), 2, "0")
    return table(spark, sf_dir, "part").select(
        k.alias("k"),
        numbers.compact_number(F.concat(F.lit(" views: "), F.col("p_retailprice").cast("string"), F.lit(" K"))).alias("thousands"),
        numbers.percentage(F.concat((k % 150).cast("string"), F.lit(" % liked"))).alias("percent"),
        numbers.duration_seconds(F.concat((k % 12).cast("string"), F.lit(":"), two)).alias("seconds"),
    )


@query(f"""{ORACLE} SELECT video_id, CASE WHEN duration_sec >= 3600 THEN (duration_sec // 3600) || ':' || lpad(CAST(duration_sec // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(duration_sec % 60 AS VARCHAR), 2, '0')
WHEN duration_sec IS NOT NULL THEN (duration_sec // 60) || ':' || lpad(CAST(duration_sec % 60 AS VARCHAR), 2, '0') END AS duration,
CASE WHEN views >= 1000 THEN regexp_replace(printf('%.1f', (views + 50) // 100 / 10), '\\.0$', '') || 'K' WHEN views IS NOT NULL THEN CAST(views AS VARCHAR) END AS views FROM c""")
def formatted_numbers(spark, sf_dir):
    return flat(spark, sf_dir).select("video_id", numbers.format_duration(F.col("duration_sec")).alias("duration"), numbers.format_compact(F.col("views")).alias("views"))


@query(f"{DATED} SELECT video_id, low AS earliest, high AS latest FROM r")
def relative_ranges(spark, sf_dir):
    r = dates.relative_range(F.col("relative_upload_text"), F.col("relative_upload_observed_at"))
    return flat(spark, sf_dir).select("video_id", r["earliest"].alias("earliest"), r["latest"].alias("latest"))


@query(f"{DATED} SELECT video_id, a AS earliest, b AS latest, CASE WHEN done AND day IS NOT NULL THEN 'detail-exact' WHEN low IS NOT NULL THEN 'listing-estimate' END AS source FROM r")
def resolved_dates(spark, sf_dir):
    c = catalogue(spark, sf_dir)
    r = dates.resolve(F.col("detail.status"), F.col("detail.exact_upload_date"), dates.listing_range(F.col))
    return c.select("video_id", r["earliest"].alias("earliest"), r["latest"].alias("latest"), r["source"].alias("source"))


@query("SELECT o_orderkey AS k, epoch_ms(o_orderdate - INTERVAL (o_orderkey % 30) MONTH) AS shifted FROM orders")
def shifted_months(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), dates.shift_months(F.unix_millis(F.col("o_orderdate").cast("timestamp")), -(F.col("o_orderkey") % 30)).alias("shifted"))


@query(f"{ORACLE} SELECT video_id, list_sort(tokens) AS tokens, CAST(quality AS VARCHAR) AS quality FROM c")
def detail_tokens(spark, sf_dir):
    d = F.col("detail")
    return catalogue(spark, sf_dir).select("video_id", F.sort_array(details.artist_tokens(d)).alias("tokens"), details.quality_fingerprint(d).alias("quality"))


# over the other tables ------------------------------------------------------------------------------------------


@query(r"""SELECT d.doc_id, CASE WHEN l.quality IS NULL THEN CAST(NULL AS BOOLEAN) WHEN l.quality = 1 THEN regexp_matches(lower(text), '(^|[^\pL\pN\pM_])(the|les)($|[^\pL\pN\pM_])') ELSE regexp_matches(lower(text), '(^|[^\pL\pN\pM_])(the|les)($|[^\pL\pN\pM_])') AND false END AS verdict FROM documents d LEFT JOIN labels l USING (doc_id)""")
def document_search(spark, sf_dir):
    """Long texts with a partly known label: UNKNOWN where there is none."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    found = text.text_match(F.col("text"), "contains", "the, les", {"separateByCommas": True, "wholeWord": True})
    return d.select("doc_id", F.when(F.col("quality").isNotNull(), found & (F.col("quality") == 1)).alias("verdict"))


@query(r"SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host, nullif(regexp_extract(url, '^https?://[^/?#]+/pages?/([0-9]+)([/?#]|$)', 1), '') AS id, CASE WHEN NOT regexp_matches(coalesce(url, ''), '^https?://', 'i') THEN 'not-http' WHEN lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) NOT IN ('example.com', 'www.example.com') THEN 'other-host' WHEN nullif(regexp_extract(url, '^https?://[^/?#]+/pages?/([0-9]+)([/?#]|$)', 1), '') IS NULL THEN 'no-id' END AS reason FROM pages")
def url_identity(spark, sf_dir):
    found = urls.identity(F.col("url"), F.lit(None).cast("string"), ("example.com", "www.example.com"), "page")
    return table(spark, sf_dir, "pages").select("page_id", urls.host(F.col("url")).alias("host"), found["id"].alias("id"), found["reason"].alias("reason"))


@query()
def page_links(spark, sf_dir):
    """Titles, links and paragraphs of HTML pages, by the tag reader."""
    return html.links(table(spark, sf_dir, "pages")).select("page_id", "page_title", "n_links", "paragraphs")


_JSON = '''length('{"video_id":"' || video_id || '","views":' || coalesce(CAST(views AS VARCHAR), 'null') || '}') + length('{"video_id":"' || video_id || '","status":"' || status || '"}')'''


@query(f"{ORACLE} SELECT count(*) AS videos, count(*) FILTER (WHERE done) AS complete, count(*) FILTER (WHERE done) / count(*) AS coverage, sum({_JSON})::BIGINT AS bytes FROM c")
def backup_summary(spark, sf_dir):
    c = flat(spark, sf_dir)
    return backup.summary({"videos": c.select("video_id", "views"), "details": c.select("video_id", "status")})


@query(f"""{ORACLE}, f AS (SELECT *, ord % 19 = 0 AS err, CASE WHEN ord % 2 = 0 THEN 404 ELSE 500 END AS http FROM c WHERE NOT done)
SELECT 'status' AS section, status AS key, count(*) AS n FROM c GROUP BY status UNION ALL SELECT 'code', CASE WHEN err THEN 'HTTP' ELSE 'unknown' END, count(*) FROM f GROUP BY 2
UNION ALL SELECT 'http', CAST(http AS VARCHAR), count(*) FROM f WHERE err GROUP BY 2 UNION ALL SELECT 'shape', CASE WHEN ord % 2 = 0 THEN 'example.com/video/#/*/' ELSE 'example.com/video/#' END, count(*) FROM c GROUP BY 2
UNION ALL SELECT 'sample', '{{"video_id":"' || video_id || '"' || CASE WHEN err THEN ',"code":"HTTP","message":"gone","http_status":' || http ELSE '' END || '}}', 1 FROM (SELECT * FROM f ORDER BY video_id LIMIT 10)""")
def diagnostics(spark, sf_dir):
    v, d = _videos_details(spark, sf_dir)
    url = F.concat(F.lit("https://Example.com/video/"), "video_id", F.when(F.col("ord") % 2 == 0, "/some-title/?from=3").otherwise("#top"))
    return backup.diagnostics(v.withColumn("url", url), d)


@query("SELECT CAST(p_partkey AS VARCHAR) AS video_id, CASE WHEN p_partkey % 5 > 1 AND p_partkey % 7 = 0 THEN 'failed once' WHEN p_partkey % 7 = 0 THEN 'failed' WHEN p_partkey % 5 = 0 THEN 'missing' WHEN p_partkey % 5 = 1 THEN 'failed' ELSE 'complete' END AS state, p_partkey % 4 + CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END AS failures FROM part")
def record_failures(spark, sf_dir):
    d = _videos_details(spark, sf_dir)[1].withColumn("last_attempt_error", F.lit(None).cast("struct<code:string,message:string,http_status:int>"))
    error = F.struct(F.lit("HTTP").alias("code"), F.lit(None).cast("string").alias("message"), F.lit(500).alias("http_status"))
    out = merging.record_failure(d, d.where("cast(video_id as long) % 7 = 0").select("video_id", error.alias("error")), NOW)
    state = F.when((F.col("status") == "complete") & F.col("last_attempt_error").isNotNull(), "failed once").otherwise(F.col("status"))
    return out.select("video_id", state.alias("state"), F.col("failure_count").alias("failures"))


def _reconciled(spark, sf_dir, where: str, at: str, size: int) -> dict[str, DataFrame]:
    v, _ = _videos_details(spark, sf_dir)
    v = v.withColumn("native_page", F.lit(None).cast("int")).withColumn("native_order", F.lit(None).cast("int"))
    ids = ordering.numbered(v.where(where).select(F.expr(at).alias("key"), F.col("video_id").alias("id")), "key").select(F.col("ord").alias("pos"), "id")
    return merging.reconcile(ids, v, v.where("ord % 2 = 0"), size, NOW)


@query("SELECT (n - 1) // 48 + 1 AS page_number, list(id ORDER BY n) AS video_ids FROM (SELECT CAST(p_partkey AS VARCHAR) AS id, row_number() OVER (ORDER BY p_partkey DESC) AS n FROM part WHERE p_partkey % 7 <> 0) GROUP BY 1")
def reconcile_pages(spark, sf_dir):
    return _reconciled(spark, sf_dir, "ord % 7 <> 0", "-ord", 48)["pages"].select("page_number", "video_ids")


@query(f"SELECT id AS video_id, ((n - 1) // 48 + 1)::INTEGER AS native_page, ((n - 1) % 48 + 1)::INTEGER AS native_order, CASE WHEN k % 2 = 0 THEN {NOW} ELSE k END AS last_seen_at FROM (SELECT p_partkey AS k, CAST(p_partkey AS VARCHAR) AS id, row_number() OVER (ORDER BY p_partkey DESC) AS n FROM part WHERE p_partkey % 7 <> 0)")
def reconcile_rows(spark, sf_dir):
    """The rows after an ordered update: placed anew, rows that were staged with their new times, others as they were."""
    return _reconciled(spark, sf_dir, "ord % 7 <> 0", "-ord", 48)["videos"].select("video_id", "native_page", "native_order", "last_seen_at")


# manifests of all rows, all events and all failures ---------------------------------------------------------------

_ALL_PAGES = _manifest(24, 2)


def _all_pages(spark, sf_dir) -> DataFrame:
    return _pages(spark, sf_dir, 24, 2)


@query(f"""WITH {_ALL_PAGES}, l AS (SELECT p_partkey AS k, CAST(p_partkey AS VARCHAR) AS video_id, p_partkey // 24 + 1 <> bad AS listed FROM part, p)
SELECT video_id, row_number() OVER (ORDER BY NOT listed, CASE WHEN listed THEN k END, CASE WHEN k % 3 = 0 THEN NULL ELSE k % 10 END NULLS LAST, video_id) - 1 AS ord FROM l""")
def whole_native_order(spark, sf_dir):
    return ordering.native_order(_all_pages(spark, sf_dir), _placed_videos(spark, sf_dir))


@query(f"WITH {_ALL_PAGES} SELECT (bad - 1)::INTEGER AS n FROM p")
def whole_contiguous_pages(spark, sf_dir):
    return ordering.contiguous_prefix(_all_pages(spark, sf_dir)).select(F.col("n").cast("int").alias("n"))


@query(f"WITH {_ALL_PAGES} SELECT (pages - 1)::BIGINT AS done, bad::BIGINT AS next_page FROM p")
def whole_resume_plan(spark, sf_dir):
    return ordering.resume_plan(_all_pages(spark, sf_dir), "s")


@query(f"WITH {_ALL_PAGES} SELECT n AS videos, pages::BIGINT AS pages, (pages - 1)::BIGINT AS complete_pages, 0::BIGINT AS lost, 'partial' AS state FROM p")
def whole_catalogue_state(spark, sf_dir):
    return worksets.catalogue_state(flat(spark, sf_dir), _all_pages(spark, sf_dir))


@query("SELECT (n - 1) // 24 + 1 AS page_number, list(id ORDER BY n) AS video_ids FROM (SELECT CAST(p_partkey AS VARCHAR) AS id, row_number() OVER (ORDER BY p_partkey) AS n FROM part WHERE p_partkey % 5 <> 0) GROUP BY 1")
def whole_reconcile_pages(spark, sf_dir):
    return _reconciled(spark, sf_dir, "ord % 5 <> 0", "ord", 24)["pages"].select("page_number", "video_ids")


@query("WITH ids AS (SELECT row_number() OVER (ORDER BY event_id) AS pos, CAST(user_id AS VARCHAR) AS video_id FROM events) SELECT pos, video_id, p_name AS name FROM ids JOIN part ON CAST(p_partkey AS VARCHAR) = video_id")
def whole_lookup_ordered(spark, sf_dir):
    return _looked_up(spark, sf_dir, "event_id")


@query("SELECT count(*)::INTEGER AS n, count(*) BETWEEN 1 AND 2 AND bool_and(p_partkey % 2 = 0) AS isolated FROM part WHERE p_partkey % 19 = 0")
def whole_gone_only(spark, sf_dir):
    d = _videos_details(spark, sf_dir)[1].where("last_attempt_error is not null").select("last_attempt_error.http_status")
    return worksets.gone_only(d, d.count()).select(F.col("n").cast("int").alias("n"), "isolated")


from . import ingest_queries  # noqa: E402, F401  registers its queries as well
