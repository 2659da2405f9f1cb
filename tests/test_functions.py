"""Text, number, date and URL functions on single values."""

from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from trivalent.functions import dates, details, numbers, text, urls


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(make(F.col("c")).alias("x")).first()["x"]


def ms(*args) -> int:
    return int(datetime(*args, tzinfo=UTC).timestamp() * 1000)


@pytest.mark.parametrize(("value", "expected"), [("52K views", 52000), ("1.2M", 1200000), ("3,456", 3456), (" - ", None), (None, None), ("1.2.3", None), ("12 k", 12000)])
def test_compact_number(spark, value, expected):
    assert one(spark, value, numbers.compact_number) == expected


@pytest.mark.parametrize(("value", "expected"), [("99%", 99.0), ("101%", None), ("x 12.5 % y", 12.5), ("", None)])
def test_percentage(spark, value, expected):
    assert one(spark, value, numbers.percentage) == expected


@pytest.mark.parametrize(("value", "expected"), [("12:34", 754), ("1:02:03", 3723), ("1:75", None), ("5", None), ("1:02:75", None)])
def test_duration(spark, value, expected):
    assert one(spark, value, numbers.duration_seconds) == expected


@pytest.mark.parametrize(("value", "expected"), [("10K", 10000), ("1.5m", 1.5e6), ("2b", 2e9), ("2,000", 2000), ("-1", None), ("x", None), (5, 5), ("", None)])
def test_compact_literal(value, expected):
    assert numbers.compact_literal(value) == expected


@pytest.mark.parametrize(
    ("value", "needle", "options", "expected"),
    [
        ("a cat sat", "cat", {"wholeWord": True}, True), ("concatenate", "cat", {"wholeWord": True}, False), ("été cat_", "cat", {"wholeWord": True}, False), ("xa a a", "a a", {"wholeWord": True}, False),
        ("Red Fox", "red fox", {}, True), ("Red Fox", "red fox", {"caseSensitive": True}, False), ("the dog", "cat, dog", {"separateByCommas": True}, True), ("the dog", " ,, ", {"separateByCommas": True}, False),
        ("the dog", "cat  dog", {"matchAnyWord": True}, True), ("the dog", "", {}, True), ("the dog", "", {"matchAnyWord": True}, False), (None, "", {}, False), ("a.c", "a.c", {}, True), ("abc", "a.c", {}, False),
    ],
)
def test_contains(spark, value, needle, options, expected):
    assert one(spark, value, lambda c: text.text_match(c, "contains", needle, options)) is expected


@pytest.mark.parametrize(
    ("operator", "value", "needle", "expected"),
    [
        ("wildcard", "red fox", "r?d *", True), ("wildcard", "red fox\n", "red fox", False), ("wildcard", "a+b", "A+*", True), ("regex", "red fox", "^R.d", True), ("regex", "red\n", "red$", False),
        ("regex", "red", "(", False), ("regex", "a b", r"a\sb", True), ("regex", "a[b", "[[b]{2}", True), ("regex", "x&&y", "[&&y]", True), ("startsWith", "Red", "re", True), ("endsWith", "Red", "ED", True), ("equals", "Red", "red", True),
    ],
)
def test_text_operators(spark, operator, value, needle, expected):
    assert one(spark, value, lambda c: text.text_match(c, operator, needle)) is expected


def test_title_words(spark):
    assert one(spark, "The [HD] Cat's 【x】 cat's (1) Re-run", text.title_words) == ["the", "cat's", "re-run"]
    assert one(spark, None, text.title_words) == []


def test_unique_ci_and_length(spark):
    assert spark.range(1).select(text.unique_ci(F.array(*(F.lit(x) for x in (" A", "a", "", "b", "B ")))).alias("x")).first()["x"] == ["A", "b"]
    assert one(spark, "a😀", text.utf16_length) == 3
    assert one(spark, " a  \n b ", text.clean_text) == "a b"
    assert one(spark, "<p>a&amp;b<br>c</p>", lambda c: text.readable_text(text.plain_text(c))) == "a&b\nc"


@pytest.mark.parametrize(
    ("value", "low", "high"),
    [
        ("3 hours ago", ms(2024, 3, 31, 8), ms(2024, 3, 31, 9)), ("a month ago", ms(2024, 1, 31, 12), ms(2024, 2, 29, 12)), ("just now", ms(2024, 3, 31, 11, 59), ms(2024, 3, 31, 12)),
        ("Less than an hour ago", ms(2024, 3, 31, 11), ms(2024, 3, 31, 12)), ("2 years ago", ms(2021, 3, 31, 12), ms(2022, 3, 31, 12)), ("soon", None, None), (None, None, None), ("99999999999999999999 days ago", None, None),
    ],
)
def test_relative_range(spark, value, low, high):
    got = one(spark, value, lambda c: dates.relative_range(c, F.lit(ms(2024, 3, 31, 12))))
    assert (got["earliest"], got["latest"]) == (low, high) if low else got is None


def test_exact_and_shown_dates(spark):
    day = ms(2024, 2, 29)
    make = lambda c: dates.exact_range(F.lit("complete"), c)
    assert one(spark, "2024-02-29", make).asDict() == {"source": "detail-exact", "precision": "date", "earliest": day, "latest": day + dates.DAY - 1, "sort": day + dates.DAY / 2}
    assert one(spark, "2023-02-29", make) is None
    assert one(spark, "2024-02-29T10:00:00Z", make)["sort"] == ms(2024, 2, 29, 10)
    listing = F.struct(F.lit(day + 1000).alias("earliest"), F.lit(day + 3000).alias("latest"))
    assert one(spark, "2024-02-29", lambda c: dates.display_resolve(F.lit("complete"), c, listing))["sort"] == day + 2000
    assert one(spark, "2024-02-29", lambda c: dates.resolve(F.lit("failed"), c, listing))["source"] == "listing-estimate"


def test_within_cutoff_and_match(spark):
    now = ms(2024, 3, 31)
    assert dates.within_cutoff(now, "1", "months") == ms(2024, 2, 29)
    assert dates.within_cutoff(now, 0, "days") is None
    straddles = lambda c: F.struct(F.lit("x").alias("source"), F.lit("range").alias("precision"), F.lit(ms(2024, 3, 1)).alias("earliest"), F.lit(ms(2024, 3, 3)).alias("latest"), F.lit(0.0).alias("sort"))
    assert one(spark, "x", lambda c: dates.date_match(straddles(c), "on", "2024-03-02")) is None
    assert one(spark, "x", lambda c: dates.date_match(straddles(c), "after", "2024-02-20")) is True
    assert one(spark, "x", lambda c: dates.date_match(straddles(c), "before", "2024-02-20")) is False
    assert one(spark, "x", lambda c: dates.date_match(straddles(c), "on", "no date")) is False


@pytest.mark.parametrize(("value", "expected"), [("March 5, 2024", "2024-03-05"), ("2024-03-05", "2024-03-05"), ("3 days ago", None), ("2024-03-05T10:00:00+02:00", "2024-03-05T08:00:00.000Z"), ("nonsense", None)])
def test_normalize_exact_date(spark, value, expected):
    assert one(spark, value, dates.normalize_exact_date) == expected


def test_formats(spark):
    assert one(spark, 3723, numbers.format_duration, "long") == "1:02:03"
    assert one(spark, 1234567, numbers.format_compact, "long") == "1.2M"
    assert one(spark, 2048, numbers.format_bytes, "long") == "2.0 KB"
    assert one(spark, 7, numbers.page_parameter, "int") == "07"
    assert one(spark, 3 * dates.HOUR, dates.format_age, "long") == "3 hours ago"


@pytest.mark.parametrize(("value", "expected"), [("123", "123"), ("video_id=45", "45"), ("https://example.com/videos/77/slug/", "77"), ("/video/8", "8"), ("https://example.com/x/77", None), ("", None)])
def test_item_id(spark, value, expected):
    assert one(spark, value, urls.item_id) == expected


def test_urls(spark):
    hosts = ("example.com",)
    ok = one(spark, "https://example.com/video/5/x#t", lambda c: urls.identity(c, F.lit("5"), hosts))
    assert (ok["ok"], ok["url"]) == (True, "https://example.com/video/5/x")
    assert one(spark, "https://other.org/video/5", lambda c: urls.identity(c, F.lit("5"), hosts))["reason"] == "other-host"
    assert one(spark, "https://example.com/video/6", lambda c: urls.identity(c, F.lit("5"), hosts))["reason"] == "id-mismatch"
    assert one(spark, "javascript:alert(1)", lambda c: urls.resolve(c, "https://example.com")) is None
    assert one(spark, "/a", lambda c: urls.resolve(c, "https://example.com")) == "https://example.com/a"
    assert one(spark, "a:1;b:2:3;bad;a:4", urls.parameters) == {"a": "4", "b": "2:3"}
    ref = one(spark, "/models/jane-doe/", lambda c: urls.entity_ref(c, F.lit(None), "https://example.com", hosts))
    assert (ref["key"], ref["name"]) == ("jane-doe", "jane doe")
    assert one(spark, "1234", lambda c: urls.thumbnails(F.lit(None), F.lit("data:x"), F.lit(None), c, "https://t.example.com/{group}/{id}.jpg")) == ["https://t.example.com/1000/1234.jpg"]
    assert one(spark, "https://example.com/video/5", urls.variants) == ["https://example.com/video/5", "https://example.com/videos/5"]


def test_quality(spark):
    d = spark.createDataFrame([(("complete", [("mp4 720p", None, None), (None, None, "1080P"), (None, "x", None)]),), (("failed", [("720p", None, None)]),), (("complete", []),)], "detail struct<status:string,formats:array<struct<name:string,quality:string,resolution:string>>>")
    assert [r["q"] for r in d.select(details.quality_fingerprint(F.col("detail")).alias("q")).collect()] == ["1080,720", None, None]
