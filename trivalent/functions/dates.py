"""Upload dates: ranges of milliseconds since 1970 UTC, and what can be said of them.

A range is struct<source, precision, earliest, latest, sort>; what is not known is null.  Predicates are TRUE if
the whole range is on one side, FALSE if it is on the other, and null in between.
"""

from __future__ import annotations

import calendar
import re
from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let
from .text import clean_text

MINUTE, HOUR, DAY = 60_000, 3_600_000, 86_400_000
WEEK = 7 * DAY
MONTH_ABOUT, YEAR_ABOUT = 30.4375 * DAY, 365.25 * DAY
UNITS = {"minutes": MINUTE, "hours": HOUR, "days": DAY, "weeks": WEEK}
OPERATORS = ("on", "after", "before", "between", "within")


def shift_months(ms: Column, months: Column) -> Column:
    """The same time of day so many months on, on the last day of the month at most."""
    return F.unix_millis(F.timestamp_millis(ms) + F.make_ym_interval(F.lit(0), months.cast("int")))


def shift_months_literal(ms: float, months: float) -> int:
    """As shift_months, of a literal; part of a month counts as a whole one into the past."""
    t = datetime.fromtimestamp(ms / 1000, UTC)
    year, month = divmod(int(-(-(t.year * 12 + t.month - 1 + months) // 1)), 12)
    day = min(t.day, calendar.monthrange(year, month + 1)[1])
    return int(t.replace(year=year, month=month + 1, day=day).timestamp() * 1000)


def parse_date_literal(value: object) -> int | None:
    """Start of a YYYY-MM-DD day of the calendar, else null."""
    text = str("" if value is None else value).strip()
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", text, re.A):
        return None
    try:
        return int(datetime.strptime(text, "%Y-%m-%d").replace(tzinfo=UTC).timestamp() * 1000)
    except ValueError:
        return None


def parse_date(c: Column) -> Column:
    """Start of the day, for texts that are a day of the calendar in YYYY-MM-DD."""
    text = F.trim(c)
    return F.when(text.rlike(r"\A\d{4}-\d{2}-\d{2}\z"), F.unix_millis(F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))))


def parse_instant(c: Column) -> Column:
    """Milliseconds of an ISO instant with time (UTC where it has no zone)."""
    text = F.trim(c)
    return F.when(text.rlike(r"\A\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:?\d{2})?\z"), F.unix_millis(F.try_to_timestamp(text)))


def relative_parts(c: Column) -> Column:
    """struct<amount, unit, special> of "3 hours ago" and its like; null for other texts."""
    unit = "(minute|hour|day|week|month|year)"
    part = lambda amount, u, special=None: F.struct(amount.cast("long").alias("amount"), u.alias("unit"), F.lit(special).cast("string").alias("special"))
    counted = rf"\A(\d+) {unit}s? ago\z"

    def of(text: Column) -> Column:
        amount = F.regexp_extract(text, counted, 1).try_cast("long")
        return (
            F.when(text == "just now", part(F.lit(0), F.lit("minute"), "just-now"))
            .when(text.rlike(r"\Aless than (an?|1) hour ago\z"), part(F.lit(0), F.lit("hour"), "under-hour"))
            .when(text.rlike(rf"\A(an?|one) {unit} ago\z"), part(F.lit(1), F.regexp_extract(text, rf"\A(?:an?|one) {unit} ago\z", 1)))
            .when(amount <= 2**53 - 1, part(amount, F.regexp_extract(text, counted, 2)))
        )

    return let(F.lower(clean_text(c)), of)


def relative_range(c: Column, observed: Column) -> Column:
    """struct<earliest, latest, amount, unit>: an age of n units lies between n and n + 1 of them."""

    def of(x: Column) -> Column:
        amount, unit, at = x["p"]["amount"], x["p"]["unit"], x["at"]
        scale = F.when(unit == "minute", MINUTE).when(unit == "hour", HOUR).when(unit == "day", DAY).when(unit == "week", WEEK).cast("long")
        months = F.least(amount, F.lit(100_000)) * F.when(unit == "year", 12).otherwise(1)
        more = F.when(unit == "year", 12).otherwise(1)
        edge = lambda n, m: F.when(scale.isNotNull(), at - n * scale).when(amount <= 100_000, shift_months(at, -m))
        out = F.struct(edge(amount + 1, months + more).alias("earliest"), edge(amount, months).alias("latest"), amount.alias("amount"), unit.alias("unit"))
        return F.when(x["p"].isNotNull() & at.isNotNull(), let(out, lambda r: F.when(r["earliest"].isNotNull() & r["latest"].isNotNull(), r)))

    return let(F.struct(relative_parts(c).alias("p"), observed.cast("long").alias("at")), of)


def _range(source: str, precision: str, earliest: Column, latest: Column, sort: Column) -> Column:
    return F.struct(F.lit(source).alias("source"), F.lit(precision).alias("precision"), earliest.cast("long").alias("earliest"), latest.cast("long").alias("latest"), sort.cast("double").alias("sort"))


def exact_range(status: Column, date: Column) -> Column:
    """Of a complete detail's date: the whole day, with noon to sort by, or the instant."""
    of_day = let(parse_date(date), lambda day: F.when(day.isNotNull(), _range("detail-exact", "date", day, day + (DAY - 1), day + DAY // 2)))
    of_instant = let(parse_instant(date), lambda at: F.when(at.isNotNull(), _range("detail-exact", "timestamp", at, at, at)))
    return F.when(status == "complete", F.coalesce(of_day, of_instant))


def listing_range(video) -> Column:
    """struct<earliest, latest> as stored, or else from the relative text; video: a column of a name."""
    earliest, latest = video("listing_upload_earliest_at"), video("listing_upload_latest_at")
    observed = F.coalesce(video("relative_upload_observed_at"), video("listing_updated_at"), video("last_seen_at"), video("first_seen_at"))
    both = lambda a, b: F.struct(a.alias("earliest"), b.alias("latest"))
    again = let(relative_range(video("relative_upload_text"), observed), lambda r: F.when(r.isNotNull(), both(r["earliest"], r["latest"])))
    return F.when(earliest <= latest, both(earliest, latest)).otherwise(again)


def _middle(earliest: Column, latest: Column) -> Column:
    return earliest + (latest - earliest) / 2


def _estimate(listing: Column) -> Column:
    return F.when(listing.isNotNull(), _range("listing-estimate", "range", listing["earliest"], listing["latest"], _middle(listing["earliest"], listing["latest"])))


def resolve(status: Column, date: Column, listing: Column) -> Column:
    """The range to filter by: the exact one, else the listing's estimate."""
    return F.coalesce(exact_range(status, date), let(listing, _estimate))


def display_resolve(status: Column, date: Column, listing: Column) -> Column:
    """The range to show and sort by: an exact day is cut to the listing's range where they meet."""

    def of(x: Column) -> Column:
        exact, listed = x["exact"], x["listing"]
        earliest, latest = F.greatest(exact["earliest"], listed["earliest"]), F.least(exact["latest"], listed["latest"])
        meets = (exact["precision"] == "date") & listed.isNotNull() & (earliest <= latest)
        cut = _range("detail-date+listing-estimate", "range", earliest, latest, _middle(earliest, latest))
        return F.when(meets, cut).otherwise(F.coalesce(exact, _estimate(listed)))

    return let(F.struct(exact_range(status, date).alias("exact"), listing.alias("listing")), of)


def within_cutoff(now: float, amount: object, unit: str) -> float | None:
    try:
        n = float(amount)
    except (TypeError, ValueError):
        return None
    if not n > 0 or n == float("inf"):
        return None
    if unit in ("months", "years"):
        return shift_months_literal(now, -n * (12 if unit == "years" else 1))
    return now - n * UNITS[unit] if unit in UNITS else None


def _inside(r: Column, start: float, end: float) -> Column:
    return F.when((r["earliest"] >= start) & (r["latest"] <= end), True).when((r["latest"] < start) | (r["earliest"] > end), False)


def date_match(resolved: Column, operator: str, value: object, value_to: object = None, unit: str = "days", now: float = 0) -> Column:
    """TRUE, FALSE or null of a range; null for a null range."""
    return let(resolved, lambda r: _match(r, operator, value, value_to, unit, now))


def _match(r: Column, operator: str, value: object, value_to: object, unit: str, now: float) -> Column:
    wrong = F.when(r.isNotNull(), False)
    if operator == "within":
        cutoff = within_cutoff(now, value, unit)
        return wrong if cutoff is None else F.when(r["earliest"] >= cutoff, True).when(r["latest"] < cutoff, False)
    start = parse_date_literal(value)
    if start is None:
        return wrong
    if operator == "on":
        return _inside(r, start, start + DAY - 1)
    if operator == "after":
        return F.when(r["earliest"] > start + DAY - 1, True).when(r["latest"] <= start + DAY - 1, False)
    if operator == "before":
        return F.when(r["latest"] < start, True).when(r["earliest"] >= start, False)
    end = parse_date_literal(value_to)
    return wrong if operator != "between" or end is None else _inside(r, start, end + DAY - 1)


def _ago(n: Column, unit: str) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, f" {unit} ago").otherwise(f" {unit}s ago"))


def format_age(ms: Column) -> Column:
    age = F.greatest(F.lit(0.0), ms.cast("double"))
    n = lambda size: F.greatest(F.lit(1).cast("long"), F.floor(age / size))
    return (
        F.when(age < HOUR, "less than 1 hour ago").when(age < DAY, _ago(n(HOUR), "hour")).when(age < 7 * DAY, _ago(n(DAY), "day"))
        .when(age < 4 * WEEK, _ago(n(WEEK), "week")).when(age < 12 * MONTH_ABOUT, _ago(n(MONTH_ABOUT), "month")).otherwise(_ago(n(YEAR_ABOUT), "year"))
    )


def format_range(r: Column, now: int) -> Column:
    """Age text of a range; a day's age counts in days of the calendar."""
    today = now // DAY * DAY
    days = F.greatest(F.lit(0).cast("long"), F.floor((F.lit(today) - r["earliest"]) / DAY))
    of_day = F.when(days == 0, "Today").when(days < 7, _ago(days, "day")).when(days < 28, _ago(F.greatest(F.lit(1).cast("long"), F.floor(days / 7)), "week")).otherwise(format_age(F.greatest(F.lit(today) - r["earliest"], F.lit(4 * WEEK))))
    return F.when(r["precision"] == "date", of_day).when(r.isNotNull(), format_age(F.lit(now) - r["sort"]))


def normalize_exact_date(c: Column) -> Column:
    """A date text of a page as YYYY-MM-DD or an ISO instant; relative and unreadable texts are null."""
    text = clean_text(c)
    relative = F.lower(text).rlike(r"\bago\b|\byesterday\b|\btoday\b|just now")
    named = F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in ("MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy")))
    instant = F.when(text.rlike(r"T\d{2}:\d{2}.*(Z|[+-]\d{2}:?\d{2})\z"), parse_instant(text))
    iso = F.date_format(F.timestamp_millis(instant), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return F.when(~relative, F.coalesce(F.when(parse_date(text).isNotNull(), text), iso, F.date_format(named, "yyyy-MM-dd")))
