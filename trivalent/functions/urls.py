"""URLs of items: identity, resolution, parameters. Hosts and path words are configuration."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let
from .text import clean_text, quoted


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def item_id(c: Column, kind: str = "video") -> Column:
    """Digits; or ``id=digits`` where there is no path; or the number in /kind/digits or /kinds/digits of a URL."""
    of = lambda t: (
        F.when(t.rlike(r"\A[0-9]+\z"), t)
        .when(~t.rlike("[/:]") & t.rlike(rf"(?i)(?:{kind}[_-]?)?id=[0-9]+"), F.regexp_extract(t, rf"(?i)(?:{kind}[_-]?id|id)=([0-9]+)", 1))
        .otherwise(F.nullif(F.regexp_extract(t, rf"(?i)\A(?:https?://[^/?#]+)?/{kind}s?/([0-9]+)(?:[/?#]|\z)", 1), F.lit("")))
    )
    return let(F.trim(c), of)


def identity(url: Column, video_id: Column, hosts: tuple[str, ...], kind: str = "video") -> Column:
    """struct<ok, reason, id, url>: whether a URL is of an allowed host and names the id; its fragment goes."""

    def of(u: Column) -> Column:
        found = item_id(u, kind)
        reason = (
            F.when(u.isNull() | ~u.rlike(r"(?i)\Ahttps?://"), "not-http").when(~F.coalesce(host(u).isin(*hosts), F.lit(False)), "other-host")
            .when(found.isNull(), "no-id").when(video_id.isNotNull() & (found != video_id), "id-mismatch")
        )
        return F.struct(reason.isNull().alias("ok"), reason.alias("reason"), found.alias("id"), F.regexp_replace(u, "#.*", "").alias("url"))

    return let(F.trim(url), of)


def shape(url: Column) -> Column:
    """A URL with numbers and names of its path as signs, for counting kinds of URLs."""
    path = F.try_parse_url(url, F.lit("PATH"))
    return F.concat(F.coalesce(host(url), F.lit("-")), F.regexp_replace(F.regexp_replace(F.coalesce(path, F.lit("")), "[0-9]+", "#"), r"(?<=/#/)[^/]+", "*"))


def resolve(c: Column, origin: str) -> Column:
    """An absolute http(s) URL; rooted paths and names are taken from the origin; other schemes are null."""
    of = lambda u: (
        F.when(u.rlike(r"(?i)\Ahttps?://[^/]"), u)
        .when(u.startswith("//"), F.concat(F.lit(origin.split(":")[0] + ":"), u))
        .when(u.rlike(r"(?i)\A[a-z][a-z0-9+.-]*:"), None)
        .when(u.startswith("/"), F.concat(F.lit(origin.rstrip("/")), u))
        .when(u != "", F.concat(F.lit(origin.rstrip("/") + "/"), u))
    )
    return let(F.trim(c), of)


def first_url(candidates: list[Column], origin: str) -> Column:
    return F.coalesce(*(resolve(c, origin) for c in candidates))


def first_of_srcset(c: Column) -> Column:
    return F.split(F.trim(F.split(c, ",")[0]), r"\s+")[0]


def thumbnails(preferred: Column, fallback: Column, stored: Column, video_id: Column, template: str) -> Column:
    """Distinct usable URLs in order; without any, the template with the id ({id}) and its thousand ({group})."""
    given = F.array_distinct(F.filter(F.array(preferred, fallback, stored), lambda u: u.rlike(r"(?i)\Ahttps?://")))
    number = video_id.try_cast("long")
    made = F.replace(F.replace(F.lit(template), F.lit("{group}"), (F.floor(number / 1000) * 1000).cast("string")), F.lit("{id}"), video_id)
    return let(given, lambda g: F.when(F.size(g) > 0, g).when(number.isNotNull(), F.array(made)).otherwise(g))


def repaired(preferred: Column, fallback: Column, stored: Column, found: Column) -> Column:
    """found only where no stored URL is usable."""
    usable = lambda u: F.coalesce(u.rlike(r"(?i)\Ahttps?://"), F.lit(False))
    return F.when(~(usable(preferred) | usable(fallback) | usable(stored)) & usable(found), found).otherwise(stored)


def parameters(c: Column) -> Column:
    """map of ``k:v;k:v``; pairs with odd keys or values of over 200 characters go."""
    pairs = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda p: F.regexp_extract_all(p, F.lit(r"\A\s*([A-Za-z0-9_-]{1,64})\s*:(.{0,200})\z"), F.lit(0))), lambda x: F.size(x) > 0)
    entry = lambda x: F.struct(F.trim(F.substring_index(x[0], ":", 1)).alias("key"), F.trim(F.regexp_replace(x[0], r"\A[^:]*:", "")).alias("value"))
    last = F.aggregate(F.transform(pairs, entry), F.array().cast("array<struct<key:string,value:string>>"), lambda a, e: F.concat(F.filter(a, lambda o: o["key"] != e["key"]), F.array(e)))
    return F.map_from_entries(last)


def entity_ref(url: Column, name: Column, origin: str, hosts: tuple[str, ...], segment: str = "models") -> Column:
    """struct<key, name, url> of /segment/slug on an allowed host; null for others. The slug is the key, and the name if none is given."""

    def of(u: Column) -> Column:
        slug = F.nullif(F.lower(F.try_url_decode(F.regexp_extract(u, rf"(?i)\Ahttps?://[^/]+/{segment}/([^/?#]+)/?(?:[?#].*)?\z", 1))), F.lit(""))
        ok = host(u).isin(*hosts) & (F.length(slug) <= 200) & ~slug.rlike(r"[\s<>\"'\\]")
        made = F.struct(slug.alias("key"), F.coalesce(clean_text(name), F.replace(slug, F.lit("-"), F.lit(" "))).alias("name"), F.concat(F.lit(f"{origin.rstrip('/')}/{segment}/"), slug, F.lit("/")).alias("url"))
        return F.when(ok, made)

    return let(resolve(url, origin), of)


def page_from_text(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(?i)(?:^|[;?&])from[:=]?(\d+)", 1), F.lit("")).try_cast("int")


def page_url(base: str, page: Column, name: str = "from") -> Column:
    from .numbers import page_parameter

    return F.concat(F.lit(base + ("&" if "?" in base else "?") + name + "="), page_parameter(page))


def variants(url: Column, kind: str = "video") -> Column:
    """The URL and the same with the other number of its path word."""
    one, many = rf"/{quoted(kind)}/", rf"/{quoted(kind)}s/"
    return F.array_distinct(F.array(url, F.when(url.rlike(many), F.regexp_replace(url, many, f"/{kind}/")).otherwise(F.regexp_replace(url, one, f"/{kind}s/"))))
