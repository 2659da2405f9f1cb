"""Text functions and text predicates as Columns.

Predicates are TRUE or FALSE for every text and FALSE for null, as the listing's fields demand; UNKNOWN for
detail fields that are not available comes from the accessors in ``details``.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the catalogue's sources understand it.
SPACE = "[\\s\\u00A0\\uFEFF\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\u000B]"
#: Any character but the ends of lines.
ANY = "[^\\n\\r\\u2028\\u2029]"
WORD = r"[\p{L}\p{N}\p{M}_]"
#: Brackets whose contents are no title words.
BRACKETS = ("[]", "()", "{}", "【】", "〔〕", "［］", "（）", "｛｝", "\u2329\u232a", "〈〉", "《》", "「」", "『』", "〖〗", "〘〙", "〚〛", "⟦⟧", "⟨⟩", "<>")
OPTIONS = {"contains": ("caseSensitive", "wholeWord", "matchAnyWord", "separateByCommas")}
OPERATORS = ("contains", "equals", "startsWith", "endsWith", "wildcard", "regex")


def option_keys(operator: str) -> tuple[str, ...]:
    return OPTIONS.get(operator, ("caseSensitive",) if operator in OPERATORS else ())


def clean_text(c: Column) -> Column:
    """White space runs as one space, trimmed; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(c, f"{SPACE}+", " ")), F.lit(""))


def comma_terms(value: object) -> list[str]:
    return [t for t in (x.strip() for x in str("" if value is None else value).split(",")) if t]


def unique_ci(values: Column) -> Column:
    """Trimmed, without empties, the first spelling of each; order kept."""
    trimmed = F.filter(F.transform(values, lambda v: F.trim(F.coalesce(v, F.lit("")))), lambda v: v != "")
    have = lambda acc, v: F.exists(acc, lambda a: F.lower(a) == F.lower(v))
    return F.aggregate(trimmed, F.array().cast("array<string>"), lambda acc, v: F.when(have(acc, v), acc).otherwise(F.concat(acc, F.array(v))))


def quoted(text: str) -> str:
    """A pattern that matches the text itself."""
    return re.sub(r"([\\.^$|?*+()\[\]{}\-&~#])", r"\\\1", text)


def pattern_of_wildcard(needle: str) -> str:
    return r"\A" + "".join({"*": ANY + "*", "?": ANY}.get(c, quoted(c)) for c in needle) + r"\z"


def pattern_of_regex(value: str) -> str | None:
    """The same search for Java's engine; null where the pattern is wrong or means something else there."""
    out, i, inside = [], 0, False
    while i < len(value):
        c = value[i]
        if c == "\\":
            if i + 1 == len(value):
                return None
            n = value[i + 1]
            out.append({"s": SPACE, "S": "[^" + SPACE[1:], "/": "/", "-": r"\-"}.get(n, c + n) if not inside else {"s": SPACE[1:-1]}.get(n, c + n))
            i += 2
            continue
        if inside and c == "[":
            out.append(r"\[")
        elif inside and c == "&" and value[i : i + 2] == "&&":
            out.append(r"\&")
        elif c == "[" and value[i : i + 3] == "[^]":
            out.append(r"[\s\S]")
            i += 3
            continue
        elif c == "[" and value[i : i + 2] == "[]":
            out.append(r"[^\s\S]")
            i += 2
            continue
        elif c == "." and not inside:
            out.append(ANY)
        elif c == "$" and not inside:
            out.append(r"\z")
        elif c in "*+?}" and not inside and i + 1 < len(value) and value[i + 1] == "+":
            return None  # possessive in Java, an error at the source
        else:
            out.append(c)
        inside = (inside or c == "[") and c != "]"
        i += 1
    return "".join(out)


def valid_regex(value: str) -> bool:
    """Whether both engines take the pattern; tried with the JVM where one runs."""
    p = pattern_of_regex(value)
    if p is None:
        return False
    from pyspark import SparkContext

    sc = SparkContext._active_spark_context
    try:
        if sc is not None:
            sc._jvm.java.util.regex.Pattern.compile(p)
        else:
            re.compile(value)
    except Exception:  # noqa: BLE001  whatever the engine says of a wrong pattern
        return False
    return True


def whole_word(text: Column, needle: str) -> Column:
    """Some occurrence has no letter, digit, mark or underscore beside it; occurrences are taken from the left, not overlapping."""
    if not needle:
        # the empty needle stands between any two characters
        return text.rlike(rf"(?s)(?<!{WORD})(?!{WORD})")
    n = quoted(needle)
    if any(needle.startswith(needle[i:]) for i in range(1, len(needle))):
        return text.rlike(rf"(?s)\A(?:{n}|(?!{n}).)*?(?<!{WORD}){n}(?!{WORD})")
    return text.rlike(rf"(?<!{WORD}){n}(?!{WORD})")


def text_match(c: Column, operator: str, value: object, options: dict | None = None) -> Column:
    """TRUE or FALSE, never null."""
    options = options or {}
    value = "" if value is None else str(value)
    if operator == "contains" and options.get("separateByCommas"):
        inner = {**options, "separateByCommas": False}
        return reduce(lambda a, b: a | b, (text_match(c, operator, t, inner) for t in comma_terms(value)), F.lit(False))
    if operator in ("regex", "wildcard"):
        cased = bool(options.get("caseSensitive"))
        if operator == "regex" and not valid_regex(value):
            return F.lit(False)
        p = pattern_of_regex(value) if operator == "regex" else pattern_of_wildcard(value if cased else value.lower())
        return F.coalesce(c.rlike(("" if cased else "(?iu)") + p), F.lit(False))
    source, needle = (c, value) if options.get("caseSensitive") else (F.lower(c), value.lower())

    def part(n: str) -> Column:
        hit = source == n if operator == "equals" else source.startswith(n) if operator == "startsWith" else source.endswith(n) if operator == "endsWith" else source.contains(n)
        return hit & whole_word(source, n) if options.get("wholeWord") else hit

    parts = needle.split() if options.get("matchAnyWord") else [needle]
    return F.coalesce(reduce(lambda a, b: a | b, map(part, parts), F.lit(False)), F.lit(False))


#: What is a word of a title.
TITLE_WORD = r"[\p{L}\p{N}]+(?:['’_-][\p{L}\p{N}]+)*"


def title_words(title: Column) -> Column:
    """Distinct lower-case words of a title, without what is in brackets."""
    for a, b in BRACKETS:
        title = F.regexp_replace(title, rf"{quoted(a)}[^{quoted(b)}]*{quoted(b)}", " ")
    words = F.regexp_extract_all(F.lower(F.coalesce(title, F.lit(""))), F.lit(TITLE_WORD), F.lit(0))
    return F.array_distinct(words)


def utf16_length(c: Column) -> Column:
    return (F.octet_length(F.encode(c, "UTF-16LE")) / 2).cast("long")


def plain_text(c: Column) -> Column:
    """Text of a piece of HTML: breaks and paragraph ends are lines, other tags go, common entities are read."""
    c = F.regexp_replace(c, r"(?i)<br\s*/?>|</p>", "\n")
    c = F.regexp_replace(c, r"<[^>]*>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def readable_text(c: Column) -> Column:
    """Lines trimmed and space-collapsed, at most one empty line in a row; null if nothing is left."""
    c = F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), "[ \t\f\u00A0]+", " ")
    c = F.regexp_replace(F.regexp_replace(c, r" ?\n ?", "\n"), r"\n{3,}", "\n\n")
    return F.nullif(F.regexp_replace(c, r"\A\s+|\s+\z", ""), F.lit(""))
