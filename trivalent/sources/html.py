"""HTML pages as rows: listing cards, details, members.

Python reads the tags of a page and picks texts and attributes by a ``Layout``, which names the classes of a site; all
parsing of the texts is Column functions.  Pages are rows (page_number or id, url, html), read batch by batch and
independent of each other; a page that cannot be read is a row with a reason.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import parser, unescape
from html.parser import HTMLParser

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, numbers, urls
from ..functions.text import clean_text, plain_text, readable_text, unique_ci
from .scratch import written

_EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Lazy-loading attributes of an image, best first, and those that its second picture is taken from first.
IMAGE_ATTRIBUTES = ("data-webp", "data-src", "data-original", "data-lazy-src", "data-source", "data-thumb", "data-srcset", "srcset")
SECOND_ATTRIBUTES = ("data-original", "src")
MOST_FORMATS = 20
#: Characters and rows of pages whose rows are made at once.
PIECE_BYTES, PIECE_ROWS = 2 << 20, 256


@dataclass(frozen=True)
class Layout:
    """Where things are: class names, path words, hosts, words of labels."""

    grid: str = "items"
    card: str = "item"
    ad: str = "ad"
    title: str = "title"
    duration: str = "time"
    added: str = "added"
    rating: str = "rating"
    views: str = "views"
    hd: str = "hd"
    pagination: str = "pagination"
    kind: str = "video"
    origin: str = "https://example.com"
    hosts: tuple[str, ...] = ("example.com", "www.example.com")
    member_items: str = "members"
    total: str = "total_results"
    labels: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"artist": ("artist", "artists"), "categories": ("category", "categories"), "tags": ("tag", "tags")})
    segments: dict[str, str] = field(default_factory=lambda: {"artist": "models", "categories": "categories", "tags": "tags"})
    challenge: str = r"(?i)log ?in|sign ?in|captcha|just a moment|access denied|verify you are human"


class Node:
    __slots__ = ("tag", "attrs", "children", "parent", "classes", "label", "order", "at", "size")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None, classes: tuple[str, ...] = ()):
        self.tag, self.attrs, self.parent, self.children, self.classes, self.label = tag, attrs, parent, [], classes, None

    def walk(self) -> list[Node]:
        """The node and all in it, in the order of the page."""
        return self.order[self.at : self.at + self.size]

    def all(self, test) -> list[Node]:
        return [n for n in self.walk()[1:] if test(n)]

    def first(self, test) -> Node | None:
        return next((n for n in self.walk()[1:] if test(n)), None)

    def has(self, name: str) -> bool:
        return name in self.classes

    @property
    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            else:
                stack.extend(reversed(n.children))
        return " ".join("".join(out).split())


def _ordered(order: list[Node]) -> Node:
    """The first of a page's nodes in order, each with its place in it and with how many are in it."""
    for k, n in enumerate(order):
        n.order, n.at, n.size = order, k, 1
    for n in order[:0:-1]:
        n.parent.size += n.size
    return order[0]


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.at = Node("#", {}, None)
        self.order = [self.at]

    def handle_starttag(self, tag, attrs):
        own = {k: v or "" for k, v in attrs}
        n = Node(tag, own, self.at, tuple(own.get("class", "").split()))
        self.at.children.append(n)
        self.order.append(n)
        if tag not in _EMPTY:
            self.at = n

    def handle_endtag(self, tag):
        n = self.at
        while n.parent is not None and n.tag != tag:
            n = n.parent
        if n.parent is not None:
            self.at = n.parent

    def handle_data(self, data):
        self.at.children.append(data)


_ATTRIBUTE = r'[ \t\n\r\f]+([a-zA-Z][a-zA-Z0-9_-]*)(?:="([^"]*)")?'
_START = re.compile(rf'([a-zA-Z][a-zA-Z0-9]*)((?:{_ATTRIBUTE.replace("(", "(?:").replace("(?:?:", "(?:")})*)[ \t\n\r\f]*(/?)')
_END = re.compile(r"/([a-zA-Z][a-zA-Z0-9]*)[ \t\n\r\f]*")
_EACH = re.compile(_ATTRIBUTE)
#: Elements whose content is text: as it is, or with references.
_RAW, _ESCAPABLE = ("script", "style"), ("title", "textarea")
_OTHER = frozenset("iframe noembed noframes xmp plaintext noscript".split())
_attribute_value = getattr(parser, "_unescape_attrvalue", unescape)


@lru_cache(maxsize=4096)
def _start(part: str) -> tuple[str, dict[str, str], tuple[str, ...], bool] | None:
    """tag, attributes, classes, whether it closes itself, of what lies between < and >; none where that isn't plain."""
    m = _START.fullmatch(part)
    if m is None or (tag := m[1].lower()) in _OTHER:
        return None
    attrs = {k.lower(): _attribute_value(v) if "&" in v else v for k, v in _EACH.findall(m[2])} if m[2] else {}
    return tag, attrs, tuple(attrs["class"].split()) if "class" in attrs else (), m[3] == "/"


def _plain(html: str) -> Node | None:
    """The tree of a page of plain tags, quoted attributes and text, as the parser would make it; none for any other page."""
    root = at = Node("#", {}, None)
    order = [root]
    text, *parts = html.split("<")
    if text:
        root.children.append(unescape(text) if "&" in text else text)
    inside = None  # of an element whose content is text
    for piece in parts:
        part, closed, text = piece.partition(">")
        if not closed:
            return None
        if part[:1] == "/":
            m = _END.fullmatch(part)
            if m is None:
                return None
            tag = m[1].lower()
            if inside is not None and tag != inside:
                return None
            inside, n = None, at
            while n.parent is not None and n.tag != tag:
                n = n.parent
            if n.parent is not None:
                at = n.parent
        else:
            got = _start(part)
            if got is None or inside is not None:
                return None
            tag, attrs, classes, empty = got
            n = Node(tag, attrs, at, classes)
            at.children.append(n)
            order.append(n)
            if tag in _RAW or tag in _ESCAPABLE:
                if empty:
                    return None
                inside = tag
            if tag in _EMPTY:
                if empty and any(x.tag == tag for x in _above(at)):
                    return None
            elif not empty:
                at = n
        if text:
            at.children.append(unescape(text) if "&" in text and inside not in _RAW else text)
    return _ordered(order) if inside is None else None


def _above(n: Node | None) -> Iterator[Node]:
    while n is not None:
        yield n
        n = n.parent


def read(html: str | None) -> Node:
    """The tree of a page.  Plain pages, which most are, are cut at their tags; the others go through the parser."""
    root = _plain(html or "")
    return _parsed(html) if root is None else root


def _parsed(html: str | None) -> Node:
    r = _Reader()
    r.feed(html or "")
    r.close()
    return _ordered(r.order)


def pieces(batches: Iterator[pa.RecordBatch], column: str = "html") -> Iterator[pa.RecordBatch]:
    """Batches with a column of pages in parts of bounded size, so that a worker holds the trees and rows of few pages."""
    for b in batches:
        if b.num_rows:
            each = max(1, (pc.sum(pc.binary_length(b.column(column))).as_py() or 0) // b.num_rows)
            step = max(1, min(PIECE_ROWS, PIECE_BYTES // each))
            for k in range(0, b.num_rows, step):
                yield b.slice(k, step)


def _record(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def by_class(name: str):
    return lambda n: n.has(name)


def _text(n: Node | None) -> str | None:
    return (n.text or None) if n is not None else None


def _is_link(layout: Layout):
    return lambda n: n.tag == "a" and re.search(rf"/{layout.kind}s?/", n.attrs.get("href", "")) is not None


def cards(grid: Node, layout: Layout) -> list[Node]:
    """Direct children that are cards, no ads, and have an item's link."""
    return [c for c in grid.children if isinstance(c, Node) and c.has(layout.card) and not c.has(layout.ad) and c.first(_is_link(layout))]


def challenged(root: Node, layout: Layout) -> bool:
    title, body = root.first(lambda n: n.tag == "title"), root.first(lambda n: n.tag == "body")
    seen = f"{_text(title) or ''} {(_text(body) or '')[:2000]}"
    password = root.first(lambda n: n.tag == "input" and n.attrs.get("type") == "password")
    return re.search(layout.challenge, _text(title) or "") is not None or (password is not None and re.search(layout.challenge, seen) is not None)


def _page_numbers(root: Node, layout: Layout) -> list[int]:
    bar = root.first(by_class(layout.pagination))
    found = [re.search(r"(?:^|[;?&])from[:=]?(\d+)", a.attrs.get("data-parameters", "")) for a in (bar.all(lambda n: n.tag == "a") if bar else [])]
    return [int(m[1]) for m in found if m]


_CARDS = "page_number int, position int, reason string, raw_id string, href string, title string, duration string, added string, rating string, views string, hd boolean, preview string, images array<string>"
_CARD_TYPES = pa.schema([(x.split()[0], {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}[x.split()[1]]) for x in _CARDS.split(", ")])


def raw_cards(pages: DataFrame, layout: Layout) -> DataFrame:
    """The texts of every card; a page without a grid, or that asks to sign in, is one row with a reason."""

    is_link = _is_link(layout)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            rows = []
            for number, html in zip(b.column("page_number").to_pylist(), b.column("html").to_pylist(), strict=True):
                root = read(html)
                grid = root.first(by_class(layout.grid))
                if grid is None:
                    rows.append((number, -1, "sign-in" if challenged(root, layout) else "no-grid", *[None] * 7, False, None, []))
                    continue
                for k, c in enumerate(cards(grid, layout)):
                    inner = c.walk()[1:]
                    one = lambda test, inner=inner: next((n for n in inner if test(n)), None)
                    named = lambda name, inner=inner: next((n for n in inner if name in n.classes), None)
                    link, image, title = one(is_link), one(lambda n: n.tag == "img"), named(layout.title)
                    own = next((n.attrs[a] for n in (c, link) for a in ("data-video-id", "data-id") if n.attrs.get(a)), None)
                    shown = (title.attrs.get("title") if title is not None else None) or _text(title) or link.attrs.get("title") or _text(link)
                    preview = one(lambda n: bool(n.attrs.get("data-preview")))
                    sources = [image.attrs.get(a) for a in (*IMAGE_ATTRIBUTES, "src")] if image is not None else []
                    texts = (_text(named(name)) for name in (layout.duration, layout.added, layout.rating, layout.views))
                    rows.append((number, k, None, own, link.attrs.get("href"), shown, *texts, named(layout.hd) is not None, preview.attrs["data-preview"] if preview is not None else None, sources))
            yield _record(rows, _CARD_TYPES)

    return pages.select(F.col("page_number").cast("int"), "html").mapInArrow(run, _CARDS)


def listing(pages: DataFrame, layout: Layout, observed_at: int) -> DataFrame:
    """Video rows of listing pages, with ``reason`` where a card or page could not be read.

    A card's addresses are resolved once, as a column of which the others pick.
    """
    raw = raw_cards(pages, layout)
    url = lambda c: urls.resolve(c, layout.origin)
    lists = [i for i, a in enumerate(IMAGE_ATTRIBUTES) if "srcset" in a]
    raw = raw.withColumn("resolved", F.transform("images", lambda u, i: F.when(u.isNotNull(), url(F.when(i.isin(lists), urls.first_of_srcset(u)).otherwise(u)))))
    resolved, n = F.col("resolved"), len(IMAGE_ATTRIBUTES)
    preferred = F.get(F.filter(F.slice(resolved, 1, n), lambda u: u.isNotNull()), F.lit(0))
    second = [F.get(resolved, F.lit([*IMAGE_ATTRIBUTES, "src"].index(a))) for a in SECOND_ATTRIBUTES]
    sources = F.filter(F.concat(F.array(*second), F.slice(resolved, 1, n)), lambda u: u.isNotNull())
    range_ = dates.relative_range(F.col("added"), F.lit(observed_at))
    video_id = F.coalesce(urls.item_id(F.col("raw_id"), layout.kind), urls.item_id(F.col("href"), layout.kind))
    rated = r"(?i)(\d{1,3}(?:\.\d+)?\s*%)\s*(?:\(\s*([\d,.kmb]+)\s*\))?"
    rows = raw.withColumn("range", range_).withColumn("preferred", preferred).withColumn("sources", sources).withColumn("video_id", video_id)
    return rows.select(
        "video_id", url(F.col("href")).alias("url"), clean_text(F.col("title")).alias("title"), numbers.duration_seconds(F.col("duration")).alias("duration_sec"),
        F.coalesce("preferred", F.get("sources", F.lit(0))).alias("thumbnail_url"), F.col("preferred").alias("thumbnail_preferred_url"),
        F.get(F.filter("sources", lambda u: ~u.eqNullSafe(F.col("preferred"))), F.lit(0)).alias("thumbnail_fallback_url"), url(F.col("preview")).alias("preview_url"),
        F.col("hd").alias("hd_available"), clean_text(F.col("added")).alias("relative_upload_text"), F.lit(observed_at).cast("long").alias("relative_upload_observed_at"),
        F.col("range.earliest").alias("listing_upload_earliest_at"), F.col("range.latest").alias("listing_upload_latest_at"), F.col("range.unit").alias("listing_upload_unit"), F.col("range.amount").alias("listing_upload_amount"),
        numbers.percentage(F.nullif(F.regexp_extract("rating", rated, 1), F.lit(""))).alias("rating_percent"), numbers.compact_number(F.nullif(F.regexp_extract("rating", rated, 2), F.lit(""))).alias("rating_votes"),
        numbers.compact_number(F.col("views")).alias("views"), F.col("page_number").alias("native_page"), (F.col("position") + 1).alias("native_order"),
        F.coalesce("reason", F.when(video_id.isNull() | F.col("href").isNull(), "missing-identity")).alias("reason"),
    )


def page_report(rows: DataFrame) -> DataFrame:
    """native_page, cards, failed, repeated, class: what a page's cards say of it."""
    g = rows.groupBy("native_page").agg(
        F.count_if(F.col("native_order") > 0).alias("cards"), F.count_if(F.col("reason").isNotNull()).alias("failed"),
        F.count_if((F.col("native_order") == 0) & (F.col("reason").isNotNull())).alias("unread"), (F.count("video_id") - F.count_distinct("video_id")).alias("repeated"),
    )
    return g.select("native_page", "cards", "failed", "repeated", F.when(F.col("unread") > 0, "missing-grid").when(F.col("failed") > 0, "partial-identity").otherwise("ok").alias("class"))


_FEED_TYPES = pa.schema([("page_number", pa.int32()), ("grid", pa.bool_()), ("cards", pa.int32()), ("headings", pa.string()), ("declared", pa.int64()), ("last", pa.int64())])


def feed(pages: DataFrame, layout: Layout, title: str = r"items?") -> DataFrame:
    """page_number, grid, cards, total, capacity, page_count: what a listing page says of the whole feed."""

    def run(batches):
        for b in pieces(batches):
            rows = []
            for number, html in zip(b.column("page_number").to_pylist(), b.column("html").to_pylist(), strict=True):
                root = read(html)
                grid = root.first(by_class(layout.grid))
                n = len(cards(grid, layout)) if grid is not None else 0
                declared = next((int(v) for a in ("data-per-page", "data-page-size", "data-items-per-page") if grid is not None and (v := grid.attrs.get(a, "")).isdigit() and int(v)), None)
                headings = " | ".join(h.text for h in root.all(lambda x: re.fullmatch("h[1-6]", x.tag) is not None))
                seen = _page_numbers(root, layout)
                rows.append((number, grid is not None, n, headings, declared, max(seen, default=None)))
            yield _record(rows, _FEED_TYPES)

    raw = pages.select(F.col("page_number").cast("int"), "html").mapInArrow(run, "page_number int, grid boolean, cards int, headings string, declared long, last long")
    total = numbers.native_total(F.col("headings"), title)
    capacity = F.coalesce("declared", F.when((F.col("page_number") < F.col("last")) & (F.col("cards") > 0), F.col("cards").cast("long")))
    out = raw.select("page_number", "grid", "cards", total.alias("total"), capacity.alias("capacity"), "last")
    # a paginator's evidence goes before arithmetic
    return out.select("page_number", "grid", "cards", "total", "capacity", F.coalesce("last", numbers.page_count(F.col("total"), F.col("capacity"))).alias("page_count"))


def terminal_empty(feed_row: DataFrame, known_pages: int) -> DataFrame:
    """Pages that end a feed: a grid without cards, after the first page and the known ones."""
    return feed_row.where(F.col("grid") & (F.col("cards") == 0) & (F.col("page_number") > 1) & (F.col("page_number") > known_pages))


def _label(n: Node) -> str:
    if n.label is None:
        own = next((c for c in n.children if isinstance(c, Node) and (c.has("label") or c.tag in ("strong", "dt"))), None)
        n.label = own.text.rstrip(":").strip().lower() if own is not None else ""
    return n.label


def _entities(root: Node, layout: Layout, item: str, name: str) -> tuple[bool, list[tuple[str, str]]]:
    """(whether the structure can be trusted, (url, text) of its links): only containers of this item with the right label count."""
    segment = layout.segments[name]
    ours = lambda n: n.attrs.get("data-video-id", item) == item
    boxes = [n for n in root.walk() if "data-video-id" in n.attrs and n.attrs["data-video-id"] == item and _label(n) in layout.labels[name]]
    links, bad = [], 0
    for box in boxes:
        for chip in box.all(lambda n: "data-item-type" in n.attrs and n.attrs.get("data-status") != "pending"):
            good = [a for a in [chip, *chip.all(lambda n: True)] if a.tag == "a" and re.search(rf"^(?:https?://[^/]+)?/{segment}/[^/]+/?$", a.attrs.get("href", ""), re.I)]
            bad += not (ours(chip) and good)
            links += [(a.attrs["href"], (_text(a.first(by_class("name"))) or a.text)) for a in good if ours(chip)]
    return bool(boxes) and not bad, list(dict(links).items())


def _inside(n: Node, box: Node) -> bool:
    at: Node | None = n
    while at is not None and at is not box:
        at = at.parent
    return at is box


def region(root: Node, layout: Layout, item: str) -> Node:
    """The smallest part of a page that has all entity boxes of the item and a column of uploaders or downloads; else the
    smallest that has the boxes; the whole page without boxes."""
    words = {w for labels in layout.labels.values() for w in labels}
    boxes = [n for n in root.walk() if "data-video-id" in n.attrs and n.attrs["data-video-id"] == item and _label(n) in words]
    found = None
    at = boxes[0].parent if boxes else None
    while at is not None and at.tag not in ("body", "html", "#"):
        if all(_inside(b, at) for b in boxes):
            found = found or at
            if at.first(lambda n: _label(n) in ("uploaded by", "download")):
                return at
        at = at.parent
    return found or root


def _uploaders(part: Node, layout: Layout, item: str) -> list[str]:
    """Texts of links to members on the site's hosts, in columns that are of this item or of none."""
    out = []
    for column in part.all(lambda n: _label(n) == "uploaded by"):
        owner: Node | None = column
        while owner is not None and "data-video-id" not in owner.attrs:
            owner = owner.parent
        if owner is not None and owner.attrs["data-video-id"] != item:
            continue
        hosts = "|".join(map(re.escape, layout.hosts))
        out += [a.text for a in column.all(lambda n: n.tag == "a") if re.fullmatch(rf"(?:https?://(?:{hosts}))?/(?:members|users)/\d+/?(?:[?#].*)?", a.attrs.get("href", ""), re.I)]
    return list(dict.fromkeys(x for x in out if x))


def _visible(n: Node) -> bool:
    at: Node | None = n
    while at is not None:
        if "hidden" in at.attrs or at.has("hidden") or re.search(r"display\s*:\s*none", at.attrs.get("style", "")):
            return False
        at = at.parent
    return True


def _favorite(root: Node) -> bool | None:
    """Whether a visible control takes the item away from the favourites, or adds it; null without one."""
    shown = {name for name in ("remove-favourite", "add-favourite") if any(_visible(n) for n in root.all(by_class(name)))}
    return True if "remove-favourite" in shown else False if shown else None


_DETAIL = "video_id string, reason string, json_ld array<string>, description string, uploaders array<string>, formats array<string>, labels map<string,array<string>>, favorite boolean, comments string, trust array<boolean>, links array<array<struct<url:string,name:string>>>"
_TEXTS = pa.list_(pa.string())
_DETAIL_TYPES = pa.schema([
    ("video_id", pa.string()), ("reason", pa.string()), ("json_ld", _TEXTS), ("description", pa.string()), ("uploaders", _TEXTS), ("formats", _TEXTS), ("labels", pa.map_(pa.string(), _TEXTS)),
    ("favorite", pa.bool_()), ("comments", pa.string()), ("trust", pa.list_(pa.bool_())), ("links", pa.list_(pa.list_(pa.struct([("url", pa.string()), ("name", pa.string())])))),
])


def raw_details(pages: DataFrame, layout: Layout) -> DataFrame:
    """The texts of detail pages; pages: video_id, html."""
    names = ("artist", "tags", "categories")

    def run(batches):
        for b in pieces(batches):
            rows = []
            for item, html in zip(b.column("video_id").to_pylist(), b.column("html").to_pylist(), strict=True):
                root = read(html)
                if challenged(root, layout):
                    rows.append((item, "sign-in", [], None, [], [], [], None, None, [], []))
                    continue
                scripts = ["".join(c for c in n.children if isinstance(c, str)) for n in root.all(lambda n: n.tag == "script" and n.attrs.get("type") == "application/ld+json")]
                found = [_entities(root, layout, item, n) for n in names]
                labels: dict[str, list[str]] = {}
                for n in root.walk():
                    if (k := _label(n)) and len(k) <= 40:
                        labels.setdefault(k, []).extend(c.text for c in n.children if isinstance(c, Node) and not (c.has("label") or c.tag in ("strong", "dt")) and c.text)
                part = region(root, layout, item)
                uploaders = _uploaders(part, layout, item)
                formats = [a.text for a in part.all(by_class("tag_item_download"))]
                body = root.first(by_class("description"))
                tab = root.first(lambda n: n.tag == "a" and n.attrs.get("href", "").endswith("#tab_comments"))
                rows.append((item, None, scripts, _text(body), uploaders, formats, list(labels.items()), _favorite(root), _text(tab), [t for t, _ in found], [[{"url": u, "name": n} for u, n in links] for _, links in found]))
            yield _record(rows, _DETAIL_TYPES)

    return pages.select("video_id", "html").mapInArrow(run, _DETAIL)


def json_ld(rows: DataFrame) -> DataFrame:
    """video_id, object: all objects of a page's JSON-LD scripts and of their @graph; what is no JSON is passed over."""
    one = rows.select("video_id", F.explode("json_ld").alias("text")).select("video_id", F.try_parse_json("text").alias("v")).where("v is not null")
    top = one.select("video_id", F.explode(F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.array("v"))).alias("o"))
    inner = F.coalesce(F.try_variant_get("o", "$['@graph']", "array<variant>"), F.array().cast("array<variant>"))
    return top.select("video_id", F.explode(F.concat(F.array("o"), inner)).alias("object"))


def json_text(v: Column) -> Column:
    """A text of JSON-LD: a string, or the name of an object."""
    return clean_text(F.coalesce(F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")), F.try_variant_get(v, "$.name", "string")))


def json_values(v: Column) -> Column:
    """A list of JSON-LD: strings are parted at commas, objects give their names; null values are left out."""
    items = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))
    parted = lambda x: F.when(F.schema_of_variant(x) == "STRING", F.split(F.try_variant_get(x, "$", "string"), ",")).otherwise(F.array(json_text(x)))
    return unique_ci(F.filter(F.transform(F.flatten(F.transform(items, parted)), clean_text), lambda t: t.isNotNull()))


def json_comments(v: Column) -> Column:
    """Comments of an object: its commentCount, else the count of an interaction statistic of that kind."""
    one = F.try_variant_get(v, "$.interactionStatistic", "variant")
    stats = F.coalesce(F.try_variant_get(one, "$", "array<variant>"), F.array(one))
    kind = lambda x: F.coalesce(F.try_variant_get(x, "$.interactionType['@type']", "string"), F.try_variant_get(x, "$.interactionType", "string"))
    counts = F.transform(F.filter(stats, lambda x: kind(x).rlike("(?i)comment")), lambda x: F.try_variant_get(x, "$.userInteractionCount", "long"))
    return F.coalesce(F.try_variant_get(v, "$.commentCount", "long"), F.get(F.filter(counts, lambda n: n >= 0), F.lit(0)))


def comments_of_tab(c: Column) -> Column:
    """The number in parentheses of a tab's text."""
    return F.replace(F.regexp_extract(c, r"\(\s*([0-9,]+)\s*\)", 1), F.lit(","), F.lit("")).try_cast("long")


def details(pages: DataFrame, layout: Layout, now: int) -> DataFrame:
    """Detail rows; ``reason`` says why a page gives none: no entity structure that can be trusted is a failure.

    What the pages say is written first: it is read for the rows and for their JSON-LD, and pages are parsed once.
    """
    raw = written(raw_details(pages, layout), "details")
    got = lambda path: F.try_variant_get("object", path, "string")
    item = json_ld(raw).where(got("$['@type']") == "VideoObject").groupBy("video_id").agg(
        F.min(dates.normalize_exact_date(got("$.uploadDate"))).alias("exact_upload_date"), F.max(got("$.description")).alias("ld_description"),
        F.max(json_comments(F.col("object"))).alias("ld_comments"), F.max(json_values(F.try_variant_get("object", "$.keywords", "variant"))).alias("keywords"), F.max(json_text(F.try_variant_get("object", "$.author", "variant"))).alias("author"),
    )
    links = lambda k: F.coalesce(F.get("links", F.lit(k)), F.array().cast("array<struct<url:string,name:string>>"))
    named = lambda k: F.array_distinct(F.filter(F.transform(links(k), lambda x: clean_text(x["name"])), lambda v: v.isNotNull()))
    trusted = lambda k: F.coalesce(F.get("trust", F.lit(k)), F.lit(False))
    refs = F.filter(F.transform(links(0), lambda x: urls.entity_ref(x["url"], x["name"], layout.origin, layout.hosts, layout.segments["artist"])), lambda r: r.isNotNull())
    text = lambda t, pattern: F.nullif(F.lower(F.regexp_extract(t, pattern, 1)), F.lit(""))
    format_ = lambda t: F.struct(F.lit(None).cast("string").alias("name"), text(t, r"(?i)^\s*([a-z0-9][a-z0-9._+-]*)\b").alias("format"), F.lit(None).cast("string").alias("quality"), text(t, r"(?i)\b(\d{3,5}p)\b").alias("resolution"))
    any_ = trusted(0) | trusted(1) | trusted(2) | (F.size("uploaders") > 0)
    reason = F.coalesce("reason", F.when(~any_, "unexpected-structure"))
    return raw.join(item, "video_id", "left").select(
        "video_id", F.when(reason.isNull(), "complete").otherwise("failed").alias("status"), F.lit(6).alias("schema_version"),
        F.struct(trusted(0).alias("artist"), (F.size("uploaders") > 0).alias("uploader"), trusted(1).alias("tags"), trusted(2).alias("categories")).alias("entity_trust"),
        F.get(named(0), F.lit(0)).alias("artist"), F.get("uploaders", F.lit(0)).alias("uploader"), named(0).alias("artists"), F.array_distinct("uploaders").alias("uploaders"),
        named(1).alias("tags"), named(2).alias("categories"), refs.alias("artist_refs"), F.coalesce(readable_text(F.col("description")), readable_text(plain_text(F.col("ld_description")))).alias("description"),
        "exact_upload_date", F.coalesce("ld_comments", comments_of_tab(F.col("comments"))).alias("comments_count"), F.slice(F.array_distinct(F.transform("formats", format_)), 1, MOST_FORMATS).alias("formats"), F.lit(now).cast("long").alias("fetched_at"), "favorite", "keywords", "author", reason.alias("reason"),
    )


def favorite_changes(details_: DataFrame, seq: int) -> DataFrame:
    """Changes of an id set (see ``merging.change_ids``) from what pages showed; a page that showed nothing changes nothing."""
    return details_.where("favorite is not null").select("video_id", F.when(F.col("favorite"), "add").otherwise("remove").alias("action"), F.lit(seq).cast("long").alias("seq"))


_MEMBER_TYPES = pa.schema([("page_number", pa.int32()), ("total", pa.int64()), ("href", pa.string()), ("text", pa.string())])


def membership(pages: DataFrame, layout: Layout) -> DataFrame:
    """page_number, total, key, name, url: a member a row; a page without the block is one row with a null key."""

    def run(batches):
        for b in pieces(batches):
            rows = []
            for number, html in zip(b.column("page_number").to_pylist(), b.column("html").to_pylist(), strict=True):
                root = read(html)
                block = root.first(by_class(layout.member_items))
                total = re.sub(r"\D", "", _text(root.first(by_class(layout.total))) or "")
                links = block.all(lambda n: n.tag == "a" and f"/{layout.segments['artist']}/" in n.attrs.get("href", "")) if block is not None else []
                found = [(number, int(total) if total else None, a.attrs["href"], _text(a.first(by_class("name"))) or a.text) for a in links]
                rows += found or [(number, int(total) if total else None, None, None)]
            yield _record(rows, _MEMBER_TYPES)

    raw = pages.select(F.col("page_number").cast("int"), "html").mapInArrow(run, "page_number int, total long, href string, text string")
    ref = urls.entity_ref(F.col("href"), F.col("text"), layout.origin, layout.hosts, layout.segments["artist"])
    return raw.withColumn("ref", ref).select("page_number", "total", "ref.key", "ref.name", "ref.url")


def member_snapshot(rows: DataFrame, pages: int) -> tuple[DataFrame | None, str]:
    """(members, reason): a snapshot is all or nothing. With a total, the distinct keys must be as many; without, no page may be empty."""
    s = rows.agg(F.count_distinct("page_number").alias("pages"), F.max("total").alias("total"), F.count_distinct("key").alias("keys")).first()
    empty = rows.groupBy("page_number").agg(F.count("key").alias("n")).where("n = 0").limit(1).count()
    if s["pages"] != pages:
        return None, "pages-missing"
    if s["total"] is not None and s["keys"] != s["total"]:
        return None, "total-mismatch"
    if s["total"] is None and empty:
        return None, "empty-page"
    return rows.where("key is not null").groupBy("key").agg(F.min(F.struct("page_number", "name", "url")).alias("x")).select("key", "x.name", "x.url").orderBy("name", "key"), "complete"


def signature(members: DataFrame) -> DataFrame:
    """One row: a digest of the set of keys, whatever their order."""
    return members.agg(F.count_distinct("key").alias("n"), F.sum(F.xxhash64("key").cast("decimal(38,0)")).alias("digest"))


_LINK_TYPES = pa.schema([("page_title", pa.string()), ("n_links", pa.int32()), ("paragraphs", pa.int32())])


def links(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Rows of any HTML table with ``page_title``, ``n_links`` and ``paragraphs``: the base of a listing of plain pages."""
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema)

    def run(batches):
        for b in pieces(batches, html_col):
            rows = []
            for h in b.column(html_col).to_pylist():
                nodes = read(h).walk()
                rows.append((_text(next((n for n in nodes if n.tag == "title"), None)), sum(n.tag == "a" and "href" in n.attrs for n in nodes), sum(n.tag == "p" for n in nodes)))
            told = _record(rows, _LINK_TYPES)
            yield pa.RecordBatch.from_arrays([*b.columns, *told.columns], [*b.schema.names, *told.schema.names])

    return pages.mapInArrow(run, f"{kind}, page_title string, n_links int, paragraphs int")
