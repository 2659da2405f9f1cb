"""The short way of reading plain pages against the parser, and pages that are parsed once and held few at a time."""

import itertools

import pyarrow as pa

from trivalent.plans import ingest_queries  # noqa: F401  registers its queries
from trivalent.sources import html

PARTS = ['<a href="x&amp;y&copy=1">', "</a>", "<br/>", "<p>", "text &lt; ", "&amp", "<title>", "</title>", "<script>", "</script>", '<DIV Class="a b" hidden>', "</div >", "<", "<!-- c -->", '<img src="a>b">', "<i x=1>"]


def tree(n):
    parts = []
    for c in n.children:
        c = c if isinstance(c, str) else tree(c)
        if isinstance(c, str) and parts and isinstance(parts[-1], str):
            parts[-1] += c
        else:
            parts.append(c)
    return n.tag, n.attrs, n.classes, n.size, parts


def test_same_trees():
    plain = 0
    for parts in itertools.product(PARTS, repeat=3):
        page = "".join(parts)
        found = html._plain(page)
        plain += found is not None
        assert found is None or tree(found) == tree(html._parsed(page)), page
    assert plain > 500


def test_pieces():
    b = pa.RecordBatch.from_arrays([pa.array(["x" * 100_000] * 100 + [None])], ["html"])
    sizes = [p.num_rows for p in html.pieces(iter([b]))]
    assert sum(sizes) == 101 and max(sizes) * 100_000 <= html.PIECE_BYTES + 100_000


def test_details_parse_once(spark, monkeypatch):
    """Rows and JSON-LD come from one written table, not from two or three readings of the pages."""
    p = spark.createDataFrame([("7", '<p class="description">x</p>')], "video_id string, html string")
    plan = html.details(p, html.Layout(), 0)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "MapInPandas" not in plan


def test_addresses_of_a_card_are_resolved_once(spark):
    """The pictures' addresses are one column of the plan, which the others pick from."""
    pages = spark.createDataFrame([(1, PAGE)], "page_number int, html string")
    plan = html.listing(pages, html.Layout(), 0)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("transform(images") == 1
    got = html.listing(pages, html.Layout(), 0).select("thumbnail_url", "thumbnail_preferred_url", "thumbnail_fallback_url").first()
    assert tuple(got) == ("https://example.com/w.webp",) * 2 + ("https://example.com/o.jpg",)


PAGE = '<div class="items"><div class="item"><a href="/video/1/x/"><img data-srcset="/s.jpg 1x" data-webp="/w.webp" data-original="/o.jpg" src="/s.gif"></a></div></div>'
