"""Filter documents and their compilation."""

import pytest
from pyspark.sql import functions as F

from trivalent.operators import ordering
from trivalent.plans import rules
from trivalent.plans.compile import Context, evaluate
from trivalent.plans.fixture import catalogue
from trivalent.plans.presets import Presets, unique_name
from trivalent.plans.query import run

SF = "/root/testdata/sf0.001"


def test_normalising():
    r = rules.normalize_rule({"field": "views", "operator": "between", "value": "10K", "valueTo": "1.5M"})
    assert (r["value"], r["valueTo"], r["enabled"], r["connector"]) == (10000, 1.5e6, True, None)
    assert rules.normalize_rule({"field": "views", "operator": "between", "value": "2", "valueTo": "1"})["enabled"] is False
    assert rules.normalize_rule({"field": "nothing", "value": "x"})["field"] == "title"
    assert rules.normalize_rule({"field": "title", "operator": "equals", "value": "x", "options": {"wholeWord": True, "caseSensitive": True}})["options"] == {"caseSensitive": True}
    assert rules.normalize_rule({"field": "duplicates"})["options"]["matchingDuration"] is True
    assert rules.normalize_rule({"field": "quality", "value": "9p", "operator": "between"})["value"] == "1080p"
    items = rules.normalize_items([{"kind": "group", "items": []}, {"field": "title", "value": "a", "connector": "or"}, {"field": "title", "value": "b", "connector": "xor"}])
    assert [i["connector"] for i in items] == [None, "and"]
    n = rules.normalize({"detailed": {"tags": {"enabled": True, "value": ["A", "a ", ""], "tagMatch": "all"}}, "quick": {"views": {"enabled": True, "value": {"value": ""}}}})
    assert n["detailed"]["tags"] == {"enabled": True, "value": ["A"], "matchMode": "all"}
    assert not n["quick"]["views"]["enabled"]
    assert rules.count_applied(n) == 1
    assert rules.normalize(rules.create_empty()) == rules.normalize(None)


@pytest.mark.parametrize(
    ("rule", "wrong"),
    [
        ({"field": "rating", "operator": "gt", "value": 101}, "percentage"), ({"field": "uploadDate", "operator": "on", "value": "2023-02-30"}, "no date"), ({"field": "uploadDate", "operator": "within", "value": "0", "unit": "days"}, "over zero"),
        ({"field": "artist", "operator": "amountOf", "value": "2", "countComparator": "is"}, "whole number"), ({"field": "title", "operator": "regex", "value": "("}, "pattern"), ({"field": "tags", "value": " "}, "tags: a value"), ({"field": "title", "operator": "gt", "value": "x"}, "operator"),
        ({"field": "title", "operator": "contains", "value": "x"}, ""), ({"field": "uploadDate", "operator": "between", "value": "2023-01-02", "valueTo": "2023-01-01"}, "before it begins"),
    ],
)
def test_validating(rule, wrong):
    message = rules.validate_rule(rule)
    assert wrong in message if wrong else not message


def test_editing_and_explaining():
    items = rules.normalize_items([{"field": "title", "value": "a"}, {"field": "hdAvailable", "connector": "or", "polarity": "exclude"}])
    a, b = (i["id"] for i in items)
    grouped = rules.edit(items, b, "group")
    assert rules.explain(grouped) == 'title contains "a" OR (NOT hd available)'
    moved = rules.edit(grouped, a, "move", group=grouped[1]["id"])
    assert len(moved) == 1 and [i["connector"] for i in moved[0]["items"]] == [None, "and"]
    assert rules.explain(rules.edit(items, a, "delete")) == "NOT hd available"
    assert len(rules.edit(items, a, "duplicate")) == 3
    assert rules.edit(items, b, "reorder", by=-1)[0]["id"] == b
    assert rules.counts(rules.edit(grouped, b, "toggle")) == {"rules": 2, "enabled": 1, "groups": 1, "detailed": 0}
    assert rules.validate([{"id": "x", "enabled": True, "field": "title", "value": ""}]) == [("x", "title: the field has no such operator")]
    assert rules.without_facet({"detailed": {"tags": {"enabled": True, "value": ["a"]}}}, "tags")["detailed"]["tags"]["enabled"] is False


def test_presets(tmp_path):
    p = Presets(tmp_path / "p.json")
    first = p.active
    q = p.create("filter")
    assert q["name"] == "filter (2)" and p.active == q["id"]
    p.commit({"quick": {"title": {"enabled": True, "value": {"value": "x"}}}})
    p.save()
    again = Presets(tmp_path / "p.json")
    assert again.get()["filters"]["quick"]["title"]["enabled"]
    assert again.remove(again.active) and again.active == first and not again.remove(first)
    assert unique_name("A", ["a", "A (2)"]) == "A (3)"


def test_kleene(spark):
    for name, items in {"and": ("and", [None, False, None]), "or": ("or", [True, None, None])}.items():
        df = spark.createDataFrame([(True, None), (False, None), (None, None)], "a boolean, b boolean")
        got = [r["x"] for r in df.select((F.col("a") & F.col("b") if name == "and" else F.col("a") | F.col("b")).alias("x")).collect()]
        assert got == items[1]


def test_registered_field_and_run(spark):
    rules.register_field("long", "Long title", ("over",), lambda rule, ctx: F.length("title") > int(rule["value"]))
    filters = {"advanced": {"enabled": True, "items": [{"field": "long", "operator": "over", "value": "9"}]}}
    result = run(catalogue(spark, SF), filters, {"field": "views"}, 99, 24, Context())
    assert result.page == -(-result.matches // 24)
    assert all(len(r["title"]) > 9 for r in result.rows.collect())
    del rules.FIELDS["long"], rules.REGISTERED["long"]


def test_plan_reads_only_what_is_asked(spark):
    plan = evaluate(catalogue(spark, SF), {"quick": {"title": {"enabled": True, "value": {"value": "red"}}}}).select("video_id", "verdict")._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan or "l_extendedprice" not in plan


def test_paging():
    assert ordering.clamp_page(9, 50, 24) == 3 and ordering.clamp_page(1, 0, 24) == 1
    assert ordering.page_size(50) == 24
    assert ordering.normalize_sort({"field": "x"}) == {"field": "uploadDate", "direction": "desc"}
    assert ordering.toggle_sort({"field": "title"}, "title") == {"field": "title", "direction": "desc"}
    assert ordering.parse_jump("07", 9) == 7 and ordering.parse_jump("10", 9) is None
    for pages in (1, 5, 9, 10, 40):
        for at in range(1, pages + 1):
            model = [b for b in ordering.paginator(at, pages) if b["kind"] in ("page", "ellipsis")]
            assert len(model) <= 9 and any(b.get("current") for b in model)
