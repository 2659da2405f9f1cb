"""Operator 7: against its SQL, layouts, and exact round trips."""

import hashlib

import pytest
from compare import SF, agree
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trivalent.llm import chat
from trivalent.llm.queries import OP7_SQL, op7_chat


def test_sql(spark):
    agree(op7_chat(spark, SF), OP7_SQL)


@pytest.mark.parametrize(
    ("record", "name", "turns"),
    [
        ('{"messages":[{"role":"human","content":"a"},{"role":"assistant","content":null}]}', "messages", [("user", "a"), ("assistant", "")]),
        ('{"id":3,"conversations":[{"from":"gpt","value":"v"}]}', "from and value", [("assistant", "v")]),
        ('{"instruction":"i","input":"q","output":"o"}', "instruction", [("user", "i\n\nq"), ("assistant", "o")]),
        ('{"system":"","instruction":"i","input":"","output":"o"}', "system and instruction", [("user", "i"), ("assistant", "o")]),
        ('{"prompt":"p","response":3}', "prompt and response", [("user", "p"), ("assistant", "3")]),
        ('{"name":"n","source":"s","messages":[{"role":"bot","content":"a","name":"m"}]}', "messages", [("assistant", "a")]), ('{"id":1,"lang":"en","prompt":"p","response":"r"}', "prompt and response", [("user", "p"), ("assistant", "r")]),
        ('{"question":"p","answer":"x"}', "question and answer", [("user", "p"), ("assistant", "x")]), ('{"messages":[]}', "messages", []), ('{"other":1}', None, None), ('{"messages":[[1]]}', None, None), ("null", None, None),
    ],
)
def test_layouts(spark, record, name, turns):
    row = chat.to_turns(spark.createDataFrame([(record,)], "j string").select(F.parse_json("j").alias("record"))).first()
    assert (row["layout"], row["turns"] if row["turns"] is None else [tuple(t) for t in row["turns"]]) == (name, turns)


CONTROL = st.text(alphabet="<>[]/\\sINTSYRO xé\n", max_size=30)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "[/ROLE]", ""]), CONTROL), min_size=1, max_size=8))
def test_round_trip(spark, turns):
    rows = [(1, k, r, t) for k, (r, t) in enumerate(turns)]
    out = chat.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    row = out.withColumn("read", chat.parse(F.col("formatted"))).first()
    assert [tuple(t) for t in row["read"]] == turns
    d = chat.digests(out).first()
    said = "".join(t for r, t in turns if r == "assistant")
    assert (d["loss_chars"], d["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())


def test_odd_rows(spark):
    rows = [(1, None, "user", None, 0), (1, 2, None, "x", 0), (1, 2, None, "x", 0), (None, 0, "assistant", "y", 0), (2, 0, "user", "z" * 50_000, 0)]
    got = {r["conv_id"]: r for r in chat.digests(chat.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segments int"))).collect()}
    assert got[1]["n_turns"] == 3 and got[None]["loss_chars"] == 1 and got[2]["loss_chars"] == 0
    assert chat.digests(chat.conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_unknown_layouts_stay_with_a_reason(spark):
    rows = ['{"conv_id":1,"turn":2,"role":"user","text":"second"}', '{"conv_id":1,"turn":1,"role":"user","text":"first"}', '{"conv_id":1,"turn":3,"other":"x"}', '{"id":2,"messages":[{"role":"user","content":"a"},{"role":"assistant","content":"b"}]}', '{"id":3,"else":[{"a":1}]}', '{"id":4,"messages":[]}']
    got = {r["conv_id"]: r for r in chat.formatted_records(spark.createDataFrame([(x,) for x in rows], "j string").select(F.parse_json("j").alias("record"))).collect()}
    assert got[1]["formatted"].index("first") < got[1]["formatted"].index("second") and "other" in got[1]["reason"]
    assert got[2]["reason"] is None and [tuple(x) for x in got[2]["loss"]] == [(len(got[2]["formatted"]) - 4, 1)]
    assert got[3]["formatted"] == "" and got[3]["reason"].startswith("unknown layout") and got[4]["reason"] is None and got[4]["formatted"] == ""


def test_mappings_share_no_layout(spark):
    known = chat.fingerprints(spark, chat.MAPPINGS)
    assert len({fp for _, _, fp in known}) == len(known) == sum(len(m.layouts) for m in chat.MAPPINGS)
    with pytest.raises(ValueError):
        chat.fingerprints(spark, (*chat.MAPPINGS, chat.Mapping("again", ("{role,text}",), single=("$.role", "$.text"))))


def test_other_columns_change_nothing(spark):
    """Whatever more a table has, also by names that other layouts know."""
    rows = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, None, None, None)], "conv_id long, turn long, role string, text string")
    more = rows.selectExpr("*", "0.5 AS weight", "'x' AS content", "array(1) AS messages", "'i' AS instruction", "'p' AS prompt", "'r' AS response", "7 AS id", "named_struct('a', 1) AS meta", "'l' AS lang", "'n' AS layout", "2 AS k")
    of = lambda df: sorted(map(tuple, chat.digests(chat.formatted_records(chat.records(df))).collect()))
    assert of(more) == of(rows) and [r[1] for r in of(rows)] == [2, 1]
