r"""Chat formatting (operator 7): schema fingerprints choose declarative mappings to canonical turns.

Every record is a VARIANT, made of a row's columns as they come.  A mapping of ``MAPPINGS`` says which fields it needs, and how they
are nested, and where the turns are: in rows of one turn, in arrays of messages, or in prompt and answer fields.  A record's fields of
those names are hashed with their nested paths (names and nesting, without the types of leaves) to a fingerprint, and the first mapping
whose fingerprint it is reads the record.  Other fields, whatever their names, change nothing.  A record that no mapping knows has null
``layout`` and null ``turns``; nothing is guessed, and its conversation stays, with ``reason``.

Turns are written by a template of control strings.  Inside texts and other roles, a control string gets a
backslash after its first character, and one that already has backslashes there gets one more; so no
control string is left in them and the change is undone exactly by taking one backslash away.  The
result is the formatted text and its loss mask, as spans of code points: the assistant texts and nothing else.

All of it is DataFrame expressions.  One shuffle brings the turns of a conversation together.

Defined results: null texts and null roles are empty; turns with equal numbers are ordered by role and
text; null turn numbers come first; rows with a null conversation id form one conversation, as in
GROUP BY; an empty table gives an empty table; other columns are ignored.  A conversation is one row, so its turns come together in one
task.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TURN_TYPE = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Mapping:
    """A layout: field paths with their nesting, and where its turns are.

    ``layouts``: the fields that must be there, in one of several forms.  ``array``: path, role field and text field of an
    array of messages; ``single``: role path and text path of a record that is one turn; ``fields``: (role, paths whose texts
    are joined by a blank line).
    """

    name: str
    layouts: tuple[str, ...]
    array: tuple[str, str, str] | None = None
    single: tuple[str, str] | None = None
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()


def needed(short: str) -> dict[str, str]:
    """The outer fields of ``{a,b:[{c,d}]}`` and how each is nested."""
    fields = re.findall(r"([^,{}\[\]:]+)(?::(\[[^\]]*\]))?", short[1:-1])
    return {name: written_out(nested) for name, nested in sorted(fields)}


#: In order: a record of several layouts is read by the first.
MAPPINGS = (
    Mapping("turn rows", ("{role,text}",), single=("$.role", "$.text")),
    Mapping("role and content", ("{content,role}",), single=("$.role", "$.content")),
    Mapping("messages", ("{messages:[{content,role}]}", "{messages:[{content,name,role}]}", "{messages:[]}"), array=("$.messages", "role", "content")),
    Mapping("from and value", ("{conversations:[{from,value}]}",), array=("$.conversations", "from", "value")),
    Mapping("system and instruction", ("{input,instruction,output,system}",), fields=(("system", ("$.system",)), ("user", ("$.instruction", "$.input")), ("assistant", ("$.output",)))),
    Mapping("instruction", ("{input,instruction,output}", "{instruction,output}"), fields=(("user", ("$.instruction", "$.input")), ("assistant", ("$.output",)))),
    Mapping("prompt and response", ("{prompt,response}",), fields=(("user", ("$.prompt",)), ("assistant", ("$.response",)))),
    Mapping("prompt and completion", ("{completion,prompt}",), fields=(("user", ("$.prompt",)), ("assistant", ("$.completion",)))),
    Mapping("question and answer", ("{answer,context,question}", "{answer,question}"), fields=(("user", ("$.context", "$.question")), ("assistant", ("$.answer",)))),
)
#: Other names of roles, in layouts that are not rows of turns.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant"}


def layout(record: Column) -> Column:
    """Field paths of a VARIANT, as in ``OBJECT<messages: ARRAY<OBJECT<content, role>>>``: no leaf types, fields in order of name."""
    leaf = r"(?!OBJECT<|ARRAY<)[A-Z0-9_]+(\(\d+,\s?\d+\))?"
    return F.regexp_replace(F.regexp_replace(F.schema_of_variant(record), f": {leaf}", ""), f"ARRAY<{leaf}>", "ARRAY<>")


def written_out(short: str) -> str:
    """The layout that ``{messages:[{content,role}]}`` stands for."""
    for x, y in (("{", "OBJECT<"), ("[", "ARRAY<"), ("}", ">"), ("]", ">"), (",", ", "), (":", ": ")):
        short = short.replace(x, y)
    return short


def fingerprint(record: Column, names: list[str]) -> Column:
    """The hash of a record's fields of these names with their layouts; a leaf has none."""
    parts = []
    for name in names:
        value = F.try_variant_get(record, f"$.{name}", "variant")
        nested = F.when(value.isNull(), F.lit("missing")).otherwise(F.regexp_replace(layout(value), r"\A(?!OBJECT<|ARRAY<).*\z", ""))
        parts += [F.lit(f"{name}="), nested, F.lit(";")]
    return F.xxhash64(F.concat(*parts))


def fingerprints(spark: SparkSession, mappings: tuple[Mapping, ...]) -> list[tuple[Mapping, list[str], int]]:
    """(mapping, names of fields, fingerprint) of every layout; one of two mappings raises."""
    at = [(m, needed(x)) for m in mappings for x in m.layouts]
    texts = ["".join(f"{k}={v};" for k, v in fields.items()) for _, fields in at]
    if len(set(texts)) < len(texts):
        raise ValueError("a layout is of another mapping as well")
    rows = ", ".join(f"({k}, '{t}')" for k, t in enumerate(texts))
    hashed = {r["k"]: r["fp"] for r in spark.sql(f"SELECT k, xxhash64(layout) AS fp FROM VALUES {rows} AS t(k, layout)").collect()}
    return [(m, list(fields), hashed[k]) for k, (m, fields) in enumerate(at)]


def _of(m: Mapping, record: Column) -> Column:
    text = lambda path: F.coalesce(F.try_variant_get(record, path, "string"), F.lit(""))
    alias = F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair))
    known = lambda role: F.coalesce(F.try_element_at(alias, F.lower(role)), role)
    turn = lambda role, body: F.struct(role.alias("role"), body.alias("text"))
    if m.single:
        return F.array(turn(text(m.single[0]), text(m.single[1])))
    if m.array:
        path, role, body = m.array
        items = F.try_variant_get(record, path, f"array<struct<`{role}`:string,`{body}`:string>>")
        return F.transform(items, lambda x: turn(known(F.coalesce(x[role], F.lit(""))), F.coalesce(x[body], F.lit(""))))
    made = [turn(F.lit(role), F.array_join(F.filter(F.array(*(text(p) for p in paths)), lambda x: x != F.lit("")), "\n\n")) for role, paths in m.fields]
    return F.array(*made) if m.fields[0][0] != "system" else F.filter(F.array(*made), lambda t: (t["role"] != F.lit("system")) | (t["text"] != F.lit("")))


def to_turns(records: DataFrame, record_col: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """records with ``layout`` (a mapping's name) and ``turns`` for its VARIANT column."""
    named, turns = F.lit(None).cast("string"), F.lit(None).cast(TURN_TYPE)
    for m, names, known in reversed(fingerprints(records.sparkSession, mappings)):
        fits = fingerprint(F.col(record_col), names) == known
        named, turns = F.when(fits, F.lit(m.name)).otherwise(named), F.when(fits, _of(m, F.col(record_col)).cast(TURN_TYPE)).otherwise(turns)
    return records.withColumn("layout", named).withColumn("turns", turns)


#: The template's control strings.
BEGIN, END = "<s>", "</s>"
HEADS = {"user": ("[INST] ", " [/INST]"), "system": ("<<SYS>>\n", "\n<</SYS>>")}
ROLE, ROLE_END = "[ROLE]", "[/ROLE]"
#: What follows the first character of a control string.
_REST = r"/?s>|/?INST\]|/?ROLE\]|</?SYS>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)({_REST})", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({_REST})", "$1$2$3")


def segments(turns: Column) -> Column:
    """array<struct<text, loss>> of canonical turns: the formatted text in order, assistant texts flagged."""
    piece = lambda text, loss=False: F.struct(text.alias("text"), F.lit(loss).alias("loss"))

    def of(t: Column) -> Column:
        head = F.when(t["role"] == "assistant", F.lit(BEGIN)).when(t["role"] == "user", F.lit(BEGIN + HEADS["user"][0])).when(t["role"] == "system", F.lit(BEGIN + HEADS["system"][0])).otherwise(F.concat(F.lit(BEGIN + ROLE), escape(t["role"]), F.lit(ROLE_END)))
        tail = F.when(t["role"] == "user", F.lit(HEADS["user"][1] + END)).when(t["role"] == "system", F.lit(HEADS["system"][1] + END)).otherwise(F.lit(END))
        body = F.struct(escape(t["text"]).alias("text"), (t["role"] == "assistant").alias("loss"))
        return F.array(piece(head), body, piece(tail))

    return F.flatten(F.transform(turns, of))


def parse(formatted: Column) -> Column:
    """The turns of a formatted text."""
    bodies = F.regexp_extract_all(formatted, F.lit(rf"(?s){BEGIN}(.*?){END}"), F.lit(1))

    def of(b: Column) -> Column:
        turn = lambda role, text: F.struct(unescape(role).alias("role"), unescape(text).alias("text"))
        inner = lambda k: F.substring(b, len(HEADS[k][0]) + 1, F.length(b) - len("".join(HEADS[k])))
        out = turn(F.lit("assistant"), b)
        out = F.when(b.startswith(ROLE), turn(F.regexp_extract(b, rf"(?s)\A{re.escape(ROLE)}(.*?){re.escape(ROLE_END)}", 1), F.regexp_extract(b, rf"(?s)\A.*?{re.escape(ROLE_END)}(.*)\z", 1))).otherwise(out)
        for k in HEADS:
            out = F.when(b.startswith(HEADS[k][0]), turn(F.lit(k), inner(k))).otherwise(out)
        return out

    return F.transform(bodies, of)


def records(rows: DataFrame, *columns: str) -> DataFrame:
    """One VARIANT a row, ``record``, of its columns as they come (nulls are fields as well)."""
    return rows.select(F.to_variant_object(F.struct(*(columns or rows.columns))).alias("record"))


def conversations(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``formatted_records`` of rows of one turn each."""
    named = rows.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    return formatted_records(records(named), rows.schema[id_col].dataType.simpleString()).withColumnRenamed("conv_id", id_col)


def formatted_records(rows: DataFrame, id_type: str = "long") -> DataFrame:
    """conv_id, formatted, loss (array<struct<start, length>>, in code points from 1) and reason, one row a conversation.

    rows: ``record``, of any layouts; a record's conversation is its field ``conv_id``, else ``id``, and its place the field
    ``turn``.  reason names the layouts of a conversation's records that no mapping knows; it is null if all were read.
    """
    field = lambda path, kind: F.try_variant_get("record", path, kind)
    placed = to_turns(rows.select(F.coalesce(field("$.conv_id", id_type), field("$.id", id_type)).alias("id"), field("$.turn", "long").alias("n"), "record"))
    unread = F.when(F.col("layout").isNull(), F.concat(F.lit("unknown layout: "), F.coalesce(layout(F.col("record")), F.lit("null"))))
    turns = placed.select("id", "n", unread.alias("unread"), F.posexplode_outer(segments_per_turn(F.col("turns"))).alias("k", "part"))
    part = F.when(F.col("part").isNotNull(), F.struct("n", "k", "part"))
    whole = turns.groupBy("id").agg(F.sort_array(F.collect_list(part)).alias("parts"), F.min("unread").alias("reason"))
    seg = F.flatten(F.transform("parts", lambda p: p["part"]["segments"]))
    out = whole.select(F.col("id").alias("conv_id"), seg.alias("segments"), "reason")
    begin = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    step = lambda a, s: F.struct((a["at"] + F.length(s["text"])).alias("at"), F.when(s["loss"], F.concat(a["spans"], F.array(F.struct(a["at"].alias("start"), F.length(s["text"]).alias("length"))))).otherwise(a["spans"]).alias("spans"))
    return out.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), F.aggregate("segments", begin, step)["spans"].alias("loss"), "reason")


def segments_per_turn(turns: Column) -> Column:
    """Each turn as struct<role, text, segments>, so that turns of one number have an order."""
    return F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), segments(F.array(t)).alias("segments")))


def under_loss(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask, read from the formatted text, unescaped, with nothing between."""
    return F.array_join(F.transform(loss, lambda x: unescape(F.substring(formatted, x["start"], x["length"]))), "")


def digests(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """What can be read back from the formatted conversations."""
    read = formatted.withColumn("turns", parse(F.col("formatted")))
    under = under_loss(F.col("formatted"), F.col("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        id_col,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(under).cast("long").alias("loss_chars"),
        F.sha2(under, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "reason",
    )
