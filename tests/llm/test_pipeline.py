"""The pipeline on the odd table, on an empty one, and against its stages in plain Python."""

import zlib
from collections import defaultdict

import pytest
from compare import SF
from fixtures import SCHEMA, documents, texts, words
from test_near_duplicates import brute as components
from test_quality import brute as counts, brute_kept, closed

from trivalent.llm import packing, pii, quality
from trivalent.llm.queries import tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark):
    docs = documents(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == corpus_pipeline.COLUMNS, name
        assert not out.where("n_chars <> length(text)").count(), name
        docs = corpus_pipeline.written(out)
    ids = {r["doc_id"] for r in docs.collect()}
    assert ids <= set(range(40)) | set(range(40, 83)) | {-5} and len(ids) > 20
    assert len(ids & {3, *range(40, 60)}) == 1
    assert not docs.where("text like '%@x-y.example.com%'").count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == len(ids)


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0, name
    assert set(docs.columns) >= {"doc_id", "piece", "sequence_id", "offset"}


def cleaned(text):
    """The text without the lines that fail."""
    lines, seen, out, failed = text.split("\n"), set(), [], False
    for x in lines:
        own = words(x)
        low = x.translate({i: i + 32 for i in range(65, 91)})
        bad = bool(own) and (x in seen or sum(c in "#*$%&|<>" for c in x) >= max(1, quality.SYMBOLS * len(own)) or x.count("!") >= max(2, quality.SHOUT * len(own)) or (len(own) < quality.SHORT_LINE and not closed(x)) or any(p in low for p in quality.BOILERPLATE))
        seen.add(x)
        failed |= bad
        if not bad:
            out.append(x)
    return "\n".join(out) if failed else text


def without_passages(rows):
    least, out = {}, []
    windows = [[tuple(w[i : i + 50]) for i in range(len(w) - 49)] for w in (words(t) for _, t in rows)]
    for (doc, _), own in zip(rows, windows, strict=True):
        for x in own:
            least[x] = min(least.get(x, doc), doc)
    for (doc, t), own in zip(rows, windows, strict=True):
        gone = {j for i, x in enumerate(own) if least[x] < doc for j in range(i, i + 50)}
        out.append((doc, " ".join(x for i, x in enumerate(words(t)) if i not in gone) if gone else t))
    return out


def masked(text, spans):
    out, done = [], 0
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= done:
            out += [text[done:s], f"<{pii.KINDS[k]}>"]
        done = max(done, e)
    return "".join([*out, text[done:]])


def test_run_by_brute_force(spark, tmp_path):
    """All rows of run() on a table of clean documents, copies, passages, junk and personal data."""
    prose = [(k, t) for k, t in texts(9) if k is not None and t and len(t) < 20_000 and k not in (75,)]
    extra = [(300 + k, f"{t}\nWrite to user{k}@mail.example.com or 10.0.{k}.7 for more of these things.") for k, (_, t) in enumerate(prose[:12])]
    junk = [(400, "\n".join(["home | menu | login"] * 40)), (401, f"{prose[0][1]}\nHere all rights reserved by the owners of this\n{prose[1][1]}")]
    rows = [*prose, *extra, *junk]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    kept = [(i, cleaned(t)) for i, t in rows if brute_kept(t)]
    assert 20 < len(kept) < len(rows) and all(not counts(t)[-1] for i, t in rows if i in dict(kept))
    first = {d for d, _, c in components(kept) if d == c}
    kept = without_passages([(i, t) for i, t in kept if i in first])
    table = spark.createDataFrame(kept, "doc_id long, text string")
    field = pii.fit(table)
    spans = {r["doc_id"]: [tuple((pii.KINDS.index(k), int(s), int(e))) for k, s, e in (x.split(":") for x in r["spans"].split(",") if x)] for r in pii.find(table, field=field).collect()}
    assert all(set(pii.base_spans(t)) <= set(spans[i]) for i, t in kept) and any(spans.values())
    kept = [(i, masked(t, spans[i])) for i, t in kept]

    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    expected = []
    for i, t in kept:
        ids = [*encoder.encode(t, add_special_tokens=False).ids, packing.END_ID]
        for p, s in enumerate(range(0, len(ids), packing.CAPACITY)):
            part = ids[s : s + packing.CAPACITY]
            expected.append((i, p, s, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))))
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(expected)
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100
