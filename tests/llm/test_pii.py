"""Operator 5: base spans against plain regular expressions, and the field on texts of known meaning."""

import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
from fixtures import SCHEMA, documents, texts

from trivalent.llm import pii

PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text or ""):
            d = re.sub(r"[^0-9]", "", m[0])
            double = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) if k == 2 else 0
            if (k == 1 and any(int(x) > 255 for x in m[0].split("."))) or (k == 2 and not (13 <= len(d) <= 19 and double % 10 == 0)) or (k == 3 and not 9 <= len(d) <= 15):
                continue
            out.append((k, *m.span()))
    return out


ODD = ["a@b.c@d.e", "x.y@z", "..@a.b..c", "1.2.3.4.5.6.7.8", "1.2.3.400", "001.002.3.4", "4111-1111-1111-1111", "4111  1111", "+12-", "+1234567890", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "é a@b.co é", "a@b-.c_d@e.f", "+-1", "++12345678901", "1" * 40]


def test_base_spans():
    for t in [t for _, t in texts() if t and len(t) < 20_000] + ODD:
        assert pii.base_spans(t) == brute(t), t


def test_field(spark):
    rows = [(k, f"word {k} call +1 ({200 + k}) 555-{1000 + k} or mail n{k}@mail.example.com at 10.1.{k}.7 with 4111111111111111 end") for k in range(40)] + [(100 + k, f"room {k} on {1990 + k} cost {k * 3}.50 and 555-{2000 + k} pieces, list {k}.{k}.{k}") for k in range(40)]
    rows += [(900, "call +1 (887) 555-1668 now, later 555-1668 again"), (901, "only 555-1668 alone"), (902, "joe@mail.example.com, or joe@mail"), (903, "4003845627459628 12 then 4003845627459628 there")]
    got = {r["doc_id"]: r["spans"] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[900] == "phone:5:22,phone:34:42" and got[901] == ""
    assert got[902] == "email:0:20,email:25:33"
    assert got[903].endswith("card:25:41")
    assert all(got[100 + k] == "" for k in range(40))


def test_numbers_in_several_words(spark):
    rows = [(k, f"word {k} call +44 20 7946 {1000 + k} or +1 ({200 + k}) 555-{1000 + k} with {'4111 1111 1111 1111' if k % 2 else '4003845627459628'} end") for k in range(40)] + [(100 + k, f"room {k} on {1990 + k} cost {k * 3} of {k * 3} and 20 pieces of 20") for k in range(40)]
    later = {
        900: ("call +44 20 7946 0958 now, later", "020 7946 0958", "phone"), 901: ("call +44 20 7946 0958 now, later", "(020) 7946-0958", "phone"),
        902: ("call +44 20 7946 0958 now, later", "02079460958", "phone"), 903: ("call +1 (887) 555-1668 now, later", "(887) 555 1668", "phone"),
        904: ("paid by 4111 1111 1111 1111 and, later", "1111 1111 1111", "card"), 905: ("paid by 4003 8456 2745 9628 and, later", "8456 2745 9628", "card"),
    }
    rows += [(i, f"{a} {b} again") for i, (a, b, _) in later.items()] + [(951, "call +44 20 7946 0958 in 20 days of 20")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.find(docs).collect()}
    for i, (a, b, kind) in later.items():
        assert f"{kind}:{len(a) + 1}:{len(a) + 1 + len(b)}" in got[i].split(","), (i, got[i])
    assert got[951] == "phone:5:21" and all(got[100 + k] == "" for k in range(40))
    assert {r["doc_id"]: r["text"] for r in pii.mask(docs).collect()}[900] == "call <phone> now, later <phone> again"


def test_edges_grow_with_words():
    for text in ("0 " * 3000, "1 2 3 " * 1000, "4111 1111 1111 1111 " * 750, "555-1234567 " * 3000):
        nodes = pii.Nodes(pa.array([text]))
        assert len(nodes.edges) <= 2 * len(nodes.words) and len(nodes.echoes) <= 2 * len(nodes.words)


def test_whole_table(spark):
    docs = documents(spark)
    got = pii.find(docs).collect()
    expected = sorted((str(d), hashlib.sha256(",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in brute(t)).encode()).hexdigest()) for d, t in texts())
    assert sorted((str(r["doc_id"]), r["base_sha256"]) for r in got) == expected
    for r, spans in ((r, set(filter(None, r["spans"].split(",")))) for r in got):
        assert sum(r[f"n_{k}"] for k in pii.KINDS) <= len(spans)
    masked = pii.mask(docs, length_col="n_chars")
    assert masked.columns == docs.columns and masked.count() == docs.count()
    row = masked.where("doc_id = 80").first()
    assert "<email>" in row["text"] and "4111" not in row["text"] and row["n_chars"] == len(row["text"])
    assert pii.find(spark.createDataFrame([], SCHEMA)).count() == 0


def exhaustive(field, nodes):
    """Marginals from all labellings."""
    n, k = len(nodes.words), len(pii.LABELS)
    unary, chain = field.unary(nodes.shape), field.chain + pii.BARRED
    alike = [((w + w.T) / 2)[pii.KIND][:, pii.KIND] for w in (field.skip, field.echo)]
    out = np.zeros((n, k))
    for labels in itertools.product(*([nodes.label[i]] if nodes.seen[i] else range(k) for i in range(n))):
        score = sum(0.0 if nodes.seen[i] else unary[i, x] + (0 if nodes.next_to[i] else chain[pii.ABSENT, x]) for i, x in enumerate(labels))
        score += sum(chain[labels[i - 1], labels[i]] for i in range(n) if nodes.next_to[i])
        score += sum(w[labels[a], labels[b]] for w, edges in zip(alike, (nodes.edges, nodes.echoes), strict=True) for a, b in edges)
        for i, x in enumerate(labels):
            out[i, x] += np.exp(score)
    return out / out.sum(axis=1, keepdims=True)


def test_marginals_of_small_graphs():
    rng = np.random.default_rng(2)
    field = pii.Field()
    for x in (field.bias, *field.features, field.chain, field.echo):
        x += rng.normal(0, 0.7, x.shape)
    field.echo = (field.echo + field.echo.T) / 2
    trees = ["call 12 345 now 77", "x +1 (887) 555-1668 y 555-1668 z", "a 5551668 b 5551668 c", "mail a@b.example.com then a@b", "20 of 20 or 3"]
    for text in trees:
        nodes = pii.Nodes(pa.array([text]))
        assert 2 <= len(nodes.words) <= 6
        np.testing.assert_allclose(field.marginals(nodes), exhaustive(field, nodes), atol=1e-6, err_msg=text)
    # with a loop of edges the messages are close
    nodes = pii.Nodes(pa.array(["7 8 or 7 8"]))
    assert len(nodes.echoes) == 2 and abs(field.marginals(nodes) - exhaustive(field, nodes)).max() < 0.15


def test_weights_are_the_same_at_every_size(spark, monkeypatch):
    """Summed over executors, the gradient gives the weights that the driver alone gives, and the same spans; nothing is left out."""
    docs = documents(spark)
    own = pii.fit(docs, steps=12)
    monkeypatch.setattr(pii, "LOCAL_ROWS", 0)
    spread = pii.fit(docs.repartition(5), steps=12)
    for a, b in zip(own.weights(), spread.weights(), strict=True):
        np.testing.assert_allclose(a, b, atol=1e-9)
    assert (own.unseen == spread.unseen).all() and not own.unseen.all() and abs(own.shapes).max() > 0
    assert sorted(map(str, pii.find(docs, field=own).collect())) == sorted(map(str, pii.find(docs, field=spread).collect()))
    assert not pii.fit(spark.createDataFrame([], SCHEMA)).shapes.any()


def test_gradient_is_that_of_the_likelihood():
    """Against differences of the pseudo-likelihood, weight by weight."""
    rng = np.random.default_rng(5)
    k = len(pii.LABELS)
    rows = np.array([(rng.integers(pii.SHAPES), rng.integers(k + 1), rng.integers(k + 1), rng.integers(6), rng.integers(6), rng.integers(k), rng.integers(1, 50)) for _ in range(40)], np.int64)
    total = float((1 + np.log(rows[:, -1])).sum())
    field = pii.Field()
    for w in field.weights():
        w += rng.normal(0, 0.5, w.shape)

    def likelihood():
        out = 0.0
        for shape, before, after, skip, echo, label, n in rows.tolist():
            s = field.bias + field.shapes[shape] + sum(f[int(x[0])] for f, x in zip(field.features, pii.decode(np.array([shape])), strict=True)) + (field.chain + pii.BARRED)[before]
            s = s + (0 if after == pii.ABSENT else (field.chain + pii.BARRED)[:k, after])
            s = s + sum(0 if x == pii.APART else w[x][pii.KIND] for w, x in ((field.skip, skip), (field.echo, echo)))
            out += (1 + np.log(n)) / total * (s[label] - np.log(np.exp(s).sum()))
        return out

    gradient, at = pii.Counted(rows, total).gradient(field), 0
    for w in field.weights():
        flat, got = w.reshape(-1), gradient[at : at + w.size]
        at += w.size
        places = np.flatnonzero(got) if w is field.shapes else np.arange(w.size)
        for i in rng.permutation(places)[:30]:
            old = flat[i]
            flat[i] = old + 1e-5
            up = likelihood()
            flat[i] = old - 1e-5
            down = likelihood()
            flat[i] = old
            assert abs((up - down) / 2e-5 - got[i]) < 1e-6
    assert at == len(gradient)
