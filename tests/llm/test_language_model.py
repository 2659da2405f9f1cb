"""Operator 9: base scores by brute force, probabilities that sum to one, and better scores on held-out texts."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from fixtures import SCHEMA, documents, texts, words

from trivalent.llm import lm


def test_base_scores(spark):
    got = lm.score(documents(spark)).collect()
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    count = Counter()
    for d, t in texts():
        if not held(d):
            count.update([*words(t, lower=True), None])
    n, v = sum(count.values()), len(count)
    score = lambda w: sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w)
    expected = sorted((str(d), held(d), len(w), sum(count[x] > 0 for x in w), n, round(score(w), 6)) for d, w in ((d, [*words(t, lower=True), None]) for d, t in texts()))
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == expected
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)


def _lexicon(seed=0, words_=400):
    """A lexicon of made-up counts, its words with vectors, and all words (keys, counts, topics)."""
    rng = np.random.default_rng(seed)
    n = np.sort((1 + rng.pareto(0.6, words_) * 2).astype(np.int64))[::-1].clip(1, 5000)
    topic, keys = rng.integers(0, 3, words_), np.arange(1, words_ + 1).astype(np.uint64) * np.uint64(7919)
    place = topic * lm.LEVELS + lm.level_of(n)
    size = lm.TOPICS * lm.LEVELS
    own = n >= lm.LEAST
    lexicon = lm.lexicon_of(np.bincount(place, minlength=size), np.bincount(place, n, size).astype(np.int64), keys[own], (n * lm.TOPICS + topic)[own])
    return lexicon, keys, n, topic


def _trained(lexicon, keys, n, topic, seed=1):
    rng = np.random.default_rng(seed)
    at = rng.choice(len(n), 6000, p=n / n.sum())
    cls, slot, _ = lexicon.place(keys[at], n[at], topic[at])
    off = np.array([0, 2500, 6000])
    model = lm.Model(lexicon)
    for k in range(3):
        model.train(lm.before(cls, off, lexicon.classes), lm.before(slot, off, lexicon.slots), cls, slot, k)
    return model


def test_probabilities_sum_to_one():
    lexicon, keys, n, topic = _lexicon()
    model = _trained(lexicon, keys, n, topic)
    all_keys, all_n, all_topic = np.append(keys, np.uint64(99)), np.append(n, 0), np.append(topic, 0)
    cls, slot, share = lexicon.place(all_keys, all_n, all_topic)
    assert cls[-1] == -1 and len(np.unique(slot)) > 50 and lexicon.slots > lexicon.classes
    for context in ((0, 1, 2), (5, lexicon.classes, lexicon.classes), (lexicon.classes + 1, 3, 3)):
        ctx = np.tile(np.array(context)[:, None], (1, len(cls)))
        ctx_slot = np.array([lexicon.first[c] if c < lexicon.classes else lexicon.slots for c in context])[:, None].repeat(len(cls), 1)
        p = 10 ** (model.log10_probabilities(ctx, ctx_slot, cls, slot) + share)
        assert abs(p.sum() - 1) < 1e-4
        # the same from the definition: class, then slot, each over all there are
        q = model.predict(ctx[:, :1], ctx_slot[:, :1])[0]
        of_class = np.exp(q @ model.dense[2].T + model.dense[3])
        of_class /= of_class.sum()
        inside = np.exp(model.sparse[1] @ q + model.sparse[2])
        inside /= np.bincount(lexicon.slot_class, inside)[lexicon.slot_class]
        plain = np.array([of_class[c] * inside[s] if c >= 0 else lm.UNSEEN_SHARE * of_class[lexicon.lowest()].sum() for c, s in zip(cls, slot, strict=True)])
        np.testing.assert_allclose(p, plain * 10**share, rtol=2e-3)


def test_averages_of_changes():
    lexicon, keys, n, topic = _lexicon()
    start = lm.Model(lexicon)
    copies = [_trained(lexicon, keys, n, topic, k) for k in (1, 2, 3)]
    changes = [c.change(start, s) for c, s in zip(copies, (100.0, 200.0, 300.0), strict=True)]
    flat = lm.averaged(changes, start.shapes())
    levels = lm.averaged([lm.averaged(changes[:2], start.shapes()), lm.averaged(changes[2:], start.shapes())], start.shapes())
    a, b = start.moved(flat), start.moved(levels)
    for x, y in zip([*a.dense, *a.sparse], [*b.dense, *b.sparse], strict=True):
        np.testing.assert_allclose(x, y, atol=2e-2)
    expected = sum(c.dense[2] * w for c, w in zip(copies, (1, 2, 3), strict=True)) / 6
    np.testing.assert_allclose(a.dense[2], expected, atol=1e-4)


def test_learns(spark):
    """On a cycle of words, where a bigram model is nearly sure, the loss is under half of the unigram's."""
    rows = [(k, " ".join(f"w{(k + i * 3) % 9}" if i % 2 else f"v{(k + i * 3) % 9}" for i in range(400))) for k in range(600)]
    got = lm.score(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").collect()
    assert sum(r["score"] for r in got) > 0.5 * sum(r["base_score"] for r in got)
    assert lm.score(spark.createDataFrame([], SCHEMA)).count() == 0
    nothing = lm.score(spark.createDataFrame([(9, None), (9, "")], "doc_id long, text string")).collect()
    assert len(nothing) == 2 and all(math.isfinite(r["score"]) for r in nothing)


def bigram(train, held):
    """Mean log10 a token of a bigram model: counts of pairs, discounted, over the add-one unigram."""
    one, two, follow = Counter(), Counter(), Counter()
    for t in train:
        before = "^"
        for w in t:
            one[w] += 1
            two[before, w] += 1
            before = w
    seen = Counter()
    for (a, _), n in two.items():
        seen[a] += n
        follow[a] += 1
    n, v, total, tokens = sum(one.values()), len(one), 0.0, 0
    for t in held:
        before = "^"
        for w in t:
            flat = (one[w] + 1) / (n + v + 1)
            total += math.log10(max(two[before, w] - 0.75, 0) / seen[before] + 0.75 * follow[before] / seen[before] * flat if seen[before] else flat)
            tokens += 1
            before = w
    return total / tokens


def test_better_than_bigrams_on_prose(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    held = lm.held_out([r["doc_id"] for r in rows])
    tokens = [[*words(r["text"], lower=True), ""] for r in rows]
    other = bigram([t for t, h in zip(tokens, held, strict=True) if not h], [t for t, h in zip(tokens, held, strict=True) if h])
    got = lm.score(docs).where("held_out").agg({"score": "sum", "n_tokens": "sum"}).first()
    assert got["sum(score)"] / got["sum(n_tokens)"] > other + 0.3


def test_topics_are_of_all_texts(spark):
    """A rare kind of text, of which a sample that hashes choose has few or none, moves the centres as much as its words weigh."""
    rows = [(k, " ".join(f"a{(k + i) % 50}" for i in range(40))) for k in range(400)]
    more = [(1000 + k, " ".join(f"b{(k + i) % 50}" for i in range(8))) for k in range(3)]
    held = lm.held_out([d for d, _ in rows + more])
    found = lm.topics(spark.createDataFrame(rows + more, "id long, text string"))
    assert not np.array_equal(found, lm.topics(spark.createDataFrame(rows, "id long, text string")))  # short texts count
    from trivalent.llm.words import Words

    w = Words(pa.array([t for (_, t), h in zip(rows + more, held, strict=True) if not h]), lower=True)
    signs = 2 * lm.ones(w.hashes(), w.off) - w.counts()[:, None]
    cells, n = {}, w.counts()
    for k, cell in enumerate((signs > 0) @ (1 << np.arange(lm.SIGNS))):
        cells.setdefault(int(cell), []).append(k)
    points = np.array([signs[at].sum(axis=0) / n[at].sum() for _, at in sorted(cells.items())], np.float32)
    np.testing.assert_array_equal(found, lm.centres_of(points, np.array([n[at].sum() for _, at in sorted(cells.items())])))
