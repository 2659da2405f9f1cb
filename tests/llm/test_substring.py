"""Operator 2 against windows in a dictionary."""

import hashlib

from fixtures import SCHEMA, documents, texts, words
from pyspark.sql import functions as F

from trivalent.llm import substring
from trivalent.llm.queries import OP2_SQL, op2_substring


def brute(rows):
    last = 1 << 62
    least, out = {}, []
    windows = [[tuple(w[i : i + 50]) for i in range(len(w) - 49)] for w in (words(t) for _, t in rows)]
    for (doc, _), own in zip(rows, windows, strict=True):
        for x in own:
            least[x] = min(least.get(x, last), last if doc is None else doc)
    for (doc, t), own in zip(rows, windows, strict=True):
        w, gone = words(t), set()
        for i, x in enumerate(own):
            if least[x] < (last if doc is None else doc):
                gone.update(range(i, i + 50))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_brute_force(spark):
    got = substring.remove_repeats(documents(spark)).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)).collect()
    assert sorted(map(tuple, got), key=str) == brute(texts())


def test_hashes_that_agree_by_chance(spark):
    """With six bits of the first hash most windows collide; the second tells them apart."""
    got = substring.remove_repeats(documents(spark), bits=6).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)).collect()
    assert sorted(map(tuple, got), key=str) == brute(texts())


def test_columns_of_the_results_names(spark):
    docs = documents(spark).select("*", *(F.lit(f"own {c}").alias(c) for c in substring.RESULTS))
    got = substring.remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)).collect()
    assert sorted(map(tuple, got), key=str) == brute(texts())
    out = substring.without_repeats(docs)
    assert out.columns == docs.columns and out.where("n_words = 'own n_words' and kept_text = 'own kept_text'").count() == docs.count()


def test_long_texts(spark):
    """A passage far inside texts of 20,000 words, and a text that repeats itself."""
    import random

    rng = random.Random(4)
    prose = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage = prose(120)
    rows = [(1, f"{prose(20_000)} {passage} {prose(5)}"), (2, f"{prose(15_000)} {passage} {prose(4_000)}"), (3, " ".join(["same words here"] * 9_000)), (4, f"{passage} " * 30)]
    got = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_without_repeats(spark):
    docs = documents(spark)
    out = substring.without_repeats(docs, length_col="n_chars")
    assert out.columns == docs.columns and out.count() == docs.count()
    assert not out.where("n_chars <> length(text)").count()
    assert substring.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sql(spark):
    from compare import SF, agree

    agree(op2_substring(spark, SF), OP2_SQL)
