"""Operator 6: base counts by brute force, and what the line rules say."""

from collections import Counter

from fixtures import SCHEMA, documents, texts, words

from trivalent.llm import quality


def brute(text):
    w = words(text)
    t = text or ""
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if often[g] > 1:
            covered.update((i, i + 1, i + 2))
    lines, seen, dup = t.split("\n"), set(), 0
    for x in lines:
        if words(x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_base_counts(spark):
    extra = [(200, "a b c\na b c\n\n \na b c"), (201, "\n"), (202, "x\n" * 60), (203, "# * $ % & | < >")]
    docs = documents(spark).unionByName(spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True)
    got = quality.judge(docs).collect()
    assert sorted((str(r["doc_id"]), *(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))) for r in got) == sorted((str(d), *brute(t)) for d, t in texts() + extra)
    assert all(not (r["base_failed"] and r["kept"]) for r in got)


def closed(line):
    return words(line)[-1][-1] in quality.CLOSING


def brute_kept(text):
    """The line rules from their definition."""
    lines, seen, n, lost = (text or "").split("\n"), set(), len(words(text)), 0
    for x in lines:
        own = words(x)
        if not own:
            continue
        bad = x in seen or sum(c in "#*$%&|<>" for c in x) >= max(1, quality.SYMBOLS * len(own)) or x.count("!") >= max(2, quality.SHOUT * len(own)) or (len(own) < quality.SHORT_LINE and not closed(x))
        low = x.translate({i: i + 32 for i in range(65, 91)})
        bad |= any(p in low for p in quality.BOILERPLATE)
        seen.add(x)
        lost += len(own) * bad
    return not brute(text)[-1] and n - lost >= quality.KEEP_SHARE * n


def test_kept_by_brute_force(spark):
    good = " ".join(f"word{i}" for i in range(60))
    short = ["меню кот", "menu dû", "меню дома", "menu du", "menú…", "un « mot »", "ende.", "终。", "tools’", "x;", "мент", "Ц", "û", "æ"]
    rows = [(1000 + k, f"{good}\n" + "\n".join([f"{s} {j}" if j else s for j in range(1)]) + "\n" + "\n".join(f"{a} {s}" for a in "abcdefghijklmnopqrstuvwxyz"[:20] for _ in range(1) if a)) for k, s in enumerate(short)]
    rows += [(1100, f"{good}\nTous droits réservés par la société du site\n{good} autres"), (1101, f"{good}!\nWow! Wow! Wow!\n# $ %")]
    docs = documents(spark).unionByName(spark.createDataFrame(rows, "doc_id long, text string"), allowMissingColumns=True)
    got = quality.judge(docs).collect()
    assert sorted((str(r["doc_id"]), r["kept"]) for r in got) == sorted((str(d), brute_kept(t)) for d, t in texts() + rows)
    assert len({brute_kept(t) for _, t in rows}) == 2


def test_marks_are_code_points(spark):
    import numpy as np

    data = "т л û æ Ц Н … ” ’ » 。 . ) a".split()
    raw = np.frombuffer("".join(data).encode(), np.uint8)
    ends = np.cumsum([len(x.encode()) for x in data])
    assert quality._closed(raw, ends).tolist() == [x in quality.CLOSING for x in data]


def test_sql(spark):
    from compare import SF, agree

    from trivalent.llm.queries import OP6_SQL, op6_quality

    agree(op6_quality(spark, SF), OP6_SQL)


def test_lines(spark):
    good = " ".join(f"word{i}" for i in range(80)) + "."
    rows = [(1, good), (2, f"{good}\nClick here to subscribe to our letter today now.\nHome | Menu | Login"), (3, "\n".join(["a | b | c | d | e | f"] * 30)), (4, f"{good}\n{good}"), (5, None)]
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, n_chars long, n_words string")
    assert {r["doc_id"]: r["kept"] for r in quality.judge(df).collect()} == {1: True, 2: True, 3: False, 4: False, 5: False}
    got = {r["doc_id"]: r for r in quality.clean_documents(df, length_col="n_chars").collect()}
    assert got[1]["text"] == good and got[2]["text"] == good and got[2]["n_chars"] == len(good) and set(got) == {1, 2}
    assert quality.judge(spark.createDataFrame([], SCHEMA)).count() == 0
