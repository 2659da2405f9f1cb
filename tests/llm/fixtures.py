"""Small tables with every odd case: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside.
CLASHING = ("id", "n", "p", "batch", "band", "key", "rank", "length", "piece", "bucket", "a", "b", "next_text", "verdict", "record", "turns")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, lower=False):
    return WORD.findall((text or "").translate(LOWER) if lower else text or "")


def texts(seed: int = 1) -> list[tuple[int | None, str | None]]:
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéßñ") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    out: list[tuple[int | None, str | None]] = [(k, ". ".join(prose(12).capitalize() for _ in range(rng.randint(3, 14))) + ".") for k in range(40)]
    base, passage = out[3][1], prose(70)
    for k in range(40, 52):  # near copies of one text
        w = base.split()
        w[rng.randrange(len(w))] = prose(1)
        out.append((k, " ".join(w)))
    out += [(k, base) for k in range(52, 60)]  # exact copies
    out += [(k, f"{prose(30)}\n{passage}\n{prose(20)}") for k in range(60, 66)]  # a shared passage
    out += [(66, None), (67, ""), (68, " \t\n\x0b "), (69, "one two three"), (70, "One TWO three"), (71, "x" * 60_000), (72, prose(9000)), (73, "😀 é́ ß \u00a0 nbsp\u2003em"), (74, "a" + "\n" * 50 + "b")]
    out += [(75, "the same row"), (75, "the same row"), (75, "the same id"), (None, "no id"), (None, None), (-5, passage)]
    out += [(80, "mail a.b+c@x-y.example.com, b@c; 1.2.3.4 300.1.1.1 and 4111 1111 1111 1111. +1 (887) 555-1668 then 555-1668"), (81, "4003845627459628 12 and again 4003845627459628"), (82, "@" * 300 + "1" * 5000 + "." * 50)]
    return out


def documents(spark, seed: int = 1, extra: bool = True):
    from pyspark.sql import functions as F

    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in texts(seed)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.select("*", *(F.lit(1).alias(c) for c in CLASHING)) if extra else df
