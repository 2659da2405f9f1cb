"""Operator 4 against its SQL, and the cascade against a set."""

import re

import numpy as np
from compare import SF, agree
from pyspark.sql import functions as F

from trivalent.llm import urls
from trivalent.llm.queries import OP4_SQL, op4_urls


def test_sql(spark):
    agree(op4_urls(spark, SF), OP4_SQL)


def test_odd_urls(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "http://A.Example.NET/en/x"), (5, "http://example.net?q"), (6, "http://x.net#a"), (7, "http://net/"), (8, "http://x.org/fr/a?b=/de/"), (9, "http://b.example.com/de/\n"), (None, "http://notexample.com/de/"), (4, "http://A.Example.NET/en/x"), (12, "x://a.net://b/")]
    got = urls.judge(spark.createDataFrame([(i, u, "x", "y") for i, u in rows], "page_id long, url string, id string, rule string")).collect()
    answer = {(r["page_id"], r["host"]): (r["path"], r["rule"], r["verdict"]) for r in got}
    assert len(got) == len(rows)
    assert answer[1, ""] == answer[2, ""] == answer[3, ""] == ("", None, "allow")
    assert answer[4, "a.example.net"] == ("/en/x", "example.net/en/", "allow")
    assert answer[5, "example.net"] == ("", None, "allow") and answer[7, "net"] == ("/", "net/", "block")
    assert answer[8, "x.org"] == ("/fr/a", "org/fr/", "allow") and answer[9, "b.example.com"] == ("/de/\n", "example.com/de/", "block")
    assert answer[None, "notexample.com"] == ("/de/", None, "allow")
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_cascade_is_exact(spark):
    urls_ = spark.range(3000).select(F.concat(F.lit("h"), "id", F.lit(".example.org")).alias("host"), F.concat(F.lit("/p"), F.col("id") % 7, F.lit("/x")).alias("path"))
    every = urls.universe(urls_.select(urls.keys_of(F.col("host"), F.col("path"), [4], 3).alias("keys")))
    keys = [(r["key"], (r["a"], r["b"])) for r in every.collect()]
    listed = [k for k, _ in keys if re.match("h[0-9]", k) and int(k[1 : k.index(".")]) % 17 == 0]
    cascade = urls.build(every, listed)
    assert (cascade.has(urls._matrix(h for _, h in keys)) == np.isin([k for k, _ in keys], listed)).all()
    assert len(cascade.levels) > 1 and len(listed) > 100


def test_long_hosts_and_many_rules(spark):
    """A host of thousands of labels costs no more than rules have; many rules against loops."""
    rules = [(f"s{k}.d{k % 9}.com", f"/{'ab'[k % 2]}", "block" if k % 3 else "allow") for k in range(300)] + [("com", "/", "allow")]
    rows = [(k, f"http://x.s{k}.d{k % 9}.com/{'abc'[k % 3]}/z?q") for k in range(400)] + [(1000, "http://" + "a." * 20_000 + "s1.d1.com/b"), (1001, "http://com"), (1002, "http://.../a")]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), rules=rules, otherwise="block").collect()}
    for i, u in rows:
        rest = u[7:].split("?")[0]
        host, path = (rest.split("/")[0], "/" + "/".join(rest.split("/")[1:])) if "/" in rest else (rest, "")
        fit = [(len(h + p), h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert got[i] == (max(fit)[1:] if fit else (None, "block")), u[:60]
