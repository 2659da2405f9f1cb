"""Operator 10 against the library, and an exact round trip."""

import hashlib

import pytest
from fixtures import SCHEMA, documents, texts

from trivalent.llm import bpe

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def test_whole_table(spark):
    e = bpe._encoding(PATH, PATTERN)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    expected = sorted((str(d), len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())) for d, t in texts() for ids in [e.encode_ordinary(t or "")])
    assert sorted((str(r["doc_id"]), *r[1:]) for r in bpe.digests(documents(spark), PATH, PATTERN).collect()) == expected


def test_round_trip(spark):
    out = bpe.decode(bpe.encode(documents(spark), PATH, PATTERN), PATH).collect()
    assert sorted((str(r["doc_id"]), bytes(r["decoded"]).decode()) for r in out) == sorted((str(d), t or "") for d, t in texts())
    assert bpe.encode(spark.createDataFrame([], SCHEMA), PATH, PATTERN).count() == 0


def test_few_partitions_and_little_memory(spark, monkeypatch):
    rows = lambda: sorted(map(str, bpe.digests(documents(spark), PATH, PATTERN).collect()))
    expected = rows()
    monkeypatch.setattr(bpe, "MOST_PARTS", 3)
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    assert rows() == expected
