"""Byte-level BPE (operator 10) by a global shuffle of distinct words.

Texts are cut into pre-tokens by the pattern, with their positions; each distinct pre-token of the whole table
is encoded once, in the task of its hash partition; its ids are joined back to the batches of texts that
asked for it, and the texts' ids are put together by position (see ``lexicon``).  Decoding looks every id up in
the token-byte table, which is as large as the vocabulary whatever the input is.

A partition's words are read as a stream, so its size needs no bound and there are ``MOST_PARTS`` partitions at
most: a batch sends so many rows at most, and all rows grow with the input only.  A task remembers the ids of up to
``REMEMBERED`` words; a word beyond them is encoded each time that it comes, with the same ids.

The vocabulary is a public file of ranks whose path is a parameter; special tokens don't exist.

Defined results: null and empty texts have no ids and decode to no bytes; rows with equal or null ids are
encoded each for itself; an empty table gives an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import digest, parts_for
from .lexicon import WIDE_SCHEMA, by_partition, exchanged, record, records, rows_in, rows_out, spread, squeeze
from .words import bytes_hash

MOST_PARTS, REMEMBERED = 1 << 12, 1 << 20


@cache
def _pattern(text: str):
    import regex

    return regex.compile(text)


@cache
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@cache
def _encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=_ranks(path), special_tokens={})


@cache
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens' bytes, and each id's start and length in them."""
    by_id = {v: k for k, v in _ranks(path).items()}
    n = np.array([len(by_id.get(i, b"")) for i in range(max(by_id) + 1)], np.int64)
    data = b"".join(by_id.get(i, b"") for i in range(len(n)))
    return np.frombuffer(data, np.uint8), np.cumsum(n) - n, n


def ragged(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Indices start[i], start[i] + 1, ... of all runs."""
    total = np.cumsum(n)
    return np.arange(total[-1] if len(n) else 0) + np.repeat(start - (total - n), n)


def decode_ids(ids: np.ndarray, path: str) -> bytes:
    data, start, n = token_bytes(path)
    return data[ragged(start[ids], n[ids])].tobytes()


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", then: tuple[Callable[[pa.Table], pa.Table], str] | None = None) -> DataFrame:
    """id, n_tokens, ids (little-endian unsigned 32-bit): a row for each row of docs.

    ``then`` is a function of a batch of these rows and its schema after the id; it runs in the tasks that put the ids
    together, so that ids which are only needed there don't leave them.
    """
    parts = parts_for(docs, text_col, most=MOST_PARTS)

    def cut(b: pa.RecordBatch, batch: int) -> list[tuple]:
        find, known, counts, at = _pattern(pattern).findall, {}, [], []
        for text in b.column("text").to_pylist():
            words = find(text) if text else []
            counts.append(len(words))
            at += [known.setdefault(w, len(known)) for w in words]
        words, at = [w.encode() for w in known], np.array(at, np.uint32)
        rank = np.empty(len(words), np.uint32)
        rank[np.argsort(-np.bincount(at, minlength=len(words)), kind="stable")] = np.arange(len(words), dtype=np.uint32)
        # words go out by partition, in order of their bytes; the batch keeps the ranks in that order
        groups = [(p, sorted(g.tolist(), key=words.__getitem__)) for p, g in by_partition(bytes_hash(words), parts)] if words else []
        sent = np.array([i for _, g in groups for i in g], np.int64)
        info = pa.RecordBatch.from_arrays([b.column("id"), pa.array(counts, pa.int64())], ["id", "n"])
        mark = digest(b, "text").to_bytes(8, "little", signed=True)  # of the batch as it was read; answers carry it back
        out, first = [record(-1, batch, rows_out(info), squeeze(rank[at]), mark + squeeze(rank[sent]))], 0
        for p, g in groups:
            n = np.array([len(words[i]) for i in g], np.uint32)
            out.append(record(p, batch, squeeze(np.frombuffer(b"".join(words[i] for i in g), np.uint8)), squeeze(n), first.to_bytes(8, "little") + mark))
            first += len(g)
        return out

    table = exchanged(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), cut)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, ids_of = _encoding(path, pattern).encode_ordinary, {}
        for b in batches:
            out = []
            for row in b.to_pylist() if b.num_rows and b.column("p")[0].as_py() >= 0 else []:
                data, n = spread(row["a"], np.uint8).tobytes(), spread(row["b"], np.uint32).astype(np.int64)
                ends, found = np.cumsum(n).tolist(), []
                for e, k in zip(ends, n.tolist(), strict=True):
                    w = data[e - k : e]
                    ids = ids_of.get(w)
                    if ids is None:
                        ids = np.array(one(w.decode()), np.uint32).tobytes()
                        if len(ids_of) < REMEMBERED:
                            ids_of[w] = ids
                    found.append(ids)
                size = np.array([len(x) // 4 for x in found], np.uint32)
                out.append(record(-1 - row["batch"], row["batch"], squeeze(np.frombuffer(b"".join(found), np.uint32)), squeeze(size), row["c"]))
            yield records(out, pa.int64())

    answers = table.groupBy("p").applyInArrow(settle, WIDE_SCHEMA)

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        own, back = left.to_pylist(), sorted(right.to_pylist(), key=lambda r: int.from_bytes(r["c"][:8], "little"))
        if len(own) != 1:
            raise RuntimeError(f"{len(own)} rows of one batch")
        if any(r["c"][8:] != own[0]["c"][:8] for r in back):
            raise RuntimeError("the input gave other batches when it was read again; write it as a table first")
        info, at, sent = rows_in(own[0]["a"]), spread(own[0]["b"], np.uint32), spread(own[0]["c"][8:], np.uint32)
        ids = np.concatenate([np.zeros(0, np.uint32), *(spread(r["a"], np.uint32) for r in back)])
        size = np.concatenate([np.zeros(0, np.uint32), *(spread(r["b"], np.uint32) for r in back)]).astype(np.int64)
        if len(size) != len(sent):
            raise RuntimeError(f"{len(size)} of {len(sent)} words came back")
        n, start = np.zeros(len(sent), np.int64), np.zeros(len(sent), np.int64)
        n[sent], start[sent] = size, np.cumsum(size) - size
        flat = ids[ragged(start[at], n[at])]
        off = np.concatenate([[0], np.cumsum(n[at])])[np.concatenate([[0], np.cumsum(info.column("n").to_numpy())])]
        out = pa.table({id_col: info.column("id"), "n_tokens": pa.array(np.diff(off), pa.int64()), "ids": pa.array([flat[a:b].astype("<u4").tobytes() for a, b in zip(off[:-1], off[1:], strict=True)], pa.binary())})
        return then[0](out) if then else out

    kind = docs.schema[id_col].dataType
    schema = f"`{id_col}` {kind.simpleString()}, {then[1] if then else 'n_tokens long, ids binary'}"
    # p of batch rows is -1 at most; compared with a random number in (-1, 0], and without a null to infer, the filter stays
    # above the exchange, which is reused
    own_rows = table.where(F.coalesce("p", F.lit(0)) < -F.rand(0))
    return own_rows.groupBy("p").cogroup(answers.groupBy("p")).applyInArrow(assemble, schema)


def decoded(t: pa.Table, path: str) -> list[bytes]:
    return [decode_ids(np.frombuffer(x or b"", "<u4").astype(np.int64), path) for x in t.column("ids").to_pylist()]


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded with ``decoded``, the bytes of its ids; no shuffle."""

    def run(batches):
        for b in batches:
            yield b.append_column("decoded", pa.array(decoded(b, path), pa.binary()))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{fields}, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256 and decoded_sha256 (of the bytes that the ids decode to) of every text."""
    sha = lambda values: pa.array([hashlib.sha256(v).hexdigest() for v in values], pa.string())

    def shape(t: pa.Table) -> pa.Table:
        decimal = (",".join(map(str, np.frombuffer(x, "<u4").tolist())).encode() for x in t.column("ids").to_pylist())
        return t.drop_columns(["ids"]).append_column("ids_sha256", sha(decimal)).append_column("decoded_sha256", sha(decoded(t, path)))

    return encode(docs, path, pattern, id_col, text_col, (shape, "n_tokens long, ids_sha256 string, decoded_sha256 string"))
