"""Quality rules (operator 6): lines are judged first, failing lines go, then texts that lose too much.

Rules for a line that has a word; each is evaluated for every line of the whole text:

* punctuation: no closing mark at its end and fewer than ``SHORT_LINE`` words, or shouting
  (``SHOUT`` exclamation marks a word or more);
* navigation: ``SYMBOLS`` symbols ``#*$%&|<>`` a word or more (menus, bars of links, stuffed marks);
* boilerplate: it contains one of ``BOILERPLATE``, or it equals an earlier line of the text.

A text is rejected when fewer than ``KEEP_SHARE`` of its words are left, when it has fewer than 50
words, or when over half of its words lie in three-word windows that the text has twice or more.

Null and empty texts have zero counts and are rejected.  Repeated rows are judged each for itself;
rows keep their other columns in ``clean_documents``.  Lines are cut at ``\\n``, compared by 64-bit
hash and length.  A mark counts as a whole code point, not by its last byte.

An empty table gives an empty table; ``judge`` leaves other columns out, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import CODE_POINT, SPACE, Words, repeats, slices, sums

SHORT_LINE = 5
SHOUT = 0.5
SYMBOLS = 0.3
KEEP_SHARE = 0.5
MIN_WORDS = 50
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of service", "terms of use", "use cookies",
    "javascript is disabled", "enable javascript", "licensed under", "license agreement", "lorem ipsum",
    "subscribe to our", "click here", "skip to content", "sign in to",
    "tous droits réservés", "politique de confidentialité", "mentions légales", "conditions d'utilisation", "cliquez ici", "abonnez-vous",
    "alle rechte vorbehalten", "datenschutzerklärung", "allgemeine geschäftsbedingungen", "nutzungsbedingungen", "hier klicken", "zum inhalt springen",
    "todos los derechos reservados", "política de privacidad", "aviso legal", "condiciones de uso", "haga clic aquí", "suscríbete",
)
#: Marks that close a line.
CLOSING = ".!?:;\"')]…”’»。"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
# the last byte of a mark, and the marks of several bytes that end in it
_LAST = np.zeros(256, bool)
_LAST[[c.encode()[-1] for c in CLOSING if ord(c) < 128]] = True
_LONG = [tuple(reversed(c.encode())) for c in CLOSING if ord(c) > 127]
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _closed(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether the code point before each end is a closing mark."""
    out = _LAST[data[ends - 1]] if len(ends) else np.zeros(0, bool)
    for mark in _LONG:
        out |= np.logical_and.reduce([(ends > k) & (data[np.maximum(ends - 1 - k, 0)] == byte) for k, byte in enumerate(mark)])
    return out


def _judge(w: Words) -> tuple[dict[str, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    data, n_words = w.data, w.counts()
    hashes = w.hashes()
    out = {"n_words": n_words, "word_chars": w.per_text(CODE_POINT[data] & ~SPACE[data]), "n_symbols": w.per_text(_SYMBOL[data])}
    at, h3 = w.windows(hashes, 3)
    twice = np.zeros(len(hashes) + 2, bool)
    twice[at] = repeats(w.doc()[at], h3)[0]
    covered = twice.copy()
    covered[1:] |= twice[:-1]
    covered[2:] |= twice[:-2]
    out["n_repeat_words"] = sums(covered[: len(hashes)], w.off)
    # lines: a text's last one ends where the text does
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([w.text_off[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([breaks, w.text_off[1:]]), kind="stable")
    doc = np.searchsorted(w.text_off, starts, "right") - 1
    # an empty text's line starts where the next text does: order decides which text owns it
    owner = np.concatenate([np.arange(w.n), np.searchsorted(w.text_off, breaks, "right") - 1])
    begun = np.concatenate([w.text_off[:-1], breaks + 1])
    order = np.lexsort((begun, owner))
    doc, starts = owner[order], begun[order]
    owner = np.concatenate([np.searchsorted(w.text_off, breaks, "right") - 1, np.arange(w.n)])
    ended = np.concatenate([breaks, w.text_off[1:]])
    ends = ended[np.lexsort((ended, owner))]
    lo, hi = np.searchsorted(w.starts, starts), np.searchsorted(w.starts, ends)
    words = hi - lo
    full = words > 0
    dup = np.zeros(len(starts), bool)
    dup[full] = repeats(doc[full], w.byte_hash(starts[full], ends[full]))[1]
    out["n_dup_lines"] = np.bincount(doc[dup], minlength=w.n)
    symbol, shout = (np.concatenate([[0], np.cumsum(x)]) for x in (_SYMBOL[data], data == 33))
    bad = dup.copy()
    bad |= symbol[ends] - symbol[starts] >= np.maximum(1, SYMBOLS * words)
    bad |= shout[ends] - shout[starts] >= np.maximum(2, SHOUT * words)
    short = np.flatnonzero(full & (words < SHORT_LINE))
    bad[short] |= ~_closed(data, w.ends[hi[short] - 1])
    low = bytes(data).lower()
    for phrase in BOILERPLATE:
        p, at = phrase.encode(), -1
        while (at := low.find(p, at + 1)) >= 0:
            k = np.searchsorted(starts, at, "right") - 1
            bad[k] |= at + len(p) <= ends[k]
    bad &= full
    left = n_words - np.bincount(doc[bad], weights=words[bad], minlength=w.n).astype(np.int64)
    out["base_failed"] = (n_words < MIN_WORDS) | (100 * out["n_repeat_words"] > 50 * n_words)
    out["kept"] = ~out["base_failed"] & (left >= KEEP_SHARE * n_words)
    return out, (doc, starts, np.where(bad, -1, ends))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base counts, base_failed and kept, a row for each row of docs; no shuffle."""

    def run(batches):
        for b in slices(batches, "text"):
            out, _ = _judge(Words(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(out[c].astype(np.int64)) for c in BASE), *(pa.array(out[c]) for c in ("base_failed", "kept"))], ["id", *BASE, "base_failed", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, " + ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, kept boolean"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def clean_documents(docs: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """Rows of docs that are kept, with the failing lines cut out of their texts; columns as they were.

    Texts without a failing line stay byte for byte; length_col, if given, is set to the new length.
    """
    names = docs.columns

    def run(batches):
        for b in slices(batches, text_col):
            w = Words(b.column(text_col))
            out, (doc, starts, ends) = _judge(w)
            rows = np.flatnonzero(out["kept"])
            raw, touched, first = bytes(w.data), np.bincount(doc[ends < 0], minlength=w.n) > 0, np.searchsorted(doc, np.arange(w.n + 1))
            texts = []
            for i in rows:
                if touched[i]:
                    texts.append("\n".join(raw[s:e].decode() for s, e in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]], strict=True) if e >= 0))
                else:
                    texts.append(raw[w.text_off[i] : w.text_off[i + 1]].decode())
            keep = b.take(pa.array(rows))
            cols = {c: keep.column(c) for c in names}
            cols[text_col] = pa.array(texts, b.schema.field(text_col).type)
            if length_col:
                cols[length_col] = pa.array([len(t) for t in texts], b.schema.field(length_col).type)
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return docs.mapInArrow(run, docs.schema)
