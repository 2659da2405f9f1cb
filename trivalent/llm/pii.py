r"""Personal data (operator 5): patterns, and a skip-chain conditional random field over the tokens that could hold some.

Base spans are the matches of the four patterns below, leftmost and not overlapping in their kind; a match
that fails its test (ip parts, card checksum, number of digits) is dropped.

The field has a node for each word with a digit or an ``@`` (no other word can carry an entity label: it is
clamped to "none" and so cuts the chain) and the labels none, and begin and inside of email, ip, card and
phone; inside follows begin or inside of its kind only.  Words that a base span covers are observed.
Neighbouring nodes share a chain potential.  Nodes of a text that repeat or resemble each other, however far
apart, share a skip potential with the next such node and with the first one, or the first observed one: words
with the same address, and words of the same digits' places in numbers with the same last seven digits, be
a number one word or a run of neighbouring ones.  Other repeated words share a weaker potential ``echo`` in
the same way, which has no prior leaning.  Loopy messages run for
``ROUNDS`` rounds; runs of unobserved words whose likeliest label is an entity with a marginal of at least
``SURE`` become spans.  Base spans always stay.

Weights are fitted by pseudo-likelihood to the whole table: its nodes are counted by (shape, labels of
neighbours, kinds of the nodes like it, label), with one small shuffle of counts.  The weights are as many whatever the input
is; a step along the gradient sums it over that table, which the driver holds up to ``LOCAL_ROWS`` rows, and beyond
which executors sum a row a weight.  Both give the same weights but for the rounding of sums.  Skip weights lean to ``AGREE`` where
the corpus has few repeats.  A label that no observed word of a shape has is ``UNSEEN`` below none: such a
word becomes an entity by what its like elsewhere in the text is, not by itself.

Two scans of the texts, no shuffle of texts.  Defined results: null and empty texts have no spans; rows
are judged each for itself, repeated ones alike; an empty table gives an empty table and is fitted to
nothing; other columns stay as they are in ``mask``.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written
from .words import CODE_POINT, Words, slices, sums

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *(f"{place} {k}" for place in ("begin", "inside") for k in KINDS))
NONE, ABSENT, INSIDE = 0, len(LABELS), 1 + len(KINDS)
#: Each label's kind, from 1; 0 for none.
KIND = np.array([0, *range(1, INSIDE), *range(1, INSIDE)])
#: The kind of no node.
APART = INSIDE
#: Set by hand: how sure an added span must be, what the weights of the nodes like it lean to, and what a label not seen of a shape costs.
ROUNDS, SURE, AGREE, UNSEEN = 6, 0.6, 6.0, 3.0
#: Counted rows whose gradient the driver sums by itself; steps along the gradient, their length, and how weights are held to what they lean to.
LOCAL_ROWS, STEPS, RATE, RIDGE = 300_000, 400, 5.0, 1e-4
#: Messages that are worked out at once.
CHUNK = 1 << 14
#: What may follow what; the last row is the start of a run of nodes.
BARRED = np.zeros((ABSENT + 1, ABSENT))
for _k in range(INSIDE, ABSENT):
    BARRED[:, _k] = np.where(np.append(KIND, -1) == KIND[_k], 0.0, -30.0)

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
# a run of digits that fails at its start fails at every place in it, so searches start at runs only
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_INTEREST = np.zeros(256, bool)
_INTEREST[[*range(48, 58), 64]] = True


def _emails(text: str):
    done = 0
    for m in _DOMAIN.finditer(text):
        start = at = m.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            done = m.end()
            yield start, done


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by kind and start."""
    out = [(0, s, e) for s, e in _emails(text)] if "@" in text else []
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p := x.lstrip("0")) < 4 and int(p or 0) < 256 for x in m[0].split("."))]
    out += [(2, *m.span()) for m in _CARD.finditer(text) if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15] if "+" in text else []
    return out


def shape(word: str) -> tuple[int, ...]:
    """Categorical features of a word; the last is the number of digits in classes."""
    digits = _digits(word)
    at = word.find("@")
    return (
        int(at >= 0) + int(0 <= at < word.rfind(".")),
        min(3, word.count(".")),
        int(any(c.isalpha() for c in word)),
        int(word[0] == "+"),
        int("(" in word or ")" in word),
        int("-" in word),
        int(13 <= len(digits) <= 19 and luhn(digits)) + 2 * int(word.count(".") >= 3 and all(len(p.lstrip("0")) < 4 and int(p or 0) < 256 for p in map(_digits, word.split(".")))),
        int(np.searchsorted([1, 4, 7, 9, 12, 13, 20], len(digits), "right")),
    )


SIZES = (3, 4, 2, 2, 2, 2, 4, 8)
SHAPES = int(np.prod(SIZES))


def code(features: tuple[int, ...]) -> int:
    out = 0
    for f, n in zip(features, SIZES, strict=True):
        out = out * n + f
    return out


def decode(codes: np.ndarray) -> list[np.ndarray]:
    out = []
    for n in reversed(SIZES):
        codes, f = np.divmod(codes, n)
        out.append(f)
    return out[::-1]


#: Digits that make numbers alike, and the longest number of any kind.
ALIKE, LONGEST = 7, 19
_EDGES = "<>()[]\"'.,;:!?"


def address_key(word: str) -> str | None:
    local = word[: word.index("@")].strip(_EDGES).lower()
    return f"{local}@" if local else None


class Nodes:
    """Candidate words of a slice of texts, with observed labels, chain neighbours and skip edges."""

    def __init__(self, column: pa.Array):
        w = Words(column)
        mask = _INTEREST[w.data]
        total = np.concatenate([[0], np.cumsum(mask)])
        word = np.flatnonzero(total[w.ends] > total[w.starts])
        self.row = np.searchsorted(w.off, word, "right") - 1
        points = np.concatenate([[0], np.cumsum(CODE_POINT[w.data])])
        base = points[w.text_off[self.row]]
        self.start, self.end = points[w.starts[word]] - base, points[w.ends[word]] - base
        n = len(word)
        self.next_to = np.zeros(n, bool)  # the node before is the word before
        if n:
            self.next_to[1:] = (word[1:] == word[:-1] + 1) & (self.row[1:] == self.row[:-1])
        raw = bytes(w.data)
        self.words = [raw[s:e].decode() for s, e in zip(w.starts[word].tolist(), w.ends[word].tolist(), strict=True)]
        self.shape = np.array([code(shape(x)) for x in self.words], np.int64)
        self.spans: dict[int, list[tuple[int, int, int]]] = {}
        self.label = np.full(n, NONE)
        self.seen = np.zeros(n, bool)
        for i in np.flatnonzero(sums(mask, w.text_off)).tolist():
            spans = base_spans(raw[w.text_off[i] : w.text_off[i + 1]].decode())
            if spans:
                self.spans[i] = spans
                lo, hi = np.searchsorted(self.row, [i, i + 1])
                for k, s, e in reversed(spans):
                    a, b = lo + np.searchsorted(self.end[lo:hi], s, "right"), lo + np.searchsorted(self.start[lo:hi], e)
                    self.label[a:b], self.seen[a:b] = k + INSIDE, True
                    self.label[a : a + 1] = k + 1
        self._skip()

    def _skip(self) -> None:
        """Edges (a, b), a < b, of either kind, and each node's anchor: the first observed, else the first node like it."""
        rows, joined, digits = self.row.tolist(), self.next_to.tolist(), [_digits(x) for x in self.words]
        part = ["@" not in x and not any(c.isalpha() for c in x) for x in self.words]
        before = [i - 1 if i and joined[i] and part[i] and part[i - 1] else -1 for i in range(len(part))]
        addresses: dict[tuple[int, str], list[int]] = {}
        numbers: dict[tuple[int, str], list[int]] = {}
        same: dict[tuple[int, str], list[int]] = {}
        for i, (r, x) in enumerate(zip(rows, self.words, strict=True)):
            if "@" in x:
                if key := address_key(x):
                    addresses.setdefault((r, key), []).append(i)
                continue
            tail, j = digits[i][-ALIKE:], before[i]
            while len(tail) < ALIKE and j >= 0:
                tail, j = (digits[j] + tail)[-ALIKE:], before[j]
            if len(tail) == ALIKE:
                numbers.setdefault((r, tail), []).append(i)
            if len(digits[i]) < ALIKE:
                same.setdefault((r, x.strip(_EDGES).lower()), []).append(i)

        def backwards(i: int):
            left = LONGEST
            while i >= 0 and left > 0:
                for c in reversed(digits[i][-left:]):
                    yield c, i
                left -= len(digits[i])
                i = before[i]

        def places(i: int, j: int):
            """Pairs of words that have the same digits in the numbers that end with the words i and j."""
            shared: dict[tuple[int, int], int] = {}
            for (c, a), (d, b) in zip(backwards(i), backwards(j)):  # noqa: B905  one may be longer
                if c != d:
                    break
                shared[a, b] = shared.get((a, b), 0) + 1
            return [p for p, n in shared.items() if p[0] != p[1] and n >= min(ALIKE, (min(len(digits[p[0]]), len(digits[p[1]])) + 1) // 2)]

        def start(i: int) -> int:
            n = len(digits[i])
            while n < ALIKE:
                i = before[i]
                n += len(digits[i])
            return i

        def first_of(g: list[int]) -> int:
            return next((i for i in g if self.seen[i]), g[0])

        def linked(pairs) -> np.ndarray:
            return np.array(sorted({(min(p), max(p)) for p in pairs}), np.int64).reshape(-1, 2)

        # a node takes one edge to a first node and one to the node before: as many edges as nodes, not as pairs
        to_first: dict[int, int] = {}
        to_before: dict[int, int] = {}
        for g in addresses.values():
            first = first_of(g)
            to_first.update((i, first) for i in g if i != first)
            to_before.update(zip(g[1:], g[:-1], strict=True))
        # observed numbers first, and long runs from their ends
        for g in sorted((g for g in numbers.values() if len(g) > 1), key=lambda g: (not self.seen[first_of(g)], -g[-1])):
            first = first_of(g)
            for i in g:
                lo = start(i)
                if first < lo or i < start(first):
                    for a, b in places(first, i):
                        to_first.setdefault(b, a)
                if n := bisect_left(g, lo):
                    for a, b in places(g[n - 1], i):
                        to_before.setdefault(b, a)
        self.edges = linked([*to_first.items(), *to_before.items()])
        known = set(map(tuple, self.edges.tolist()))
        echo: set[tuple[int, int]] = set()
        for g in same.values():
            if len(g) > 1:
                first = first_of(g)
                echo.update(zip(g[:-1], g[1:], strict=True))
                echo.update((min(first, i), max(first, i)) for i in g if i != first)
        self.echoes = linked(echo - known)
        self.anchor, self.echo_anchor = self._anchors(self.edges), self._anchors(self.echoes)

    def _anchors(self, edges: np.ndarray) -> np.ndarray:
        """Each node's first observed partner, else its first one; -1 without any."""
        n = len(self.words)
        node, partner = np.concatenate([edges, edges[:, ::-1]]).T
        out = np.full(n, 2 * n)
        np.minimum.at(out, node, partner + n * ~self.seen[partner])
        return np.where(out == 2 * n, -1, out % max(n, 1))


def _count_rows(batches):
    for b in slices(batches, "text"):
        n = Nodes(b.column("text"))
        if len(n.words):
            before = np.where(n.next_to, np.roll(n.label, 1), ABSENT)
            after = np.where(np.roll(n.next_to, -1) & (np.arange(len(n.words)) < len(n.words) - 1), np.roll(n.label, -1), ABSENT)
            skip = np.where(n.anchor >= 0, KIND[n.label[n.anchor]], APART)
            echo = np.where(n.echo_anchor >= 0, KIND[n.label[n.echo_anchor]], APART)
            rows, count = np.unique(np.stack([n.shape, before, after, skip, echo, n.label]), axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in rows), pa.array(count)], [*_COUNTED, "n"])


_COUNTED = ("shape", "before", "after", "skip", "echo", "label")


class Field:
    """Weights: unary by feature and by whole shape, chain, and skip and echo by kind."""

    def __init__(self):
        k = len(LABELS)
        self.bias = np.zeros(k)
        self.shapes = np.zeros((SHAPES, k))
        self.features = [np.zeros((n, k)) for n in SIZES]
        self.chain = np.zeros((k + 1, k))
        self.skip = np.diag([0.0] + [AGREE] * len(KINDS))
        self.echo = np.zeros((1 + len(KINDS), 1 + len(KINDS)))
        #: Labels that no observed word of a shape has.
        self.unseen = np.tile(np.arange(k) != NONE, (SHAPES, 1))

    def unary(self, codes: np.ndarray) -> np.ndarray:
        out = self.bias + sum(f[x] for f, x in zip(self.features, decode(codes), strict=True)) + self.shapes[codes]
        return np.where(self.unseen[codes], out[:, NONE : NONE + 1] - UNSEEN, out)

    def weights(self) -> list[np.ndarray]:
        return [self.bias, self.shapes, *self.features, self.chain, self.skip, self.echo]

    def step(self, gradient: np.ndarray) -> None:
        """Changes all weights along their gradient, one vector in the order of ``weights``."""
        ends = np.cumsum([w.size for w in self.weights()])
        leans = {id(self.skip): np.diag([0.0] + [AGREE] * len(KINDS)), id(self.echo): 0.0}
        for w, g in zip(self.weights(), np.split(gradient, ends[:-1]), strict=True):
            g = g.reshape(w.shape)
            if id(w) in leans:  # of pairs without an order
                w += RATE * (g + g.T) / 2 - RATE * RIDGE * (w - leans[id(w)])
            else:
                w += RATE * g - (0.0 if w is self.bias else RATE * RIDGE * w)

    def marginals(self, nodes: Nodes) -> np.ndarray:
        """Loopy belief propagation; observed nodes have their labels."""
        n, k = len(nodes.words), len(LABELS)
        unary = self.unary(nodes.shape)
        unary[~nodes.next_to] += (self.chain + BARRED)[ABSENT]
        clamp = np.where(np.eye(k, dtype=bool)[nodes.label], 0.0, -1e9)
        unary[nodes.seen] = clamp[nodes.seen]
        b = np.flatnonzero(nodes.next_to)
        links = (np.stack([b - 1, b], axis=1), nodes.edges, nodes.echoes)
        left, right = np.concatenate(links).T
        chain = (self.chain + BARRED)[:k]
        alike = [((w + w.T) / 2)[KIND][:, KIND] for w in (self.skip, self.echo)]
        tables = np.stack([chain, *alike, chain.T, *alike])
        form = np.repeat(np.arange(3), [len(x) for x in links])
        source, target, form = np.concatenate([left, right]), np.concatenate([right, left]), np.concatenate([form, form + 3])
        twin = np.concatenate([np.arange(len(left)) + len(left), np.arange(len(left))])
        message = np.zeros((len(source), k))
        for _ in range(ROUNDS if len(source) else 0):
            belief = unary.copy()
            np.add.at(belief, target, message)
            old, message = message, np.empty_like(message)
            for lo in range(0, len(source), CHUNK):
                c = slice(lo, lo + CHUNK)
                s = (belief[source[c]] - old[twin[c]])[:, :, None] + tables[form[c]]
                top = s.max(axis=1)
                message[c] = top + np.log(np.exp(s - top[:, None, :]).sum(axis=1))
            message -= message.max(axis=1, keepdims=True)
        belief = unary.copy()
        if len(source):
            np.add.at(belief, target, message)
        p = np.exp(belief - belief.max(axis=1, keepdims=True)) if n else belief
        return p / p.sum(axis=1, keepdims=True) if n else p

    def spans(self, nodes: Nodes) -> dict[int, list[tuple[int, int, int]]]:
        """Base spans and added ones of each row that has any, by kind and start."""
        p = self.marginals(nodes)
        out = {i: list(s) for i, s in nodes.spans.items()}
        best = p.argmax(axis=1) if len(p) else np.zeros(0, int)
        new = np.flatnonzero((best != NONE) & ~nodes.seen & (1 - p[:, NONE] >= SURE)) if len(p) else best
        runs: list[list[int]] = []
        for i in new.tolist():
            if runs and nodes.next_to[i] and runs[-1][-1] == i - 1 and best[i] >= INSIDE and KIND[best[i - 1]] == KIND[best[i]]:
                runs[-1].append(i)
            else:
                runs.append([i])
        for run in runs:
            first, last = nodes.words[run[0]], nodes.words[run[-1]]
            s = nodes.start[run[0]] + len(first) - len(first.lstrip("\"'<[{,;:"))
            e = nodes.end[run[-1]] - len(last) + len(last.rstrip("\"'>]},;:.!?"))
            if s < e:
                out.setdefault(int(nodes.row[run[0]]), []).append((int(KIND[best[run[0]]]) - 1, int(s), int(e)))
        return {i: sorted(s) for i, s in out.items()}


class Counted:
    """Counted nodes (rows of _COUNTED and n, which weigh 1 + log n of total), and the gradient of their pseudo-likelihood."""

    def __init__(self, counts: np.ndarray, total: float):
        self.shape, self.before, after, skip, echo, label, n = counts.T
        self.weight, self.truth = ((1 + np.log(n)) / total)[:, None], np.eye(len(LABELS))[label]
        self.parts = decode(self.shape)
        self.after, self.has_after = np.where(after == ABSENT, 0, after), (after != ABSENT)[:, None]
        self.far = [((x != APART)[:, None], np.where(x == APART, 0, x)) for x in (skip, echo)]

    def gradient(self, field: Field) -> np.ndarray:
        k, kinds = len(LABELS), len(KINDS) + 1
        chain, of_kind = field.chain + BARRED, np.eye(kinds)[KIND]
        s = field.bias + field.shapes[self.shape] + sum(f[x] for f, x in zip(field.features, self.parts, strict=True)) + chain[self.before] + self.has_after * chain[:k].T[self.after]
        s += sum(has * w[kind][:, KIND] for w, (has, kind) in zip((field.skip, field.echo), self.far, strict=True))
        p = np.exp(s - s.max(axis=1, keepdims=True))
        d = (self.truth - p / p.sum(axis=1, keepdims=True)) * self.weight

        def at(index: np.ndarray, size: int, d: np.ndarray = d) -> np.ndarray:
            return np.stack([np.bincount(index, d[:, j], size) for j in range(d.shape[1])], axis=1)

        pairs = at(self.before, k + 1)
        pairs[:k] += at(self.after, k, d * self.has_after).T
        out = [d.sum(axis=0), at(self.shape, SHAPES), *(at(x, n) for x, n in zip(self.parts, SIZES, strict=True)), pairs]
        return np.concatenate([x.ravel() for x in (*out, *(at(kind, kinds, d * has @ of_kind) for has, kind in self.far))])


def _summed(table: DataFrame, field: Field, total: float) -> np.ndarray:
    """The gradient over a table of counted rows: each partition's, added up by weight."""
    size = sum(w.size for w in field.weights())

    def run(batches):
        out = np.zeros(size)
        for b in batches:
            out += Counted(np.stack([c.to_numpy() for c in b.columns], axis=1), total).gradient(field)
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(out[at])], ["at", "value"])

    sums = table.mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(size)
    out[sums.column("at").to_numpy()] = sums.column("value").to_numpy()
    return out


def fit(docs: DataFrame, text_col: str = "text", steps: int = STEPS) -> Field:
    """By gradient ascent of the pseudo-likelihood of the whole table."""
    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(_count_rows, ", ".join(f"{c} long" for c in (*_COUNTED, "n")))
    table = written(counted.groupBy(*_COUNTED).agg(F.sum("n").alias("n")), "shapes")
    size = table.agg(F.count("*").alias("rows"), F.sum(1 + F.log("n")).alias("weight")).first()
    field = Field()
    if not size["rows"]:
        return field
    own = None
    if size["rows"] <= LOCAL_ROWS:
        own = Counted(np.array(sorted(tuple(r) for r in table.collect()), np.int64), size["weight"])
    # as many pairs as weights at most
    seen = np.array([tuple(r) for r in table.select("shape", "label").distinct().collect()], np.int64)
    for _ in range(steps):
        field.step(own.gradient(field) if own else _summed(table, field, size["weight"]))
    field.unseen[seen[:, 0], seen[:, 1]] = False
    return field


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None) -> DataFrame:
    """id, n_email, n_ip, n_card, n_phone, base_sha256, spans: a row for each row of docs; the counts are of base spans."""
    model = field or fit(docs, text_col)

    def run(batches):
        for b in slices(batches, "text"):
            nodes = Nodes(b.column("text"))
            all_ = model.spans(nodes)
            base = [nodes.spans.get(i, []) for i in range(b.num_rows)]
            counts = [pa.array([sum(x[0] == k for x in s) for s in base], pa.int64()) for k in range(len(KINDS))]
            digest = pa.array([hashlib.sha256(_written(s).encode()).hexdigest() for s in base], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("id"), *counts, digest, pa.array([_written(all_.get(i, [])) for i in range(b.num_rows)], pa.string())], [id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def mask(docs: DataFrame, text_col: str = "text", length_col: str | None = None, field: Field | None = None) -> DataFrame:
    """docs with every span of personal data replaced by its kind in angle brackets; texts without any stay as they are."""
    model = field or fit(docs, text_col)

    def run(batches):
        for b in slices(batches, text_col):
            found = model.spans(Nodes(b.column(text_col)))
            if not found:
                yield b
                continue
            texts = b.column(text_col).to_pylist()
            for i, spans in found.items():
                out, done = [], 0
                for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
                    if s >= done:
                        out += [texts[i][done:s], f"<{KINDS[k]}>"]
                    done = max(done, e)
                texts[i] = "".join([*out, texts[i][done:]])
            cols = {c: b.column(c) for c in b.schema.names}
            cols[text_col] = pa.array(texts, b.schema.field(text_col).type)
            if length_col:
                cols[length_col] = pa.array([None if t is None else len(t) for t in texts], b.schema.field(length_col).type)
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return docs.mapInArrow(run, docs.schema)
