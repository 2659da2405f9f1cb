"""LM scoring (operator 9): a log-bilinear neural model, trained in numpy with noise-contrastive estimation.

Words are lower-cased (A-Z) runs of other than white space; a text ends with one end token.  The words of the
whole table are counted over the training texts by a global dictionary exchange (see ``lexicon``), and every
batch gets the counts of its words back.  ``base_score`` is the add-one unigram score from these counts.

The model predicts a word's class, and then the word in its class, both from the ``ORDER`` tokens before.  The
prediction is the sum of the context vectors, each scaled dimension by dimension by its distance; a class's score is
its product with the class's vector, plus a bias, and a word's score in its class likewise.  Both softmaxes are
normalised exactly, with batched matrix products, and both are trained with noise.

* Classes: every word that was seen has one, by its count (halves of powers of two) and by its *topic*; where more than
  ``SPLIT`` of a class have vectors, hashes cut it.  Texts are dealt to ``TOPICS`` centres by a signature of their words, and a word's topic is the one that it is seen in most.
  The centres are fitted to all training texts, summed up in ``2 ** SIGNS`` cells.
* Words with vectors of their own, as context and as prediction: all with ``LEAST`` training tokens or more and at
  least one in ``MOST_WORDS`` of all training tokens.  So there are at most ``MOST_WORDS`` of them whatever the corpus
  (counts sum up to all tokens), which bounds what is broadcast: 43 MB.  The others of a class are one member
  of it and share its part by their counts.
* Words seen once and unseen ones are the lowest classes; ``UNSEEN_SHARE`` of these goes to the unseen, as one type.
  So the probabilities of all words and one unseen type sum to one.

Training passes over all training tokens once, in ``ROUNDS`` rounds of texts: in a round every task trains a
copy of the model, and the copies' changes are averaged in levels of ``FAN`` at a time, by tokens, and those of a
word's vectors by how often it was met.

Defined results: null and empty texts are the end token alone; rows with equal ids are scored each for itself,
and train if the id says so; a null id (its text is null too) is in training; with nothing to train on N and V
are 0 and the model is uniform over unseen words; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import pack, parts_for, unpack
from .lexicon import answered, by_partition, record, records, rows_in, rows_out, spell, spread, squeeze
from .scratch import written
from .words import U64, Words, slices

FOLDS, HELD_OUT = 7, 2
ORDER, DIM = 3, 16
TOPICS, SIGNS = 8, 16
#: Levels of counts: two for each power of two.
LEVELS = 124
LEAST, MOST_WORDS = 16, 1 << 18
ROUNDS, FAN, BATCH, NOISE, IN_CLASS, RATE = 2, 16, 2048, 48, 2, 0.1
#: Words with vectors in a class.
SPLIT = 256
UNSEEN_SHARE = 0.5
END_KEY = U64(0x5DEECE66D1CE4E5B)
#: Bytes of text in a batch, and tokens whose class scores and in-class scores are worked out at once.
SLICE, CHUNK, WIDE = 4 << 20, 1 << 9, 1 << 16


def held_out(ids: list) -> np.ndarray:
    return np.array([i is not None and zlib.crc32(str(i).encode()) % FOLDS == HELD_OUT for i in ids], bool)


# topics -----------------------------------------------------------------------------------------------------


def ones(hashes: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Of each text, how many of its words have each sign."""
    out = np.zeros((len(off) - 1, SIGNS), np.int64)
    for j in range(SIGNS):
        total = np.concatenate([[0], np.cumsum((hashes >> U64(7 + 3 * j)) & U64(1), dtype=np.int64)])
        out[:, j] = total[off[1:]] - total[off[:-1]]
    return out


def signatures(hashes: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Of each text, the mean of its words' signs; a text without words has zeros."""
    out, n = ones(hashes, off), np.diff(off)[:, None]
    return np.where(n > 0, 2 * out / np.maximum(n, 1) - 1, 0).astype(np.float32)


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1) - 2 * points @ centres.T).argmin(axis=1) if len(centres) else np.zeros(len(points), np.int64)


def centres_of(points: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """Centres of weighted points: each new one is the point that adds most to the squared distances, then they move to their means."""
    if not len(points):
        return np.zeros((0, SIGNS), np.float32)
    weights = np.ones(len(points)) if weights is None else weights.astype(float)
    mean = lambda own: (points[own] * weights[own, None]).sum(axis=0) / weights[own].sum()
    out = mean(np.ones(len(points), bool))[None]
    while len(out) < TOPICS:
        far = weights * ((points - out[nearest(points, out)]) ** 2).sum(axis=1)
        if far.max() <= 0:
            break
        out = np.concatenate([out, points[far.argmax()][None]])
        for _ in range(8):
            own = nearest(points, out)
            out = np.stack([mean(own == k) if (own == k).any() else out[k] for k in range(len(out))])
    return out.astype(np.float32)


def topics(docs: DataFrame) -> np.ndarray:
    """Centres of all training texts that have words; docs: id, text.

    Texts are summed up in cells, by which of a text's signs are positive; sums are whole numbers, so their order changes nothing.
    """

    def run(batches):
        sums = np.zeros((1 << SIGNS, SIGNS + 1), np.int64)
        for b in slices(batches, "text"):
            w = Words(b.column("text"), lower=True)
            keep = np.flatnonzero(~held_out(b.column("id").to_pylist()) & (w.counts() > 0))
            n = w.counts()[keep]
            signs = 2 * ones(w.hashes(), w.off)[keep] - n[:, None]
            np.add.at(sums, (signs > 0) @ (1 << np.arange(SIGNS)), np.concatenate([signs, n[:, None]], axis=1))
        at = np.flatnonzero(sums[:, SIGNS])
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(sums[at, j]) for j in range(SIGNS + 1))], ["cell", *names])

    names = [f"s{j}" for j in range(SIGNS + 1)]
    cells = docs.mapInArrow(run, ", ".join(f"{c} long" for c in ("cell", *names))).groupBy("cell").agg(*(F.sum(c).alias(c) for c in names))
    # at most a row a cell, whatever the corpus
    found = np.array(sorted(tuple(r) for r in cells.collect()), np.int64).reshape(-1, SIGNS + 2)
    return centres_of((found[:, 1:-1] / np.maximum(found[:, -1:], 1)).astype(np.float32), found[:, -1])


# counts -----------------------------------------------------------------------------------------------------


def _cut(parts: int, centres: np.ndarray):
    def cut(b: pa.RecordBatch, batch: int) -> list[tuple]:
        w = Words(b.column("text"), lower=True)
        n, held, h = w.counts(), held_out(b.column("id").to_pylist()), w.hashes()
        topic = np.repeat(nearest(signatures(h, w.off), centres), n + 1)
        keys = np.insert(h, w.off[1:], END_KEY)
        train = np.repeat(~held, n + 1)
        distinct, at, count = np.unique(keys, return_inverse=True, return_counts=True)
        votes = np.bincount(at[train] * TOPICS + topic[train], minlength=len(distinct) * TOPICS).reshape(-1, TOPICS)
        own = (votes.sum(axis=1) * TOPICS + votes.argmax(axis=1)).astype(np.uint32)
        rank = np.empty(len(distinct), np.uint32)
        rank[np.argsort(-count, kind="stable")] = np.arange(len(distinct), dtype=np.uint32)
        info = pa.RecordBatch.from_arrays([b.column("id"), pa.array(n + 1), pa.array(held)], ["id", "n", "held"])
        out = [record(-1, batch, rows_out(info), squeeze(rank[at]), len(distinct).to_bytes(8, "little"))]
        # distinct keys ascend, and so do those of a partition
        out += [record(p, batch, pack(distinct[g]), squeeze(own[g]), squeeze(rank[g])) for p, g in by_partition(distinct, parts)]
        return out

    return cut


def level_of(n: np.ndarray) -> np.ndarray:
    """Level of a count: 0 for counts of 0 and 1, then two for each power of two."""
    return np.where(n < 2, 0, np.floor(2 * np.log2(np.maximum(n, 1))).astype(np.int64) - 1).clip(0, LEVELS - 1)


def _settle(t: pa.Table) -> pa.Table:
    """Counts and topics (count * TOPICS + topic) back to the batches, and for the partition a row (batch -1) of its
    totals by topic and level, and of the words that may get vectors."""
    keys = [unpack(x, U64) for x in t.column("a").to_pylist()]
    all_, at = np.unique(np.concatenate(keys), return_inverse=True)
    own = np.concatenate([spread(x, np.uint32) for x in t.column("b").to_pylist()]).astype(np.int64)
    votes = np.bincount(at * TOPICS + own % TOPICS, own // TOPICS, len(all_) * TOPICS).reshape(-1, TOPICS)
    n, topic = votes.sum(axis=1).astype(np.int64), votes.argmax(axis=1)
    place = np.where(n > 0, topic * LEVELS + level_of(n), TOPICS * LEVELS)
    totals = np.stack([np.bincount(place, minlength=TOPICS * LEVELS + 1)[:-1], np.bincount(place, n, TOPICS * LEVELS + 1)[:-1].astype(np.int64)])
    p, full, frequent = t.column("p")[0].as_py(), n * TOPICS + topic, n >= LEAST
    out = [record(p, -1, all_[frequent].tobytes(), full[frequent].tobytes(), totals.astype(np.int64).tobytes())]
    out += [record(p, batch, pack(k), squeeze(full[np.searchsorted(all_, k)]), c) for batch, k, c in zip(t.column("batch").to_pylist(), keys, t.column("c").to_pylist(), strict=True)]
    return pa.Table.from_batches([records(out)])


@dataclass
class Lexicon:
    """What is known of the training corpus, of a size that MOST_WORDS, TOPICS and LEVELS bound.

    Slots are the members of classes, class by class: words with vectors, then one for the other words if there are any.
    """

    tokens: int
    distinct: int
    keys: np.ndarray  # of words with vectors, ascending
    slot_of: np.ndarray  # their slots
    class_at: np.ndarray  # class of each topic and level, its first if it is cut; -1 for none
    first: np.ndarray  # first slot of each class, and the number of slots
    rest_types: np.ndarray  # of each class, the words without vectors
    rest_tokens: np.ndarray
    mass: np.ndarray  # tokens of each slot
    slot_class: np.ndarray

    @property
    def classes(self) -> int:
        return len(self.first) - 1

    @property
    def slots(self) -> int:
        return len(self.mass)

    def class_mass(self) -> np.ndarray:
        return np.bincount(self.slot_class, self.mass, self.classes)

    def lowest(self) -> np.ndarray:
        """The classes of words seen once, which unseen words are of as well."""
        at = self.class_at.reshape(TOPICS, LEVELS)[:, 0]
        return at[at >= 0]

    def place(self, keys: np.ndarray, n: np.ndarray, topic: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class (-1 for unseen words), slot, and log10 of the share in the slot."""
        cls = np.where(n > 0, self.class_at[topic * LEVELS + level_of(n)], -1)
        slot = self.first[cls + 1] - 1
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        own = (self.keys[at] == keys) & (n > 0) if len(self.keys) else np.zeros(len(keys), bool)
        if len(self.keys):
            slot = np.where(own, self.slot_of[at], slot)
            cls = np.where(own, self.slot_class[slot], cls)
        share = np.where(n > 1, n / np.maximum(self.rest_tokens[cls], 1), (1 - UNSEEN_SHARE) / np.maximum(self.rest_types[cls], 1))
        return cls, np.where(cls < 0, self.slots, slot), np.where(own | (cls < 0), 0.0, np.log10(np.maximum(share, 1e-300)))


def lexicon_of(types: np.ndarray, tokens: np.ndarray, keys: np.ndarray, full: np.ndarray) -> Lexicon:
    """From the totals by topic and level, and the words with vectors (count * TOPICS + topic)."""
    there = tokens > 0
    there.reshape(TOPICS, LEVELS)[0 if not there.any() else there.reshape(TOPICS, LEVELS).any(axis=1), 0] = True
    class_at = np.where(there, np.cumsum(there) - 1, -1)
    c = int(there.sum())
    n, topic = full // TOPICS, full % TOPICS
    own_class = class_at[topic * LEVELS + level_of(n)]
    # a class of many vectors is followed by its other parts; what has no vectors stays in the first
    members = np.bincount(own_class, minlength=c)
    parts = np.maximum(1, -(-members // SPLIT))
    start = np.cumsum(parts) - parts
    class_at, c = np.where(there, start[np.maximum(class_at, 0)], -1), int(parts.sum())
    rest_types, rest_tokens = np.zeros(c, np.int64), np.zeros(c, np.int64)
    rest_types[start], rest_tokens[start] = types[there] - members, tokens[there] - np.bincount(own_class, n, len(parts)).astype(np.int64)
    own_class = start[own_class] + ((keys >> U64(20)) % parts[own_class].astype(U64)).astype(np.int64)
    lowest = class_at.reshape(TOPICS, LEVELS)[:, 0]
    rest = rest_tokens + np.isin(np.arange(c), lowest[lowest >= 0])  # an unseen word
    extra = np.flatnonzero(rest > 0)
    cls = np.concatenate([own_class, extra])
    order = np.lexsort((np.concatenate([keys, np.full(len(extra), ~U64(0))]), np.concatenate([np.zeros(len(keys)), np.ones(len(extra))]), cls))
    slot = np.empty(len(cls), np.int64)
    slot[order] = np.arange(len(cls))
    ascending = np.argsort(keys)
    return Lexicon(int(tokens.sum()), int(types.sum()), keys[ascending], slot[: len(keys)][ascending], class_at, np.searchsorted(cls[order], np.arange(c + 1)), rest_types, rest_tokens, np.concatenate([n, rest[extra]])[order].astype(float), cls[order])


# the model --------------------------------------------------------------------------------------------------


class Model:
    """Vectors of classes and of slots as context (with one class for "before the text" and a zero one for unseen words),
    a scale for each distance, vectors and biases of classes and of slots as predictions.

    A slot's vectors are added to its class's as context, and begin at zero, so a class begins as its counts say.
    """

    def __init__(self, lexicon: Lexicon):
        rng, c, m = np.random.default_rng(5), lexicon.classes, lexicon.slots
        self.lexicon = lexicon
        class_mass = lexicon.class_mass()
        self.chance = ((class_mass + 0.01) / (class_mass + 0.01).sum()).astype(np.float64)
        self.share = lexicon.mass / np.maximum(class_mass[lexicon.slot_class], 1e-9)
        self.cumulated = np.concatenate([[0.0], np.cumsum(lexicon.mass)])
        near = np.repeat(np.float32(1 / (1 + np.arange(ORDER)))[:, None], DIM, 1)
        self.dense = [rng.normal(0, 0.1, (c + 2, DIM)).astype(np.float32), near, rng.normal(0, 0.1, (c, DIM)).astype(np.float32), np.log(self.chance).astype(np.float32)]
        self.dense[0][c + 1] = 0
        self.sparse = [np.zeros((m + 1, DIM), np.float32), np.zeros((m, DIM), np.float32), np.log(np.maximum(self.share, 1e-30)).astype(np.float32)]
        self.grown = [np.full_like(x, 1e-8) for x in self.dense]
        self.met = [np.zeros(len(x), np.float32) for x in self.sparse]
        self.grown_rows = [np.ones(len(x), np.float32) for x in self.sparse]

    def copy(self) -> Model:
        out = Model(self.lexicon)
        out.dense, out.sparse = [x.copy() for x in self.dense], [x.copy() for x in self.sparse]
        return out

    def predict(self, contexts: np.ndarray, slots: np.ndarray) -> np.ndarray:
        e, c = self.dense[:2]
        return sum((e[contexts[i]] + self.sparse[0][slots[i]]) * c[i] for i in range(ORDER))

    def log10_probabilities(self, contexts: np.ndarray, context_slots: np.ndarray, classes: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """Of each token's class (-1: unseen) and of its slot in it."""
        w, b = self.dense[2:]
        columns, one, longest = np.concatenate([w.T, b[None]]), np.ones(len(b), np.float32), np.sqrt((w * w).sum(axis=1).max())
        low, n, m = self.lexicon.lowest(), self.lexicon.classes, self.lexicon.slots
        out = np.empty(len(classes))
        # the parts of a prediction by distance and slot, then of unseen words and of what is before a text
        e, scale = self.dense[:2]
        both = np.concatenate([e[self.lexicon.slot_class] + self.sparse[0][:m], e[[n + 1, n]] + self.sparse[0][m]])
        parts = [both * scale[i] for i in range(ORDER)]
        for wide in range(0, len(classes), WIDE):
            end = min(len(classes), wide + WIDE)
            q = np.ones((end - wide, DIM + 1), np.float32)  # with one for the bias
            for lo in range(wide, end, CHUNK):
                s = slice(lo, min(lo + CHUNK, end))
                row = q[lo - wide : s.stop - wide]
                own = sum(parts[i].take(np.where(contexts[i, s] == n, m + 1, context_slots[i, s]), 0) for i in range(ORDER))
                row[:, :DIM] = own
                # no score is above this, so exponentials stay finite
                most = np.sqrt((own * own).sum(axis=1).max()) * longest + b.max()
                scores = row @ columns
                if most > 80:
                    scores -= np.float32(most - 80)
                np.exp(scores, out=scores)
                known = classes[s] >= 0
                part = np.where(known, scores[np.arange(len(scores)), np.maximum(classes[s], 0)], UNSEEN_SHARE * scores[:, low].sum(axis=1) if not known.all() else 1)
                out[s] = np.log(np.maximum(part, 1e-37)) - np.log(scores @ one)
            out[wide:end] += self._in_class(q, classes[wide:end], slots[wide:end])
        return out / np.log(10)

    def _in_class(self, q: np.ndarray, classes: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """Natural logarithms of the slots' probabilities in their classes, class by class; q: with a column of ones."""
        u, b = self.sparse[1:]
        longest = np.sqrt(np.einsum("ij,ij->i", q, q).max()) if len(q) else 0
        out, first = np.zeros(len(classes)), self.lexicon.first
        order = np.argsort(classes, kind="stable")
        cut = np.flatnonzero(np.diff(classes[order])) + 1
        for g in np.split(order, cut):
            c = classes[g[0]] if len(g) else -1
            if c < 0 or first[c + 1] - first[c] < 2:
                continue
            lo, hi = first[c], first[c + 1]
            columns, one = np.concatenate([u[lo:hi].T, b[None, lo:hi]]), np.ones(hi - lo, np.float32)
            small = longest * np.sqrt((columns * columns).sum(axis=0).max()) < 80  # then no exponential is too large or all too small
            block = max(1, (CHUNK << 7) // (hi - lo))
            for k in range(0, len(g), block):
                part = g[k : k + block]
                s = q.take(part, 0) @ columns
                own = s[np.arange(len(part)), slots[part] - lo]
                if not small:
                    top = s.max(axis=1)
                    s -= top[:, None]
                    own = own - top
                np.exp(s, out=s)
                out[part] = own - np.log(s @ one)
        return out

    def train(self, contexts: np.ndarray, context_slots: np.ndarray, classes: np.ndarray, slots: np.ndarray, seed: int) -> None:
        """One pass of noise-contrastive estimation; a step's tokens share the noise of classes, each has its own in its class."""
        rng = np.random.default_rng(seed)
        chance, cumulated = np.log(self.chance * NOISE).astype(np.float32), np.cumsum(self.chance)
        share = np.log(np.maximum(self.share, 1e-30) * IN_CLASS).astype(np.float32)
        e, c, w, b = self.dense
        ew, u, bu = self.sparse
        n, first = len(b), self.lexicon.first
        many = np.diff(first) > 1
        for lo in range(0, len(classes), BATCH):
            s = slice(lo, lo + BATCH)
            ctx, ctx_slot, own, slot = contexts[:, s], context_slots[:, s], classes[s], slots[s]
            noise = np.minimum(np.searchsorted(cumulated, rng.random(NOISE)), n - 1)
            vectors = [e.take(ctx[i], 0) + ew.take(ctx_slot[i], 0) for i in range(ORDER)]  # several times as fast as an index
            q = sum(v * c[i] for i, v in enumerate(vectors))
            w_own = w.take(own, 0)
            g_true = _residual(np.einsum("ij,ij->i", q, w_own) + b[own] - chance[own], True)
            g_other = _residual(q @ w[noise].T + (b[noise] - chance[noise]), False)
            g_q = g_true[:, None] * w_own + g_other @ w[noise]
            g_w = _sum_rows(own, g_true[:, None] * q, n)
            np.add.at(g_w, noise, g_other.T @ q)
            g_b = np.bincount(own, g_true, n) + np.bincount(noise, g_other.sum(axis=0), n)
            # in the classes of several members
            inner = np.flatnonzero(many[own])
            if len(inner):
                a, z = self.cumulated[first[own[inner]]], self.cumulated[first[own[inner] + 1]]
                drawn = np.searchsorted(self.cumulated, a + rng.random((IN_CLASS, len(inner))) * (z - a), "right") - 1
                drawn = np.clip(drawn, first[own[inner]], first[own[inner] + 1] - 1)
                rows = np.concatenate([slot[inner][None], drawn])
                qi, ui = q.take(inner, 0), u.take(rows, 0)
                score = np.einsum("kij,ij->ki", ui, qi) + bu[rows] - share[rows]
                g = np.concatenate([_residual(score[:1], True), _residual(score[1:], False)])
                g_q[inner] += sum(ui[j] * g[j][:, None] for j in range(len(ui)))
                both = np.empty((*g.shape, DIM + 1), np.float32)
                np.multiply(g[:, :, None], qi, out=both[:, :, :DIM])
                both[:, :, DIM] = g
                met, sums, count = _by_row(rows.ravel(), both.reshape(-1, DIM + 1))
                self._step_rows(1, met, sums[:, :DIM], count)
                self._step_rows(2, met, sums[:, DIM:], count)
            g_c = np.stack([np.einsum("ij,ij->j", g_q, v) for v in vectors])
            scaled = np.concatenate([g_q * c[i] for i in range(ORDER)])
            # a context's class is its slot's; the last slot is of what has none
            met, sums, count = _by_row(ctx_slot.ravel(), scaled)
            if met[-1] == len(ew) - 1:
                met, sums, count = met[:-1], sums[:-1], count[:-1]
            g_e = _sum_rows(self.lexicon.slot_class[met], sums, n + 2)
            g_e[n] = scaled[ctx.ravel() == n].sum(axis=0)
            self._step_rows(0, met, sums, count)
            for x, h, g in zip(self.dense, self.grown, (g_e, g_c, g_w, g_b), strict=True):
                g = (g / len(own)).astype(np.float32)
                h += g * g
                x += np.float32(RATE) * g / np.sqrt(h)

    def _step_rows(self, k: int, met: np.ndarray, g: np.ndarray, count: np.ndarray) -> None:
        """A step of the vectors that a batch has met, by the sums of their gradients."""
        x = self.sparse[k]
        self.met[k][met] += count
        grown = self.grown_rows[k][met] + np.einsum("ij,ij->i", g, g) / g.shape[1]
        self.grown_rows[k][met] = grown
        step = (np.float32(RATE) / np.sqrt(grown))[:, None] * g
        x[met] += step if x.ndim > 1 else step[:, 0]

    # a copy's change, as it travels: dense parts, and rows that were met

    def change(self, start: Model, seen: float) -> bytes:
        return _joined([np.float64(seen).reshape(1), *(np.float32(x - y) for x, y in zip(self.dense, start.dense, strict=True)), *(y for k in range(3) for y in (self.met[k], np.float16(self.sparse[k] - start.sparse[k])))])

    def shapes(self) -> list[tuple[type, tuple]]:
        return [(np.float64, (1,)), *((np.float32, x.shape) for x in self.dense), *(y for x in self.sparse for y in ((np.float32, (len(x),)), (np.float16, x.shape)))]

    def moved(self, change: bytes) -> Model:
        parts = _parts(change, self.shapes())
        out = self.copy()
        for x, d in zip(out.dense, parts[1:5], strict=True):
            x += d
        for k, x in enumerate(out.sparse):
            x += parts[6 + 2 * k].astype(np.float32)
        return out


def _joined(parts: list[np.ndarray]) -> bytes:
    raw = b"".join(np.ascontiguousarray(x).tobytes() for x in parts)
    return pa.compress(raw, codec="zstd", asbytes=True)


def _parts(data: bytes, shapes: list[tuple[type, tuple]]) -> list[np.ndarray]:
    sizes = [np.dtype(t).itemsize * int(np.prod(s)) for t, s in shapes]
    raw, at, out = pa.decompress(data, decompressed_size=sum(sizes), codec="zstd", asbytes=True), 0, []
    for (t, s), n in zip(shapes, sizes, strict=True):
        out.append(np.frombuffer(raw, t, int(np.prod(s)), at).reshape(s))
        at += n
    return out


def averaged(changes: list[bytes], shapes: list[tuple[type, tuple]]) -> bytes:
    """Several copies' changes as one: by tokens, and rows by how often they were met."""
    total: list[np.ndarray] = []
    for data in changes:
        parts = [x.astype(np.float64) for x in _parts(data, shapes)]
        seen = parts[0][0]
        weighted = [parts[0], *(x * seen for x in parts[1:5]), *(y for k in range(3) for y in (parts[5 + 2 * k], parts[6 + 2 * k] * parts[5 + 2 * k].reshape(-1, *[1] * (parts[6 + 2 * k].ndim - 1))))]
        total = [a + b for a, b in zip(total, weighted, strict=True)] if total else weighted
    out = [total[0], *(np.float32(x / max(total[0][0], 1)) for x in total[1:5])]
    for k in range(3):
        met = total[5 + 2 * k]
        out += [np.float32(met), np.float16(total[6 + 2 * k] / np.maximum(met, 1).reshape(-1, *[1] * (total[6 + 2 * k].ndim - 1)))]
    return _joined(out)


def _residual(score: np.ndarray, true: bool) -> np.ndarray:
    """What a score falls short of certainty, that it is data or that it is noise."""
    return (1 / (1 + np.exp(np.clip(score, -30, 30)))) if true else (-1 / (1 + np.exp(np.clip(-score, -30, 30))))


def _by_row(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows in ascending order, the sums of their values, and how many each has."""
    bits = max(1, len(rows) - 1).bit_length()
    keys = np.sort(rows.astype(np.int64) << bits | np.arange(len(rows)))
    order, sorted_ = keys & ((1 << bits) - 1), keys >> bits
    begin = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    return sorted_[begin], np.add.reduceat(values.take(order, 0), begin), np.diff(np.append(begin, len(rows)))


def _sum_rows(index: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    d = values.shape[1]
    flat = (index[:, None] * d + np.arange(d)).ravel()
    return np.bincount(flat, values.ravel(), n * d).reshape(n, d)


def before(values: np.ndarray, off: np.ndarray, blank: int) -> np.ndarray:
    """The ORDER values before each token of its text, the nearest first."""
    left = np.arange(len(values)) - np.repeat(off[:-1], np.diff(off))
    out = np.full((ORDER, len(values)), blank, np.int32)
    for i in range(ORDER):
        inside = left > i
        out[i, inside] = values[np.flatnonzero(inside) - i - 1]
    return out


@dataclass
class Tokens:
    """Of a batch: its texts, and each token's count, class, slot and share, and the classes and slots before it."""

    info: pa.RecordBatch
    off: np.ndarray
    n: np.ndarray
    classes: np.ndarray
    slots: np.ndarray
    share: np.ndarray
    contexts: np.ndarray
    context_slots: np.ndarray


def tokens_of(row: dict, lexicon: Lexicon, some: Callable[[pa.RecordBatch], np.ndarray] | None = None) -> Tokens:
    """The tokens of a batch row, or of some of its texts."""
    info, at = rows_in(row["a"]), spread(row["b"], np.uint32)
    if some is not None:
        keep = some(info)
        at, info = at[np.repeat(keep, info.column("n").to_numpy())], info.filter(pa.array(keep))
    keys, full = (np.frombuffer(row["c"], np.int64).reshape(2, -1)[i] for i in (0, 1))
    cls, slot, share = lexicon.place(keys.view(U64), full // TOPICS, full % TOPICS)
    cls, slot = cls.astype(np.int32)[at], slot.astype(np.int32)[at]
    off = np.concatenate([[0], np.cumsum(info.column("n").to_numpy())])
    as_context = np.where(cls < 0, lexicon.classes + 1, cls)
    return Tokens(info, off, (full // TOPICS)[at], cls, slot, share[at], before(as_context, off, lexicon.classes), before(slot, off, lexicon.slots))


def counted(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, Lexicon]:
    """A written table of batches, each with the counts of its words, and the lexicon."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    table = spell(slim, _cut(parts_for(docs, text_col), topics(slim)), size=SLICE)
    answers = written(table.where("p >= 0").groupBy("p").applyInArrow(_settle, table.schema), "counts")
    ends = answers.where("batch = -1")

    def sums(batches):
        total = np.zeros((2, TOPICS * LEVELS), np.int64)
        for b in batches:
            for x in b.column("c").to_pylist():
                total += np.frombuffer(x, np.int64).reshape(2, -1)
        at = np.flatnonzero(total[1])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0][at]), pa.array(total[1][at])], ["place", "types", "tokens"])

    # a row a topic and level, whatever the number of partitions
    rows = ends.select("c").mapInArrow(sums, "place long, types long, tokens long").groupBy("place").agg(F.sum("types").alias("types"), F.sum("tokens").alias("tokens")).collect()
    types, tokens = np.zeros(TOPICS * LEVELS, np.int64), np.zeros(TOPICS * LEVELS, np.int64)
    for r in rows:
        types[r["place"]], tokens[r["place"]] = r["types"], r["tokens"]
    least = max(LEAST, -(-int(tokens.sum()) // MOST_WORDS))

    def frequent(batches):
        for b in batches:
            keys, full = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.int64) for c in ("a", "b"))
            at = full // TOPICS >= least
            yield pa.RecordBatch.from_arrays([pa.array([keys[at].tobytes()], pa.binary()), pa.array([full[at].tobytes()], pa.binary())], ["keys", "full"])

    own = ends.select("a", "b").mapInArrow(frequent, "keys binary, full binary").collect()
    keys, full = (np.frombuffer(b"".join(r[c] for r in own), np.int64) for c in ("keys", "full"))

    def finish(own: tuple, back: list[tuple]) -> pa.Table:
        words = int.from_bytes(own[4], "little")
        keys, n = np.zeros(words, U64), np.zeros(words, np.int64)
        for r in back:
            place = spread(r[4], np.uint32)
            keys[place], n[place] = unpack(r[2], U64), spread(r[3], np.int64)
        return pa.Table.from_batches([records([record(-1, own[1], own[2], own[3], np.stack([keys.view(np.int64), n]).tobytes())])])

    batches = answered(table.where("p = -1"), answers.where("batch >= 0"), finish, "p int, batch long, a binary, b binary, c binary")
    return written(batches, "tokens"), lexicon_of(types, tokens, keys.view(U64), full)


def train(tokens: DataFrame, lexicon: Lexicon) -> Model:
    model = Model(lexicon)
    shapes = model.shapes()
    most = tokens.agg(F.max("batch")).first()[0]
    for k in range(ROUNDS):
        start = model

        def run(batches, k=k, start=start):
            own, seen, part = start.copy(), 0, None
            for b in batches:
                for row in b.to_pylist():
                    part = row["batch"] >> 32 if part is None else part
                    # every training text is in one round
                    t = tokens_of(row, lexicon, lambda info, row=row: ~info.column("held").to_numpy(zero_copy_only=False) & ((np.arange(info.num_rows) + row["batch"]) % ROUNDS == k))
                    if len(t.n):
                        own.train(t.contexts, t.context_slots, t.classes, t.slots, row["batch"] % (1 << 31))
                        seen += len(t.n)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([(part or 0) // FAN], pa.int64()), pa.array([own.change(start, seen)], pa.binary())], ["p", "change"])

        def mean(t: pa.Table) -> pa.Table:
            return pa.table({"p": pa.array([t.column("p")[0].as_py() // FAN], pa.int64()), "change": pa.array([averaged(t.column("change").to_pylist(), shapes)], pa.binary())})

        # copies of FAN tasks are averaged, then FAN averages, until one group is left
        changes, groups = tokens.mapInArrow(run, "p long, change binary"), 1 + (0 if most is None else (most >> 32) // FAN)
        while True:
            changes = changes.groupBy("p").applyInArrow(mean, "p long, change binary")
            if groups == 1:
                break
            groups = 1 + (groups - 1) // FAN
        for r in changes.collect():
            model = model.moved(r["change"])
    return model


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score: a row for each row of docs."""
    tokens, lexicon = counted(docs, id_col, text_col)
    model = train(tokens, lexicon)

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                t = tokens_of(row, lexicon)
                sums = lambda x: np.add.reduceat(x, t.off[:-1]) if len(t.off) > 1 else x  # noqa: B023,E731  every text has a token
                base = np.log10((t.n + 1) / (lexicon.tokens + lexicon.distinct + 1))
                own = model.log10_probabilities(t.contexts, t.context_slots, t.classes, t.slots) + t.share
                cols = [t.info.column("id"), t.info.column("held"), t.info.column("n"), pa.array(sums((t.n > 0).astype(np.int64))), pa.array(np.full(t.info.num_rows, lexicon.tokens)), pa.array(sums(base)), pa.array(sums(own))]
                yield pa.RecordBatch.from_arrays(cols, [id_col, *_OUT])

    kind = docs.schema[id_col].dataType.simpleString()
    return tokens.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


_OUT = ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
