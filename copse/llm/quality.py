"""Document quality: a linear-chain conditional random field labels every line good or bad.

Each line has features of its own (shares of character classes, repeated
words, length) and those of the lines before and after it.  Only documents are
labelled; which of their lines bear the other label is found by expectation and
maximisation: a fit without transitions, with the document's label on every
line, says which lines contradict it; those change sides, the clearest first,
while most of the document's length keeps its label; the chain is fitted to the
lines' labels, and once more after its own marginals have dealt them anew.  As
labelled documents seldom are of two minds, each fit also sees documents spliced
from runs of lines of a good one and a bad one, so that the chain learns where
labels change.  A document's mean of the lines' forward-backward marginals, weighted by length, is
put on the scale of the label by a logistic fit on the same training documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, log
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, unpacked
from .fitting import labelled_sample, minimise, sigmoid

#: Training texts of each class, at most.
PER_CLASS = 2000
#: Fits of the chain after the one without transitions; a line changes sides where the other label is at least so likely.
ROUNDS, SURE = 2, 0.8
#: Spliced training documents: at most as many, of so much weight all together, beside 1 of the others.
SPLICED, SPLICE_WEIGHT = 1000, 0.3
OWN = 15
FEATURES = 3 * OWN + 3

#: Character classes by code point; those from 0x250 on count as letters without case.
_UPPER, _LOWER, _DIGIT, _SPACE, _STOP, _BAR, _BANG, _MARK, _OTHER = range(9)


def _classes() -> np.ndarray:
    out = np.full(0x251, _LOWER, np.uint8)
    for i in range(0x250):
        c = chr(i)
        out[i] = _UPPER if c.isupper() else _LOWER if c.isalpha() else _DIGIT if c.isdigit() else _SPACE if c.isspace() else _STOP if c in ".,;:?'\"-()" else _BAR if c == "|" else _BANG if c == "!" else _MARK if c in "*#$%&@~^_=+<>{}[]\\/" else _OTHER
    return out


CLASSES = _classes()


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """``(lines, FEATURES)`` features and the lines' lengths in code points, the line feed included."""
    lines = text.split("\n")
    n = len(lines)
    length = np.fromiter(map(len, lines), np.int64, n) + 1
    points = np.frombuffer((text + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = CLASSES[np.minimum(points, 0x250)]
    first = np.cumsum(length) - length
    share = np.stack([np.add.reduceat(kind == k, first, dtype=np.int64) for k in range(9)], 1).astype(float)
    share[:, _SPACE] -= 1  # the line feed
    repeat, fresh, words = np.zeros(n), np.ones(n), np.zeros(n)
    for i, line in enumerate(lines):
        w = line.split()
        if len(w) > 1:
            repeat[i] = sum(map(eq, w, w[1:])) / (len(w) - 1)
            fresh[i] = len(set(w)) / len(w)
        words[i] = len(w)
    chars = np.maximum(length - 1, 1)
    letters = np.maximum(share[:, _UPPER] + share[:, _LOWER], 1)
    own = np.column_stack([
        share[:, _UPPER] / letters, share[:, _LOWER] / chars, share[:, _DIGIT] / chars, share[:, _SPACE] / chars, share[:, _STOP] / chars,
        np.minimum(1, 20 * share[:, _BAR] / chars), np.minimum(1, 10 * share[:, _BANG] / chars), np.minimum(1, 5 * share[:, _MARK] / chars), share[:, _OTHER] / chars,
        repeat, fresh, np.log1p(length) / 10, np.minimum(words / np.maximum(length, 1), 1), length == 1, words == 1,
    ])
    x = np.zeros((n, FEATURES))
    x[:, :OWN] = own
    x[1:, OWN : 2 * OWN] = own[:-1]
    x[:-1, 2 * OWN : 3 * OWN] = own[1:]
    x[:, -3] = 1
    x[0, -2] = x[-1, -1] = 1
    return x, length


@dataclass
class Chain:
    """``unary``: a line's score for good over bad; ``trans[a, b]``: of label b after a (0 bad, 1 good); ``scale``: slope and offset of the document's score."""

    unary: np.ndarray
    trans: np.ndarray
    scale: tuple[float, float] = (1.0, 0.0)

    def marginals(self, x: np.ndarray) -> np.ndarray:
        """Probability of good for each line, by forward-backward."""
        u = (x @ self.unary).tolist()
        (t00, t01), (t10, t11) = np.exp(self.trans).tolist()
        a, forward = 1.0, []  # odds, good over bad, of what is before and at the line
        for i, s in enumerate(u):
            a = (a * t11 + t01) / (a * t10 + t00) * exp(min(max(s, -50.0), 50.0)) if i else exp(min(max(s, -50.0), 50.0))
            a = min(max(a, 1e-30), 1e30)
            forward.append(a)
        b, out = 1.0, np.empty(len(u))
        for i in range(len(u) - 1, -1, -1):
            odds = forward[i] * b
            out[i] = odds / (1 + odds)
            e = exp(min(max(u[i], -50.0), 50.0)) * b
            b = min(max((t10 + t11 * e) / (t00 + t01 * e), 1e-30), 1e30)
        return out

    def mean(self, text: str) -> float:
        x, length = line_features(text)
        return float(self.marginals(x) @ length / length.sum())

    def score(self, text: str) -> float:
        return float(sigmoid(np.float64(self.scale[0] * self.mean(text) + self.scale[1])))


def _loss(v: np.ndarray, xs: list[np.ndarray], y: np.ndarray, weight: np.ndarray, l2: float) -> tuple[float, np.ndarray]:
    """Penalised negative log-likelihood of documents, longest first, whose lines have labels ``y``, one after another; its gradient."""
    unary, trans = v[:FEATURES], v[FEATURES:].reshape(2, 2)
    size = np.array([len(x) for x in xs])
    start = np.cumsum(size) - size
    x = np.concatenate(xs)
    s = np.zeros((len(x), 2))
    s[:, 1] = x @ unary
    top, m = size[0], len(xs)
    alive = [int((size > t).sum()) for t in range(top)]
    f, b = np.empty_like(s), np.zeros_like(s)
    f[start] = s[start]
    for t in range(1, top):
        k = start[: alive[t]] + t
        p = f[k - 1]
        f[k] = s[k] + np.logaddexp(p[:, :1] + trans[0], p[:, 1:] + trans[1])
    last = start + size - 1
    z = np.logaddexp(f[last, 0], f[last, 1])
    pair = np.zeros((2, 2))
    for t in range(top - 1, 0, -1):
        k = start[: alive[t]] + t
        e = s[k] + b[k]
        b[k - 1] = np.logaddexp(trans[:, 0] + e[:, :1], trans[:, 1] + e[:, 1:])
        joint = np.exp(f[k - 1][:, :, None] + trans + e[:, None, :] - z[: alive[t], None, None])
        pair += (weight[: alive[t], None, None] * joint).sum(0)
    doc = np.repeat(np.arange(m), size)
    good = np.exp(f[:, 1] + b[:, 1] - z[doc])
    inner = np.setdiff1d(np.arange(len(x)), start)  # lines with one before them
    path = np.bincount(doc, s[np.arange(len(x)), y], m) + np.bincount(doc[inner], trans[y[inner - 1], y[inner]], m)
    value = (weight * (z - path)).sum() + l2 / 2 * (v @ v)
    own = np.zeros((2, 2))
    np.add.at(own, (y[inner - 1], y[inner]), weight[doc[inner]])
    return value, np.concatenate([x.T @ (weight[doc] * (good - y)), (pair - own).ravel()]) + l2 * v


def relabelled(good: np.ndarray, length: np.ndarray, label: int) -> np.ndarray:
    """Labels of a document's lines: the document's own, but for lines whose marginals contradict it by SURE, the clearest
    first, while they have less than half of its length."""
    out = np.full(len(good), label)
    other = 1 - good if label else good
    order = np.argsort(-other, kind="stable")
    order = order[other[order] >= SURE]
    out[order[2 * np.cumsum(length[order]) < length.sum()]] = 1 - label
    return out


def spliced(lines: list[list[str]], marks: list[np.ndarray], y: np.ndarray, count: int = SPLICED) -> list[tuple[str, np.ndarray]]:
    """Texts, with their lines' labels, each a document with a run of lines of one of the other label put in."""
    rng = np.random.default_rng(11)
    sides = [np.flatnonzero(y == k) for k in (0, 1)]
    out = []
    for n in range(min(count, 2 * min(map(len, sides)))):
        outer, inner = (rng.choice(sides[k]) for k in ((1, 0) if n % 2 else (0, 1)))
        at = int(rng.integers(len(lines[outer]) + 1))
        first = int(rng.integers(len(lines[inner])))
        last = int(rng.integers(first, len(lines[inner]))) + 1
        text = [*lines[outer][:at], *lines[inner][first:last], *lines[outer][at:]]
        out.append(("\n".join(text), np.concatenate([marks[outer][:at], marks[inner][first:last], marks[outer][at:]])))
    return out


def fit(texts: list[str], labels: np.ndarray, weights: np.ndarray, l2: float = 1.0) -> Chain:
    """Without texts of both classes the score is the weighted share of label 1 everywhere (0.5 without any text)."""
    labels, weights = np.asarray(labels, np.int64), np.asarray(weights, float)
    if len(texts) == 0 or labels.min() == labels.max():
        share = float(labels.mean()) if len(texts) else 0.5
        return Chain(np.zeros(FEATURES), np.zeros((2, 2)), (0.0, log((share + 1e-6) / (1 - share + 1e-6))))
    made = [line_features(t) for t in texts]
    order = np.argsort([-len(x) for x, _ in made], kind="stable")
    xs, y, w = [made[i][0] for i in order], labels[order], weights[order] / weights.mean()
    per = w / np.array([len(x) for x in xs])
    of_lines = np.concatenate([np.full(len(x), k) for x, k in zip(xs, y, strict=True)])

    def alone(u: np.ndarray) -> tuple[float, np.ndarray]:  # without transitions
        value, slope = _loss(np.concatenate([u, np.zeros(4)]), xs, of_lines, per, l2)
        return value, slope[:FEATURES]

    v = np.concatenate([minimise(alone, np.zeros(FEATURES), steps=60, tol=1e-5), np.zeros(4)])
    lines = [texts[i].split("\n") for i in order]
    for _ in range(ROUNDS):
        chain = Chain(v[:FEATURES], v[FEATURES:].reshape(2, 2))
        marks = [relabelled(chain.marginals(x), made[i][1], k) for x, i, k in zip(xs, order, y, strict=True)]
        more = spliced(lines, marks, y)
        docs = [(x, m, p) for x, m, p in zip(xs, marks, per, strict=True)]
        for text, m in more:
            docs.append((line_features(text)[0], m, SPLICE_WEIGHT * len(xs) / len(more) / len(m)))
        docs.sort(key=lambda d: -len(d[0]))
        all_x, all_y, all_w = [d[0] for d in docs], np.concatenate([d[1] for d in docs]), np.array([d[2] for d in docs])
        v = minimise(lambda v: _loss(v, all_x, all_y, all_w, l2), v, steps=60, tol=1e-5)
    chain = Chain(v[:FEATURES], v[FEATURES:].reshape(2, 2))
    mean = np.array([chain.marginals(made[i][0]) @ made[i][1] / made[i][1].sum() for i in order])

    def scale(p: np.ndarray) -> tuple[float, np.ndarray]:
        z = p[0] * mean + p[1]
        g = w * (sigmoid(z) - y)
        return (w * (np.logaddexp(0, z) - y * z)).sum() + 0.01 * p @ p / 2, np.array([g @ mean, g.sum()]) + 0.01 * p

    chain.scale = tuple(map(float, minimise(scale, np.zeros(2))))
    return chain


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Chain:
    """Fits on at most ``per_class`` labelled texts of each class (see :func:`labelled_sample`)."""
    rows = labelled_sample(docs, labels, "quality", per_class).orderBy("id").collect()
    return fit([r.text for r in rows], np.array([r.label for r in rows]), np.array([r.weight for r in rows]))


def score(docs: DataFrame, chain: Chain, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """All columns of ``docs`` with ``score`` and ``predicted`` of each whole text.

    Null counts as empty; an empty text is one empty line; a long one is read
    whole, in time linear in it.  Rows are scored one by one, so repeats and
    empty tables need no rule; columns of the same names are replaced.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    place = docs.columns.index(text_col)  # the text goes to the workers once, inside its row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).field(place)
            s = np.array([chain.score(texts[i].as_py() or "") for i in range(len(texts))], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], names=["row", "score"])

    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("score", T.DoubleType())])
    return unpacked(rows.mapInArrow(run, schema), score="score", predicted=(F.col("score") >= threshold).cast("int"))


def op10_quality(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
