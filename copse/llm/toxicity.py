"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text is lower-cased and its white space made single spaces; the n-grams of
its UTF-8 bytes, hashed to BITS bits, are the features, each by the logarithm of
its frequency in the text.  A feature is scaled by its naive Bayes ratio
r = log((p / |p|) / (q / |q|)), where p and q are its smoothed sums over toxic and
other training texts; a logistic regression on the scaled features of all hashes
met in training gives the score.  The half million n-grams of a training sample
share 2^18 hashes; on labels held out that was as accurate as 2^20 (0.992 and
0.990), and 2^22 was worse.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, relieve, tidy, unpacked
from .fitting import labelled_sample, minimise, sigmoid

ORDERS = (4, 5, 6)
BITS = 18
#: Training texts of each class, at most.
PER_CLASS = 1500
#: Frequencies are per so many n-grams; the smoothing of the sums; the ridge.
PER, SMOOTH, L2 = 1000.0, 0.1, 0.1
#: Bytes of a text that are hashed at once.
CHUNK = 1 << 16
#: Training texts whose products are made at once.
BLOCK = 64


def grams(b: np.ndarray, orders: tuple[int, ...] = ORDERS, bits: int = BITS) -> np.ndarray:
    """Hashes of all n-grams of a text's bytes, repeats included."""
    b = b.astype(np.uint64)
    out, h = [], b
    for n in range(2, max(orders) + 1):
        if len(h) < 2:
            break
        h = h[:-1] * np.uint64(1099511628211) + b[n - 1 :]
        if n in orders:
            x = (h ^ np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            out.append(((x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - bits)).astype(np.int32))
    return np.concatenate(out) if out else np.zeros(0, np.int32)


def features(text: str, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """A text's distinct hashes, and the logarithm of one and how often each stands among PER n-grams of it.

    Texts longer than CHUNK bytes are counted piece by piece, so that a worker's memory does not follow the longest text.
    """
    b = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-8", "surrogatepass"), np.uint8)
    if len(b) <= CHUNK:
        h, n = np.unique(grams(b, bits=bits), return_counts=True)
    else:
        table = np.zeros(1 << bits, np.int64)
        for order in ORDERS:
            for at in range(0, len(b) - order + 1, CHUNK):
                table += np.bincount(grams(b[at : at + CHUNK + order - 1], (order,), bits), minlength=1 << bits)
        h = np.flatnonzero(table).astype(np.int32)
        n = table[h]
    return h, np.log1p(n * (PER / max(1, n.sum()))).astype(np.float32)


@dataclass
class Model:
    weights: np.ndarray  # of each hash, scaled by its ratio
    bias: float

    def score(self, text: str) -> float:
        h, x = features(text, len(self.weights).bit_length() - 1)
        return float(sigmoid(np.float64(self.weights[h] @ x + self.bias)))


def fit(texts: list[str], labels: np.ndarray, weights: np.ndarray, bits: int = BITS, l2: float = L2) -> Model:
    """Without texts of both classes the score is the weighted share of label 1 everywhere (0 without any)."""
    labels, weights = np.asarray(labels, float), np.asarray(weights, float)
    if len(texts) == 0 or labels.min() == labels.max():
        share = float(labels.mean()) if len(texts) else 0.0
        return Model(np.zeros(1 << bits, np.float32), float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    sums, place = np.full((2, 1 << bits), SMOOTH), np.full(1 << bits, -1, np.int32)
    for text, y in zip(texts, labels, strict=True):
        h, x = features(text, bits)
        sums[int(y), h] += x
        place[h] = 0
    met = np.flatnonzero(place == 0)
    place[met] = np.arange(len(met))
    ratio = (np.log(sums[1] / sums[1].sum()) - np.log(sums[0] / sums[0].sum()))[met].astype(np.float32)
    del sums
    blocks = []
    for at in range(0, len(texts), BLOCK):  # features are made twice, as only this small form of them is held for all texts
        own = [features(t, bits) for t in texts[at : at + BLOCK]]
        sizes = np.array([len(h) for h, _ in own])
        blocks.append((slice(at, at + len(own)), sizes, place[np.concatenate([h for h, _ in own])], np.concatenate([x for _, x in own]).astype(np.float16)))
    weights, m = weights / weights.mean(), len(met)

    def loss(v: np.ndarray) -> tuple[float, np.ndarray]:
        value, slope = l2 / 2 * (v[:-1] @ v[:-1]), l2 * v
        slope[-1] = 0
        scaled = v[:-1] * ratio
        for part, sizes, cols, x in blocks:
            y, w = labels[part], weights[part]
            rows = np.repeat(np.arange(len(y)), sizes)
            z = np.bincount(rows, x * scaled[cols], len(y)) + v[-1]
            g = w * (sigmoid(z) - y)
            value += (w * (np.logaddexp(0, z) - y * z)).sum()
            slope[:-1] += ratio * np.bincount(cols, x * g[rows], m)
            slope[-1] += g.sum()
        return value, slope

    v = minimise(loss, np.zeros(m + 1), steps=60, memory=5, tol=1e-5)
    out = np.zeros(1 << bits, np.float32)
    out[met] = ratio * v[:-1]
    return Model(out, float(v[-1]))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Fits on at most ``per_class`` labelled texts of each class (see :func:`labelled_sample`)."""
    rows = labelled_sample(docs, labels, "toxic", per_class).orderBy("id").collect()
    model = fit([r.text for r in rows], np.array([r.label for r in rows]), np.array([r.weight for r in rows]))
    del rows
    relieve(docs.sparkSession)
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """All columns of ``docs`` with ``score`` and ``predicted`` of each whole text.

    Null counts as empty, and an empty text gets the score of its one or two
    blanks, that is of no feature; a long text is read whole, in time in
    proportion.  Rows are scored one by one, so repeats and empty tables need
    no rule; columns of the same names are replaced.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    place = docs.columns.index(text_col)  # the text goes to the workers once, inside its row
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))  # 2 ** BITS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            texts = batch.column(0).field(place)
            s = np.array([own.score(texts[i].as_py() or "") for i in range(len(texts))], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], names=["row", "score"])

    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("score", T.DoubleType())])
    return unpacked(rows.mapInArrow(tidy(run), schema), score="score", predicted=(F.col("score") >= threshold).cast("int"))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
