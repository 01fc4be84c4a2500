"""What the trained operators share: bounded labelled samples and a small L-BFGS."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import held_out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, id_col: str = "doc_id") -> DataFrame:
    """``(id, text, label, weight)``: whole texts of at most ``per_class`` rows of each label 0 and 1, drawn by hash of the id.

    Only rows that are not held out count; null ids, labels and texts give no
    row; an id labelled both ways gives none.  ``weight`` is how many labelled
    rows of its class a drawn one stands for.  The drawn ids (at most 2 x
    ``per_class``) are broadcast, so that documents are not shuffled.
    """
    own = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y in (0, 1)").where(~held_out(F.col("id")))
    own = own.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("top")).where("y = top").select("id", "y", F.xxhash64("id").alias("draw"))
    sizes = own.groupBy("y").agg(F.count("*").alias("n"))
    parts = [own.where(F.col("y") == y).orderBy("draw", "id").limit(per_class) for y in (0, 1)]
    drawn = parts[0].unionByName(parts[1]).withColumn("taken", F.count("*").over(Window.partitionBy("y")))
    drawn = drawn.join(F.broadcast(sizes), "y").select(F.col("id").alias("of"), "y", (F.col("n") / F.col("taken")).alias("weight"))
    texts = docs.select(F.col(id_col).alias("id"), "text").where("text is not null").join(F.broadcast(drawn), F.col("id") == F.col("of"))
    return texts.select("id", "text", F.col("y").alias("label"), "weight")


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int = 100, memory: int = 8, tol: float = 1e-6) -> np.ndarray:
    """Argument that (nearly) minimises a smooth f, which returns value and gradient: L-BFGS with backtracking."""
    value, grad = f(x)
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        d, alphas = -grad, []
        for s, y, rho in reversed(pairs):
            a = rho * (s @ d)
            alphas.append(a)
            d = d - a * y
        if pairs:
            s, y, _ = pairs[-1]
            d = d * ((s @ y) / (y @ y))
        for (s, y, rho), a in zip(pairs, reversed(alphas), strict=True):
            d = d + (a - rho * (y @ d)) * s
        slope = grad @ d
        if slope >= 0:
            d, slope, pairs = -grad, -(grad @ grad), []
        t = 1.0 if pairs else min(1.0, 1.0 / (np.abs(grad).sum() + 1e-12))
        for _ in range(30):
            new, new_grad = f(x + t * d)
            if new <= value + 1e-4 * t * slope:
                break
            t /= 2
        else:
            break
        s, y = t * d, new_grad - grad
        if s @ y > 1e-12:
            pairs = [*pairs, (s, y, 1.0 / (s @ y))][-memory:]
        x, done = x + s, value - new <= tol * max(1.0, abs(value))
        value, grad = new, new_grad
        if done:
            break
    return x


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))
