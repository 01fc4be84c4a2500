"""Exact top-k by inner product: a KD-tree per shard, best-first traversal, a propagated kth score.

A frame fitted on a bounded sample (a rotation onto the principal axes, and
median splits on them) deals the vectors to shards of neighbours; shards that
are too large are dealt further by hash.  Each shard becomes one KD-tree once:
median splits on the widest side of the rotated vectors, tight bounding boxes,
and the greatest norm in each box.  Queries travel to trees, never trees to
queries.  A query visits first the shard where it lies itself, then, round by
round, GROWTH times as many of the shards that are left, best bound first; the
kth best row so far goes along, and shards and boxes whose bound is below its
score are not opened.  Scores are inner products of integers, and exact.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, discard, scratch, table

SHARD_ROWS, LEAF, GROWTH = 4096, 128, 8
#: Rows that the frame is fitted on, and shards that queries are compared with, at most; beyond, shards grow.
SAMPLE, SHARDS = 20_000, 16_384
K, SCALE, QUERY_STEP = 20, 64, 20
LONG = 1 << 63
#: A bound may fall short of an integer score by rounding; relative to the norms.
SLACK = 1e-9


def bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """``(queries, boxes)``: no point of a box, of ``norm`` at most, has a larger inner product with the query.

    The lesser of two: the best corner of the box; and, on the axes where the box lies all on the query's far side, the
    nearest face, on the others as much as the norm allows.
    """
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    corner = up @ high.T + down @ low.T
    far = up @ np.minimum(high, 0).T + down @ np.maximum(low, 0).T
    own = (q * q).sum(1)
    free = own[:, None] - (up * up) @ (high <= 0).T - (down * down) @ (low >= 0).T
    ball = far + np.sqrt(np.maximum(free, 0)) * norm
    return np.maximum(np.minimum(corner, ball) + SLACK * (1 + np.sqrt(own)[:, None] * norm), -float(LONG))


def products(x: np.ndarray, q: np.ndarray, most: float) -> np.ndarray:
    """Exact inner products of integers, none above ``most``; what a long cannot hold counts as its ends."""
    if most < 2**53:
        return (x @ q).astype(np.int64)
    big = (x.astype(np.int64).astype(object) * q.astype(np.int64).astype(object)).sum(1)
    return np.array([min(max(int(v), -LONG), LONG - 1) for v in big], np.int64)


class Tree:
    """KD-tree over integer vectors: rows are put in the order of the leaves, boxes are in the rotated frame."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray, x: np.ndarray, turned: np.ndarray, leaf: int = LEAF):
        n = len(ids)
        at = np.lexsort((copies, ids))
        low, high, norm, span, kids = [], [], [], [], []
        length = np.sqrt((turned * turned).sum(1))
        todo = [(0, n, -1)]
        while todo:
            a, b, up = todo.pop()
            own = at[a:b]
            box = turned[own]
            lo, hi = box.min(0), box.max(0)
            me = len(span)
            low.append(lo)
            high.append(hi)
            norm.append(length[own].max())
            span.append((a, b))
            kids.append([])
            if up >= 0:
                kids[up].append(me)
            side = int(np.argmax(hi - lo)) if b - a > leaf else -1
            if side < 0 or hi[side] == lo[side]:
                continue
            mid = (b - a) // 2
            at[a:b] = own[np.argpartition(box[:, side], mid)]
            todo += [(a, a + mid, me), (a + mid, b, me)]
        self.low, self.high, self.norm = np.array(low), np.array(high), np.array(norm)
        self.span, self.kids = np.array(span, np.int64), [k or [0, 0] for k in kids]
        self.kids = np.array(self.kids, np.int64)
        self.ids, self.copies, self.x = ids[at], copies[at], x[at]

    _PARTS = ("low", "high", "norm", "span", "kids", "ids", "copies", "x")

    def pack(self) -> bytes:
        small = next(t for t in (np.int8, np.int16, np.int32, np.int64) if self.x.min() >= np.iinfo(t).min and self.x.max() <= np.iinfo(t).max)
        parts = [np.ascontiguousarray(getattr(self, p).astype(small) if p == "x" else getattr(self, p)) for p in self._PARTS]
        head = ";".join(f"{p.dtype.str}:{','.join(map(str, p.shape))}" for p in parts).encode()
        return len(head).to_bytes(4, "big") + head + b"".join(p.tobytes() for p in parts)

    @classmethod
    def unpack(cls, raw: bytes) -> Tree:
        self, end = cls.__new__(cls), 4 + int.from_bytes(raw[:4], "big")
        for name, one in zip(cls._PARTS, raw[4:end].decode().split(";"), strict=True):
            kind, shape = one.split(":")
            shape = tuple(map(int, shape.split(",")))
            size = math.prod(shape)
            setattr(self, name, np.frombuffer(raw, np.dtype(kind), size, end).reshape(shape))
            end += size * np.dtype(kind).itemsize
        if self.x.dtype != np.int64:
            self.x = self.x.astype(np.float64)
        self.top = float(np.abs(self.x.astype(np.float64)).max())
        return self

    def search(self, own: int, q: np.ndarray, bound: np.ndarray, kth: tuple[int, int], k: int) -> tuple[list[tuple[int, int]], int]:
        """The rows of this tree that beat ``kth`` (score, -id), as a heap of k at most, and how many leaves were opened.

        ``bound`` has the query's bound of each box; rows of the query's own id take no part.
        """
        best: list[tuple[int, int]] = []
        floor, opened, agenda = kth, 0, [(-bound[0], 0)]
        most = self.top * float(np.abs(q.astype(np.float64)).max()) * len(q)
        while agenda:
            value, node = heapq.heappop(agenda)
            if -value < floor[0]:
                break
            a, b = self.kids[node]
            if a:
                for c in (a, b):
                    if bound[c] >= floor[0]:
                        heapq.heappush(agenda, (-bound[c], c))
                continue
            a, b = self.span[node]
            opened += 1
            score = products(self.x[a:b], q, most)
            for r in np.flatnonzero(score >= floor[0]):
                got = (int(score[r]), -int(self.ids[a + r]))
                if got[1] == -own:
                    continue
                for _ in range(min(k, int(self.copies[a + r]))):
                    if got <= floor:
                        break
                    if len(best) < k:
                        heapq.heappush(best, got)
                    else:
                        heapq.heapreplace(best, got)
                    if len(best) == k and best[0] > floor:
                        floor = best[0]
        return best, opened


class Frame:
    """Principal axes of a sample, and median splits on them: which shard of neighbours a vector is in."""

    def __init__(self, x: np.ndarray, cells: int):
        self.axes = np.linalg.eigh(np.cov(x.T).reshape(x.shape[1], -1))[1][:, ::-1] if len(x) > 1 else np.eye(x.shape[1])
        turned = x @ self.axes
        self.side, self.value, self.kids, self.cell = [], [], [], []
        todo = [(np.arange(len(x)), cells, -1)]
        done = 0
        while todo:
            own, want, up = todo.pop()
            me = len(self.side)
            if up >= 0:
                self.kids[up].append(me)
            box = turned[own]
            spread = box.max(0) - box.min(0)
            side = int(np.argmax(spread))
            split = want > 1 and len(own) > 1 and spread[side] > 0
            value = float(np.median(box[:, side])) if split else 0.0
            left = box[:, side] < value
            if split and not left.any():  # the median is the least value
                value = float(box[box[:, side] > value, side].min())
                left = box[:, side] < value
            self.side.append(side if split else -1)
            self.value.append(value)
            self.kids.append([])
            self.cell.append(done)
            if split:
                todo += [(own[~left], want - want // 2, me), (own[left], want // 2, me)]
            else:
                done += 1

    def cells(self, turned: np.ndarray) -> np.ndarray:
        out = np.empty(len(turned), np.int64)
        todo = [(np.arange(len(turned)), 0)]
        while todo:
            own, node = todo.pop()
            if self.side[node] < 0:
                out[own] = self.cell[node]
                continue
            left = turned[own, self.side[node]] < self.value[node]
            todo += [(own[left], self.kids[node][0]), (own[~left], self.kids[node][1])]
        return out


def quantised(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``(id, x, dim)``: floor(scale * component), as double, within the range of a long.

    Rows with a null id, vector or component, without components, or with a component that is not finite are left out.
    """
    v = F.col(f"`{vec_col}`")
    big = F.lit(float("inf"))
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < big))
    rows = vectors.where(F.col(f"`{id_col}`").isNotNull() & v.isNotNull() & F.coalesce(fine, F.lit(False)) & (F.size(v) > 0))
    return rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.transform(v, lambda c: F.floor(c.cast("double") * scale)).alias("x"), F.size(v).alias("dim"))


class Search:
    """The k highest inner products of each query with the rows of a table.

    Both tables are ``(id, x, dim)`` as :func:`quantised` gives them; vectors
    are compared with those of as many components.  No row of a query's own id
    is a candidate, however often that id stands in the table; other rows are
    candidates each, repeated ones as often as they stand there.  A query id
    that stands there with several vectors asks with the least of them (fewest
    components, then by components).  Empty tables give no rows.

    ``leaves`` is the number of leaves of all trees; ``opened`` counts those that queries opened.
    """

    def __init__(self, vectors: DataFrame, queries: DataFrame, k: int = K, shard_rows: int = SHARD_ROWS, leaf: int = LEAF, growth: int = GROWTH, sample: int = SAMPLE, shards: int = SHARDS):
        self.spark, self.k, self.growth = vectors.sparkSession, k, growth
        sc = self.spark.sparkContext
        self.leaves, self.opened = 0, sc.accumulator(0)
        self.paths: list[str] = []
        rows = self._table(vectors.groupBy("id", "dim", "x").agg(F.count("*").alias("copies")), "vectors")
        n = rows.count()
        per = max(shard_rows, -(-2 * n // shards))
        frames = self._frames(rows, n, per, sample)
        trees = self._trees(rows, frames, per, leaf)
        boxes = {}
        for r in trees.drop("raw").orderBy("dim", "unit").collect():  # SHARDS and a few
            self.leaves += r.leaves
            boxes.setdefault(r.dim, []).append((r.unit, r.cell, r.part, np.array(r.low), np.array(r.high), r.norm))
        shared = {}
        for dim, own in boxes.items():
            unit, cell, part, low, high, norm = zip(*own, strict=True)
            shared[dim] = (frames.get(dim), np.array(unit), np.array(cell), np.array(part), np.stack(low), np.stack(high), np.array(norm))
        self.shared, self.trees = sc.broadcast(shared), trees
        self.most = max((len(own) for own in boxes.values()), default=0)
        least = F.min(F.struct("dim", "x"))
        self.queries = cut(queries.groupBy("id").agg(least.alias("q")).select(F.col("id").alias("query_id"), "q.dim", "q.x"))

    def _table(self, df: DataFrame, what: str) -> DataFrame:
        self.paths.append(scratch(self.spark, what))
        df.write.parquet(self.paths[-1])
        return self.spark.read.parquet(self.paths[-1])

    @staticmethod
    def _frames(rows: DataFrame, n: int, per: int, sample: int) -> dict[int, Frame]:
        """A frame for each number of components met in the sample; it decides where rows lie, never what is found."""
        step = max(1, n // sample)
        drawn: dict[int, list] = {}
        for r in rows.where(F.pmod(F.xxhash64("id", "x"), F.lit(step)) == 0).select("dim", "x").limit(sample).collect():
            drawn.setdefault(r.dim, []).append(r.x)
        total = sum(map(len, drawn.values()))
        return {dim: Frame(np.array(x, np.float64), max(1, math.ceil(n * len(x) / total / per))) for dim, x in drawn.items()}

    def _trees(self, rows: DataFrame, frames: dict[int, Frame], per: int, leaf: int) -> DataFrame:
        """A row for each shard: its place, its box, and its packed tree."""
        shared = self.spark.sparkContext.broadcast(frames)

        def cell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in batches:
                frame["cell"] = 0
                for dim, own in frame.groupby("dim"):
                    if dim in shared.value:
                        f = shared.value[dim]
                        frame.loc[own.index, "cell"] = f.cells(np.stack(own["x"].to_numpy()).astype(np.float64) @ f.axes)
                yield frame

        placed = self._table(rows.mapInPandas(cell, "id long, dim int, x array<long>, copies long, cell int"), "cells")
        parts = placed.groupBy("dim", "cell").agg(F.ceil(F.count("*") / (2 * per)).alias("parts"))
        dealt = placed.join(F.broadcast(parts), ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("id", "x"), F.col("parts")).cast("int"))

        def build(frame: pd.DataFrame) -> pd.DataFrame:
            dim, x = int(frame["dim"].iloc[0]), np.stack(frame["x"].to_numpy())
            f = shared.value.get(dim)
            wide = x.astype(np.float64)
            tree = Tree(frame["id"].to_numpy(np.int64), frame["copies"].to_numpy(np.int64), x, wide @ f.axes if f else wide, leaf)
            head = {"dim": dim, "cell": int(frame["cell"].iloc[0]), "part": int(frame["part"].iloc[0])}
            return pd.DataFrame([head | {"low": tree.low[0], "high": tree.high[0], "norm": tree.norm[0], "leaves": int((tree.kids[:, 0] == 0).sum()), "raw": tree.pack()}])

        made = dealt.groupBy("dim", "cell", "part").applyInPandas(build, "dim int, cell int, part int, low array<double>, high array<double>, norm double, leaves long, raw binary")
        place = F.shiftleft(F.col("dim").cast("long"), 40) + F.shiftleft(F.col("cell").cast("long"), 20) + F.col("part")  # SHARDS bounds both
        return self._table(made.withColumn("unit", place), "trees")

    def _asked(self, state: DataFrame, first: int, last: int) -> DataFrame:
        """Which shards each query goes to in a round: those of these ranks whose bound is not below its kth score."""
        shared = self.shared

        def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in batches:
                for dim, own in frame.groupby("dim"):
                    if dim not in shared.value:
                        continue
                    f, unit, cell, part, low, high, norm = shared.value[dim]
                    for at in range(0, len(own), 64):
                        some = own.iloc[at : at + 64]
                        x = np.stack(some["x"].to_numpy()).astype(np.float64)
                        turned = x @ f.axes if f else x
                        bound = bounds(turned, low, high, norm)
                        home = np.flatnonzero(part == 0)  # the first part of the query's own cell leads
                        lead = np.full(bound.shape, 0)
                        where = f.cells(turned) if f else np.zeros(len(x), int)
                        lead[:, home] = cell[home] == where[:, None]
                        rank = np.lexsort((np.broadcast_to(unit, bound.shape), -bound, -lead), axis=1)[:, first:last]
                        i = np.repeat(np.arange(len(some)), rank.shape[1])
                        j = rank.ravel()
                        go = bound[i, j] >= some["score"].to_numpy()[i]
                        picked = some.iloc[i[go]]
                        yield pd.DataFrame({"unit": unit[j[go]], "query_id": picked["query_id"], "x": picked["x"], "dim": picked["dim"], "score": picked["score"], "vec_id": picked["vec_id"]})

        return state.mapInPandas(ask, "unit long, query_id long, x array<long>, dim int, score long, vec_id long")

    def _answers(self, asked: DataFrame) -> DataFrame:
        """``(query_id, vec_id, score)``: what each shard adds; rows come sorted by shard, its tree first."""
        k, shared, opened = self.k, self.shared, self.opened
        empty = [F.lit(0).cast("long").alias("query_id"), F.lit(None).cast("array<long>").alias("x"), F.lit(0).cast("long").alias("score"), F.lit(0).cast("long").alias("vec_id")]
        both = self.trees.select("unit", "dim", "raw", F.lit(0).alias("role"), *empty).unionByName(asked.select("unit", "dim", F.lit(None).cast("binary").alias("raw"), F.lit(1).alias("role"), "query_id", "x", "score", "vec_id"))

        def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            raw, tree, unit = None, None, None
            for frame in batches:
                out: list[tuple[int, int, int]] = []
                heads = np.flatnonzero(frame["role"].to_numpy() == 0)
                edges = [0, *heads.tolist(), len(frame)]
                for a, b in zip(edges, edges[1:], strict=False):
                    if a == b:
                        continue
                    some = frame.iloc[a:b]
                    if some["role"].iloc[0] == 0:
                        raw, tree, unit = some["raw"].iloc[0], None, some["unit"].iloc[0]
                        some = some.iloc[1:]
                    if not len(some):
                        continue
                    assert (some["unit"] == unit).all()
                    tree = tree or Tree.unpack(raw)
                    axes = shared.value[int(some["dim"].iloc[0])][0]
                    x = np.stack(some["x"].to_numpy())
                    wide = x.astype(np.float64)
                    bound = bounds(wide @ axes.axes if axes else wide, tree.low, tree.high, tree.norm)
                    q = wide if np.abs(wide).max() < 2**53 else x
                    for i, (own, score, vec) in enumerate(zip(some["query_id"].tolist(), some["score"].tolist(), some["vec_id"].tolist(), strict=True)):
                        best, n = tree.search(own, q[i], bound[i], (score, -vec), k)
                        opened.add(n)
                        out += [(own, -v, s) for s, v in best]
                yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

        dealt = both.repartition(max(1, self.most), "unit").sortWithinPartitions("unit", "role")
        return dealt.mapInPandas(answer, "query_id long, vec_id long, score long")

    def result(self) -> DataFrame:
        """``(query_id, rank, vec_id, score)``, ties to the smaller id; fewer rows than k where there are fewer candidates."""
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        found = self.spark.createDataFrame([], "query_id long, vec_id long, score long, rank int")
        first, last = 0, 1
        while first < self.most:
            kth = found.where(F.col("rank") == self.k).select(F.col("query_id").alias("of"), "score", "vec_id")
            none = F.coalesce("score", F.lit(-LONG)).alias("score"), F.coalesce("vec_id", F.lit(LONG - 1)).alias("vec_id")  # any row beats these
            state = self.queries.join(kth, F.col("query_id") == F.col("of"), "left").select("query_id", "dim", "x", *none)
            more = self._answers(self._asked(state, first, last))
            found = cut(found.drop("rank").unionByName(more).withColumn("rank", rank).where(F.col("rank") <= self.k))
            first, last = last, last * self.growth
        for path in self.paths:
            discard(self.spark, path)
        return found.select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, **settings: int) -> DataFrame:
    """The result of a :class:`Search`."""
    return Search(vectors, queries, k, **settings).result()


def op8_kdtree_topk(spark, sf_dir: str) -> DataFrame:
    x = quantised(table(spark, sf_dir, "embeddings"))
    return top_k(x, x.where(F.col("id") % QUERY_STEP == 0))


OP8_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(64 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.x, v.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id AND len(q.x) = len(v.x) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
