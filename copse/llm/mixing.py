"""Mixing sources to target weights over fixed-length token blocks.

The words of a source's documents, in a fixed pseudorandom order of documents,
form one stream that is packed into blocks of ``block_words`` words.  The mix
is a sequence of block slots dealt over output shards: each shard draws its
number of slots per source from a multinomial over what the sources still owe.
The k-th slot of a source takes the block at index perm(k mod n) of pass
k div n, where perm is a keyed Feistel permutation of the n block indexes of
that source and pass; blocks join slots by that index.

Only per-source totals reach the driver; the shard table has ``shards`` times
sources rows, and slots are made in executors in runs of ``SLOT_RUN``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, cut, listed, tidy, word_count

BLOCK_WORDS = 128
SHARDS = 64
SEED = 42
SLOT_RUN = 1 << 16
#: Documents in a bucket of one source, over which running word counts are made.
BUCKET_ROWS = 500
#: Weights of the sources by code point, repeating; their targets share BUDGET of all words, none above CAP times its own.
WEIGHTS, BUDGET, CAP = (3.0, 1.0, 2.0), 1.5, 2.0


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, cap: float = CAP) -> dict[str | None, float]:
    """Target words of each source: by weight, stopped at ``cap`` times its size, the excess reshared by weight.

    Sources are weighed in code point order, null last.  Sources without words have target 0.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out = {s: 0.0 for s in order}
    left, open_ = budget * sum(sizes.values()), [s for s in order if sizes[s] > 0]
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if share * weight[s] >= cap * sizes[s]]
        if not full:
            return out | {s: share * weight[s] for s in open_}
        for s in full:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ = [s for s in open_ if s not in set(full)]
    return out


def permuted(k: np.ndarray, n: int, key: int) -> np.ndarray:
    """The image of each k in [0, n) under a permutation of [0, n) chosen by ``key``: four Feistel rounds, walked until inside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    rounds = np.random.default_rng(key).integers(1, 1 << 63, size=(4, 2), dtype=np.uint64) | np.uint64(1)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for a, b in rounds:
            f = (right + b) * a
            f ^= f >> np.uint64(29)
            f *= np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f >> np.uint64(32)) & mask)
        return (left << np.uint64(half)) | right

    x = once(k.astype(np.uint64))
    while (outside := x >= np.uint64(n)).any():
        x[outside] = once(x[outside])
    return x.astype(np.int64)


def shard_counts(quota: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Slots of each source in each shard: multinomial draws over what the sources still owe; columns sum to ``quota``."""
    rng, owed, out = np.random.default_rng(seed), quota.astype(np.int64).copy(), np.zeros((shards, len(quota)), np.int64)
    for s in range(shards):
        want = -(-int(owed.sum()) // (shards - s))
        if s == shards - 1 or want == 0:
            draw = owed.copy() if s == shards - 1 else np.zeros_like(owed)
        else:
            draw = np.minimum(rng.multinomial(want, owed / owed.sum()), owed)
            short = want - int(draw.sum())
            for i in np.argsort(draw - owed, kind="stable") if short else ():
                more = min(short, int(owed[i] - draw[i]))
                draw[i] += more
                short -= more
        out[s], owed = draw, owed - draw
    return out


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


class Mix:
    """The mix of one table: ``units`` (documents with their place in the streams) and ``pieces`` (what each slot takes of them).

    Rows equal in id, source and text are one unit: each takes what the unit
    takes.  Null and empty texts have no words and are never taken; long ones
    are cut into blocks like any other.  An empty table gives an empty mix.
    Columns keep their names, whatever they are.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = SEED, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, cap: float = CAP):
        spark = docs.sparkSession
        text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
        self.docs, self.id, self.text, self.source, self.h = docs, F.col(f"`{id_col}`"), text, F.col(f"`{source_col}`"), F.xxhash64(text)
        self.rows = cut(docs.select(self.id.alias("id"), self.source.alias("source"), self.h.alias("h"), word_count(text).alias("size")))
        units = self.rows.distinct()
        counted = self.rows.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("n")).collect()
        distinct = {r.source: r.words for r in units.groupBy("source").agg(F.sum("size").alias("words")).collect()}
        self.sizes = {r.source: r.words for r in counted}
        self.targets = targets(self.sizes, weights, budget, cap)
        order = sorted(self.sizes, key=lambda s: (s is None, s or ""))
        n_blocks = np.array([-(-distinct[s] // block_words) for s in order], dtype=np.int64)
        ratio = np.array([self.targets[s] / self.sizes[s] if self.sizes[s] else 0.0 for s in order])
        quota = np.minimum(np.rint(ratio * n_blocks), np.floor(cap) * n_blocks).astype(np.int64)
        rows = {r.source: r.n for r in counted}
        known = [(i, s, int(self.sizes[s]), float(self.targets[s]), -(-rows[s] // BUCKET_ROWS)) for i, s in enumerate(order)]
        self.sources = listed(spark, known, sid=pa.int32(), source=pa.string(), source_size=pa.int64(), target=pa.float64(), buckets=pa.int64())
        self.units = self._placed(units, block_words)
        self.slots = self._slots(spark, quota, n_blocks, shards, seed)
        on = ["sid", "block"]  # both sides grow with the words; their sizes as planned say nothing, as slots are made in executors
        self.pieces = self._pieces(block_words).join(self.slots.hint("merge"), on).select("source", "id", "h", "shard", "slot", "pass", "block", "start", "words")

    def _placed(self, units: DataFrame, block_words: int) -> DataFrame:
        """Units with ``first``, the place of their first word in the stream of their source."""
        u = units.join(self.sources.withColumnRenamed("source", "of"), _same(F.col("source"), F.col("of")))
        u = u.withColumn("bucket", F.pmod(F.xxhash64("id", "h"), F.col("buckets")))
        before = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        offsets = u.groupBy("sid", "bucket").agg(F.sum("size").alias("w")).select("sid", "bucket", F.coalesce(F.sum("w").over(before), F.lit(0)).alias("base"))
        inside = Window.partitionBy("sid", "bucket").orderBy("id", "h").rowsBetween(Window.unboundedPreceding, -1)
        u = u.withColumn("local", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        return u.join(offsets, ["sid", "bucket"]).select("sid", "source", "id", "h", "size", (F.col("base") + F.col("local")).alias("first"))

    def _pieces(self, b: int) -> DataFrame:
        """A row for each block that a unit has words in: which words."""
        u = self.units.where("size > 0")
        u = u.withColumn("block", F.explode(F.sequence(F.floor(F.col("first") / b), F.floor((F.col("first") + F.col("size") - 1) / b))))
        start = F.greatest(F.col("block") * b - F.col("first"), F.lit(0))
        end = F.least((F.col("block") + 1) * b - F.col("first"), F.col("size"))
        return u.select("sid", "source", "id", "h", "block", start.alias("start"), (end - start).alias("words"))

    @staticmethod
    def _slots(spark, quota: np.ndarray, n_blocks: np.ndarray, shards: int, seed: int) -> DataFrame:
        """``(sid, shard, slot, pass, block)``: the block that each slot takes."""
        counts = shard_counts(quota, shards, seed)
        firsts = np.cumsum(counts, axis=0) - counts
        runs = [(int(i), s, int(n_blocks[i]), int(firsts[s, i]), int(counts[s, i])) for s in range(shards) for i in np.flatnonzero(counts[s])]
        table = listed(spark, runs, sid=pa.int32(), shard=pa.int32(), n=pa.int64(), k=pa.int64(), slots=pa.int64())
        step = F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1, F.lit(SLOT_RUN).cast("long"))).alias("at")
        table = table.select("sid", "shard", "n", "k", "slots", step).select("sid", "shard", "n", (F.col("k") + F.col("at")).alias("k"), F.least(F.col("slots") - F.col("at"), F.lit(SLOT_RUN)).alias("slots"))

        def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for r in frame.itertuples(index=False):
                    k = np.arange(r.k, r.k + r.slots, dtype=np.int64)
                    turn = k // r.n
                    block = np.empty_like(k)
                    for p in np.unique(turn):
                        block[turn == p] = permuted(k[turn == p] % r.n, int(r.n), hash((seed, int(r.sid), int(p))) & 0x7FFFFFFF)
                    yield pd.DataFrame({"sid": np.int32(r.sid), "shard": np.int32(r.shard), "slot": k, "pass": turn, "block": block})

        return table.repartition(max(1, min(len(runs), 200))).mapInPandas(tidy(deal), "sid int, shard int, slot bigint, pass bigint, block bigint")

    def taken(self) -> DataFrame:
        """A row for each input row: id, size, source_size, target, taken (words, repeats counted)."""
        sums = self.pieces.groupBy("source", "id", "h").agg(F.sum("words").alias("taken"))
        r = self.rows.join(self.sources.select(F.col("source").alias("of"), "source_size", "target"), _same(F.col("source"), F.col("of")))
        t = sums.select(*[F.col(c).alias(f"t_{c}") for c in sums.columns])
        r = r.join(t, _same(F.col("source"), F.col("t_source")) & _same(F.col("id"), F.col("t_id")) & (F.col("h") == F.col("t_h")), "left")
        return r.select("id", "size", "source_size", "target", F.coalesce("t_taken", F.lit(0)).cast("long").alias("taken"))

    def documents(self, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
        """The mix as documents, columns as in the input: each unit once for each pass that takes words of it.

        A pass that takes all words has the text as it is; else the runs of
        words that it takes, one space between runs.  ``length_col``, if there,
        is set to the code points of the new text.
        """
        cols = self.docs.columns
        per = self.pieces.groupBy("source", "id", "h", "pass").agg(F.array_sort(F.collect_list(F.struct("start", "words"))).alias("runs"), F.sum("words").alias("n"))
        t = per.select(*[F.col(c).alias(f"t_{c}") for c in per.columns])
        packed = self.docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"), self.id.alias("id"), self.source.alias("source"), self.h.alias("h"), self.text.alias("body"))
        both = packed.join(t, _same(F.col("source"), F.col("t_source")) & _same(F.col("id"), F.col("t_id")) & (F.col("h") == F.col("t_h")))
        whole = F.col("t_n") == word_count(F.col("body"))
        new = F.when(whole, F.col("body")).otherwise(F.pandas_udf(_cut_words, "string")(F.when(~whole, F.col("body")), F.col("t_runs")))
        both = both.select("row", new.alias("new"))
        out = [F.col("new").alias(c) if c == text_col else F.length("new").cast("long").alias(c) if c == length_col else F.col(f"row.`{c}`").alias(c) for c in cols]
        return both.select(*out)


_WORD = re.compile(WORD)


def _cut_words(texts: pd.Series, runs: pd.Series) -> pd.Series:
    """The words of each text in ``runs`` (start, words), white space inside a run kept; null for a null text."""
    out = []
    for text, own in zip(texts, runs, strict=True):
        if text is None:
            out.append(None)
            continue
        at = [m.span() for m in _WORD.finditer(text)]
        joined: list[list[int]] = []
        for r in own:
            if joined and joined[-1][1] == r["start"]:
                joined[-1][1] += r["words"]
            else:
                joined.append([r["start"], r["start"] + r["words"]])
        out.append(" ".join(text[at[a][0] : at[b - 1][1]] for a, b in joined))
    return pd.Series(out, dtype=object)


def op5_mix_sources(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return Mix(table(spark, sf_dir, "documents")).taken().withColumnRenamed("id", "doc_id")
