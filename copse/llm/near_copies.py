"""Near copies by SimHash, and by Jaccard similarity of word shingles.

First come the links of :mod:`simhash` (fingerprints of the same shingles,
pigeonring chains), each checked by the exact similarity of the two texts'
sets of 64-bit shingle hashes.  At a similarity of 0.8 about 10 of 64 bits
differ, and keys for so wide a distance would hold a few bits each; what the
fingerprints miss comes from bands: texts that share one of ``BANDS`` x
``ROWS`` minima of the shingles' hashes (``ROWS`` agree).  At similarity 0.8 a
pair shares none of the 32 bands of 5 with a probability of 3 in a million,
and less above.  Every link rests on the exact similarity.

Of the bands' pairs only those are read whose texts SimHash has not linked.
First all texts of a band's key are compared with the least of them, so that a
large group of near copies makes one pair a text and key.  Then, where texts of
a key are still in different components, the task that holds the key compares
all pairs across components, first by their minima, and gives only the links
that join two of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import simhash
from .common import cut, tidy
from .exact_dedup import BITS, _bitmap, _hit, _slot
from .graph import components

SHINGLE, SIMILARITY, SEED = 5, 0.8, 42
#: Differing bits of fingerprints that are linked.
DISTANCE = 3
BANDS, ROWS = 32, 5
#: Pairs whose minima agree less are not compared exactly: six standard deviations below ``SIMILARITY``.
SLACK = 0.2
#: Shingles whose hashes are permuted at once, and texts compared at once with all of a key.
BLOCK, TEXTS = 1 << 10, 64
#: Pairs whose minima are compared at once.
PAIRS = 1 << 16

_R = np.random.default_rng(SEED)
_A = (_R.integers(0, 1 << 63, BANDS * ROWS, np.uint64) << np.uint64(1)) | np.uint64(1)
_B = _R.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
_C = (_R.integers(0, 1 << 63, ROWS, np.uint64) << np.uint64(1)) | np.uint64(1)


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a text of fewer words is one shingle, one without words the empty shingle."""
    import xxhash

    words = text.lower().split()
    grams = {b" ".join(words)} if len(words) < shingle else set(map(b" ".join, zip(*[words[i:] for i in range(shingle)], strict=False)))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(g, SEED) for g in grams), np.uint64, len(grams)))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of each permutation of the hashes."""
    least = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), BLOCK):
        np.minimum(least, (_A[:, None] * hashes[None, at : at + BLOCK] + _B[:, None]).min(1), out=least)
    return least


def sketches(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """``(id, h, n, bands, sig)`` of each row: id, hash of the text, distinct shingles, a key for each band, a byte of each minimum."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("h"), text.cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, sig = [], [], []
            for t in batch.column(2):
                hashes = shingles(t.as_py(), shingle)
                least = minima(hashes)
                n.append(len(hashes))
                keys.append((least.reshape(BANDS, ROWS) * _C).sum(1, dtype=np.uint64).view(np.int64))
                sig.append(least.astype(np.uint8).tobytes())
            flat = pa.array(np.concatenate(keys) if keys else np.array([], np.int64))
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * BANDS), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), bands, pa.array(sig, pa.binary())], names=["id", "h", "n", "bands", "sig"])

    more = [T.StructField("h", T.LongType()), T.StructField("n", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sig", T.BinaryType())]
    return rows.mapInArrow(tidy(run), T.StructType([rows.schema["id"], *more]))


def similar(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= similarity * (len(x) + len(y) - both) - 1e-9


def asked(docs: DataFrame, text_col: str, of: DataFrame) -> DataFrame:
    """``docs`` with boolean ``__asked``: the hash of the text may be among those of ``of`` (h), by a bitmap of fixed size.

    So texts are not sent to others for the few that are sought.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    wanted = _bitmap(of.select(_slot(F.col("h"), bits=BITS).alias("slot")), BITS)
    return _hit(docs, _slot(F.xxhash64(text), bits=BITS), wanted, "__asked")


def sets(docs: DataFrame, of: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """``(h, hashes)``: the shingles of each text whose hash is in ``of`` (h)."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    texts = asked(docs, text_col, of).where("__asked").select(F.xxhash64(text).alias("h"), text.cast("binary").alias("text")).join(of.distinct(), "h", "left_semi").dropDuplicates(["h"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [shingles(t.as_py(), shingle).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hashes, pa.binary())], names=["h", "hashes"])

    return cut(texts.mapInArrow(tidy(read), "h long, hashes binary"))


def verified(docs: DataFrame, edges: DataFrame, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """Those of ``edges`` (a, b: hashes of texts) whose shingle sets are at least as similar as ``similarity``."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = zip(batch.column(2), batch.column(3), strict=True)
            near = [similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), similarity) for x, y in ends]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    read = sets(docs, edges.select(F.col("a").alias("h")).unionByName(edges.select(F.col("b").alias("h"))), text_col, shingle)
    of_a, of_b = read.select(F.col("h").alias("a"), F.col("hashes").alias("x")), read.select(F.col("h").alias("b"), F.col("hashes").alias("y"))
    return edges.join(of_a, "a").join(of_b, "b").select("a", "b", "x", "y").mapInArrow(tidy(compare), "a long, b long")


def _across(rows: np.ndarray, sig: np.ndarray, bands: np.ndarray, hashes: list, similarity: float) -> list[tuple[int, int]]:
    """Spanning edges of the links across components among one key's texts (band, key, h, root, n)."""
    band, _, h, root, n = rows.T
    roots, which, size = np.unique(root, return_inverse=True, return_counts=True)
    out: list[tuple[int, int]] = []
    if len(roots) < 2:
        return out
    label = list(range(len(roots)))

    def find(i: int) -> int:
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    rest = np.flatnonzero(which != size.argmax())  # of each pair across components one at least is not in the largest
    for at in range(0, len(rest), TEXTS):
        i = rest[at : at + TEXTS]
        fits = (which[i, None] != which[None]) & (np.minimum(n[i, None], n[None]) >= similarity * np.maximum(n[i, None], n[None]) - 1e-9)
        a, b = np.nonzero(fits)
        for part in range(0, len(a), PAIRS):
            u, v = i[a[part : part + PAIRS]], b[part : part + PAIRS]
            likely = (sig[u] == sig[v]).mean(1) >= similarity - SLACK
            u, v = u[likely], v[likely]
            own = (bands[u] == bands[v]).argmax(1) == band[0]  # a pair is compared at the first band that it shares
            for x, y in zip(u[own], v[own], strict=True):
                p, q = find(which[x]), find(which[y])
                if p != q and similar(np.frombuffer(hashes[x], np.uint64), np.frombuffer(hashes[y], np.uint64), similarity):
                    label[p] = q
                    out.append((int(h[x]), int(h[y])))
    return out


def _linked(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """From rows (band, key, h, root, n, sig, bands, hashes) sorted by band and key: the spanning edges of each key."""
    held: list[tuple] = []  # the rows of the key that is not yet known to be complete

    def done() -> list[tuple[int, int]]:
        rows, sig, bands = (np.concatenate([x[k] for x in held]) for k in range(3))
        return _across(rows, sig, bands, [v.as_buffer() for x in held for v in x[3]], similarity)

    def out(edges: list) -> pa.RecordBatch:
        a, b = zip(*edges, strict=True) if edges else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)])
        sig = np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint8).reshape(len(rows), -1)
        bands = batch.column(6).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
        starts = np.concatenate([[0], np.flatnonzero(np.any(rows[1:, :2] != rows[:-1, :2], axis=1)) + 1, [len(rows)]])
        edges: list = []
        for s, e in zip(starts, starts[1:], strict=False):
            if held and (held[0][0][0, :2] != rows[s, :2]).any():
                edges += done()
                held = []
            held.append((rows[s:e], sig[s:e], bands[s:e], batch.column(7).slice(s, e - s)))
        yield out(edges)
    if held:
        yield out(done())


def simhash_links(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float, distance: int = DISTANCE) -> DataFrame:
    """``(a, b)``: links of texts (by hash) whose fingerprints differ in ``distance`` bits at most and that are similar.

    A fingerprint stands for all texts that have it by their least hash.
    """
    texts = cut(simhash.fingerprints(docs, id_col, text_col, shingle).select("h", "fp").distinct())
    nodes = cut(texts.groupBy("fp").agg(F.min("h").alias("own")))
    equal = texts.join(nodes, "fp").where("h <> own").select(F.col("h").alias("a"), F.col("own").alias("b"))
    ends = lambda k: nodes.select(F.col("fp").alias(k), F.col("own").alias(f"{k}_own"))
    apart = simhash.links(nodes.select("fp"), distance).join(ends("a"), "a").join(ends("b"), "b").select(F.col("a_own").alias("a"), F.col("b_own").alias("b"))
    return cut(verified(docs, cut(equal.unionByName(apart)), text_col, shingle, similarity))


def links(docs: DataFrame, rows: DataFrame, text_col: str, shingle: int, similarity: float, known: DataFrame) -> DataFrame:
    """``(a, b)``: edges whose components are those of all links among the texts of ``rows``, the sketches of ``docs``; ``known`` are some of them."""
    keys = rows.select("h", F.posexplode("bands").alias("band", "key"))
    hubs = keys.groupBy("band", "key").agg(F.min("h").alias("hub"), F.max("h").alias("last")).where("hub < last").drop("last")
    shared = cut(keys.join(hubs, ["band", "key"]))
    stars = shared.where("h <> hub").select(F.col("h").alias("a"), F.col("hub").alias("b")).distinct()
    found = cut(components(known))
    root = lambda k: found.select(F.col("node").alias(k), F.col("root").alias(f"{k}_root"))
    stars = stars.join(root("a"), "a", "left").join(root("b"), "b", "left").where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b"))
    near = cut(known.unionByName(verified(docs, cut(stars.select("a", "b")), text_col, shingle, similarity)))
    roots = components(near)
    placed = shared.join(roots, F.col("h") == F.col("node"), "left").select("band", "key", "h", F.coalesce("root", "h").alias("root"))
    mixed = placed.groupBy("band", "key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").drop("low", "high")
    rest = cut(placed.join(mixed, ["band", "key"]).dropDuplicates(["band", "key", "h"]))
    of = rest.select("h")
    sketch = rows.select("h", "n", "sig", "bands").join(of.distinct(), "h", "left_semi").dropDuplicates(["h"]).join(sets(docs, of, text_col, shingle), "h")
    ordered = rest.join(sketch, "h").select("band", "key", "h", "root", "n", "sig", "bands", "hashes").repartition("band", "key").sortWithinPartitions("band", "key")
    return near.unionByName(ordered.mapInArrow(tidy(lambda batches: _linked(batches, similarity)), "a long, b long"))


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each component of near copies, columns unchanged: that of the least (id, hash of the text).

    Texts are linked whose sets of ``shingle`` words in a row have a Jaccard
    similarity of ``similarity`` or more.  Texts without words are alike; null
    counts as empty.  Null ids come after all others.  Rows equal in id and
    text are alike and stay or go together.
    """
    rows = cut(sketches(docs, id_col, text_col, shingle))
    key = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("h").alias("h"))
    nodes = cut(rows.groupBy("h").agg(F.min(key).alias("own")))
    known = simhash_links(docs, id_col, text_col, shingle, similarity)
    roots = components(links(docs, rows, text_col, shingle, similarity, known))
    grouped = nodes.join(roots, F.col("h") == F.col("node"), "left").select(F.col("h").alias("of"), "own", F.coalesce("root", "h").alias("root"))
    least = grouped.groupBy("root").agg(F.min("own").alias("least"))
    of = grouped.join(least, "root").select("of", "least")
    gone = rows.join(of, F.col("h") == F.col("of")).where(F.col("least") != key).select(F.col("id").alias("__gone"), F.col("h").alias("__gone_h")).distinct()
    gone = cut(gone)
    marked = asked(docs, text_col, gone.select(F.col("__gone_h").alias("h")))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    same = F.col(f"`{id_col}`").eqNullSafe(F.col("__gone")) & (F.xxhash64(text) == F.col("__gone_h"))
    kept = marked.where("__asked").join(gone, same, "left_anti")
    return marked.where("not __asked").unionByName(kept).drop("__asked")
