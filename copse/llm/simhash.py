"""SimHash near-duplicates with pigeonring filtering.

A fingerprint's 64 bits are cut into ``distance`` + 1 consecutive segments on a
ring.  Of two fingerprints that differ in at most ``distance`` bits, some start
has a chain of consecutive segments whose differences, summed, stay within
chain length x distance / segments at every step: none in the first segment, at
most one bit over the first two, and so on.  The chain of two is joined on
exactly: a key holds the first segment and the second with one bit cleared, 64
keys in all.  Within a key longer chains and then the full Hamming distance
are checked.

Equal fingerprints are one node.  A key's links are reduced to a spanning
forest, so that large groups of near copies never become all their pairs.  Keys
with more than ``bucket`` nodes go another exact way: each node is keyed by
clearing every choice of ``distance`` of the bits that the key leaves open, and
nodes that share such a key are linked to the least.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, listed, table, tidy
from .graph import components

SHINGLE, DISTANCE, SEED = 3, 2, 42
BUCKET = 2048
#: Shingles whose bits are counted at once.
BLOCK = 1 << 15


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of a text in UTF-8, as a signed 64-bit integer; 0 for a text without words."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*[words[i:] for i in range(shingle)], strict=False))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(g, SEED) for g in grams], dtype=">u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), BLOCK):
        part = h[at : at + BLOCK]
        counts += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h)).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(id, h, fp)`` of each row: id, hash of the text, fingerprint of the whole text; null counts as empty."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("h"), text.cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2)
            fp = [fingerprint(texts[i].as_py(), shingle) for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp, pa.int64())], names=["id", "h", "fp"])

    schema = T.StructType([rows.schema["id"], T.StructField("h", T.LongType()), T.StructField("fp", T.LongType())])
    return rows.mapInArrow(tidy(run), schema)


def segments(distance: int) -> list[list[int]]:
    """The bits of each segment, 0 the least significant."""
    edges = [64 * i // (distance + 1) for i in range(distance + 2)]
    return [list(range(a, b)) for a, b in zip(edges, edges[1:], strict=False)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _mask(bits: list[int] | tuple[int, ...]) -> int:
    return sum(1 << b for b in bits)


def chain_masks(distance: int) -> list[int]:
    """For each bit: which bits a key of the chain of two that ends in this bit's segment holds."""
    segs = segments(distance)
    out = [0] * 64
    for i, seg in enumerate(segs):
        for b in seg:
            out[b] = (_mask(segs[i - 1]) | _mask(seg)) & ~(1 << b)
    return out


def _forest(fps: np.ndarray, distance: int, masks: list[int]) -> list[tuple[int, int]]:
    """Spanning edges of the links among distinct fingerprints of one key: longer chains first, then the full distance."""
    x = fps.view(np.uint64)
    apart = x[:, None] ^ x[None, :]
    near = np.zeros(apart.shape, bool)
    segs = segments(distance)
    for start in range(len(segs)):
        fits, total = np.ones(apart.shape, bool), np.zeros(apart.shape, np.uint8)
        for step in range(len(segs)):
            total += np.bitwise_count(apart & np.uint64(_mask(segs[(start + step) % len(segs)])))
            fits &= total <= step  # floor((step + 1) * distance / (distance + 1))
            if not fits.any():
                break
        near |= fits
    near &= np.bitwise_count(apart) <= distance
    label = np.arange(len(fps))
    while True:
        new = np.where(near, label[None, :], len(fps)).min(1)
        if (new == label).all():
            break
        label = new
    return [(int(fps[i]), int(fps[r])) for i, r in enumerate(label) if i != r]


def _linked(batches: Iterator[pa.RecordBatch], distance: int, bucket: int) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (bit, key, fp): spanning edges (a, b, null) of each key; of keys above ``bucket`` nodes all rows (fp, null, bit)."""
    masks = chain_masks(distance)
    held: list[np.ndarray] = []  # the rows of the key that is not yet known to be complete
    over = False

    def done(group: np.ndarray, edges: list) -> None:
        if len(group) > 1:
            edges += [(a, b, None) for a, b in _forest(np.ascontiguousarray(group[:, 2]), distance, masks)]

    def out(edges: list) -> pa.RecordBatch:
        a, b, bit = zip(*edges, strict=True) if edges else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(bit, pa.int32())], names=["a", "b", "bit"])

    for batch in batches:
        rows = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)])
        if not len(rows):
            continue
        edges: list = []
        new = np.any(rows[1:, :2] != rows[:-1, :2], axis=1)
        starts = np.concatenate([[0], np.flatnonzero(new) + 1, [len(rows)]])
        size = np.diff(starts)
        for k in np.flatnonzero((size > 1) | (np.arange(len(size)) == 0) | (np.arange(len(size)) == len(size) - 1)):
            group = rows[starts[k] : starts[k + 1]]
            if k == 0 and (held or over):
                last = held[-1][-1] if held else over_key
                if (last[:2] == group[0, :2]).all():
                    if over:
                        edges += [(int(r[2]), None, int(r[0])) for r in group]
                        if len(size) == 1:
                            continue
                        over = False
                        continue
                    group = np.concatenate([*held, group])
                elif held:
                    done(np.concatenate(held), edges)
                held, over = [], False
            if len(group) > bucket:
                edges += [(int(r[2]), None, int(r[0])) for r in group]
                if k == len(size) - 1:
                    over, over_key, held = True, group[-1], []
            elif k == len(size) - 1:
                held, over = [group], False
            else:
                done(group, edges)
        yield out(edges)
    if held:
        edges = []
        done(np.concatenate(held), edges)
        yield out(edges)


def links(nodes: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """``(a, b)``: edges whose components are those of all links between the distinct fingerprints ``fp`` of ``nodes``."""
    masks = F.array(*[F.lit(_signed(m)).cast("long") for m in chain_masks(distance)])
    keys = nodes.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit"))
    keys = keys.select("bit", F.col("fp").bitwiseAND(F.get(masks, F.col("bit"))).alias("key"), "fp")
    ordered = keys.repartition("bit", "key").sortWithinPartitions("bit", "key", "fp")
    found = cut(ordered.mapInArrow(tidy(lambda batches: _linked(batches, distance, bucket)), "a long, b long, bit int").distinct())
    edges = found.where("bit is null").select("a", "b")
    # keys above the bound: clear every choice of bits that the key leaves open
    full = (1 << 64) - 1
    table_ = [[_signed(full & ~_mask(c)) for c in combinations([b for b in range(64) if not m >> b & 1], distance)] for m in chain_masks(distance)]
    big = found.where("bit is not null").select(F.col("a").alias("fp"), "bit")
    sets = listed(nodes.sparkSession, list(enumerate(table_)), bit=pa.int32(), masks=pa.list_(pa.int64()))
    opened = big.join(F.broadcast(sets), "bit").select("fp", "bit", F.posexplode("masks").alias("choice", "mask"))
    opened = opened.select("fp", "bit", "choice", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    least = opened.groupBy("bit", "choice", "key").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1")
    more = opened.join(least, ["bit", "choice", "key"]).select(F.col("fp").alias("a"), "b")
    return edges.unionByName(more.where("a <> b").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, shingle: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """A row for each input row: ``id``, ``h`` (hash of the text), ``fingerprint``, ``component_id``, ``first``.

    Documents whose fingerprints differ in at most ``distance`` bits are linked;
    ``component_id`` is the least id reachable over links, and ``first`` marks
    the row of the component with the least (id, h).  Texts without words have
    fingerprint 0 and are linked like any other; null counts as empty.  Null
    ids come after all others.  Rows equal in id and text are alike in all
    columns.  An empty table gives an empty result.  Texts of any length are
    shingled whole, their bits counted in blocks; other columns of ``docs``, whatever their
    names, take no part.
    """
    rows = cut(fingerprints(docs, id_col, text_col, shingle))
    key = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("h").alias("h"))
    nodes = cut(rows.groupBy("fp").agg(F.min(key).alias("own")))
    roots = components(links(nodes.select("fp"), distance, bucket))
    grouped = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "own", F.coalesce("root", "fp").alias("root"))
    least = grouped.groupBy("root").agg(F.min("own").alias("least"))
    of = grouped.join(least, "root").select(F.col("fp").alias("of"), "least")
    out = rows.join(of, F.col("fp") == F.col("of"))
    return out.select("id", "h", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least.id").alias("component_id"), (F.col("least") == key).alias("first"))


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with one row of each component, columns unchanged: that of the least (id, hash of the text)."""
    gone = near_duplicates(docs, id_col, text_col, **how).where("not first").select(F.col("id").alias("__gone"), F.col("h").alias("__gone_h")).distinct()
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    same = F.col(f"`{id_col}`").eqNullSafe(F.col("__gone")) & (F.xxhash64(text) == F.col("__gone_h"))
    return docs.join(gone, same, "left_anti")


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "fingerprint", "component_id")
