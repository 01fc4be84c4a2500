"""Repeated substrings by an enhanced suffix array over content-defined anchors.

A byte counts as repeated if a string of ``length`` bytes that covers it starts
anywhere else too.  Every such string holds an anchor: the ``MER``-byte string
with the least hash in it, ties included, so that equal strings have their
anchors at equal places.  Suffixes that start at anchors are dealt by the
anchor's hash; those of one anchor, sorted, are a part of the suffix array.
Common prefixes of neighbours give the interval tree by a stack scan; in each
interval the bytes to the left are scanned the same way, and an interval of
both whose occurrences differ on either side is a maximal repeat group.

Texts never leave their own partition but once, keyed by content; equal texts
are made one there before they leave, and one where they meet.  Anchors that occur once are dropped before any bytes
move; of the others ``length`` bytes to the right and ``length`` - ``MER`` to
the left do.  Anchors with more than ``GROUP`` occurrences go another exact
way: their occurrences are dealt into units, in which digests (128 bits) of what
BLOCK neighbouring strings of ``length`` bytes share are compared, then, where
those meet, digests of the strings themselves; units tell each other what they
have, each string once.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch, table

LENGTH, MER = 200, 32
GROUP = 50_000
#: Units among which the rows of a hot anchor are dealt, at least; and rows a unit should have at most.
SALTS, UNIT = 64, 4096
#: Neighbouring windows of a hot anchor that are looked up by what they share; divides LENGTH - MER + 1.
BLOCK = 13
#: Bytes of a text that are hashed at once.
CHUNK = 1 << 16
_MULT = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of an odd multiplier modulo 2^64, of its inverse, and a random value for each byte."""
    inverse = pow(_MULT, -1, 1 << 64)
    up, down = np.empty(n, np.uint64), np.empty(n, np.uint64)
    up[0] = down[0] = 1
    up[1:], down[1:] = _MULT, inverse
    return np.multiply.accumulate(up), np.multiply.accumulate(down), np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)


def mer_hashes(b: np.ndarray, mer: int = MER) -> np.ndarray:
    """A hash of each substring of ``mer`` bytes, the same wherever it stands."""
    n = len(b) - mer + 1
    out = np.empty(max(n, 0), np.uint64)
    up, down, of = _powers(CHUNK + 256)
    for at in range(0, max(n, 0), CHUNK):
        k = min(CHUNK, n - at)
        s = np.zeros(k + mer, np.uint64)
        np.cumsum(of[b[at : at + k + mer - 1]] * up[: k + mer - 1], out=s[1:])
        h = (s[mer:] - s[:k]) * down[:k]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        out[at : at + k] = h ^ (h >> np.uint64(29))
    return out


def _sliding(x: np.ndarray, width: int, f: np.ufunc) -> np.ndarray:
    """f over each ``width`` neighbours."""
    have, step = x, 1
    while 2 * step <= width:
        have = f(have[:-step], have[step:])
        step *= 2
    rest = width - step
    return f(have[: len(have) - rest], have[rest:]) if rest else have


def anchors(text: bytes, length: int = LENGTH, mer: int = MER) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of a text's anchors: of every string of ``length`` bytes, the ``mer``-byte strings of least hash."""
    if len(text) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = mer_hashes(np.frombuffer(text, np.uint8), mer)
    short = (h >> np.uint64(32)).astype(np.uint32)
    width = length - mer + 1
    least = _sliding(short, width, np.minimum)
    padded = np.zeros(len(short) + width - 1, np.uint32)
    padded[width - 1 : width - 1 + len(least)] = least
    at = np.flatnonzero(_sliding(padded, width, np.maximum) == short)
    return at, h[at].view(np.int64)


def intervals(lcp: list[int]) -> list[tuple[int, int, int]]:
    """The interval tree of an array of common prefixes of neighbours, by a stack scan: (length, first, last), children first."""
    out, stack = [], [(-1, 0)]
    for i, value in enumerate([*lcp, -1]):
        first = i
        while stack[-1][0] > value:
            depth, first = stack.pop()
            out.append((depth, first, i))
        if stack[-1][0] < value:
            stack.append((value, first))
    return out


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def repeat_groups(right: list[bytes], left: list[bytes], lcp: list[int], length: int = LENGTH) -> Iterator[tuple[int, int, list[int]]]:
    """Maximal repeats of ``length`` bytes or more among occurrences of one anchor.

    ``right``: the suffixes at the anchor, sorted; ``lcp``: common prefixes of
    neighbours; ``left``: the bytes before it, reversed.  Yields bytes to the
    left, bytes to the right, and the places of all occurrences.
    """
    for r, first, last in intervals(lcp):
        order = sorted(range(first, last + 1), key=left.__getitem__)
        back = [common(left[a], left[b]) for a, b in zip(order, order[1:], strict=False)]
        if max(back) + r < length:
            continue
        ends = [i for i in range(first, last) if lcp[i] == r]  # after each child of this interval
        for l, a, b in intervals(back):  # noqa: E741
            if l + r < length:
                continue
            members = order[a : b + 1]
            if bisect_left(ends, min(members)) == bisect_left(ends, max(members)) and r < length:
                continue  # all in one child: they share more to the right
            yield l, r, members


def extents(lcp: list[int], left: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Of each occurrence of one anchor the most bytes to the left and to the right over the maximal repeats that hold it.

    What :func:`repeat_groups` gives, folded per occurrence without listing the groups: in an interval of the tree an occurrence's deepest group to
    the left ends where it parts from its neighbours there.  The bytes to the left are sorted once; neighbours in an
    interval share the least of the common prefixes between them, by a sparse table of minima.
    """
    n = len(left)
    order = sorted(range(n), key=left.__getitem__)
    back = [common(left[x], left[y]) for x, y in zip(order, order[1:], strict=False)]
    outer, inner = np.zeros(n, np.int64), np.zeros(n, np.int64)
    order, level = np.array(order), np.array(back, np.int64)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    least, ranks = [level], rank.tolist()
    while len(level) > 1 << (len(least) - 1):
        half = 1 << (len(least) - 1)
        level = np.minimum(level[:-half], level[half:])
        least.append(level)
    for r, first, last in intervals(lcp):
        if last == first + 1:
            x, y = sorted(ranks[first : last + 1])
            depth = (y - x).bit_length() - 1
            l = min(least[depth][x], least[depth][y - (1 << depth)])  # noqa: E741
            if l + r >= length:
                for i in (first, last):
                    outer[i], inner[i] = max(outer[i], l), max(inner[i], r)
            continue
        here = np.sort(rank[first : last + 1])
        depth = np.frexp(np.diff(here).astype(np.float64))[1] - 1
        share = np.empty(len(depth), np.int64)
        for d in set(depth.tolist()):
            k = np.flatnonzero(depth == d)
            share[k] = np.minimum(least[d][here[k]], least[d][here[k + 1] - (1 << d)])
        best = np.zeros(len(here), np.int64)
        best[:-1] = share
        best[1:] = np.maximum(best[1:], share)
        good = best + r >= length
        i = order[here[good]]
        outer[i], inner[i] = np.maximum(outer[i], best[good]), np.maximum(inner[i], r)
    return outer, inner


def _ints(name: str, sha: Column) -> list[Column]:
    """The first 128 bits of a hex digest as two longs ``name``a and ``name``b."""
    return [F.conv(F.substring(sha, 1 + 16 * i, 16), 16, -10).cast("long").alias(f"{name}{c}") for i, c in enumerate("ab")]


def _merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals, touching ones joined, sorted."""
    if not len(lo):
        return lo, hi
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.concatenate([[True], lo[1:] > hi[:-1]])
    return lo[new], hi[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(hi) - 1]])]


_CONTEXT = pa.schema([("hash", pa.int64()), ("right", pa.binary()), ("left", pa.binary()), ("a", pa.int64()), ("b", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("salt", pa.int32())])
_SPAN = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])


def _anchor_rows(batches: Iterator[pa.RecordBatch], length: int, mer: int) -> Iterator[pa.RecordBatch]:
    """Of (a, b, text): a row ``(a, b, hash, n)`` for each text and anchor hash in it, with how often."""
    for batch in batches:
        a, b, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
        hashes, counts, sizes = [], [], []
        for i in range(len(texts)):
            h, n = np.unique(anchors(texts[i].as_py(), length, mer)[1], return_counts=True)
            hashes.append(h)
            counts.append(n)
            sizes.append(len(h))
        if hashes:
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(a, sizes)), pa.array(np.repeat(b, sizes)), pa.array(np.concatenate(hashes)), pa.array(np.concatenate(counts).astype(np.int32))], names=["a", "b", "hash", "n"])


def _context_rows(batches: Iterator[pa.RecordBatch], length: int, mer: int, salts: int, every: bool = False) -> Iterator[pa.RecordBatch]:
    """Of (a, b, text, few, many): the bytes around each anchor of these hashes.

    Occurrences of one text with the same bytes around are sent once; what they
    cover is repeated for sure and goes along as rows without bytes; with
    ``every`` all are sent as they are.  With
    ``salts`` the bytes are those around the hot anchors ``many`` instead, dealt
    out by ``salt``, and nothing else.
    """
    reach = length - mer
    for batch in batches:
        rows: list[list] = [[] for _ in _CONTEXT]
        size = 0
        for i in range(batch.num_rows):
            a, b, text, few, many = (batch.column(c)[i].as_py() for c in range(5))
            at, h = anchors(text, length, mer)
            hot = np.isin(h, np.array(many, np.int64))
            keep = hot | np.isin(h, np.array(few, np.int64))
            at, h, hot = at[keep].tolist(), h[keep].tolist(), hot[keep].tolist()
            back, n = text[::-1], len(text)
            seen: dict[tuple[bytes, bytes], list[int]] = {}
            lo, hi = [], []
            for p, x, y in zip(at, h, hot, strict=True):
                around = (text[p : p + length], back[n - p : n - p + reach])
                first = None if every else seen.get(around)
                if first is None:
                    seen[around] = [p]
                    if y != bool(salts):
                        continue
                    for col, v in zip(rows, (x, *around, a, b, p, None, (a + p) % salts if y else -1), strict=True):
                        col.append(v)
                    size += length + reach
                else:
                    for q in (*first, p):
                        lo.append(q - len(around[1]))
                        hi.append(q + len(around[0]))
                    first.clear()
            if salts:
                continue
            for s, e in zip(*(v.tolist() for v in _merged(np.array(lo, np.int64), np.array(hi, np.int64))), strict=True):
                for col, v in zip(rows, ((a ^ s * _MULT) & 0x7FFFFFFFFFFFFFFF, None, None, a, b, s, e, -1), strict=True):
                    col.append(v)
            if size > 1 << 23:
                yield pa.RecordBatch.from_pydict(dict(zip(_CONTEXT.names, rows, strict=True)), schema=_CONTEXT)
                rows, size = [[] for _ in _CONTEXT], 0
        yield pa.RecordBatch.from_pydict(dict(zip(_CONTEXT.names, rows, strict=True)), schema=_CONTEXT)


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Binary values as rows of a byte matrix, and their lengths."""
    column = pa.concat_arrays([column])
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1 + column.offset)[column.offset :]
    size = np.diff(offsets)
    out = np.zeros((len(column), width), np.uint8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    out[np.arange(width) < size[:, None]] = data[offsets[0] : offsets[-1]]
    return out, size


def _prefix(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray) -> np.ndarray:
    differ = x != y
    first = np.where(differ.any(1), differ.argmax(1), x.shape[1])
    return np.minimum(first, np.minimum(nx, ny))


def _grouped(batch: pa.RecordBatch, length: int, mer: int, groups: bool) -> Iterator[pa.RecordBatch]:
    """Spans, or maximal repeat groups, of complete anchors; rows are sorted by hash and bytes to the right."""
    hashes = batch.column(0).to_numpy()
    n = len(hashes)
    right, nr = _matrix(batch.column(1), length)
    starts = np.concatenate([[0], np.flatnonzero(hashes[1:] != hashes[:-1]) + 1, [n]])
    size = np.diff(starts)
    lcp = _prefix(right[:-1], nr[:-1], right[1:], nr[1:])
    left_max, right_max = np.zeros(n, np.int64), np.zeros(n, np.int64)
    a, b, at = (batch.column(i).to_numpy() for i in (3, 4, 5))
    out: list[tuple] = []
    pairs = starts[:-1][size == 2]
    if len(pairs) and not groups:
        lefts, nl = _matrix(batch.column(2).take(pa.array(np.concatenate([pairs, pairs + 1]))), length - mer)
        k = len(pairs)
        back = _prefix(lefts[:k], nl[:k], lefts[k:], nl[k:])
        good = back + lcp[pairs] >= length
        for p in (pairs[good], pairs[good] + 1):
            left_max[p], right_max[p] = back[good], lcp[pairs[good]]
    for g in np.flatnonzero((size > 2) | ((size == 2) & groups)):
        s, e = int(starts[g]), int(starts[g + 1])
        lefts = batch.column(2)[s:e].to_pylist()
        if not groups:
            left_max[s:e], right_max[s:e] = extents(lcp[s : e - 1].tolist(), lefts, length)
            continue
        rights = batch.column(1)[s:e].to_pylist()
        for l, r, members in repeat_groups(rights, lefts, lcp[s : e - 1].tolist(), length):  # noqa: E741
            name = hashlib.sha256(lefts[members[0]][:l][::-1] + rights[members[0]][:r]).hexdigest()
            out += [(name, int(a[s + i]), int(b[s + i]), int(at[s + i]) - l, l + r) for i in members]
    if groups:
        names = ["repeat", "a", "b", "start", "length"]
        types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        cols = zip(*out, strict=True) if out else ([] for _ in names)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=names)
    else:
        k = np.flatnonzero(right_max)
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (a[k], b[k], at[k] - left_max[k], at[k] + right_max[k])], schema=_SPAN)


def _scan(batches: Iterator[pa.RecordBatch], length: int, mer: int, groups: bool) -> Iterator[pa.RecordBatch]:
    """Cuts the sorted stream at ends of anchors, so that each is complete."""
    held: list[pa.RecordBatch] = []

    def whole() -> Iterator[pa.RecordBatch]:
        one = pa.Table.from_batches(held).combine_chunks().to_batches()
        for x in one:
            yield from _grouped(x, length, mer, groups)

    for batch in batches:
        known = batch.filter(pc.is_valid(batch.column(6)))
        if known.num_rows and not groups:
            yield pa.RecordBatch.from_arrays([known.column(i) for i in (3, 4, 5, 6)], schema=_SPAN)
        batch = batch.filter(pc.is_null(batch.column(6)))
        if not batch.num_rows:
            continue
        h = batch.column(0).to_numpy()
        last = len(h) - int(np.argmax((h != h[-1])[::-1])) if h[0] != h[-1] else 0
        if held and held[0].column(0)[0].as_py() != h[0]:
            yield from whole()
            held = []
        if last:
            held.append(batch.slice(0, last))
            yield from whole()
            held = []
        held.append(batch.slice(last))
    if held:
        yield from whole()


def _blocks(row: tuple[bytes, bytes, int], length: int, mer: int) -> Iterator[tuple[bytes, int, bytes, bytes]]:
    """The windows of ``length`` bytes around an anchor in blocks of BLOCK neighbours: what all of a block share, as a
    digest and its start, and up to BLOCK - 1 bytes to its left and right.  ``row``: bytes from the anchor on, those
    before it reversed, and its place."""
    right, left, at = row
    text, here = left[::-1] + right, len(left)
    for j, back in enumerate(range(0, length - mer + 1, BLOCK)):
        start, end = here - back, here - back + length - BLOCK + 1
        if start >= 0 and end <= len(text):
            yield xxhash.xxh3_128_digest(text[start:end], seed=j), at - back, text[max(0, start - BLOCK + 1) : start], text[end : end + BLOCK - 1]


def _block_windows(core: bytes, left: bytes, right: bytes) -> Iterator[tuple[int, bytes]]:
    """Of the windows of a block that the text has: bytes to the left of the core, and a digest of the whole."""
    for k in range(max(0, BLOCK - 1 - len(right)), min(BLOCK - 1, len(left)) + 1):
        yield k, xxhash.xxh3_128_digest(core + bytes([k]) + left[len(left) - k :] + right[: BLOCK - 1 - k])


def _halves(digest: bytes) -> tuple[int, int]:
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


_CORE = pa.schema([("w1", pa.int64()), ("w2", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("lo", pa.int64()), ("left", pa.binary()), ("right", pa.binary())])
_WINDOW = pa.schema([("w1", pa.int64()), ("w2", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("sure", pa.bool_())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else ([] for _ in schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows (right, left, a, b, at) of hot anchors, all of one anchor and salt at a time."""
    key, unit = None, []
    for batch in batches:
        for h, right, left, a, b, at, _, salt in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (h, salt) != key and unit:
                yield unit
                unit = []
            key = (h, salt)
            unit.append((right, left, a, b, at))
    if unit:
        yield unit


def _probe(batches: Iterator[pa.RecordBatch], length: int, mer: int, cores: bool) -> Iterator[pa.RecordBatch]:
    """What units of hot anchors have to tell each other.

    ``cores``: a row for each block's core in a unit, with the bytes beside it if it stands there once.  Else a row for
    each window of the cores that stand there twice or more, and the ranges known from windows that do so themselves.
    """
    for unit in _units(batches):
        stand: dict[bytes, list[tuple]] = {}
        for i, (right, left, _, _, at) in enumerate(unit):
            for core, *rest in _blocks((right, left, at), length, mer):
                stand.setdefault(core, []).append((i, *rest))
        rows: list[tuple] = []
        if cores:
            for core, found in stand.items():
                i, lo, left, right = found[0]
                rows.append((*_halves(core), *unit[i][2:4], lo, *((left, right) if len(found) == 1 else (None, None))))
            yield _batch(rows, _CORE)
            continue
        windows: dict[bytes, list[tuple[int, int]]] = {}
        for core, found in stand.items():
            if len(found) > 1:
                for i, lo, left, right in found:
                    for k, window in _block_windows(core, left, right):
                        windows.setdefault(window, []).append((i, lo - k))
        known: dict[int, tuple[int, int]] = {}
        for window, found in windows.items():
            i, lo = found[0]
            rows.append((*_halves(window), *unit[i][2:4], lo, lo + length, False))
            if len(found) > 1:
                for i, lo in found:
                    s, e = known.get(i, (lo, lo + length))
                    known[i] = min(s, lo), max(e, lo + length)
        rows += [(unit[i][2] ^ s * 31, unit[i][3], *unit[i][2:4], s, e, True) for i, (s, e) in known.items()]
        yield _batch(rows, _WINDOW)


def _opened(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The windows of cores that stand once in their unit and again elsewhere."""
    for batch in batches:
        rows = []
        for w1, w2, a, b, lo, left, right in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            core = w1.to_bytes(8, "big", signed=True) + w2.to_bytes(8, "big", signed=True)
            rows += [(*_halves(window), a, b, lo - k, lo - k + length, False) for k, window in _block_windows(core, left, right)]
        yield _batch(rows, _WINDOW)


class Repeats:
    """Repeats of a table's whole texts, as bytes of UTF-8; null counts as empty.

    ``texts``: the distinct texts ``(a, b, text)``, keyed by 128 bits of their
    SHA-256.  Matches never cross texts.  Repeated rows are equal texts, so all
    their bytes are repeated if there are ``length`` of them.  Texts of any length are taken
    whole; a text of many anchors is one row until its contexts are dealt.
    Other columns take no part, whatever their names; an empty table gives
    empty results.
    """

    def __init__(self, docs: DataFrame, text_col: str = "text", length: int = LENGTH, mer: int = MER, group: int = GROUP):
        self.length, self.mer, self.group = length, mer, group
        self.text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
        self.docs = docs
        long = docs.select(self.text.cast("binary").alias("text")).where(F.octet_length("text") >= length)
        keyed = long.select(*_ints("", F.sha2("text", 256)), "text").where("a IS NOT NULL AND b IS NOT NULL")  # never null; said here, so that all uses share one exchange
        # copies are reduced before the exchange, so that a text of many copies sends one from each partition
        self.texts = keyed.groupBy("a", "b").agg(F.any_value("text").alias("text"))
        # anchors are read twice below: as a table, since a plan with such a function in it is run anew for each use
        path = scratch(docs.sparkSession, "anchors")
        keyed.mapInArrow(lambda x: _anchor_rows(x, length, mer), "a long, b long, hash long, n int").write.parquet(path)
        found = docs.sparkSession.read.parquet(path)
        # copies of a text are counted here as well: that only sends more than is needed
        often = found.groupBy("hash").agg(F.sum("n").alias("total")).where("total > 1")
        most, rows = often.agg(F.max("total"), F.sum(F.when(F.col("total") > group, F.col("total")))).first()
        self.hot, self.salts = (most or 0) > group, max(SALTS, (most or 0) // UNIT)
        self.tasks = max(SALTS, (rows or 0) // (4 * UNIT))  # for hot anchors: by work, as their rows are few bytes and much of it
        # a key of its own keeps the exchanges of the join apart from the sum's, so that a hot anchor's rows can be split
        hits = found.select("a", "b", (F.col("hash") + F.lit(0)).alias("hash")).join(often.select((F.col("hash") + F.lit(0)).alias("hash"), "total"), "hash")
        own = hits.groupBy("a", "b").agg(F.collect_set(F.when(F.col("total") <= group, F.col("hash"))).alias("few"), F.collect_set(F.when(F.col("total") > group, F.col("hash"))).alias("many"))
        self.around = self.texts.join(own, ["a", "b"])

    def _contexts(self, hot: bool = False, every: bool = False) -> DataFrame:
        """Context rows, dealt by anchor; those of hot anchors by salt too."""
        length, mer, salts = self.length, self.mer, self.salts if hot else 0
        texts = self.around.where(F.size("many") > 0) if hot else self.around
        rows = texts.select("a", "b", "text", "few", "many").mapInArrow(lambda x: _context_rows(x, length, mer, salts, every), "hash long, right binary, left binary, a long, b long, lo long, hi long, salt int")
        return rows.repartition(self.tasks, "hash", "salt") if hot else rows.repartition("hash", "salt")

    def _sorted(self, groups: bool, schema: str) -> DataFrame:
        length, mer = self.length, self.mer
        return self._contexts(every=groups).sortWithinPartitions("hash", "right").mapInArrow(lambda x: _scan(x, length, mer, groups), schema)

    def groups(self) -> DataFrame:
        """``(repeat, a, b, start, length)``: maximal repeats as seen from each anchor, a row for each occurrence; ``repeat`` names the string.

        All occurrences are there, also those within one text.  Strings reach
        as far as the bytes kept around an anchor: longer ones come in pieces,
        one from each anchor.  Repeats of anchors above the group bound are in
        :meth:`spans` alone.
        """
        return self._sorted(True, "repeat string, a long, b long, start long, length long").distinct()

    def spans(self) -> DataFrame:
        """``(a, b, lo, hi)``: byte ranges whose bytes are repeated; they overlap, and their union is complete."""
        length, mer = self.length, self.mer
        few = self._sorted(False, "a long, b long, lo long, hi long")
        if not self.hot:
            return few
        # both probes make these rows anew, as no exchange above such a function is shared; a unit has the same rows
        # whenever they run, and tells of each string once, so that the lists below stay short
        units = self._contexts(hot=True).sortWithinPartitions("hash", "salt", "right", "left", "a", "b", "lo")
        window = "w1 long, w2 long, a long, b long, lo long, hi long, sure boolean"
        cores = units.mapInArrow(lambda x: _probe(x, length, mer, True), "w1 long, w2 long, a long, b long, lo long, left binary, right binary").repartition(self.tasks, "w1")
        met = cores.groupBy("w1", "w2").agg(F.collect_list(F.struct("a", "b", "lo", "left", "right")).alias("rows")).where(F.size("rows") > 1)
        opened = met.select("w1", "w2", F.inline("rows")).where("left is not null").mapInArrow(lambda x: _opened(x, length), window)
        windows = units.mapInArrow(lambda x: _probe(x, length, mer, False), window).unionByName(opened).repartition(self.tasks, "w1")
        again = windows.groupBy("w1", "w2").agg(F.collect_list(F.struct("a", "b", "lo", "hi")).alias("rows"), F.max("sure").alias("sure")).where((F.size("rows") > 1) | F.col("sure"))
        return few.unionByName(again.select(F.inline("rows")))

    def removed(self, id_col: str = "doc_id") -> DataFrame:
        """A row for each input row: id, n_bytes, n_removed, n_spans, kept (the remaining bytes) as its SHA-256.

        A text of ``length`` bytes or more that occurs twice is repeated
        throughout.  Shorter texts keep all bytes.
        """
        length = self.length
        per = self.spans().groupBy("a", "b").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
        cut_ = self.texts.join(per, ["a", "b"]).select("a", "b", "text", "spans").mapInArrow(_kept, "a long, b long, removed long, spans long, kept string")
        sha = F.sha2(self.text.cast("binary"), 256)
        rows = self.docs.select(F.col(f"`{id_col}`").alias("id"), sha.alias("sha"), F.octet_length(self.text).cast("long").alias("n_bytes"))
        rows = rows.select("id", "sha", "n_bytes", *_ints("", F.col("sha")))
        copies = rows.where(F.col("n_bytes") >= length).groupBy("a", "b").agg(F.count("*").alias("copies"))
        facts = copies.join(cut_, ["a", "b"], "left").where("copies > 1 or removed is not null")
        facts = facts.select(F.col("a").bitwiseXOR(F.lit(0)).alias("fa"), F.col("b").alias("fb"), "copies", "removed", "spans", "kept")
        out = rows.join(facts, (F.col("a").bitwiseXOR(F.lit(0)) == F.col("fa")) & (F.col("b") == F.col("fb")), "left")
        twice = F.coalesce(F.col("copies") > 1, F.lit(False))
        return out.select(
            "id", "n_bytes",
            F.when(twice, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
            F.when(twice, 1).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
            F.when(twice, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
        )


def without(text: bytes, lo: np.ndarray, hi: np.ndarray) -> bytes:
    """A text without the bytes of these sorted, disjoint ranges."""
    edges = [0, *np.column_stack([lo, hi]).ravel().tolist(), len(text)]
    return b"".join(text[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (a, b, text, spans): bytes removed, ranges, SHA-256 of the rest."""
    for batch in batches:
        removed, count, kept = [], [], []
        for i in range(batch.num_rows):
            own = batch.column(3)[i].values
            lo, hi = _merged(own.field(0).to_numpy(), own.field(1).to_numpy())
            removed.append(int((hi - lo).sum()))
            count.append(len(lo))
            kept.append(hashlib.sha256(without(batch.column(2)[i].as_py(), lo, hi)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.string())], names=["a", "b", "removed", "spans", "kept"])


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return Repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).removed().withColumnRenamed("id", "doc_id")
