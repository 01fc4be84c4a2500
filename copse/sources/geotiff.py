"""Single-band GeoTIFF: header, windows and writing, and a Spark data source.

Classic TIFF of either byte order, in strips or tiles, plain, deflated or LZW,
with or without horizontal or floating-point prediction.  The source reads
headers alone (``headers``), or pixels (path, row, col, z) in blocks of rows;
the options row0, row1, col0 and col1 (ends excluded) keep blocks from being
read.  :func:`read_windows` reads windows of many files, each for itself.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import listed, open_input

# Field types (size, struct code), tags and keys of the format.
TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 7: (1, "B"), 8: (2, "h"), 9: (4, "i"), 11: (4, "f"), 12: (8, "d")}
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILES, TILE_BYTES, SAMPLE_FORMAT = 317, 322, 323, 324, 325, 339
PIXEL_SCALE, TIEPOINT, TRANSFORM, GEO_KEYS, NODATA = 33550, 33922, 34264, 34735, 42113
PROJECTED, GEOGRAPHIC = 3072, 2048
HEADER_BYTES = 1 << 16
ROWS = 512


@dataclass
class Header:
    order: str
    tags: dict[int, tuple]

    def one(self, tag: int, default=None):
        return self.tags.get(tag, (default,))[0]

    @property
    def shape(self) -> tuple[int, int]:
        return self.one(LENGTH), self.one(WIDTH)

    @property
    def dtype(self) -> np.dtype:
        return np.dtype(f"{self.order}{ {1: 'u', 2: 'i', 3: 'f'}[self.one(SAMPLE_FORMAT, 1)] }{self.one(BITS, 8) // 8}")

    @property
    def transform(self) -> tuple[float, float, float, float, float, float] | None:
        """(a, b, c, d, e, f): x = c + col a + row b, y = f + col d + row e."""
        if TRANSFORM in self.tags:
            m = self.tags[TRANSFORM]
            return m[0], m[1], m[3], m[4], m[5], m[7]
        if PIXEL_SCALE in self.tags and TIEPOINT in self.tags:
            (sx, sy, *_), (i, j, _, x, y, *_) = self.tags[PIXEL_SCALE], self.tags[TIEPOINT]
            return sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy
        return None

    @property
    def epsg(self) -> int | None:
        keys = self.tags.get(GEO_KEYS, ())
        found = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
        code = found.get(PROJECTED) or found.get(GEOGRAPHIC)
        return code if code and code != 32767 else None

    @property
    def nodata(self) -> float | None:
        text = b"".join(self.tags.get(NODATA, ())).rstrip(b"\0 ").decode("ascii", "replace")
        try:
            return float(text)
        except ValueError:
            return None

    @property
    def bounds(self) -> tuple[float, float, float, float] | None:
        t = self.transform
        if t is None:
            return None
        a, b, c, d, e, f = t
        h, w = self.shape
        xs, ys = [c + i * a + j * b for i in (0, w) for j in (0, h)], [f + i * d + j * e for i in (0, w) for j in (0, h)]
        return min(xs), min(ys), max(xs), max(ys)


def header(f: BinaryIO) -> Header:
    """Tags of the first image; only the first bytes of the file and what its directory points to are read."""
    head = f.read(HEADER_BYTES)

    def at(offset: int, size: int) -> bytes:
        if offset + size <= len(head):
            return head[offset : offset + size]
        f.seek(offset)
        return f.read(size)

    order = {b"II": "<", b"MM": ">"}[head[:2]]
    magic, first = struct.unpack(order + "HI", head[2:8])
    if magic != 42:
        raise ValueError("not a classic TIFF")
    (count,) = struct.unpack(order + "H", at(first, 2))
    tags = {}
    for i in range(count):
        entry = at(first + 2 + 12 * i, 12)
        tag, kind, n = struct.unpack(order + "HHI", entry[:8])
        if kind not in TYPES:
            continue
        size, code = TYPES[kind]
        data = entry[8 : 8 + n * size] if n * size <= 4 else at(struct.unpack(order + "I", entry[8:])[0], n * size)
        tags[tag] = tuple(struct.unpack(f"{order}{'c' * n if code == 's' else code * n}", data))
    return Header(order, tags)


def _lzw(data: bytes) -> bytes:
    """LZW with the early change of TIFF: 9 to 12 bits, 256 clears, 257 ends."""
    out, table, width, pos, value, have = bytearray(), [], 9, 0, 0, 0
    last = None
    while True:
        while have < width:
            if pos >= len(data):
                return bytes(out)
            value, have, pos = value << 8 | data[pos], have + 8, pos + 1
        have -= width
        code, value = value >> have, value & ((1 << have) - 1)
        if code == 257:
            return bytes(out)
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, None
            continue
        if last is None:
            piece = table[code]
        else:
            piece = table[code] if code < len(table) else last + last[:1]
            table.append(last + piece[:1])
            if len(table) >= (1 << width) - 1 and width < 12:
                width += 1
        out += piece
        last = piece


def _block(h: Header, raw: bytes, rows: int, cols: int) -> np.ndarray:
    kind, predictor, dtype = h.one(COMPRESSION, 1), h.one(PREDICTOR, 1), h.dtype
    if kind in (8, 32946):
        raw = zlib.decompress(raw)
    elif kind == 5:
        raw = _lzw(raw)
    elif kind != 1:
        raise ValueError(f"compression {kind} is not read")
    raw = raw[: rows * cols * dtype.itemsize]
    if predictor == 3:  # bytes of a row by significance, then differences
        planes = np.add.accumulate(np.frombuffer(raw, np.uint8).reshape(rows, -1), axis=1, dtype=np.uint8).reshape(rows, dtype.itemsize, cols)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(dtype.newbyteorder(">")).reshape(rows, cols)
    out = np.frombuffer(raw, dtype).reshape(rows, cols)
    return np.add.accumulate(out.astype(dtype.newbyteorder("=")), axis=1, dtype=dtype.newbyteorder("=")) if predictor == 2 else out


def window(f: BinaryIO, h: Header, row0: int, row1: int, col0: int, col1: int) -> np.ndarray:
    """Values of a window, ends excluded; only the strips or tiles that it meets are read."""
    if h.one(SAMPLES, 1) != 1:
        raise ValueError("only single-band rasters are read")
    height, width = h.shape
    if TILES in h.tags:
        rows, cols, places, sizes = h.one(TILE_LENGTH), h.one(TILE_WIDTH), h.tags[TILES], h.tags[TILE_BYTES]
    else:
        rows, cols, places, sizes = min(h.one(ROWS_PER_STRIP, height), height), width, h.tags[STRIPS], h.tags[STRIP_BYTES]
    across = -(-width // cols)
    out = np.empty((row1 - row0, col1 - col0), h.dtype)
    for i in range(row0 // rows, -(-row1 // rows)):
        for j in range(col0 // cols, -(-col1 // cols)):
            tall = rows if TILES in h.tags else min(rows, height - i * rows)
            f.seek(places[i * across + j])
            block = _block(h, f.read(sizes[i * across + j]), tall, cols)
            r0, r1, c0, c1 = max(row0, i * rows), min(row1, (i + 1) * rows), max(col0, j * cols), min(col1, (j + 1) * cols)
            out[r0 - row0 : r1 - row0, c0 - col0 : c1 - col0] = block[r0 - i * rows : r1 - i * rows, c0 - j * cols : c1 - j * cols]
    return out


def encode(values: np.ndarray, transform: tuple[float, ...], epsg: int | None = None, nodata: float | None = None, rows: int = 64) -> bytes:
    """A deflated GeoTIFF of one band in strips: float32, uint8, uint16 or uint32 as the values are; other kinds become float32."""
    a, b, c, d, e, f = transform
    if not (values.dtype.kind == "u" and values.dtype.itemsize <= 4):
        values = values.astype(np.float32)
    values = values.astype(values.dtype.newbyteorder("<"))
    h, w = values.shape
    strips = [zlib.compress(np.ascontiguousarray(values[r : r + rows]).tobytes(), 6) for r in range(0, h, rows)]
    tags: dict[int, tuple[int, tuple]] = {
        WIDTH: (4, (w,)), LENGTH: (4, (h,)), BITS: (3, (values.dtype.itemsize * 8,)), COMPRESSION: (3, (8,)), PHOTOMETRIC: (3, (1,)), SAMPLES: (3, (1,)), ROWS_PER_STRIP: (4, (rows,)),
        PLANAR: (3, (1,)), SAMPLE_FORMAT: (3, (3 if values.dtype.kind == "f" else 1,)), STRIP_BYTES: (4, tuple(map(len, strips))), STRIPS: (4, (0,) * len(strips)),
    }
    if b == 0 and d == 0:
        tags |= {PIXEL_SCALE: (12, (a, -e, 0.0)), TIEPOINT: (12, (0.0, 0.0, 0.0, c, f, 0.0))}
    else:
        tags[TRANSFORM] = (12, (a, b, 0.0, c, d, e, 0.0, f, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0))
    if epsg is not None:
        tags[GEO_KEYS] = (3, (1, 1, 0, 3, 1024, 0, 1, 1, 1025, 0, 1, 1, PROJECTED, 0, 1, epsg))
    if nodata is not None:
        text = f"{nodata!r}\0".encode()
        tags[NODATA] = (2, tuple(bytes([x]) for x in text))
    start = 8 + 2 + 12 * len(tags) + 4
    extra = {t: math.prod((len(v), TYPES[k][0])) for t, (k, v) in tags.items()}
    places, at = {}, start
    for t in sorted(tags):
        if extra[t] > 4:
            places[t], at = at, at + extra[t] + extra[t] % 2
    offsets = []
    for s in strips:
        offsets.append(at)
        at += len(s)
    tags[STRIPS] = (4, tuple(offsets))
    entries, tail = b"", b""
    for t in sorted(tags):
        kind, v = tags[t]
        data = struct.pack("<" + ("c" if kind == 2 else TYPES[kind][1]) * len(v), *v)
        if t in places:
            entries += struct.pack("<HHII", t, kind, len(v), places[t])
            tail += data + b"\0" * (len(data) % 2)
        else:
            entries += struct.pack("<HHI", t, kind, len(v)) + data.ljust(4, b"\0")
    return b"II" + struct.pack("<HI", 42, 8) + struct.pack("<H", len(tags)) + entries + struct.pack("<I", 0) + tail + b"".join(strips)


@dataclass
class Block(InputPartition):
    path: str
    row0: int
    row1: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths, self.headers = options["path"], options.get("headers", "false").lower() == "true"
        limit = lambda name, default: int(options.get(name, default))
        self.row = [limit("row0", 0), limit("row1", 1 << 62)]
        self.col = [limit("col0", 0), limit("col1", 1 << 62)]

    def partitions(self) -> list[Block]:
        files = listed(self.paths, r"\.tiff?$")
        if self.headers:
            return [Block(p, 0, 0) for p in files]
        out = []
        for path in files:
            with open_input(path) as f:
                height = header(f).shape[0]
            out += [Block(path, r, min(r + ROWS, height, self.row[1])) for r in range(max(self.row[0], 0) // ROWS * ROWS, min(height, self.row[1]), ROWS)]
        return out

    def read(self, block: Block) -> Iterator[pa.RecordBatch | tuple]:
        if self.headers:
            yield head_row(block.path)
            return
        yield pa.RecordBatch.from_arrays([pa.array(v) if not isinstance(v, pa.Array) else v for v in _cells(block.path, max(block.row0, self.row[0]), block.row1, *self.col)], names=["path", "row", "col", "z"])


def _cells(path: str, row0: int, row1: int, col0: int, col1: int) -> tuple[pa.Array, ...]:
    """path, row, col and z of a window, cut at the raster's edge; nodata and NaN are null."""
    with open_input(path) as f:
        h = header(f)
        r0, r1, c0, c1 = max(row0, 0), min(row1, h.shape[0]), max(col0, 0), min(col1, h.shape[1])
        z = window(f, h, r0, r1, c0, c1).astype(np.float64) if r0 < r1 and c0 < c1 else np.zeros((0, 0))
    row, col = np.meshgrid(np.arange(r0, max(r0, r1)), np.arange(c0, max(c0, c1)), indexing="ij")
    missing = np.isnan(z) if h.nodata is None else np.isnan(z) | (z == h.nodata)
    return pa.array([path] * z.size, pa.string()), pa.array(row.ravel()[: z.size]), pa.array(col.ravel()[: z.size]), pa.array(z.ravel(), mask=missing.ravel())


def read_windows(windows: DataFrame) -> DataFrame:
    """``(plot_id, path, row, col, z)``: the pixels of windows (plot_id, path, row0, row1, col0, col1), ends excluded; of each file only these are read.

    Files that cannot be read give no pixels.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in batch.to_pylist():
                try:
                    cells = _cells(w["path"], w["row0"], w["row1"], w["col0"], w["col1"])
                except Exception:  # noqa: BLE001
                    continue
                plot = pa.array([w["plot_id"]] * len(cells[0]), batch.schema.field("plot_id").type)
                yield pa.RecordBatch.from_arrays([plot, *cells], names=["plot_id", "path", "row", "col", "z"])

    kind = windows.schema["plot_id"].dataType.simpleString()
    return windows.select("plot_id", "path", "row0", "row1", "col0", "col1").mapInArrow(run, f"plot_id {kind}, path string, row long, col long, z double")


def head_row(path: str) -> tuple:
    """``(path, epsg, xmin, ymin, xmax, ymax, height, width, x0, y0, px_x, px_y)``; all null but the path for a file that cannot be read."""
    try:
        with open_input(path) as f:
            h = header(f)
        t, b = h.transform, h.bounds
        return (path, h.epsg, *(b or (None,) * 4), *h.shape, *((t[2], t[5], abs(t[0]), abs(t[4])) if t else (None,) * 4))
    except Exception:  # noqa: BLE001  any unreadable file is a tile without system and bounds
        return (path, *(None,) * 11)


class GeoTiff(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        if self.options.get("headers", "false").lower() == "true":
            return "path string, epsg int, xmin double, ymin double, xmax double, ymax double, height long, width long, x0 double, y0 double, px_x double, px_y double"
        return "path string, row long, col long, z double"

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes ``spark.read.format("geotiff")`` known."""
    spark.dataSource.register(GeoTiff)
