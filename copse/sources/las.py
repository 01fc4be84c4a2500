"""LAS point clouds: header, records in chunks, writing, and a Spark data source.

Versions 1.0 to 1.4, point formats 0 to 10.  Compressed files (LAZ) give their
header; their points need a decompressor that is not here, and such a file has
no points.  The source reads headers alone (``headers``), or points in chunks
of CHUNK records.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import listed, open_input

CHUNK = 1_000_000
# Record lengths of the point formats, header sizes of the versions, record ids of reference systems.
SIZES = {0: 20, 1: 28, 2: 26, 3: 34, 4: 57, 5: 63, 6: 30, 7: 36, 8: 38, 9: 59, 10: 67}
HEADER_SIZE = 375
GEO_KEYS, WKT = 34735, 2112
PROJECTED = 3072


@dataclass
class Header:
    version: tuple[int, int]
    point_format: int
    compressed: bool
    record: int
    first: int
    count: int
    scale: tuple[float, float, float]
    offset: tuple[float, float, float]
    mins: tuple[float, float, float]
    maxs: tuple[float, float, float]
    epsg: int | None

    @property
    def bounds(self) -> tuple[float, float, float, float] | None:
        b = (self.mins[0], self.mins[1], self.maxs[0], self.maxs[1])
        return b if np.isfinite(b).all() else None


def _system(f: BinaryIO, start: int, count: int) -> int | None:
    """EPSG code of the variable-length records: the projected key, or the last authority of a WKT text."""
    at = start
    for _ in range(count):
        f.seek(at)
        head = f.read(54)
        if len(head) < 54:
            return None
        record, size = struct.unpack("<HH", head[18:22])
        if record == GEO_KEYS:
            keys = np.frombuffer(f.read(size), "<u2")
            for i in range(4, len(keys) - 3, 4):
                if keys[i] == PROJECTED and keys[i + 1] == 0:
                    return int(keys[i + 3])
        elif record == WKT:
            codes = re.findall(r'(?:AUTHORITY|ID)\["EPSG",\s*"?(\d+)"?\]', f.read(size).decode("utf-8", "replace"))
            if codes:
                return int(codes[-1])
        at += 54 + size
    return None


def header(f: BinaryIO) -> Header:
    raw = f.read(HEADER_SIZE)
    if raw[:4] != b"LASF":
        raise ValueError("not a LAS file")
    version = raw[24], raw[25]
    size, first, records = struct.unpack("<HII", raw[94:104])
    kind, length, count = raw[104], *struct.unpack("<HI", raw[105:111])
    scale, offset = struct.unpack("<3d", raw[131:155]), struct.unpack("<3d", raw[155:179])
    x1, x0, y1, y0, z1, z0 = struct.unpack("<6d", raw[179:227])
    if version >= (1, 4) and not count:
        (count,) = struct.unpack("<Q", raw[247:255])
    return Header(version, kind & 0x3F, bool(kind & 0x80), length, first, count, scale, offset, (x0, y0, z0), (x1, y1, z1), _system(f, size, records))


def points(f: BinaryIO, h: Header, start: int = 0, stop: int | None = None) -> dict[str, np.ndarray]:
    """x, y, z, intensity, return_number and number_of_returns of a run of records."""
    if h.compressed:
        raise ValueError("compressed points are not read")
    stop = h.count if stop is None else min(stop, h.count)
    f.seek(h.first + start * h.record)
    raw = np.frombuffer(f.read((stop - start) * h.record), np.uint8)
    raw = raw[: len(raw) // h.record * h.record].reshape(-1, h.record)
    xyz = np.ascontiguousarray(raw[:, :12]).view("<i4") * np.array(h.scale) + np.array(h.offset)
    bits = raw[:, 14]
    few = h.point_format < 6
    return {
        "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2], "intensity": np.ascontiguousarray(raw[:, 12:14]).view("<u2")[:, 0].astype(np.int64),
        "return_number": (bits & (7 if few else 15)).astype(np.int64), "number_of_returns": (bits >> 3 & 7 if few else bits >> 4).astype(np.int64),
    }


def encode(p: dict[str, np.ndarray], point_format: int = 6, scale: tuple[float, float, float] = (0.001, 0.001, 0.001), offset: tuple[float, float, float] | None = None, epsg: int | None = None) -> bytes:
    """A LAS 1.4 file of these points; other dimensions of the format are 0.  Without an offset it is the floor of the least."""
    n = len(p["x"])
    xyz = np.column_stack([p["x"], p["y"], p["z"]]).astype(np.float64)
    low, high = (xyz.min(0), xyz.max(0)) if n else (np.zeros(3), np.zeros(3))
    offset = tuple(np.floor(low).tolist()) if offset is None else offset
    raw = np.zeros((n, SIZES[point_format]), np.uint8)
    raw[:, :12] = np.rint((xyz - offset) / scale).astype("<i4").view(np.uint8).reshape(n, 12)
    zero = np.zeros(n, np.int64)
    raw[:, 12:14] = np.asarray(p.get("intensity", zero)).astype("<u2").reshape(n, 1).view(np.uint8).reshape(n, 2)
    number, total = np.asarray(p.get("return_number", zero)), np.asarray(p.get("number_of_returns", zero))
    raw[:, 14] = (number & 7 | (total & 7) << 3) if point_format < 6 else (number & 15 | (total & 15) << 4)
    keys = b""
    if epsg is not None:
        data = struct.pack("<12H", 1, 1, 0, 2, 1024, 0, 1, 1, PROJECTED, 0, 1, epsg)
        keys = struct.pack("<H16sHH32s", 0, b"LASF_Projection", GEO_KEYS, len(data), b"") + data
    legacy = n if point_format < 6 and n < 1 << 32 else 0
    head = b"LASF" + struct.pack("<HH16sBB32s32sHHHII", 0, 0, b"", 1, 4, b"copse", b"copse", 1, 2000, HEADER_SIZE, HEADER_SIZE + len(keys), int(bool(keys)))
    head += struct.pack("<BHI5I", point_format, SIZES[point_format], legacy, *(0,) * 5) + struct.pack("<6d", *scale, *offset)
    head += struct.pack("<6d", high[0], low[0], high[1], low[1], high[2], low[2]) + struct.pack("<QQIQ15Q", 0, 0, 0, n, *(0,) * 15)
    return head + keys + raw.tobytes()


@dataclass
class Chunk(InputPartition):
    path: str
    start: int
    stop: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths, self.headers, self.chunk = options["path"], options.get("headers", "false").lower() == "true", int(options.get("chunk", CHUNK))

    def partitions(self) -> list[Chunk]:
        out = []
        for path in listed(self.paths, r"\.(las|laz)$"):
            if self.headers:
                out.append(Chunk(path, 0, 0))
                continue
            try:
                with open_input(path) as f:
                    h = header(f)
            except Exception:  # noqa: BLE001  a file that cannot be read has no points
                continue
            if not h.compressed:
                out += [Chunk(path, s, min(s + self.chunk, h.count)) for s in range(0, h.count, self.chunk)]
        return out

    def read(self, chunk: Chunk) -> Iterator[pa.RecordBatch | tuple]:
        if self.headers:
            yield head_row(chunk.path)
            return
        with open_input(chunk.path) as f:
            h = header(f)
            p = points(f, h, chunk.start, chunk.stop)
        n = len(p["x"])
        yield pa.RecordBatch.from_arrays([pa.array([chunk.path] * n, pa.string()), *[pa.array(v) for v in p.values()], pa.array(np.full(n, h.point_format, np.int32))], names=["path", *p, "point_format"])


def head_row(path: str) -> tuple:
    """``(path, epsg, xmin, ymin, xmax, ymax, point_format, points, compressed)``; nulls for a file that cannot be read, and for bounds that are not finite."""
    try:
        with open_input(path) as f:
            h = header(f)
        return (path, h.epsg, *(h.bounds or (None,) * 4), h.point_format, h.count, h.compressed)
    except Exception:  # noqa: BLE001  any unreadable file is a tile without system and bounds
        return (path, *(None,) * 8)


class Las(DataSource):
    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        if self.options.get("headers", "false").lower() == "true":
            return "path string, epsg int, xmin double, ymin double, xmax double, ymax double, point_format int, points long, compressed boolean"
        return "path string, x double, y double, z double, intensity long, return_number long, number_of_returns long, point_format int"

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes ``spark.read.format("las")`` known."""
    spark.dataSource.register(Las)
