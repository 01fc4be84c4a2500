"""Tree detection against a plain NumPy version, masks, equalisation, outlines, and a whole plot from pixels to polygons."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from copse.operators import masks, stencils, trees
from copse.operators.components import label

PX = 0.5


def raster(seed, side=40):
    r = np.random.default_rng(seed)
    y, x = np.mgrid[:side, :side]
    z = r.random((side, side)) * 0.4
    for _ in range(14):
        a, b, h, w = r.uniform(0, side), r.uniform(0, side), r.uniform(5, 18), r.uniform(2, 5)
        z = np.maximum(z, h * (1 - ((y - a) ** 2 + (x - b) ** 2) / (4 * w * w)) + r.random((side, side)) * 0.3)
    return np.maximum(z, 0)


def frame(spark, rasters):
    rows = [(p, r, c, float(z[r, c])) for p, z in rasters.items() for r in range(z.shape[0]) for c in range(z.shape[1])]
    return spark.createDataFrame(rows, "plot_id long, row long, col long, z double")


def smooth(z, down, right):
    """Two-dimensional weighted sums, borders mirrored."""
    for axis, taps in ((0, down), (1, right)):
        n, out = z.shape[axis], np.zeros_like(z)
        for d, w in taps:
            at = [(i if 0 <= i < n else -1 - i if i < 0 else 2 * n - 1 - i) for i in range(d, n + d)]
            out += np.take(z, at, axis) * w
        z = out
    return z


def plain(z, mask):
    """The detector as loops over candidates."""
    g = stencils.gauss
    lhd = z - smooth(z, g(5 / PX / 2.355), g(5 / PX / 2.355))
    resp = np.stack([-(s**2) * (smooth(z, g(s, 2), g(s)) + smooth(z, g(s), g(s, 2))) for s in (max(m / PX, 0.5) for m in trees.SIGMAS_M)])
    found = []
    for i, m in enumerate(trees.SIGMAS_M):
        v = resp[i][mask & (resp[i] > 0)]
        if not v.size:
            continue
        t = np.percentile(v, (93 if m <= 1 else 96) - (0 if v.size >= 5000 else 2))
        top = np.where(mask & (resp[i] > t), resp[i], 0)
        reach, spots = max(int(1.6 * m / PX), 1), []
        for r, c in sorted(zip(*np.nonzero(top), strict=True), key=lambda p: -top[p]):
            box = top[max(r - reach, 0) : r + reach + 1, max(c - reach, 0) : c + reach + 1]
            if top[r, c] == box.max() and all(max(abs(r - a), abs(c - b)) > reach for a, b in spots):
                spots.append((r, c))
        s = max(m / PX, 0.8)
        xx, yy, xy = smooth(z, g(s, 2), g(s)), smooth(z, g(s), g(s, 2)), smooth(z, g(s, 1), g(s, 1))
        for r, c in spots:
            a, b = np.linalg.eigvalsh([[xx[r, c], xy[r, c]], [xy[r, c], yy[r, c]]])
            if z[r, c] >= 4 and lhd[r, c] >= 0.9 and resp[:, r, c].argmax() == i and b < 0 and abs(b) / (abs(a) + 1e-6) >= 0.5:
                found.append((resp[i, r, c], r, c, m))
    for factor in (1.0, 0.8):
        kept = []
        for x in sorted(found, reverse=True):
            if all(np.hypot(x[1] - k[1], x[2] - k[2]) > factor * 2.2 * k[3] / PX for k in kept):
                kept.append(x)
        found = kept
    return {(int(r), int(c), m) for _, r, c, m in found}


def test_detect_matches_a_plain_version(spark):
    rasters = {p: raster(p) for p in range(3)}
    df = frame(spark, rasters).withColumn("mask", F.col("z") > 3.5)
    got = trees.detect(df, PX, equalise=False).collect()
    for p, z in rasters.items():
        own = [x for x in got if x.plot_id == p]
        assert {(x.row, x.col, x.sigma_m) for x in own} == plain(z, z > 3.5) and len(own) > 1
        assert [x.tree_id for x in sorted(own, key=lambda x: -x.score)] == list(range(1, len(own) + 1))


def test_plateaus_are_one_peak_and_stand_out_less():
    pick = np.zeros((8, 8))
    pick[2, 3] = 5
    assert trees.collapsed([(2, 2), (2, 3), (3, 3), (7, 7)], pick) == [(2, 3, 3), (7, 7, 1)]


def test_masks_and_statistics(spark):
    z = raster(7)
    df = frame(spark, {1: z, 2: np.zeros((12, 12))})
    rows = masks.mask_intersection(df, PX).where("plot_id = 1").collect()
    tall = z >= 3.5
    wide = np.pad(tall, 3)
    disk = stencils.disk(3)
    grown = np.any([wide[3 + a : 43 + a, 3 + b : 43 + b] for a, b in disk], 0)
    full = np.pad(grown, 3, constant_values=True)
    closed = np.all([full[3 + a : 43 + a, 3 + b : 43 + b] for a, b in disk], 0)
    lab = label(closed)
    canopy = np.bincount(lab.ravel())[lab] * (lab > 0) >= 64
    edge = np.pad(z, ((2, 1), (2, 1)), mode="edge")
    cells = np.lib.stride_tricks.sliding_window_view(edge, (4, 4))
    want = closed & canopy & (cells.std(axis=(2, 3)) >= 0.28)
    assert sum(x.mask != want[x.row, x.col] for x in rows) == 0 and want.any()
    q = masks.quick_stats(df, mask=F.col("z") > 1).collect()
    assert [x.plot_id for x in q] == [1] and q[0].p95 == pytest.approx(np.percentile(z[z > 1], 95))


def test_equalisation(spark):
    r = np.random.default_rng(3)
    v = np.sort(r.random(1600) ** 3)
    out = masks.equalise(v)
    assert out.min() >= 0 and out.max() == 1 and (np.diff(masks.equalise(np.full(100, 0.5))) == 0).all()
    hist = masks._clipped(np.array([50, 0, 3, 10, 0]), 15)
    assert hist.sum() == 63 and hist.max() <= 15
    z = raster(4)
    df = frame(spark, {1: z, 2: np.ones((5, 5))}).withColumn("mask", F.col("z") > 3.5)
    got = masks.equalised(df).collect()
    assert all(x.z == z[x.row, x.col] for x in got if x.plot_id == 1 and not x.mask) and all(x.z == 1 for x in got if x.plot_id == 2)
    own = np.array([x.z for x in got if x.plot_id == 1 and x.mask])
    assert own.min() == pytest.approx(z[z > 3.5].min()) and own.max() == pytest.approx(z.max())


def area(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False)) / 2


def test_outlines_cover_the_pixels():
    m = np.array([[1, 1, 1, 0, 0], [1, 0, 1, 0, 1], [1, 1, 1, 1, 0], [0, 0, 0, 0, 0], [1, 0, 0, 0, 0]], bool)
    parts = masks.outline(m)
    assert sorted(len(p) for p in parts) == [1, 2] and sum(area(r) for p in parts for r in p) == m.sum()
    (square,) = masks.outline(np.ones((2, 3), bool))
    assert square == [[(0, 0), (3, 0), (3, 2), (0, 2), (0, 0)]]
    r = np.random.default_rng(1)
    for _ in range(50):
        m = r.random((9, 9)) < 0.5
        assert sum(area(ring) for p in masks.outline(m) for ring in p) == m.sum()


def test_whole_plots(spark):
    out = trees.delineate(frame(spark, {1: raster(1), 2: np.zeros((10, 10)), 3: -raster(2)}), PX)
    f = {x.plot_id: x for x in out["features"].collect()}
    assert set(f) == {1, 2, 3} and f[1].n_trees > 3 and f[2].n_trees == f[3].n_trees == 0 and f[2].cover_ratio is None
    c = out["crowns"].collect()
    assert all(x.area_m2 >= 2 for x in c) and f[1].cover_ratio == pytest.approx(sum(x.area_m2 for x in c) / 400)
    shapes = masks.crown_polygons(out["labels"], (PX, 0.0, 0.0, 0.0, -PX, 0.0)).collect()
    assert {x.tree_id for x in shapes} == {x.tree_id for x in c} and all(x.wkt.startswith("POLYGON ((") for x in shapes)


def test_kernels_refuse_what_is_no_plot(spark, monkeypatch):
    from copse.operators import components

    monkeypatch.setattr(components, "PLOT_PIXELS", 50)
    big = frame(spark, {1: np.ones((10, 10))}).withColumn("m", F.col("z") > 0)

    def size(key, own):
        return own.head(1)

    assert components.plotwise(big.where("row < 2").select("plot_id", "row"), size, "plot_id long, row long").count() == 1
    with pytest.raises(Exception, match="clip it first"):
        components.plotwise(big.select("plot_id", "row"), size, "plot_id long, row long").count()
