"""Plot operators: hand-made cases and invariants; the full queries are compared with DuckDB by their oracle SQL."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from copse.functions import geo
from copse.functions.geo import forward, inverse, staged
from copse.operators import canopy, coordinates, metrics, point_features, stencils, tiles, trees
from copse.operators.components import label

# lon, lat, zone, easting, northing
GOLDEN = [(-81.0, 48.0, 17, 500000.0, 5316300.2245), (-87.0, 49.5, 16, 500000.0, 5483040.8272), (-82.5, 47.123456, 17, 386225.5268, 5219974.9912), (-84.123456, 48.654321, 16, 711838.6064, 5393023.2185), (-79.0, 46.0, 17, 654863.5734, 5095992.1709)]


def test_projection_round_trip(spark):
    for lon, lat, zone, e, n in GOLDEN:
        df = staged(spark.createDataFrame([(lon, lat)], "lon double, lat double"), forward("lon", "lat", str(zone), 298.257223563, "p"))
        row = staged(df, inverse("pe", "pn", str(zone), 298.257223563, "q")).first()
        assert (row.pe, row.pn) == pytest.approx((e, n), abs=1e-3) and (row.qlon, row.qlat) == pytest.approx((lon, lat), abs=1e-9)


def test_coordinates(spark):
    x = spark.createDataFrame([(48.123456,), (48.5,), (48.12345,)], "x double")
    assert [r[0] for r in x.select(coordinates.decimals_ok(F.col("x"))).collect()] == [True, False, False]
    errs = spark.createDataFrame([(None, False), (2.999, True), (3.0, True), (50.0, True), (50.01, True)], "e double, p boolean")
    assert [r[0] for r in errs.select(coordinates.confidence(F.col("e"), F.col("p"))).collect()] == ["Low", "High", "Medium", "Medium", "Low"]
    with pytest.raises(ValueError):
        coordinates.coerce(x)
    empty = coordinates.coerce(spark.createDataFrame([], "vsnplotname string, latitude string, longitude string"))
    assert coordinates.auto_bounds(empty).first().asDict() == {"lat_min": 45.0, "lat_max": 55.0, "lon_min": -95.0, "lon_max": -70.0, "zone": 17}
    lost = coordinates.clean(coordinates.coerce(spark.createDataFrame([("p", "x", "-81")], "vsnplotname string, latitude string, longitude string"))).first()
    assert (lost.STATUS, lost.QC_FLAGS, lost.TARGET_EPSG) == ("NO_LATLON", "NA_LATLON", None)


def test_coverage(spark):
    plots = spark.createDataFrame([("P1", 0.0, 0.0, 2956)], "plot_id string, e double, n double, epsg int")
    tile = lambda name, a, b: (f"d/P1{name}_CHM_1m.tif", "d", "CHM", 2956, a, -10.0, b, 10.0)
    schema = "path string, dir string, kind string, epsg int, xmin double, ymin double, xmax double, ymax double"
    mode = lambda *t: tiles.coverage(plots, spark.createDataFrame(list(t), schema)).where("kind = 'CHM'").first()
    west, east = tile("-a", -10.0, 0.0), tile("-b", 0.0, 10.0)
    assert mode(west, east).mode == "union"
    assert (mode(west).mode, mode(west).missing) == ("none", [1, 2, 5])
    assert mode(tile("-c", -9.0, 9.0)).mode == "single"
    assert mode((*west[:3], None, *west[4:])).mode == "none"


def test_plots_and_tiles_of_two_zones(spark):
    at = spark.createDataFrame([(-84.02, 47.3)], "lon double, lat double")
    e16, n16 = geo.staged(at, geo.forward("lon", "lat", "16", 298.257222101, "p")).select("pe", "pn").first()
    e17, n17 = geo.staged(at, geo.forward("lon", "lat", "17", 298.257222101, "p")).select("pe", "pn").first()
    rows = [(e16, n16, 2956, 2957), (e17, n17, 2957, 2956), (e16, n16, 2956, 2956), (e16, n16, 32616, 26917), (e16, n16, 1, 2957)]
    to = geo.placed(spark.createDataFrame(rows, "e double, n double, a int, b int"), geo.reprojection("e", "n", "a", "b", "q"), "qe", "qn").collect()
    for got, want in zip(to, [(e17, n17), (e16, n16), (e16, n16), (e17, n17), (None, None)], strict=True):
        assert want == (None, None) == (got.qe, got.qn) or (got.qe, got.qn) == pytest.approx(want, abs=2e-3)
    south = geo.placed(spark.createDataFrame([(400000.0, 9000000.0, 32716, 32717)], "e double, n double, a int, b int"), geo.reprojection("e", "n", "a", "b", "q"), "qe", "qn").first()
    back = geo.placed(spark.createDataFrame([(south.qe, south.qn, 32717, 32716)], "e double, n double, a int, b int"), geo.reprojection("e", "n", "a", "b", "q"), "qe", "qn").first()
    assert (back.qe, back.qn) == pytest.approx((400000.0, 9000000.0), abs=1e-2)
    plots = spark.createDataFrame([("P1", e16, n16, 2956)], "plot_id string, e double, n double, epsg int")
    tile = spark.createDataFrame([("d/P1_CHM_1m.tif", "d", "CHM", 2957, e17 - 11, n17 - 11, e17 + 11, n17 + 11)], "path string, dir string, kind string, epsg int, xmin double, ymin double, xmax double, ymax double")
    assert tiles.coverage(plots, tile).where("kind = 'CHM'").first().mode == "single" and tiles.overlap(plots, tile).count() == 1
    assert tiles.overlap(plots.withColumn("e", F.col("e") + 40), tile).count() == 0
    pair = plots.selectExpr("*", "'r' AS path", "2957 AS tile_epsg", f"{e17}D - 30 AS x0", f"{n17}D + 5.2D AS y0", "0.9D AS px_x", "0.5D AS px_y", "100L AS width", "100L AS height")
    w = tiles.clip_windows(pair).first()
    assert (w.col0, w.col1, w.row0, w.row1) == (33 - 11, 33 + 11, 0, 30)  # 22 pixels of 0.9 m, 40 of 0.5 m cut at the top


def test_merged_points_are_in_the_format_of_the_first_file(spark):
    p = spark.createDataFrame([(1, "b", 3, 1.0), (1, "a", 7, 2.0), (1, "a", 7, 3.0), (2, "b", 3, 4.0)], "box long, path string, point_format int, z double")
    assert sorted(x.z for x in tiles.merge_points(p).collect()) == [2.0, 3.0, 4.0]


def test_point_features_and_entropy(spark):
    p = spark.createDataFrame([(1, 0.25, 1, 1, 1), (1, 0.75, 1, 1, 1), (2, float("nan"), 1, 1, 1), (2, -1.0, None, None, None)], "plot_id long, z double, intensity int, return_number int, number_of_returns int")
    got = {r.plot_id: r for r in point_features.point_features(p).collect()}
    assert got[1].fhd_0p5m == pytest.approx(1.0) and got[1].num_points == 2
    assert got[2].fhd_0p5m == 0 and got[2].num_points == 1 and got[2].intensity_mean is None and got[2].ratio_first_returns is None


def test_metrics(spark):
    one = spark.createDataFrame([(2, 1, 1)], "tp int, fp int, fn int").select(metrics.fbeta(F.col("tp"), F.col("fp"), F.col("fn"))).first()[0]
    assert one == pytest.approx(2 / 3)
    r = np.random.default_rng(0)
    rows = [(int(y), float(round(s, 2))) for y, s in zip(r.integers(0, 2, 200), r.random(200), strict=True)]
    s = spark.createDataFrame(rows, "y int, score double")
    pos, neg = [b for a, b in rows if a], [b for a, b in rows if not a]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert metrics.roc_auc(s).first()[0] == pytest.approx(auc)
    scan = {round(t.t, 6): t.fbeta for t in metrics.fbeta_scan(s).collect()}
    for t in (0.01, 0.5049494949, 0.99):
        t = min(scan, key=lambda k: abs(k - t))
        tp, fp, fn = sum(b >= t for b in pos), sum(b >= t for b in neg), sum(b < t for b in pos)
        assert scan[t] == pytest.approx(3.25 * tp / (3.25 * tp + 2.25 * fn + fp) if tp else 0)


def test_components_and_stencils(spark):
    assert label(np.array([[1, 0], [0, 1]], bool)).max() == 2 and label(np.array([[1, 0, 1], [1, 1, 1]], bool)).max() == 1
    r = np.random.default_rng(1)
    z = r.random((6, 7))
    px = spark.createDataFrame([(1, i, j, float(z[i, j])) for i in range(6) for j in range(7)], "plot_id long, row long, col long, z double")
    wide = np.pad(z, 1, mode="edge")
    std = {(x.row, x.col): x.k_std for x in stencils.local_moments(px, {"k": (1, 1)}).collect()}
    assert all(std[i, j] == pytest.approx(wide[i : i + 3, j : j + 3].std(), abs=1e-9) for i in range(6) for j in range(7))
    closed = stencils.fill_pits(px, 1, 99.0)
    again = stencils.fill_pits(closed.select("plot_id", "row", "col", F.col("filled").alias("z")), 1, 99.0)
    assert closed.where("filled < z").count() == 0 and again.where("abs(filled - z) > 1e-12").count() == 0
    k = stencils.gauss(0.8)
    got = {(x.row, x.col): x.g for x in stencils.convolved(px, "z", {"g": [(k, k)]}).collect()}
    far = np.pad(z, 6, mode="symmetric")
    w = dict(k)
    want = sum(w[a] * w[b] * far[6 + 2 + a, 6 + 3 + b] for a in w for b in w)
    assert got[2, 3] == pytest.approx(want)
    assert canopy.odd_window(3.0, 1.0) == 3 and canopy.odd_window(1.0, 0.2) == 5


def test_suppression_and_neighbours(spark):
    c = spark.createDataFrame([(1, 0.0, 0.0, 2.0, 9.0, 1), (1, 1.0, 0.0, 3.0, 8.0, 2), (1, 3.0, 0.0, 1.0, 7.0, 3), (1, 3.5, 0.0, 1.0, 6.0, 4)], "plot_id long, col double, row double, r double, score double, tree_id long")
    kept = trees.suppressed(c)
    assert {x.tree_id for x in kept.collect()} == {1, 3}
    t = spark.createDataFrame([(1, i, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (3, 4), (3, 5)])], "plot_id long, tree_id long, row double, col double")
    assert sorted(x.nnd for x in trees.nearest(t, 1.0).collect()) == [1.0, 1.0, 5.0]


def test_watershed():
    z = np.zeros((12, 12))
    tops = [(3, 3), (8, 8)]
    mask = np.ones((12, 12), bool)
    mask[0] = False
    lab = trees.watershed(z, tops, mask, 8.0)
    assert not lab[0].any() and lab[3, 3] == 1 and lab[8, 8] == 2 and set(np.unique(lab[mask])) == {1, 2}
