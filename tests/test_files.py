"""Files: what is written is read again, and hand-made files of other writers' kinds are read."""

import sqlite3
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from copse.operators import tiles
from copse.sources import geotiff, las, sinks, tables

AT = (0.5, 0.0, 500000.0, 0.0, -0.5, 5300000.0)


@pytest.fixture(scope="module", autouse=True)
def sources(spark):
    geotiff.register(spark)
    las.register(spark)


def test_geotiff_windows_and_headers(spark, tmp_path):
    r = np.random.default_rng(1)
    z = r.normal(size=(700, 90)).astype(np.float32)
    z[5, 7] = -9999.0
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "P1_CHM_1m.tif").write_bytes(geotiff.encode(z, AT, 2956, -9999.0))
    (tmp_path / "a" / "P2.tif").write_bytes(b"no picture")
    (tmp_path / "a" / "._P3.tif").write_bytes(b"hidden")
    head = {x.path.rsplit("/", 1)[1]: x for x in spark.read.format("geotiff").option("headers", True).load(str(tmp_path)).collect()}
    assert set(head) == {"P1_CHM_1m.tif", "P2.tif"} and head["P2.tif"].epsg is None
    h = head["P1_CHM_1m.tif"]
    assert (h.epsg, h.xmin, h.ymin, h.xmax, h.ymax, h.height, h.width, h.px_x) == (2956, 500000.0, 5299650.0, 500045.0, 5300000.0, 700, 90, 0.5)
    path = str(tmp_path / "a" / "P1_CHM_1m.tif")
    px = spark.read.format("geotiff").load(path)
    rows = px.where("row >= 600 AND row < 602 AND col = 3").orderBy("row").collect()
    assert [(x.row, x.col, x.z) for x in rows] == [(600, 3, float(z[600, 3])), (601, 3, float(z[601, 3]))]
    assert px.count() == 700 * 90 and px.where("z IS NULL").select("row", "col").collect() == [(5, 7)]
    part = spark.read.format("geotiff").option("row0", 10).option("row1", 12).option("col0", 80).load(path)
    assert part.count() == 20
    windows = spark.createDataFrame([(1, path, 4, 6, 6, 8)], "plot_id long, path string, row0 long, row1 long, col0 long, col1 long")
    want = [(4, 6), (4, 7), (5, 6), (5, 7)]
    assert sorted((x.row, x.col) for x in tiles.clip_pixels(px, windows).collect()) == want
    own = geotiff.read_windows(windows.unionAll(windows.withColumn("path", F.lit("none.tif"))))
    assert sorted((x.row, x.col) for x in own.collect()) == want and own.where("z IS NULL").count() == 1


def lzw(data):
    """Codes of 9 bits, cleared before they would need more."""
    bits, out = "", [256]
    for at in range(0, len(data), 200):
        out += [*data[at : at + 200], 256]
    out[-1] = 257
    bits = "".join(f"{c:09b}" for c in out)
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


@pytest.mark.parametrize(("kind", "predictor"), [(1, 1), (5, 1), (8, 2), (8, 3)])
def test_tiled_big_endian_rasters(tmp_path, kind, predictor):
    v = (np.arange(40 * 24).reshape(40, 24) * 37 % 501).astype(">f4" if predictor == 3 else ">u2")
    blocks = []
    for r in range(0, 48, 16):
        for c in range(0, 32, 16):
            b = np.zeros((16, 16), v.dtype)
            part = v[r : r + 16, c : c + 16]
            b[: part.shape[0], : part.shape[1]] = part
            if predictor == 2:
                b = np.diff(b, axis=1, prepend=np.zeros((16, 1), b.dtype)).astype(b.dtype)
            raw = b.tobytes()
            if predictor == 3:
                planes = b.view(np.uint8).reshape(16, 16, 4).transpose(0, 2, 1).reshape(16, 64)
                raw = np.diff(planes, axis=1, prepend=np.zeros((16, 1), np.uint8)).astype(np.uint8).tobytes()
            blocks.append({1: bytes, 5: lzw, 8: zlib.compress}[kind](raw))
    tags = {256: (24,), 257: (40,), 258: (v.itemsize * 8,), 259: (kind,), 277: (1,), 317: (predictor,), 322: (16,), 323: (16,), 339: (3 if predictor == 3 else 1,), 324: [0] * 6, 325: [len(b) for b in blocks]}
    start, lists = 8 + 2 + 12 * len(tags) + 4, b""
    places = {324: start, 325: start + 24}
    at = start + 48
    for i, b in enumerate(blocks):
        tags[324][i] = at
        at += len(b)
    entries = b"".join(struct.pack(">HHII", t, 4, len(tags[t]), places[t] if t in places else tags[t][0]) for t in sorted(tags))
    lists = struct.pack(">6I", *tags[324]) + struct.pack(">6I", *tags[325])
    path = tmp_path / "t.tif"
    path.write_bytes(b"MM" + struct.pack(">HIH", 42, 8, len(tags)) + entries + b"\0" * 4 + lists + b"".join(blocks))
    with open(path, "rb") as f:
        h = geotiff.header(f)
        assert (geotiff.window(f, h, 3, 37, 5, 24) == v[3:37, 5:24]).all() and h.bounds is None and h.epsg is None


@pytest.mark.parametrize("point_format", [1, 6])
def test_las(spark, tmp_path, point_format):
    r = np.random.default_rng(2)
    n = 2500
    p = {"x": 500000 + r.random(n) * 50, "y": 5300000 + r.random(n) * 50, "z": r.random(n) * 30, "intensity": r.integers(0, 65536, n), "return_number": r.integers(1, 6, n), "number_of_returns": r.integers(1, 6, n)}
    raw = las.encode(p, point_format, epsg=2957)
    (tmp_path / "a.las").write_bytes(raw)
    (tmp_path / "b.laz").write_bytes(raw[:104] + bytes([raw[104] | 0x80]) + raw[105:])
    (tmp_path / "c.las").write_bytes(b"LASF")
    head = {x.path.rsplit("/", 1)[1]: x for x in spark.read.format("las").option("headers", True).load(str(tmp_path)).collect()}
    assert (head["a.las"].epsg, head["a.las"].points, head["a.las"].point_format) == (2957, n, point_format)
    assert head["b.laz"].compressed and head["b.laz"].xmin == pytest.approx(p["x"].min()) and head["c.las"].epsg is None
    df = spark.read.format("las").option("chunk", 1000).load(str(tmp_path))
    got = df.toPandas()
    assert len(got) == n and set(got["path"].map(lambda x: x[-5:])) == {"a.las"}
    got = got.sort_values(["x", "y"]).reset_index(drop=True)
    order = np.lexsort((np.round(p["y"], 3), np.round(p["x"], 3)))
    for k, v in p.items():
        assert np.allclose(got[k], v[order], atol=6e-4)
    out = sinks.las_files(df.withColumn("plot_id", (F.col("x") > 500025).cast("int")), str(tmp_path / "out"), template=str(tmp_path / "a.las"))
    assert [o.rsplit("/", 1)[1] for o in out] == ["0_LAZ_20m.las", "1_LAZ_20m.las"]
    again = spark.read.format("las").load(str(tmp_path / "out"))
    assert again.count() == n and again.select("point_format").distinct().collect() == [(point_format,)]


def test_raster_and_layer_sinks(spark, tmp_path):
    px = spark.createDataFrame([(1, r, c, float(r * 10 + c) if (r, c) != (3, 3) else None) for r in range(2, 5) for c in range(3, 7)], "plot_id long, row long, col long, z double")
    (path,) = sinks.geotiffs(px, str(tmp_path / "tif"), AT, epsg=2956)
    got = spark.read.format("geotiff").load(path)
    assert path.endswith("/1_CHM_20m.tif") and {(x.row, x.col): x.z for x in got.collect()} == {(r - 2, c - 3): (float(r * 10 + c) if (r, c) != (3, 3) else None) for r in range(2, 5) for c in range(3, 7)}
    (mask,) = sinks.geotiffs(px.withColumn("m", (F.col("z") > 30).cast("double")), str(tmp_path / "mask"), AT, "{plot}_mask.tif", nodata=0.0, dtype="uint8", value="m")
    with open(mask, "rb") as f:
        h = geotiff.header(f)
        assert h.dtype == np.uint8 and h.transform[2] == 500001.5 and h.nodata == 0.0
    square = "POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0), (0.5 0.5, 1 0.5, 1 1, 0.5 0.5))"
    rows = spark.createDataFrame([("a", 2956, "POINT (1.5 2)", square), ("b", 2957, "POINT (3 4)", square)], "vsnplotname string, epsg int, centre string, square string")
    gpkg = str(tmp_path / "plots.gpkg")
    sinks.geopackage({"plot_centers": (rows.drop("square"), "centre"), "plot_20m_squares": (rows.drop("centre"), "square")}, gpkg)
    db = sqlite3.connect(gpkg)
    assert {t for (t,) in db.execute("SELECT table_name FROM gpkg_contents")} == {"plot_centers", "plot_20m_squares"}
    (blob,) = db.execute("SELECT geom FROM plot_centers WHERE vsnplotname = 'a'").fetchone()
    assert blob[:2] == b"GP" and struct.unpack("<i", blob[4:8]) == (2956,) and struct.unpack("<2d", blob[13:]) == (1.5, 2.0)
    assert len(db.execute("SELECT geom FROM plot_20m_squares").fetchone()[0]) == 8 + 9 + 4 + 5 * 16 + 4 + 4 * 16
    assert sinks.polygons(rows.selectExpr("vsnplotname", "square AS wkt"), str(tmp_path / "c.shp"), 2956).endswith("c.gpkg")
    sinks.polygons(rows.selectExpr("vsnplotname", "square AS wkt"), str(tmp_path / "c.geojson"))
    import json

    features = [json.loads(x.value) for x in spark.read.text(str(tmp_path / "c.geojson")).collect()]
    assert features[0]["geometry"]["coordinates"][1] == [[0.5, 0.5], [1, 0.5], [1, 1], [0.5, 0.5]] and {f["properties"]["vsnplotname"] for f in features} == {"a", "b"}


def test_csv_scans(spark, tmp_path):
    (tmp_path / "gps.csv").write_text("vsnplotname,latitude,longitude,easting,Easting,Northing\nA,46.5,-87.1,1,2,x\nB,bad,,,,4\n")
    a, b = tables.gps_csv(spark, str(tmp_path / "gps.csv")).orderBy("vsnplotname").collect()
    assert (a.latitude, a.raw_e, a.cap_e, a.cap_n, a.utmzone) == (46.5, 1.0, 2.0, None, None) and (b.latitude, b.longitude, b.cap_n) == (None, None, 4.0)
    (tmp_path / "bad.csv").write_text("name,latitude\nA,1\n")
    with pytest.raises(ValueError, match="vsnplotname"):
        tables.gps_csv(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "xy.csv").write_text("VSNPlotName,Target_EPSG,CENTER_e,center_E,CENTER_N\n vsn1 ,EPSG:2956,1,2,3\n")
    row = tables.coordinate_csv(spark, str(tmp_path / "xy.csv")).first()
    assert (row.plot_id, row.e, row.n, row.target_epsg, row.lon) == ("VSN1", 2.0, 3.0, "EPSG:2956", None)
    with pytest.raises(ValueError, match="CENTER_E"):
        tables.coordinate_csv(spark, str(tmp_path / "gps.csv"))
    (tmp_path / "f.csv").write_text("plot_id,x,lichen_presence\nP1,1.5,1\nP2,2.5,0\n")
    f = tables.feature_csv(spark, str(tmp_path / "f.csv"))
    assert dict(f.dtypes) == {"plot_id": "string", "x": "double", "lichen_presence": "int"}
    with pytest.raises(ValueError, match="lichen_presence"):
        tables.feature_csv(spark, str(tmp_path / "xy.csv"))
    joined = tables.with_labels(f.drop("lichen_presence"), spark.createDataFrame([(" p1 ", 1), ("P9", 0)], "plot_id string, lichen_presence int"))
    assert [(x.plot_id, x.lichen_presence) for x in joined.collect()] == [("P1", 1)]


def test_table_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 2.0625, None, 1), ("b", float("nan"), 0.0005, 2)], "name string, x double, y double, k int")
    sinks.clean_csv(df, str(tmp_path / "clean"))
    (part,) = (tmp_path / "clean").glob("part-*.csv")
    assert part.read_text() == "name,x,y,k\na,2.062,,1\nb,,0.001,2\n"
    tops = spark.createDataFrame([(1, 7, 2, 4, 9.5, 1.3, 0.5)], "plot_id long, tree_id long, row long, col long, h double, sigma_m double, score double")
    t = sinks.tops_table(tops, AT)
    assert t.columns == ["plot_id", *sinks.TOPS] and (t.first().x, t.first().y, t.first().crown_r_est_m) == (500002.0, 5299999.0, pytest.approx(2.34))
    f = spark.createDataFrame([(1, 3, None)], "plot_id long, n_trees long, mean_nnd_m double")
    f = f.select("*", *[F.lit(1.0).alias(c) for c in sinks.MASTER[3:10]])
    m = sinks.master_table(f, spark.createDataFrame([(1, "c.tif", "")], "plot_id long, chm string, laz string")).first()
    assert (m.plot_id, m.mean_nnd_m, m._chm_path, m._laz_path) == ("1", "", "c.tif", "")
    report = spark.createDataFrame([("0", 0.5, 1.0, 0.6667, 2), ("1", None, 0.0, 0.0, 1), ("accuracy", 0.6, 0.6, 0.6, 3), ("macro avg", 0.5, 0.5, 0.5, 3), ("weighted avg", 0.5, 0.5, 0.5, 3)], "label string, precision double, recall double, f1 double, support long")
    text = sinks.report_text(report).split("\n")
    assert text[0].split() == ["precision", "recall", "f1-score", "support"] and text[2].split() == ["0", "0.500", "1.000", "0.667", "2"] and text[5].split() == ["accuracy", "0.600", "3"]
    metrics = spark.createDataFrame([("RF@0.50", 0.5, 0.9, 0.8, 0.1, 0.7, None)], "label string, threshold double, roc_auc double, pr_auc double, brier double, accuracy double, f1 double")
    assert r"RF@0.50 & 0.500 & 0.900 & 0.800 & 0.100 & 0.700 &  \\" in sinks.latex_table(metrics)
    sinks.text(str(tmp_path / "x" / "README.txt"), sinks.readme_text(["RF"]))
    assert "RF_classification_report" in (tmp_path / "x" / "README.txt").read_text()
    shares = {m: spark.createDataFrame([(m, "x0", 0.1, 0.01, 0.1, 100.0, 10.0, 100.0, 0.9)], "model string, feature string, perm_importance_mean double, perm_importance_std double, imp_pos double, share_percent double, rel_drop_percent double, rank_percentile double, baseline_ap double") for m in ("RF", "SVM")}
    assert sinks.importances(shares, str(tmp_path / "imp")).count() == 2 and len(list((tmp_path / "imp").iterdir())) == 3
