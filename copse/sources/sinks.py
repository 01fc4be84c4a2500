"""What is written: tables as CSV, layers as GeoPackage or GeoJSON, rasters as GeoTIFF, points as LAS, reports as text.

Tables are written by Spark, in one file where a single one is meant for people
to read.  Rasters and point clouds are encoded in the tasks that hold a plot,
a file a plot.  GeoPackage and the text reports are made on the driver: their
rows, one a plot or a setting, come as a stream.
"""

from __future__ import annotations

import re
import sqlite3
import struct
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import PLOT_PIXELS, rasters
from . import geotiff, las
from .files import open_input, write_bytes

# Columns of the treetop table, the master table and the importance table; radius of a crown over sigma.
TOPS = ("x", "y", "col", "row", "height", "sigma_m", "score", "crown_r_est_m")
MASTER = ("plot_id", "n_trees", "mean_nnd_m", "cv_nnd", "cover_ratio", "mean_radius_m", "cv_radius", "pct_oversize", "pct_edge_trees", "mean_peak_h", "_chm_path", "_laz_path")
IMPORTANCE = ("model", "feature", "perm_importance_mean", "perm_importance_std", "share_percent", "rel_drop_percent", "rank_percentile")
CROWN_OF_SIGMA = 1.8


def fixed3(value: Column) -> Column:
    """Three decimals, rounded as binary values are: half of the last place to even only where it is exact."""

    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None or x != x else f"{x:.3f}").astype(object)

    return F.pandas_udf(run, "string")(value)


def csv(df: DataFrame, path: str, single: bool = True, three: bool = False, by: str | None = None) -> None:
    """A CSV folder with a header; ``single``: one part; ``three``: doubles with three decimals; ``by``: a folder for each value."""
    if three:
        df = df.select(*[fixed3(F.col(f"`{c}`")).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes])
    w = (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).option("emptyValue", "")
    (w.partitionBy(by) if by else w).csv(path)


def clean_csv(table: DataFrame, path: str) -> None:
    csv(table, path, three=True)


def tops_table(tops: DataFrame, transform: tuple[float, ...]) -> DataFrame:
    """Treetops with their positions and an estimate of the crown's radius."""
    from ..operators.trees import pix_to_xy

    x, y = pix_to_xy(transform)
    t = tops.withColumns({"x": x, "y": y, "height": F.col("h"), "crown_r_est_m": F.col("sigma_m") * CROWN_OF_SIGMA})
    return t.select("plot_id", *TOPS)


def master_table(features: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """The slim features in their fixed order, with the files (plot_id, chm, laz); what is missing is empty."""
    none = F.lit(None).cast("string")
    df = features.join(files.select("plot_id", F.col("chm").alias("_chm_path"), F.col("laz").alias("_laz_path")), "plot_id", "left") if files is not None else features.withColumns({"_chm_path": none, "_laz_path": none})
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in MASTER])


def first_columns(df: DataFrame, first: tuple[str, ...] = ("Name", "CHM_file", "LAZ_file")) -> DataFrame:
    return df.select(*[c for c in first if c in df.columns], *[c for c in df.columns if c not in first])


def split_tables(df: DataFrame, row: str = "id") -> tuple[DataFrame, DataFrame]:
    """The training and the test rows' numbers."""
    return df.where("not is_test").select(F.col(row).alias("train_index")), df.where("is_test").select(F.col(row).alias("test_index"))


def importances(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """The importance tables of all models as one, written model by model and together (with baseline_ap)."""
    out = None
    for name, t in tables.items():
        csv(t.select(*IMPORTANCE), f"{path}/perm_importance_{name}_percent")
        out = t if out is None else out.unionByName(t)
    csv(out.select(*IMPORTANCE, "baseline_ap"), f"{path}/perm_importance_all_models_percent")
    return out


# -- layers ------------------------------------------------------------------------------------

_NUMBER = re.compile(r"-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?")


def wkb(wkt: str) -> bytes:
    """Well-known bytes of a POINT or POLYGON."""
    kind, body = wkt.split("(", 1)
    if kind.strip() == "POINT":
        return struct.pack("<BI2d", 1, 1, *map(float, _NUMBER.findall(body)[:2]))
    rings = [np.array(list(map(float, _NUMBER.findall(r))), "<f8").reshape(-1, 2) for r in re.findall(r"\(([^()]*)\)", "(" + body)]
    return struct.pack("<BII", 1, 3, len(rings)) + b"".join(struct.pack("<I", len(r)) + r.tobytes() for r in rings)


def _rows(df: DataFrame) -> Iterator:
    return df.toLocalIterator(prefetchPartitions=True)


def geopackage(layers: dict[str, tuple[DataFrame, str]], path: str, epsg: int | None = None, default: int = 2957) -> None:
    """Layers (a table and its WKT column) of one GeoPackage; the system is given, or the first row's ``epsg``, or the default."""
    with tempfile.TemporaryDirectory() as folder:  # the driver's own: SQLite needs a real file, and only the result is shared
        made = Path(folder) / "layers.gpkg"
        db = sqlite3.connect(made)
        db.executescript(
            "PRAGMA application_id = 1196444487; PRAGMA user_version = 10300;"
            "CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT);"
            "CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT UNIQUE, description TEXT DEFAULT '', last_change DATETIME DEFAULT '2000-01-01T00:00:00.000Z', min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER);"
            "CREATE TABLE gpkg_geometry_columns (table_name TEXT PRIMARY KEY, column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL, srs_id INTEGER NOT NULL, z TINYINT NOT NULL, m TINYINT NOT NULL);"
        )
        for name, (df, geometry) in layers.items():
            if epsg is None and "epsg" in df.columns:
                first = df.where("epsg IS NOT NULL").select("epsg").first()
                epsg = first.epsg if first else None
            epsg = epsg or default
            cols = [(c, "INTEGER" if t in ("int", "bigint") else "REAL" if t in ("double", "float") else "TEXT") for c, t in df.dtypes if c != geometry]
            db.execute(f'CREATE TABLE "{name}" (fid INTEGER PRIMARY KEY AUTOINCREMENT, geom BLOB, {", ".join(f"""\"{c}\" {t}""" for c, t in cols)})')
            head = b"GP" + struct.pack("<BBi", 0, 1, epsg)
            rows = ((head + wkb(r[geometry]) if r[geometry] else None, *[r[c] if isinstance(r[c], (int, float, str, type(None))) else str(r[c]) for c, _ in cols]) for r in _rows(df))
            db.executemany(f'INSERT INTO "{name}" (geom, {", ".join(f"""\"{c}\"""" for c, _ in cols)}) VALUES ({", ".join("?" * (len(cols) + 1))})', rows)
            db.execute("INSERT INTO gpkg_contents (table_name, data_type, identifier, srs_id) VALUES (?, 'features', ?, ?)", (name, name, epsg))
            db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', 'GEOMETRY', ?, 0, 0)", (name, epsg))
        for code in {epsg or default, 4326}:
            db.execute("INSERT OR IGNORE INTO gpkg_spatial_ref_sys VALUES (?, ?, 'EPSG', ?, 'undefined', NULL)", (f"EPSG:{code}", code, code))
        db.commit()
        db.close()
        write_bytes(path, made.read_bytes())


def _geojson(wkt: Column) -> Column:
    """A geometry as GeoJSON text."""
    point = F.concat(F.lit('{"type":"Point","coordinates":['), F.regexp_replace(F.regexp_extract(wkt, r"\(([^()]*)\)", 1), " ", ","), F.lit("]}"))
    rings = F.transform(F.regexp_extract_all(wkt, F.lit(r"\(([^()]+)\)"), F.lit(1)), lambda r: F.concat(F.lit("["), F.concat_ws(",", F.transform(F.split(r, ", "), lambda p: F.concat(F.lit("["), F.regexp_replace(p, " ", ","), F.lit("]")))), F.lit("]")))
    polygon = F.concat(F.lit('{"type":"Polygon","coordinates":['), F.concat_ws(",", rings), F.lit("]}"))
    return F.when(wkt.startswith("POINT"), point).otherwise(polygon)


def geojson(df: DataFrame, geometry: str, path: str) -> None:
    """A folder of GeoJSON text sequences: a feature a line, with all other columns as properties."""
    rest = F.to_json(F.struct(*[c for c in df.columns if c != geometry]), {"ignoreNullFields": "false"})
    line = F.concat(F.lit('{"type":"Feature","properties":'), rest, F.lit(',"geometry":'), _geojson(F.col(geometry)), F.lit("}"))
    df.select(line.alias("value")).write.mode("overwrite").text(path)


def polygons(df: DataFrame, path: str, epsg: int | None = None) -> str:
    """Crown polygons (with a column wkt) by the path's ending: GeoJSON, or a GeoPackage in all other cases; gives the path written."""
    if re.search(r"\.(geojson|json)$", path, re.I):
        geojson(df, "wkt", path)
        return path
    path = path if path.lower().endswith(".gpkg") else re.sub(r"\.[^./]*$", "", path) + ".gpkg"
    geopackage({"crowns": (df, "wkt")}, path, epsg)
    return path


# -- rasters and point clouds ------------------------------------------------------------------


def _by_plot(df: DataFrame, key: str, write: Callable[[object, pd.DataFrame], str]) -> DataFrame:
    def run(k: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"plot": [str(k[0])], "path": [write(k[0], frame)], "n": [len(frame)]})

    return df.groupBy(key).applyInPandas(run, "plot string, path string, n long")


def geotiffs(px: DataFrame, folder: str, transform: tuple[float, ...], name: str = "{plot}_CHM_20m.tif", epsg: int | None = None, nodata: float | None = -9999.0, dtype: str = "float32", value: str = "z") -> list[str]:
    """A GeoTIFF for each plot, and their paths; rows and columns keep their place in the grid of ``transform``.

    The picture starts at the plot's first row and column; pixels without a row or a value get the nodata mark.
    """
    a, b, c, d, e, f = transform

    def write(plot: object, frame: pd.DataFrame) -> str:
        if len(frame) > PLOT_PIXELS:
            raise ValueError(f"plot {plot} has {len(frame)} pixels, more than {PLOT_PIXELS}")
        r0, c0 = int(frame["row"].min()), int(frame["col"].min())
        (z,) = rasters(frame.assign(row=frame["row"] - r0, col=frame["col"] - c0), value)
        z = np.where(np.isnan(z), np.nan if nodata is None else nodata, z).astype(dtype)
        path = f"{folder}/{name.format(plot=plot)}"
        write_bytes(path, geotiff.encode(z, (a, b, c + c0 * a + r0 * b, d, e, f + c0 * d + r0 * e), epsg, nodata))
        return path

    return sorted(r.path for r in _by_plot(px.select("plot_id", "row", "col", value), "plot_id", write).collect())


def las_files(points: DataFrame, folder: str, template: str | None = None, point_format: int = 6, epsg: int | None = None, name: str = "{plot}_LAZ_20m.las", key: str = "plot_id") -> list[str]:
    """A LAS file for each plot, and their paths; format, scale, offset and system are the template file's, if one is given.

    Files are plain LAS, as there is no compressor for LAZ.
    """
    scale, offset = (0.001, 0.001, 0.001), None
    if template is not None:
        with open_input(template) as f:
            h = las.header(f)
        point_format, scale, offset, epsg = h.point_format, h.scale, h.offset, h.epsg or epsg
    dims = [c for c in ("x", "y", "z", "intensity", "return_number", "number_of_returns") if c in points.columns]

    def write(plot: object, frame: pd.DataFrame) -> str:
        path = f"{folder}/{name.format(plot=plot)}"
        write_bytes(path, las.encode({d: frame[d].to_numpy() for d in dims}, point_format, scale, offset, epsg))
        return path

    return sorted(r.path for r in _by_plot(points.select(key, *dims), key, write).collect())


# -- reports -----------------------------------------------------------------------------------


def report_text(report: DataFrame) -> str:
    """The classification report (five rows) as text with three digits."""
    rows = {r.label: r for r in report.collect()}
    width = len("weighted avg")
    line = lambda name, *v: f"{name:>{width}} " + " ".join(f"{x:>9}" for x in v)
    out = [line("", "precision", "recall", "f1-score", "support"), ""]
    for k in ("0", "1", "accuracy", "macro avg", "weighted avg"):
        r, n = rows[k], lambda x: "0.000" if x is None else f"{x:.3f}"
        out += ([""] if k == "accuracy" else []) + [line(k, *(("", "", n(r.f1)) if k == "accuracy" else (n(r.precision), n(r.recall), n(r.f1))), r.support)]
    return "\n".join(out) + "\n"


# Headers of the table of metrics.
HEADERS = {"label": "Setting", "threshold": "Threshold", "roc_auc": "ROC AUC", "pr_auc": "PR AUC", "brier": "Brier", "accuracy": "Accuracy", "f1": "F1"}


def latex_table(metrics: DataFrame) -> str:
    """The metrics (three rows a model) as a LaTeX table with three decimals; no value is an empty cell."""
    cell = lambda v: "" if v is None else v if isinstance(v, str) else f"{v:.3f}"
    lines = [" & ".join(cell(r[c]) for c in HEADERS) + r" \\" for r in metrics.select(*HEADERS).collect()]
    return "\n".join([r"\begin{tabular}{l" + "c" * (len(HEADERS) - 1) + "}", r"\toprule", " & ".join(HEADERS.values()) + r" \\", r"\midrule", *lines, r"\bottomrule", r"\end{tabular}", ""])


def readme_text(models: list[str]) -> str:
    """What a run of the models leaves in its folder."""
    return "\n".join(["Outputs:", "- tables/metrics_table_all_models (csv), metrics_table_all_models.tex", *[f"- tables/perm_importance_{m}_percent (csv)" for m in models], "- tables/perm_importance_all_models_percent (csv)", "- tables/train_indices, tables/test_indices (csv)", *[f"- {m}_classification_report_0.50.txt, {m}_classification_report_cvopt.txt" for m in models], ""])


def text(path: str, content: str) -> None:
    write_bytes(path, content.encode())
