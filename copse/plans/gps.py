"""Queries of the coordinate operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geo import SYSTEMS, forward, nested
from ..operators import coordinates as co
from . import adapters
from .points import rounded
from .registry import query

_GPS = adapters.gps_sql()
_BOUNDS = """b0 AS (SELECT quantile_cont(latitude, 0.01) - 0.3e0 AS lat_min, quantile_cont(latitude, 0.99) + 0.3e0 AS lat_max, quantile_cont(longitude, 0.01) - 0.3e0 AS lon_min, quantile_cont(longitude, 0.99) + 0.3e0 AS lon_max FROM a_gps),
z0 AS (SELECT CAST(floor((longitude + 180) / 6) + 1 AS INTEGER) AS z, count(*) AS n FROM a_gps WHERE longitude IS NOT NULL GROUP BY 1),
bounds AS (SELECT *, CASE (SELECT z FROM z0 WHERE z BETWEEN 1 AND 60 ORDER BY n DESC, z LIMIT 1) WHEN 16 THEN 16 ELSE 17 END AS zone FROM b0)"""
_DEC = "length(rtrim(split_part(printf('%.10f', {x}), '.', 2), '0')) >= 6"
_Z = "CAST(floor((longitude + 180) / 6) + 1 AS INTEGER)"
_FLAGS = f"""CASE WHEN latitude IS NULL OR longitude IS NULL THEN 'NA_LATLON' ELSE coalesce(nullif(array_to_string(list_sort(list_distinct(list_filter([
  CASE WHEN latitude NOT BETWEEN -90 AND 90 OR longitude NOT BETWEEN -180 AND 180 THEN 'RANGE_LL' END,
  CASE WHEN latitude NOT BETWEEN lat_min AND lat_max THEN 'LAT_OUT' END, CASE WHEN longitude NOT BETWEEN lon_min AND lon_max THEN 'LON_OUT' END,
  CASE WHEN longitude > 0 THEN 'LON_SIGN' END, CASE WHEN NOT ({_DEC.format(x="latitude")}) OR NOT ({_DEC.format(x="longitude")}) THEN 'LOW_PREC' END,
  CASE WHEN CAST(utmzone AS INTEGER) NOT IN (16, 17) THEN 'UTMZONE_VAL?' END, CASE WHEN CAST(utmzone AS INTEGER) <> {_Z} THEN 'UTMZONE_MISMATCH(theory=' || {_Z} || ')' END,
  {", ".join(f"CASE WHEN {c} NOT BETWEEN 200000 AND 800000 THEN 'E_RANGE?' END" for c in ("raw_e", "asg_e", "cap_e"))},
  {", ".join(f"CASE WHEN {c} NOT BETWEEN 5300000 AND 5800000 THEN 'N_RANGE?' END" for c in ("raw_n", "asg_n", "cap_n"))}], lambda f: f IS NOT NULL))), '|'), ''), 'OK') END"""


def _systems() -> str:
    parts = []
    for i, (epsg, zone, datum, invf) in enumerate(SYSTEMS):
        made = nested("SELECT vsnplotname, longitude, latitude FROM a_gps", forward("longitude", "latitude", str(zone), invf, "q"))
        parts.append(f"SELECT vsnplotname, {i} AS ord, {epsg} AS epsg, {zone} AS zone, '{datum}' AS datum, qe AS e, qn AS n FROM ({made})")
    return "pj AS MATERIALIZED (" + " UNION ALL ".join(parts) + ")"


_PJ = _systems()
_PAIRS = "pr AS (" + " UNION ALL ".join(f"SELECT vsnplotname, {i} AS tag, '{t}' AS name, {e} AS e, {n} AS n FROM a_gps WHERE {e} IS NOT NULL AND {n} IS NOT NULL" for i, (t, e, n) in enumerate(co.PAIRS)) + ")"
_BEST = f"""{_PJ}, {_PAIRS}, er AS (SELECT pr.vsnplotname, tag, name, ord, epsg, sqrt((pj.e - pr.e) * (pj.e - pr.e) + (pj.n - pr.n) * (pj.n - pr.n)) AS err FROM pr JOIN pj USING (vsnplotname)),
best AS (SELECT * FROM er QUALIFY row_number() OVER (PARTITION BY vsnplotname ORDER BY err, tag, ord) = 1)"""
_DEFAULT = f"CASE WHEN CASE WHEN utmzone IN (16, 17) THEN CAST(utmzone AS INTEGER) ELSE {_Z} END = 16 THEN 2956 ELSE 2957 END"
_CLEAN = f"""WITH {_GPS}, {_BOUNDS}, {_BEST},
ch AS (SELECT g.*, {_FLAGS} AS flags, coalesce(best.epsg, {_DEFAULT}) AS epsg, CASE WHEN best.epsg IS NOT NULL THEN 'matched_' || best.name ELSE 'heuristic_lon/utmzone' END AS reason
  FROM a_gps g CROSS JOIN bounds LEFT JOIN best USING (vsnplotname)),
ce AS (SELECT ch.*, pj.e, pj.n, pj.zone, pj.datum, least({", ".join(f"sqrt((pj.e - ch.{e}) * (pj.e - ch.{e}) + (pj.n - ch.{n}) * (pj.n - ch.{n}))" for _, e, n in co.PAIRS)}) AS err,
  ch.latitude IS NOT NULL AND ch.longitude IS NOT NULL AS ok FROM ch JOIN pj ON pj.vsnplotname = ch.vsnplotname AND pj.epsg = ch.epsg),
cl AS (SELECT vsnplotname, CASE WHEN ok THEN latitude END AS "LAT", CASE WHEN ok THEN longitude END AS "LON", CASE WHEN ok THEN 'EPSG:' || epsg END AS "TARGET_EPSG", CASE WHEN ok THEN epsg END AS "TARGET_EPSG_INT",
  CASE WHEN ok THEN zone END AS "TARGET_ZONE", CASE WHEN ok THEN datum END AS "TARGET_DATUM", CASE WHEN ok THEN e END AS "CENTER_E", CASE WHEN ok THEN n END AS "CENTER_N", flags AS "QC_FLAGS",
  CASE WHEN ok THEN err END AS "MIN_LEGACY_ERR_m", CASE WHEN ok THEN CASE WHEN err IS NULL OR reason = 'heuristic_lon/utmzone' THEN 'Low' WHEN err < 3 THEN 'High' WHEN err <= 50 THEN 'Medium' ELSE 'Low' END END AS "CONFIDENCE",
  CASE WHEN ok THEN reason END AS "DECISION_REASON", CASE WHEN ok THEN 'OK' ELSE 'NO_LATLON' END AS "STATUS" FROM ce)"""


def _g(spark, sf_dir):
    return adapters.gps(spark, sf_dir)


_TEXT = "CASE WHEN c_custkey % 13 = 0 THEN 'n/a' WHEN c_custkey % 17 = 0 THEN '' ELSE CAST(c_custkey * 3 AS {t}) || '.25' END"


@query("gps_scan_coerce", f"SELECT c_name AS vsnplotname, TRY_CAST({_TEXT.format(t='VARCHAR')} AS DOUBLE) AS latitude, TRY_CAST('-' || {_TEXT.format(t='VARCHAR')} AS DOUBLE) AS longitude, CAST(NULL AS DOUBLE) AS raw_e, CAST(NULL AS DOUBLE) AS utmzone FROM customer")
def gps_scan_coerce(spark, sf_dir):
    raw = spark.sql(f"SELECT c_name AS vsnplotname, {_TEXT.format(t='STRING')} AS latitude, '-' || {_TEXT.format(t='STRING')} AS longitude FROM {{c}}", c=adapters.table(spark, sf_dir, "customer"))
    return co.coerce(raw).select("vsnplotname", "latitude", "longitude", "raw_e", "utmzone")


@query("gps_auto_bounds", f"WITH {_GPS}, {_BOUNDS} SELECT round(lat_min, 6) AS lat_min, round(lat_max, 6) AS lat_max, round(lon_min, 6) AS lon_min, round(lon_max, 6) AS lon_max, zone FROM bounds")
def gps_auto_bounds(spark, sf_dir):
    return rounded(co.auto_bounds(_g(spark, sf_dir)))


@query("gps_zone_mode", f"WITH {_GPS}, {_BOUNDS} SELECT zone FROM bounds")
def gps_zone_mode(spark, sf_dir):
    return co.auto_bounds(_g(spark, sf_dir)).select("zone")


@query("gps_decimals_ok", f"WITH {_GPS} SELECT vsnplotname, {_DEC.format(x='latitude')} AS lat_ok, {_DEC.format(x='longitude')} AS lon_ok FROM a_gps WHERE latitude IS NOT NULL AND longitude IS NOT NULL")
def gps_decimals_ok(spark, sf_dir):
    g = _g(spark, sf_dir).where("latitude IS NOT NULL AND longitude IS NOT NULL")
    return g.select("vsnplotname", co.decimals_ok(F.col("latitude")).alias("lat_ok"), co.decimals_ok(F.col("longitude")).alias("lon_ok"))


@query("gps_qc_flags", f"WITH {_GPS}, {_BOUNDS} SELECT vsnplotname, {_FLAGS} AS qc_flags FROM a_gps, bounds")
def gps_qc_flags(spark, sf_dir):
    g = _g(spark, sf_dir)
    return g.crossJoin(F.broadcast(co.auto_bounds(g))).select("vsnplotname", co.qc_flags().alias("qc_flags"))  # one row


@query("gps_project_utm", f"WITH {_GPS}, {_PJ} SELECT vsnplotname, epsg, round(e, 3) AS e, round(n, 3) AS n FROM pj")
def gps_project_utm(spark, sf_dir):
    return co.projected(_g(spark, sf_dir)).select("vsnplotname", F.explode("systems").alias("s")).select("vsnplotname", "s.epsg", F.round("s.e", 3).alias("e"), F.round("s.n", 3).alias("n"))


@query("gps_best_crs", f"WITH {_GPS}, {_BEST} SELECT vsnplotname, name, epsg, round(err, 3) AS err FROM best WHERE err IS NOT NULL")
def gps_best_crs(spark, sf_dir):
    tags = F.array(*[F.lit(t) for t, _, _ in co.PAIRS])
    whole = " OR ".join(f"({e} IS NOT NULL AND {n} IS NOT NULL)" for _, e, n in co.PAIRS)
    b = co.best_system(co.projected(_g(spark, sf_dir).where(f"latitude IS NOT NULL AND longitude IS NOT NULL AND ({whole})")))
    return b.select("vsnplotname", F.get(tags, F.col("best.tag")).alias("name"), "best.epsg", F.round("best.err", 3).alias("err"))


@query("gps_default_crs", f"WITH {_GPS} SELECT vsnplotname, {_DEFAULT} AS epsg FROM a_gps WHERE longitude IS NOT NULL")
def gps_default_crs(spark, sf_dir):
    return _g(spark, sf_dir).where("longitude IS NOT NULL").select("vsnplotname", co.default_epsg().alias("epsg"))


@query("gps_legacy_diff", f'{_CLEAN} SELECT vsnplotname, round("MIN_LEGACY_ERR_m", 3) AS err FROM cl')
def gps_legacy_diff(spark, sf_dir):
    return co.clean(_g(spark, sf_dir)).select("vsnplotname", F.round("MIN_LEGACY_ERR_m", 3).alias("err"))


@query("gps_confidence", f'{_CLEAN} SELECT vsnplotname, "CONFIDENCE", "DECISION_REASON" FROM cl')
def gps_confidence(spark, sf_dir):
    return co.clean(_g(spark, sf_dir)).select("vsnplotname", "CONFIDENCE", "DECISION_REASON")


@query("gps_clean", f'{_CLEAN} SELECT * REPLACE (round("LAT", 3) AS "LAT", round("LON", 3) AS "LON", round("CENTER_E", 3) AS "CENTER_E", round("CENTER_N", 3) AS "CENTER_N", round("MIN_LEGACY_ERR_m", 3) AS "MIN_LEGACY_ERR_m") FROM cl')
def gps_clean(spark, sf_dir):
    return rounded(co.clean(_g(spark, sf_dir)), 3)


@query("gps_forced_crs", f'WITH {_GPS}, {_PJ} SELECT vsnplotname, epsg AS "TARGET_EPSG_INT", round(e, 3) AS "CENTER_E", round(n, 3) AS "CENTER_N", \'forced\' AS "DECISION_REASON" FROM pj WHERE epsg = 2957 AND e IS NOT NULL')
def gps_forced_crs(spark, sf_dir):
    return rounded(co.clean(_g(spark, sf_dir), force_epsg=2957).where("STATUS = 'OK'").select("vsnplotname", "TARGET_EPSG_INT", "CENTER_E", "CENTER_N", "DECISION_REASON"), 3)


@query(
    "gps_issues",
    f"""{_CLEAN} SELECT vsnplotname, CASE WHEN "STATUS" = 'NO_LATLON' THEN 'NO_LATLON' ELSE 'LOW_CONF_or_QC' END AS issue,
  CASE WHEN "STATUS" = 'NO_LATLON' THEN 'Missing lat/lon' ELSE 'QC=' || "QC_FLAGS" || '; CONF=' || "CONFIDENCE" || '; reason=' || "DECISION_REASON" || '; min_legacy_err=' || coalesce(printf('%.3f', "MIN_LEGACY_ERR_m"), 'nan') END AS detail
FROM cl WHERE "STATUS" = 'NO_LATLON' OR "CONFIDENCE" = 'Low' OR "QC_FLAGS" <> 'OK'""",
)
def gps_issues(spark, sf_dir):
    return co.issues(co.clean(_g(spark, sf_dir)))


_AT = "printf('%.2f %.2f', \"CENTER_E\" + {x}, \"CENTER_N\" + {y})"
_RING = " || ', ' || ".join(_AT.format(x=f"{x}.0e0", y=f"{y}.0e0") for x, y in ((-10, -10), (10, -10), (10, 10), (-10, 10), (-10, -10)))


@query("gps_squares", f"{_CLEAN} SELECT vsnplotname, \"TARGET_EPSG_INT\" AS epsg, 'POINT (' || {_AT.format(x='0.0e0', y='0.0e0')} || ')' AS centre, 'POLYGON ((' || {_RING} || '))' AS square FROM cl WHERE \"STATUS\" = 'OK'")
def gps_squares(spark, sf_dir):
    return co.square(co.clean(_g(spark, sf_dir)))
