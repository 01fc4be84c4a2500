"""Plot coordinates: quality flags, choice of reference system, projection, confidence.

Input rows: vsnplotname, latitude, longitude (degrees), raw_e/raw_n,
asg_e/asg_n, cap_e/cap_n (legacy eastings and northings), utmzone; doubles or
null.  Missing columns count as null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import SYSTEMS, datum_of_epsg, forward, staged, together, zone_of, zone_of_epsg

NUMBERS = ("latitude", "longitude", "raw_e", "raw_n", "asg_e", "asg_n", "cap_e", "cap_n", "utmzone")
PAIRS = (("RAW", "raw_e", "raw_n"), ("ASSIGNED", "asg_e", "asg_n"), ("CAP", "cap_e", "cap_n"))
PAD, QUANTILES = 0.30, (0.01, 0.99)
LOOSE = (45.0, 55.0, -95.0, -70.0, 17)
E_RANGE, N_RANGE = (200000.0, 800000.0), (5300000.0, 5800000.0)
HALF = 10.0


def coerce(records: DataFrame, required: tuple[str, ...] = ("vsnplotname", "latitude", "longitude")) -> DataFrame:
    """Texts to numbers, unreadable ones and NaN to null; optional columns added as null.  Fails if a required column is missing."""
    missing = set(required) - set(records.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    number = lambda c: F.nanvl(F.col(c).try_cast("double"), F.lit(None).cast("double"))
    return records.select(F.col("vsnplotname").cast("string").alias("vsnplotname"), *[(number(c) if c in records.columns else F.lit(None).cast("double")).alias(c) for c in NUMBERS])


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def auto_bounds(records: DataFrame) -> DataFrame:
    """One row: lat_min, lat_max, lon_min, lon_max (1 % and 99 % quantiles, padded) and zone (most frequent, 17 unless 16)."""
    lat, lon = F.when(finite(F.col("latitude")), F.col("latitude")), F.when(finite(F.col("longitude")), F.col("longitude"))
    zone = F.when(zone_of(lon).between(1, 60), zone_of(lon))
    q = F.array(*[F.lit(p) for p in QUANTILES])
    a = records.agg(F.percentile(lat, q).alias("la"), F.percentile(lon, q).alias("lo"), F.mode(zone, True).alias("z"))
    empty = F.col("la").isNull() | F.col("lo").isNull()
    pick = lambda value, i: F.when(empty, LOOSE[i]).otherwise(value)
    return a.select(
        pick(F.get("la", F.lit(0)) - PAD, 0).alias("lat_min"), pick(F.get("la", F.lit(1)) + PAD, 1).alias("lat_max"),
        pick(F.get("lo", F.lit(0)) - PAD, 2).alias("lon_min"), pick(F.get("lo", F.lit(1)) + PAD, 3).alias("lon_max"),
        F.when(~empty & (F.col("z") == 16), 16).otherwise(17).alias("zone"),
    )


def decimals_ok(x: Column, least: int = 6) -> Column:
    """At least so many decimals once trailing zeros are gone."""
    decimals = F.split_part(F.format_string("%.10f", x), F.lit("."), F.lit(2))
    return F.length(F.regexp_replace(decimals, "0+$", "")) >= least


def qc_flags() -> Column:
    """Sorted flags joined by ``|``, ``OK`` without any; needs the columns of :func:`auto_bounds`."""
    lat, lon, z = F.col("latitude"), F.col("longitude"), F.col("utmzone").cast("int")
    out = lambda c, r: finite(c) & ~c.between(*r)
    flags = [
        F.when(~lat.between(-90.0, 90.0) | ~lon.between(-180.0, 180.0), "RANGE_LL"),
        F.when(~lat.between(F.col("lat_min"), F.col("lat_max")), "LAT_OUT"),
        F.when(~lon.between(F.col("lon_min"), F.col("lon_max")), "LON_OUT"),
        F.when(lon > 0, "LON_SIGN"),
        F.when(~decimals_ok(lat) | ~decimals_ok(lon), "LOW_PREC"),
        F.when(z.isNotNull() & ~z.isin(16, 17), "UTMZONE_VAL?"),
        F.when(z.isNotNull() & (z != zone_of(lon)), F.concat(F.lit("UTMZONE_MISMATCH(theory="), zone_of(lon).cast("string"), F.lit(")"))),
        *[F.when(out(F.col(e), E_RANGE), "E_RANGE?") for _, e, _ in PAIRS],
        *[F.when(out(F.col(n), N_RANGE), "N_RANGE?") for _, _, n in PAIRS],
    ]
    found = F.array_sort(F.array_distinct(F.array_compact(F.array(*flags))))
    return F.when(lat.isNull() | lon.isNull(), "NA_LATLON").when(F.size(found) == 0, "OK").otherwise(F.concat_ws("|", found))


def projected(records: DataFrame) -> DataFrame:
    """Adds array ``systems`` of ``(ord, epsg, e, n)``: the position in each candidate system."""
    kinds = sorted({(zone, invf) for _, zone, _, invf in SYSTEMS})  # some systems share zone and ellipsoid
    df = staged(records, together(*[forward("longitude", "latitude", str(zone), invf, f"_p{i}") for i, (zone, invf) in enumerate(kinds)]))
    found = []
    for i, (epsg, zone, _, invf) in enumerate(SYSTEMS):
        k = kinds.index((zone, invf))
        found.append(F.struct(F.lit(i).alias("ord"), F.lit(epsg).alias("epsg"), F.col(f"_p{k}e").alias("e"), F.col(f"_p{k}n").alias("n")))
    # exploding one array keeps filters on what is made of it from moving below, where they would repeat the series
    return df.select(*records.columns, F.explode(F.array(F.array(*found))).alias("systems"))


def _match(e: str, n: str, tag_ord: int) -> Column:
    """The least error of a legacy pair over the systems as ``(err, tag, ord, epsg)``; null for an incomplete pair."""
    errs = F.transform("systems", lambda s: F.struct(F.hypot(s.e - F.col(e), s.n - F.col(n)).alias("err"), F.lit(tag_ord).alias("tag"), s.ord.alias("ord"), s.epsg.alias("epsg")))
    return F.when(F.col(e).isNotNull() & F.col(n).isNotNull(), F.array_min(errs))


def best_system(records: DataFrame) -> DataFrame:
    """Adds ``best`` ``(err, tag, ord, epsg)`` over the three legacy pairs; the first pair and system win ties; null without a pair."""
    choices = F.array_compact(F.array(*[_match(e, n, i) for i, (_, e, n) in enumerate(PAIRS)]))
    return records.withColumn("best", F.when(F.size(choices) > 0, F.array_min(choices)))


def default_epsg() -> Column:
    """NAD83(CSRS) in the given zone if 16 or 17, else in that of the longitude; 17 for any other."""
    z = F.col("utmzone").cast("int")
    zone = F.when(z.isin(16, 17), z).otherwise(zone_of(F.col("longitude")))
    return F.when(zone == 16, 2956).otherwise(2957)


def confidence(err: Column, has_pair: Column) -> Column:
    return F.when(~has_pair | err.isNull(), "Low").when(err < 3.0, "High").when(err <= 50.0, "Medium").otherwise("Low")


def clean(records: DataFrame, force_epsg: int | None = None) -> DataFrame:
    """The 14-column clean table; rows without latitude or longitude carry name, status and flags only."""
    df = best_system(projected(records.crossJoin(F.broadcast(auto_bounds(records)))))  # one row of bounds
    tags = F.array(*[F.lit(t) for t, _, _ in PAIRS])
    if force_epsg is not None:
        epsg, reason = F.lit(force_epsg), F.lit("forced")
    else:
        epsg = F.coalesce(F.col("best.epsg"), default_epsg())
        reason = F.when(F.col("best").isNotNull(), F.concat(F.lit("matched_"), F.get(tags, F.col("best.tag")))).otherwise("heuristic_lon/utmzone")
    df = df.withColumns({"epsg": epsg, "reason": reason, "flags": qc_flags()})
    df = df.withColumn("at", F.get(F.filter("systems", lambda s: s.epsg == F.col("epsg")), F.lit(0)))
    diff = lambda e, n: F.hypot(F.abs(F.col("at.e") - F.col(e)), F.abs(F.col("at.n") - F.col(n)))
    df = df.withColumn("err", F.least(*[diff(e, n) for _, e, n in PAIRS]))
    here = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    only = lambda c: F.when(here, c)
    return df.select(
        "vsnplotname", only(F.col("latitude")).alias("LAT"), only(F.col("longitude")).alias("LON"),
        only(F.concat(F.lit("EPSG:"), F.col("epsg").cast("string"))).alias("TARGET_EPSG"), only(F.col("epsg")).alias("TARGET_EPSG_INT"),
        only(zone_of_epsg(F.col("epsg"))).alias("TARGET_ZONE"), only(datum_of_epsg(F.col("epsg"))).alias("TARGET_DATUM"),
        only(F.col("at.e")).alias("CENTER_E"), only(F.col("at.n")).alias("CENTER_N"), F.col("flags").alias("QC_FLAGS"),
        only(F.col("err")).alias("MIN_LEGACY_ERR_m"), only(confidence(F.col("err"), F.col("reason") != "heuristic_lon/utmzone")).alias("CONFIDENCE"),
        only(F.col("reason")).alias("DECISION_REASON"), F.when(here, "OK").otherwise("NO_LATLON").alias("STATUS"),
    )


def issues(table: DataFrame) -> DataFrame:
    """``(vsnplotname, issue, detail)`` of a clean table: missing positions, low confidence, flags."""
    lost = F.col("STATUS") == "NO_LATLON"
    err = F.when(F.col("MIN_LEGACY_ERR_m").isNull(), "nan").otherwise(F.format_string("%.3f", F.col("MIN_LEGACY_ERR_m")))
    detail = F.concat(F.lit("QC="), F.col("QC_FLAGS"), F.lit("; CONF="), F.col("CONFIDENCE"), F.lit("; reason="), F.col("DECISION_REASON"), F.lit("; min_legacy_err="), err)
    bad = lost | (F.col("CONFIDENCE") == "Low") | (F.col("QC_FLAGS") != "OK")
    return table.where(bad).select("vsnplotname", F.when(lost, "NO_LATLON").otherwise("LOW_CONF_or_QC").alias("issue"), F.when(lost, "Missing lat/lon").otherwise(detail).alias("detail"))


def square(table: DataFrame, half: float = HALF) -> DataFrame:
    """Centre and square as WKT, with the row's own system."""
    e, n = F.col("CENTER_E"), F.col("CENTER_N")
    at = lambda dx, dy: F.format_string("%.2f %.2f", e + dx, n + dy)
    ring = F.concat_ws(", ", at(-half, -half), at(half, -half), at(half, half), at(-half, half), at(-half, -half))
    return table.where("STATUS = 'OK'").select("vsnplotname", F.col("TARGET_EPSG_INT").alias("epsg"), F.concat(F.lit("POINT ("), at(0.0, 0.0), F.lit(")")).alias("centre"), F.concat(F.lit("POLYGON (("), ring, F.lit("))")).alias("square"))
