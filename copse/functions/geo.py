"""Transverse Mercator projection as plain expressions, and the coordinate reference systems in use.

Forward and inverse are sixth-order series in the third flattening; the text is
valid Spark SQL (and DuckDB SQL), so that the projection stays inside code
generation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Candidate reference systems in order of preference among equals (epsg, zone, datum, inverse flattening).
SYSTEMS = (
    (32616, 16, "WGS84", 298.257223563),
    (32617, 17, "WGS84", 298.257223563),
    (26916, 16, "NAD83", 298.257222101),
    (26917, 17, "NAD83", 298.257222101),
    (2956, 16, "NAD83(CSRS)", 298.257222101),
    (2957, 17, "NAD83(CSRS)", 298.257222101),
)
RADIUS, SCALE, EASTING = 6378137.0, 0.9996, 500000.0

# Series coefficients by power of n, from n^j on, for j = 1..6.
ALPHA = (
    (1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800),
    (13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360),
    (61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440),
    (49561 / 161280, -179 / 168, 6601661 / 7257600),
    (34729 / 80640, -3418889 / 1995840),
    (212378941 / 319334400,),
)
BETA = (
    (1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800),
    (1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720),
    (17 / 480, -37 / 840, -209 / 4480, 5569 / 90720),
    (4397 / 161280, -11 / 504, -830251 / 7257600),
    (4583 / 161280, -108847 / 3991680),
    (20648693 / 638668800,),
)
DELTA = (
    (2, -2 / 3, -2, 116 / 45, 26 / 45, -2854 / 675),
    (7 / 3, -8 / 5, -227 / 45, 2704 / 315, 2323 / 945),
    (56 / 15, -136 / 35, -1262 / 105, 73814 / 2835),
    (4279 / 630, -332 / 35, -399572 / 14175),
    (4174 / 315, -144838 / 6237),
    (601676 / 22275,),
)


def _series(table: tuple, n: float) -> list[float]:
    return [sum(c * n ** (j + i) for i, c in enumerate(row)) for j, row in enumerate(table, 1)]


def _constants(inverse_flattening: float) -> tuple[float, float, float]:
    """Third flattening, rectifying radius times scale, and 2 sqrt(n) / (1 + n)."""
    f = 1 / inverse_flattening
    n = f / (2 - f)
    return n, SCALE * RADIUS / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256), 2 * n**0.5 / (1 + n)


def _d(x: float) -> str:
    return f"({x!r}e0)" if "e" not in repr(x) else f"({x!r})"


Stages = list[dict[str, str]]


def forward(lon: str, lat: str, zone: str, inverse_flattening: float, p: str) -> Stages:
    """Steps from degrees to easting ``{p}e`` and northing ``{p}n`` in a zone.

    Each step names its results, which the next one uses more than once; one
    nested expression would grow beyond what code generation compiles.
    """
    n, a, k = _constants(inverse_flattening)
    x, y, al = f"{p}x", f"{p}y", _series(ALPHA, n)
    e = " + ".join([y, *[f"{_d(c)} * cos({2 * j}.0e0 * {x}) * sinh({2 * j}.0e0 * {y})" for j, c in enumerate(al, 1)]])
    no = " + ".join([x, *[f"{_d(c)} * sin({2 * j}.0e0 * {x}) * cosh({2 * j}.0e0 * {y})" for j, c in enumerate(al, 1)]])
    return [
        {f"{p}s": f"sin(radians({lat}))", f"{p}l": f"radians({lon} - (6.0e0 * ({zone}) - 183.0e0))"},
        {f"{p}t": f"sinh(atanh({p}s) - {_d(k)} * atanh({_d(k)} * {p}s))"},
        {x: f"atan2({p}t, cos({p}l))", y: f"atanh(sin({p}l) / sqrt(1.0e0 + {p}t * {p}t))"},
        {f"{p}e": f"{_d(EASTING)} + {_d(a)} * ({e})", f"{p}n": f"{_d(a)} * ({no})"},
    ]


def inverse(e: str, n_: str, zone: str, inverse_flattening: float, p: str) -> Stages:
    """Steps from easting and northing in a northern zone to degrees ``{p}lon`` and ``{p}lat``."""
    n, a, _ = _constants(inverse_flattening)
    x, y, be, de = f"{p}u", f"{p}v", _series(BETA, n), _series(DELTA, n)
    return [
        {x: f"({n_}) / {_d(a)}", y: f"(({e}) - {_d(EASTING)}) / {_d(a)}"},
        {
            f"{p}u1": f"{x} - (" + " + ".join(f"{_d(c)} * sin({2 * j}.0e0 * {x}) * cosh({2 * j}.0e0 * {y})" for j, c in enumerate(be, 1)) + ")",
            f"{p}v1": f"{y} - (" + " + ".join(f"{_d(c)} * cos({2 * j}.0e0 * {x}) * sinh({2 * j}.0e0 * {y})" for j, c in enumerate(be, 1)) + ")",
        },
        {f"{p}c": f"asin(sin({p}u1) / cosh({p}v1))"},
        {f"{p}lon": f"(6.0e0 * ({zone}) - 183.0e0) + degrees(atan2(sinh({p}v1), cos({p}u1)))", f"{p}lat": f"degrees({p}c + " + " + ".join(f"{_d(c)} * sin({2 * j}.0e0 * {p}c)" for j, c in enumerate(de, 1)) + ")"},
    ]


def staged(df: DataFrame, stages: Stages) -> DataFrame:
    """``df`` with the results of all steps as columns."""
    for step in stages:
        df = df.withColumns({k: F.expr(v) for k, v in step.items()})
    return df


def placed(df: DataFrame, stages: Stages, *results: str) -> DataFrame:
    """``df`` with these results of the last step alone; filters on them stay above the steps, where they do not repeat them."""
    made = staged(df, stages).select(*df.columns, F.explode(F.array(F.struct(*results))).alias("_at"))
    return made.select(*df.columns, *[f"_at.{r}" for r in results])


def together(*stages: Stages) -> Stages:
    """Steps of independent computations, side by side."""
    return [{k: v for s in step for k, v in s.items()} for step in zip(*stages, strict=True)]


def nested(sql: str, stages: Stages) -> str:
    """The same as text: a select for each step around ``sql``."""
    for step in stages:
        sql = f"SELECT *, {', '.join(f'{v} AS {k}' for k, v in step.items())} FROM ({sql})"
    return sql


def zone_sql(epsg: str) -> str:
    """Zone of a UTM system: WGS84 north and south, NAD83, NAD83(CSRS); null for any other."""
    return f"CASE WHEN {epsg} BETWEEN 32601 AND 32660 THEN {epsg} - 32600 WHEN {epsg} BETWEEN 32701 AND 32760 THEN {epsg} - 32700 WHEN {epsg} BETWEEN 26901 AND 26923 THEN {epsg} - 26900 WHEN {epsg} IN (2956, 2957) THEN {epsg} - 2940 END"


def reprojection(e: str, n: str, source: str, target: str, p: str) -> Stages:
    """Steps from the system ``source`` to ``target`` (columns of EPSG codes) over degrees, to ``{p}e`` and ``{p}n``.

    Datums count as equal on the globe, and both ways go over GRS80, which differs from WGS84 by a tenth of a millimetre.
    Equal codes leave a position as it is; an unknown system gives null.
    """
    south = lambda code: f"CASE WHEN {code} BETWEEN 32701 AND 32760 THEN 1.0e7 ELSE 0.0e0 END"
    invf = min(s[3] for s in SYSTEMS)
    return [
        {f"{p}zs": zone_sql(source), f"{p}zt": zone_sql(target), f"{p}f": f"{n} - {south(source)}"},
        *inverse(e, f"{p}f", f"{p}zs", invf, f"{p}i"),
        *forward(f"{p}ilon", f"{p}ilat", f"{p}zt", invf, f"{p}o"),
        {f"{p}e": f"CASE WHEN {source} = {target} THEN {e} ELSE {p}oe END", f"{p}n": f"CASE WHEN {source} = {target} THEN {n} ELSE {p}on + {south(target)} END"},
    ]


def zone_of(lon: Column) -> Column:
    return (F.floor((lon + 180.0) / 6.0) + 1).cast("int")


def zone_of_epsg(epsg: Column) -> Column:
    out = F.when(epsg == SYSTEMS[0][0], SYSTEMS[0][1])
    for code, zone, _, _ in SYSTEMS[1:]:
        out = out.when(epsg == code, zone)
    return out


def datum_of_epsg(epsg: Column) -> Column:
    out = F.when(epsg == SYSTEMS[0][0], SYSTEMS[0][2])
    for code, _, datum, _ in SYSTEMS[1:]:
        out = out.when(epsg == code, datum)
    return out.otherwise("UNKNOWN")
