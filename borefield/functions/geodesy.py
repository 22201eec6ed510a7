"""Coordinates on one grid: GDA2020 / MGA zone 53 (EPSG 7853)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRID_SRID = 7853
# The grid's envelope in metres, and the EPSG codes whose datum is known, as (code, family, kind, zone).
ENVELOPE = {"min_x": 60_000.0, "max_x": 940_000.0, "min_y": 7_100_000.0, "max_y": 8_900_000.0}
CODES = [(7844, "GDA2020", "geographic", None), (7843, "GDA2020", "geographic", None), (4283, "GDA94", "geographic", None), (4939, "GDA94", "geographic", None)]
CODES += [(7800 + z, "GDA2020", "projected", z) for z in range(46, 60)] + [(28300 + z, "GDA94", "projected", z) for z in range(46, 60)]
_A, _F, _K0, _FE, _FN = 6_378_137.0, 1 / 298.257222101, 0.9996, 500_000.0, 10_000_000.0  # GRS80 and the zone's constants


class CrsError(ValueError):
    """Coordinates can't be put on the grid, or aren't on it."""


def crs_table(spark: SparkSession) -> DataFrame:
    """(epsg, datum_family, kind, zone): a fixed table of some thirty rows."""
    return spark.createDataFrame(CODES, "epsg int, datum_family string, kind string, zone int")


def datum_family(epsg: Column) -> Column:
    """GDA2020, GDA94 or other; null for no code."""
    of = lambda family: epsg.isin([c for c, f, _, _ in CODES if f == family])
    return F.when(epsg.isNull(), None).when(of("GDA2020"), "GDA2020").when(of("GDA94"), "GDA94").otherwise("other")


def resolve_source_crs(file_epsg: Column, declared_epsg: Column) -> Column:
    """struct(status, epsg): ok with the code that exists, none_declared, or conflict where two differ. Nothing is guessed."""
    status = (
        F.when(file_epsg.isNull() & declared_epsg.isNull(), "none_declared")
        .when(file_epsg.isNotNull() & declared_epsg.isNotNull() & (file_epsg != declared_epsg), "conflict")
        .otherwise("ok")
    )
    return F.struct(status.alias("status"), F.when(status == "ok", F.coalesce(file_epsg, declared_epsg)).alias("epsg"))


def _series() -> tuple[float, list[float], list[float]]:
    """Rectifying radius and the forward and inverse coefficients of the transverse Mercator series, to third order."""
    n = _F / (2 - _F)
    radius = _A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    forward = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    inverse = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480]
    return radius, forward, inverse


def project(lon: Column, lat: Column, zone: int = 53) -> tuple[Column, Column]:
    """Easting and northing of geographic degrees on the zone; plain column arithmetic."""
    radius, forward, _ = _series()
    e = math.sqrt(_F * (2 - _F))
    phi, lam = F.radians(lat), F.radians(lon - F.lit(6.0 * zone - 183.0))
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - F.lit(e) * F.atanh(F.lit(e) * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(F.lit(1.0) + t * t))
    x, y = eta, xi
    for i, a in enumerate(forward, 1):
        x = x + F.lit(a) * F.cos(xi * (2 * i)) * F.sinh(eta * (2 * i))
        y = y + F.lit(a) * F.sin(xi * (2 * i)) * F.cosh(eta * (2 * i))
    return F.lit(_FE) + F.lit(_K0 * radius) * x, F.lit(_FN) + F.lit(_K0 * radius) * y


def unproject(x: Column, y: Column, zone: Column) -> tuple[Column, Column]:
    """Geographic degrees of a zone's easting and northing; the zone is a column."""
    radius, _, inverse = _series()
    xi0, eta0 = (y - _FN) / (_K0 * radius), (x - _FE) / (_K0 * radius)
    xi, eta = xi0, eta0
    for i, b in enumerate(inverse, 1):
        xi = xi - F.lit(b) * F.sin(xi0 * (2 * i)) * F.cosh(eta0 * (2 * i))
        eta = eta - F.lit(b) * F.cos(xi0 * (2 * i)) * F.sinh(eta0 * (2 * i))
    chi, n = F.asin(F.sin(xi) / F.cosh(eta)), _F / (2 - _F)
    phi = chi
    for i, d in enumerate((2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15), 1):
        phi = phi + F.lit(d) * F.sin(chi * (2 * i))
    lam = F.atan2(F.sinh(eta), F.cos(xi))
    return F.degrees(lam) + (zone * 6.0 - 183.0), F.degrees(phi)


def shift_cells(nodes: DataFrame) -> DataFrame:
    """(_i, _j, _a, _b, _c, _d): each cell whose four corners are in the node table, with their shifts; nodes are folded once."""
    corners = {"_a": (0, 0), "_b": (1, 0), "_c": (0, 1), "_d": (1, 1)}
    each = [F.struct(F.lit(name).alias("corner"), (F.col("i") - di).alias("_i"), (F.col("j") - dj).alias("_j")) for name, (di, dj) in corners.items()]
    spread = nodes.select(F.struct("dlon", "dlat").alias("s"), F.explode(F.array(*each)).alias("e"))
    folded = spread.groupBy("e._i", "e._j").agg(*(F.max(F.when(F.col("e.corner") == name, F.col("s"))).alias(name) for name in corners))
    return folded.where(" AND ".join(f"{name} IS NOT NULL" for name in corners))


def shift_by_grid(points: DataFrame, nodes: DataFrame, step: float, where: Column | None = None) -> DataFrame:
    """Add the bilinear shift of a node table (i, j, dlon, dlat), node (i, j) at (i step, j step) degrees, to lon and lat.

    Points whose four nodes aren't all there get null coordinates: never a rougher shift. One join by cell, so neither side need
    fit anywhere. Points that `where` isn't true for stay as they are: each has a cell of its own that no table has, so they
    are spread over all tasks and meet nothing.
    """
    moves = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    none = -(F.lit(1 << 40) + F.pmod(F.xxhash64("lon", "lat"), F.lit(1 << 30)))
    cell = points.withColumns({"_moves": moves, "_i": F.when(moves, F.floor(F.col("lon") / step)).otherwise(none), "_j": F.floor(F.col("lat") / step)})
    met = cell.join(shift_cells(nodes), ["_i", "_j"], "left")
    u, v = F.col("lon") / step - F.col("_i"), F.col("lat") / step - F.col("_j")

    def at(part: str) -> Column:
        a, b, c, d = (F.col(f"{n}.{part}") for n in ("_a", "_b", "_c", "_d"))
        return a * (1 - u) * (1 - v) + b * u * (1 - v) + c * (1 - u) * v + d * u * v

    moved = {c: F.when(F.col("_moves"), F.col(c) + at(f"d{c}")).otherwise(F.col(c)) for c in ("lon", "lat")}
    return met.withColumns(moved).drop("_moves", "_i", "_j", "_a", "_b", "_c", "_d")


def require_known_crs(points: DataFrame, nodes: DataFrame | None) -> None:
    """Raise for codes without an approved way to the grid, or that need a shift table when none is given."""
    found = points.groupBy("epsg").agg(F.count("*").alias("n")).select("epsg", datum_family(F.col("epsg")).alias("family")).collect()  # one row a code
    for epsg, family in found:
        if family not in ("GDA94", "GDA2020"):
            raise CrsError(f"EPSG {epsg} is neither GDA94 nor GDA2020; no approved way to EPSG {GRID_SRID}")
        if family == "GDA94" and nodes is None:
            raise CrsError(f"EPSG {epsg} is GDA94 and needs a shift table; the seven-parameter way isn't used")


def to_grid_xy(points: DataFrame, nodes: DataFrame | None = None, step: float = 1.0) -> DataFrame:
    """`points` (x, y, epsg, ...) with x, y on the grid and srid set.

    Points on the grid stay as they are; other zones go back to degrees; GDA94 degrees are shifted by the node table. A point that no
    shift covers has neither coordinates nor srid, and no guard lets it pass.
    """
    require_known_crs(points, nodes)
    zone = F.coalesce(*(F.when(F.col("epsg") == c, z) for c, _, _, z in CODES if z))
    lon, lat = unproject(F.col("x"), F.col("y"), zone)
    moved = points.withColumns({"lon": F.when(zone.isNull(), F.col("x")).otherwise(lon), "lat": F.when(zone.isNull(), F.col("y")).otherwise(lat)})
    if nodes is not None:
        moved = shift_by_grid(moved, nodes, step, datum_family(F.col("epsg")) == "GDA94")
    east, north = project(F.col("lon"), F.col("lat"))
    same = F.col("epsg") == GRID_SRID
    return moved.withColumns({"x": F.when(same, F.col("x")).otherwise(east), "y": F.when(same, F.col("y")).otherwise(north)}).withColumn("srid", F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), F.lit(GRID_SRID))).drop("lon", "lat")


def within_zone(x: Column, y: Column) -> Column:
    return x.between(ENVELOPE["min_x"], ENVELOPE["max_x"]) & y.between(ENVELOPE["min_y"], ENVELOPE["max_y"])


def total_bounds(df: DataFrame, x: str = "x", y: str = "y", by: tuple[str, ...] = ()) -> DataFrame:
    """Least and greatest coordinates, of the whole table or of each group."""
    return df.groupBy(*by).agg(F.min(x).alias("min_x"), F.min(y).alias("min_y"), F.max(x).alias("max_x"), F.max(y).alias("max_y"))


def require_within_zone(df: DataFrame, what: str = "layer") -> None:
    """Raise where a point lies outside the zone or has no coordinates; an empty table passes."""
    b, lost = total_bounds(df).first(), df.where("x IS NULL OR y IS NULL").count()
    if lost:
        raise CrsError(f"{what}: {lost} points without coordinates, such as no shift covers")
    if b.min_x is not None and (b.min_x < ENVELOPE["min_x"] or b.max_x > ENVELOPE["max_x"] or b.min_y < ENVELOPE["min_y"] or b.max_y > ENVELOPE["max_y"]):
        raise CrsError(f"{what} lands outside the zone: x {b.min_x}..{b.max_x}, y {b.min_y}..{b.max_y}; the declared code is likely wrong")


def require_grid_srid(df: DataFrame, what: str = "table", srid: str = "srid") -> None:
    wrong = df.agg(F.count(F.when(F.coalesce(F.col(srid) != GRID_SRID, F.lit(True)), 1))).first()[0]
    if wrong:
        raise CrsError(f"{what}: {wrong} rows without EPSG {GRID_SRID}")


def coords_verdict(min_x: Column, min_y: Column, max_x: Column) -> Column:
    """What bounds look like: lonlat, mga_metres or neither."""
    return (
        F.when(min_x.between(-180, 180) & min_y.between(-90, 90) & (F.abs(max_x) <= 180), "lonlat")
        .when(min_x.between(100_000, 900_000) & min_y.between(6_000_000, 8_000_000), "mga_metres")
        .otherwise("neither")
    )


def epsg_code(declared: Column) -> Column:
    """The code in a declaration such as EPSG:7844 or 7844; null where there is none to be read."""
    return F.regexp_extract(F.trim(declared.cast("string")), r"^(?i:epsg:{1,2})?(\d{4,5})$", 1).try_cast("int")


def crs_verdict(epsg: Column, declared: Column | None = None) -> Column:
    """Notes on a code: none_declared; on_grid; geographic_needs_projecting; gda94_needs_shift_table.

    With the text that was declared: unparseable where it holds no code.
    """
    if declared is not None:
        return F.when(declared.isNotNull() & epsg_code(declared).isNull(), F.array(F.lit("unparseable"))).otherwise(crs_verdict(epsg_code(declared)))
    geographic = epsg.isin([c for c, _, kind, _ in CODES if kind == "geographic"])
    return F.when(epsg.isNull(), F.array(F.lit("none_declared"))).otherwise(
        F.array_compact(
            F.array(
                F.when(epsg == GRID_SRID, "on_grid"),
                F.when(geographic, "geographic_needs_projecting"),
                F.when(datum_family(epsg) == "GDA94", "gda94_needs_shift_table"),
            )
        )
    )
