"""Geometry and geodesy as columns.

Points are two double columns, lines arrays of (x, y), polygons arrays of parts, each an array of rings, each an array of
(x, y). Coordinate systems are EPSG numbers: 4326 (degrees), 3857 (spherical Mercator), 32632 (UTM zone 32 north).
"""

from __future__ import annotations

import math

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

VERTEX = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
LINE = T.ArrayType(VERTEX)
POLYGON = T.ArrayType(T.ArrayType(T.ArrayType(VERTEX)))
# Nested values go through Arrow lists: pandas' conversion of nested nulls is not to be relied on.
ARROW_POLYGON = pa.list_(pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))

# WGS84 and the UTM grid.
A, FLATTENING, SCALE, FALSE_EASTING, MERIDIAN = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 9.0
MEAN_RADIUS = 6371008.8
_N = FLATTENING / (2 - FLATTENING)
_RECTIFYING = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
# Krüger's series to the fourth power of n.
_ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
_BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)
_DELTA = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
    7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
    56 * _N**3 / 15 - 136 * _N**4 / 35,
    4279 * _N**4 / 630,
)


def finite(v: Column) -> Column:
    """The number, or null for NaN and the infinities: how tables that come from elsewhere hold what is missing.

    ``v`` may be a long formula (a projection), so it is worked out once: what a finite number leaves over, divided by infinity, is itself, and of the
    others it is NaN.
    """
    return F.nanvl(v % F.lit(float("inf")), F.lit(None).cast("double"))


def _to_utm(lon: Column, lat: Column) -> tuple[Column, Column]:
    s = 2 * math.sqrt(_N) / (1 + _N)
    phi, lam = F.radians(lat), F.radians(lon - MERIDIAN)
    t = F.sinh(F.atanh(F.sin(phi)) - s * F.atanh(s * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return FALSE_EASTING + SCALE * _RECTIFYING * east, SCALE * _RECTIFYING * north


def _from_utm(x: Column, y: Column) -> tuple[Column, Column]:
    xi0, eta0 = y / (SCALE * _RECTIFYING), (x - FALSE_EASTING) / (SCALE * _RECTIFYING)
    xi, eta = xi0, eta0
    for j, b in enumerate(_BETA, 1):
        xi = xi - b * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0)
        eta = eta - b * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0)
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    phi = chi
    for j, d in enumerate(_DELTA, 1):
        phi = phi + d * F.sin(2 * j * chi)
    return MERIDIAN + F.degrees(F.atan2(F.sinh(eta), F.cos(xi))), F.degrees(phi)


def _to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.radians(lon) * A, F.log(F.tan(math.pi / 4 + F.radians(lat) / 2)) * A


def _from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / A), F.degrees(2 * F.atan(F.exp(y / A)) - math.pi / 2)


_TO = {4326: lambda x, y: (x, y), 3857: _to_mercator, 32632: _to_utm}
_FROM = {4326: lambda x, y: (x, y), 3857: _from_mercator, 32632: _from_utm}


def transform_crs(x: Column, y: Column, source: int, target: int) -> tuple[Column, Column]:
    """(x, y) of one system in another; x is east or longitude. An unknown system raises."""
    if source not in _FROM or target not in _TO:
        raise ValueError(f"systems are {sorted(_TO)}")
    return (x, y) if source == target else _TO[target](*_FROM[source](x, y))


def transform_polygon(polygon: Column, source: int, target: int) -> Column:
    """A polygon's vertices in another system."""

    def vertex(v: Column) -> Column:
        x, y = transform_crs(v["x"], v["y"], source, target)
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(polygon, lambda part: F.transform(part, lambda ring: F.transform(ring, vertex)))


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres between two points on a sphere of the Earth's mean radius; null where a coordinate is."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    # least() would take 1 for null.
    return 2 * MEAN_RADIUS * F.asin(F.when(h > 1, 1.0).otherwise(F.sqrt(h)))


def inverse_geodesic(lon1: float, lat1: float, lon2: float, lat2: float) -> float:
    """Metres between two points on the WGS84 ellipsoid, by Vincenty's iteration; nearly antipodal points give nan."""
    if (lon1, lat1) == (lon2, lat2):
        return 0.0
    b = A * (1 - FLATTENING)
    u1, u2 = (math.atan((1 - FLATTENING) * math.tan(math.radians(v))) for v in (lat1, lat2))
    gap = lam = math.radians(lon2 - lon1)
    for _ in range(200):
        sin_s = math.hypot(math.cos(u2) * math.sin(lam), math.cos(u1) * math.sin(u2) - math.sin(u1) * math.cos(u2) * math.cos(lam))
        if sin_s == 0:
            return 0.0
        cos_s = math.sin(u1) * math.sin(u2) + math.cos(u1) * math.cos(u2) * math.cos(lam)
        sigma = math.atan2(sin_s, cos_s)
        sin_a = math.cos(u1) * math.cos(u2) * math.sin(lam) / sin_s
        cos2_a = 1 - sin_a**2
        mid = cos_s - 2 * math.sin(u1) * math.sin(u2) / cos2_a if cos2_a else 0.0
        c = FLATTENING / 16 * cos2_a * (4 + FLATTENING * (4 - 3 * cos2_a))
        before, lam = lam, gap + (1 - c) * FLATTENING * sin_a * (sigma + c * sin_s * (mid + c * cos_s * (2 * mid**2 - 1)))
        if abs(lam - before) < 1e-12:
            u = cos2_a * (A**2 - b**2) / b**2
            big = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
            small = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
            turn = small * sin_s * (mid + small / 4 * (cos_s * (2 * mid**2 - 1) - small / 6 * mid * (4 * sin_s**2 - 3) * (4 * mid**2 - 3)))
            return b * big * (sigma - turn)
    return math.nan


@F.pandas_udf(T.DoubleType())
def geodesic_distance_m(lon1: pd.Series, lat1: pd.Series, lon2: pd.Series, lat2: pd.Series) -> pd.Series:
    """Ellipsoidal metres; null where a coordinate is."""
    rows = zip(lon1, lat1, lon2, lat2, strict=True)
    return pd.Series([None if any(pd.isna(v) for v in r) else inverse_geodesic(*r) for r in rows], dtype="f8")


def metres_to_degrees(metres: float, lat: float = 14.0, lon: float = 6.0) -> tuple[float, float]:
    """Degrees along latitude and along longitude that span ``metres`` at a point, to 7 decimals, 1 degree at most.

    Once a call, on the driver.
    """

    def span(length) -> float:
        low, high = 0.0, 1.0
        if length(high) <= metres:
            return high
        while high - low > 1e-8:
            mid = (low + high) / 2
            low, high = (mid, high) if length(mid) < metres else (low, mid)
        return round((low + high) / 2, 7)

    return span(lambda d: inverse_geodesic(lon, lat, lon, lat + d)), span(lambda d: inverse_geodesic(lon, lat, lon + d, lat))


def radius_in_degrees(metres: float) -> float:
    """The mean of the two spans: the radius of discs in degrees."""
    return sum(metres_to_degrees(metres)) / 2


def ring_edges(ring: Column) -> Column:
    """(x1, y1, x2, y2) of a ring's sides; a ring need not repeat its first vertex."""
    turned = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return F.zip_with(ring, turned, lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))


def polygon_edges(polygon: Column) -> Column:
    """The sides of all rings of all parts."""
    return F.flatten(F.transform(polygon, lambda part: F.flatten(F.transform(part, ring_edges))))


def polygon_vertices(polygon: Column) -> Column:
    return F.flatten(F.flatten(polygon))


def polygon_bounds(polygon: Column) -> dict[str, Column]:
    """min_x, min_y, max_x, max_y."""
    v = polygon_vertices(polygon)
    xs, ys = F.transform(v, lambda p: p["x"]), F.transform(v, lambda p: p["y"])
    return {"min_x": F.array_min(xs), "min_y": F.array_min(ys), "max_x": F.array_max(xs), "max_y": F.array_max(ys)}


def polygon_area_centroid(polygon: Column) -> tuple[Column, Column, Column]:
    """(area, x, y) by the shoelace formula. Holes, wherever they turn, count against their part."""
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def ring_sums(ring: Column) -> Column:
        # Taken from the first vertex, so that large coordinates lose no digits.
        ox, oy = ring[0]["x"], ring[0]["y"]

        def add(acc: Column, e: Column) -> Column:
            x1, y1, x2, y2 = e["x1"] - ox, e["y1"] - oy, e["x2"] - ox, e["y2"] - oy
            c = x1 * y2 - x2 * y1
            return F.struct((acc["a"] + c / 2).alias("a"), (acc["x"] + (x1 + x2) * c / 6).alias("x"), (acc["y"] + (y1 + y2) * c / 6).alias("y"))

        s = F.aggregate(ring_edges(ring), zero, add)
        return F.struct(F.abs(s["a"]).alias("a"), (F.signum(s["a"]) * s["x"] + F.abs(s["a"]) * ox).alias("x"), (F.signum(s["a"]) * s["y"] + F.abs(s["a"]) * oy).alias("y"))

    def part_sums(part: Column) -> Column:
        signed = F.transform(part, lambda ring, i: F.struct(ring_sums(ring).alias("s"), F.when(i == 0, 1.0).otherwise(-1.0).alias("f")))
        return F.aggregate(signed, zero, lambda acc, r: F.struct(*((acc[k] + r["f"] * r["s"][k]).alias(k) for k in ("a", "x", "y"))))

    total = F.aggregate(F.transform(polygon, part_sums), zero, lambda acc, p: F.struct(*((acc[k] + p[k]).alias(k) for k in ("a", "x", "y"))))
    return total["a"], total["x"] / F.when(total["a"] != 0, total["a"]), total["y"] / F.when(total["a"] != 0, total["a"])


def inside_edges(x: Column, y: Column, edges: Column) -> Column:
    """Strictly within the rings that ``edges`` are the sides of: an odd number of crossings, and on none."""
    crosses = lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"])
    on = lambda e: (
        ((e["x2"] - e["x1"]) * (y - e["y1"]) == (e["y2"] - e["y1"]) * (x - e["x1"]))
        & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
        & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))
    )
    return (F.size(F.filter(edges, crosses)) % 2 == 1) & ~F.exists(edges, on)


def segment_distance2(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Squared distance of a point from a segment."""
    dx, dy = x2 - x1, y2 - y1
    length2 = dx * dx + dy * dy
    t = F.when(length2 > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((x - x1) * dx + (y - y1) * dy) / length2))).otherwise(F.lit(0.0))
    ex, ey = x - (x1 + t * dx), y - (y1 + t * dy)
    return ex * ex + ey * ey


def _simplify_ring(ring: list, tolerance: float) -> list:
    """Douglas-Peucker with a stack; ends stay."""
    n = len(ring)
    if n < 3:
        return ring
    keep, stack = [True] + [False] * (n - 2) + [True], [(0, n - 1)]
    while stack:
        a, b = stack.pop()
        (ax, ay), (bx, by) = ring[a], ring[b]
        far, at = tolerance**2, None
        for i in range(a + 1, b):
            px, py = ring[i]
            dx, dy = bx - ax, by - ay
            length2 = dx * dx + dy * dy
            t = max(0.0, min(1.0, ((px - ax) * dx + (py - ay) * dy) / length2)) if length2 else 0.0
            d = (px - ax - t * dx) ** 2 + (py - ay - t * dy) ** 2
            if d > far:
                far, at = d, i
        if at is not None:
            keep[at] = True
            stack += [(a, at), (at, b)]
    return [v for v, stays in zip(ring, keep, strict=True) if stays]


def simplify_polygon(tolerance: float):
    """Arrow UDF: polygon -> polygon with no vertex farther than ``tolerance`` from the drawn line. Rings keep four vertices at least, or stay."""

    @F.arrow_udf(POLYGON)
    def run(polygons: pa.Array) -> pa.Array:
        def ring(r):
            pts = [(v["x"], v["y"]) for v in r]
            out = _simplify_ring(pts, tolerance)
            return [{"x": x, "y": y} for x, y in (out if len(out) >= 4 else pts)]

        return pa.array([None if p is None else [[ring(r) for r in part] for part in p] for p in polygons.to_pylist()], ARROW_POLYGON)

    return run


#: Metres of tolerance by level.
SIMPLIFY_TOLERANCE = {"regione": 500, "provincia": 500, "comune": 250}


def box_polygon(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A polygon of one part and one ring: a box."""
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(F.array(F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1), corner(x0, y0))))
