"""Geospatial and numeric scalars as Column expressions; all of them stay in the JVM."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import EARTH_RADIUS_M, METRES_PER_DEGREE, Box


def let(value: Column, body) -> Column:
    """body of a value that is computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def point(lat, lon) -> Column:
    return F.struct(lat.cast("double").alias("lat"), lon.cast("double").alias("lon"))


def _chord(lat1, lon1, lat2, lon2) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.least(F.greatest(a, F.lit(0.0)), F.lit(1.0))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres, arcsine form; the argument is clamped, so rounding gives no NaN."""
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(_chord(lat1, lon1, lat2, lon2)))


def haversine_atan2(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """The same distance, arctangent form."""
    return let(_chord(lat1, lon1, lat2, lon2), lambda a: 2 * EARTH_RADIUS_M * F.atan2(F.sqrt(a), F.sqrt(1 - a)))


def polyline_length(geometry: Column) -> Column:
    """Metres along an array of points; 0 below two points, null if the array is."""

    def fold(g: Column) -> Column:
        start = F.struct(F.get(g, F.lit(0)).alias("p"), F.lit(0.0).alias("m"))
        step = lambda acc, p: F.struct(p.alias("p"), (acc["m"] + haversine(acc["p"]["lat"], acc["p"]["lon"], p["lat"], p["lon"])).alias("m"))
        return F.when(F.size(g) < 2, F.lit(0.0)).otherwise(F.aggregate(F.slice(g, 2, F.greatest(F.size(g) - 1, F.lit(1))), start, step, lambda acc: acc["m"]))

    return F.when(geometry.isNotNull(), let(geometry, fold))


def pixel_to_latlon(row: Column, col: Column, box: Box, height: int, width: int) -> Column:
    """The place of a pixel's corner; rows grow southward."""
    return point(box.max_lat - row * ((box.max_lat - box.min_lat) / height), box.min_lon + col * ((box.max_lon - box.min_lon) / width))


def latlon_to_pixel(lat: Column, lon: Column, box: Box, height: int, width: int) -> Column:
    """X04 backwards: fractional (row, col)."""
    return F.struct(((box.max_lat - lat) / ((box.max_lat - box.min_lat) / height)).alias("row"), ((lon - box.min_lon) / ((box.max_lon - box.min_lon) / width)).alias("col"))


def burn_pixel(lat: Column, lon: Column, box: Box, height: int, width: int, truncate: bool = False) -> Column:
    """The pixel that a point burns into: spans of size - 1, rounded half to even (or truncated), clamped."""
    whole = (lambda x: x.cast("int")) if truncate else (lambda x: F.rint(x).cast("int"))
    inside = lambda x, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), whole(x)))
    row = (box.max_lat - lat) / (box.max_lat - box.min_lat) * (height - 1)
    col = (lon - box.min_lon) / (box.max_lon - box.min_lon) * (width - 1)
    return F.struct(inside(row, height).alias("row"), inside(col, width).alias("col"))


def resolution(box: Box, height: int, width: int, declared: float) -> float:
    """Metres a pixel by the box; fails unless it is between half and twice the declared value."""
    middle = math.radians((box.min_lat + box.max_lat) / 2)
    mean = ((box.max_lat - box.min_lat) * METRES_PER_DEGREE / height + (box.max_lon - box.min_lon) * METRES_PER_DEGREE * math.cos(middle) / width) / 2
    if not 0.5 <= mean / declared <= 2.0:
        raise ValueError(f"the box gives {mean:.2f} m a pixel, {declared} m are declared")
    return mean


def local_metres(lat: Column, lon: Column, centre_lat: Column) -> Column:
    """Equirectangular metres around a latitude."""
    return F.struct((lon * METRES_PER_DEGREE * F.cos(F.radians(centre_lat))).alias("x"), (lat * METRES_PER_DEGREE).alias("y"))


def inward_bearing(lat: Column, lon: Column, geometry: Column, points: int = 5) -> Column:
    """Degrees from the nearer end of a polyline into it, over up to five points; null if that has no direction."""
    far = lambda p: F.sqrt(F.pow(p["lat"] - lat, 2) + F.pow(p["lon"] - lon, 2))

    def towards(a: Column, b: Column) -> Column:
        dlat, dlon = b["lat"] - a["lat"], b["lon"] - a["lon"]
        turn = F.degrees(F.atan2(dlon, dlat))
        return F.when((F.abs(dlat) >= 1e-12) | (F.abs(dlon) >= 1e-12), F.when(turn < 0, turn + 360).otherwise(turn))

    def bearing(g: Column) -> Column:
        first, last = F.get(g, F.lit(0)), F.element_at(g, -1)
        from_first = towards(first, F.get(g, F.least(F.size(g), F.lit(points)) - 1))
        from_last = towards(last, F.get(g, F.greatest(F.size(g) - points, F.lit(0))))
        return F.when(F.size(g) >= 2, F.when(far(first) < far(last), from_first).otherwise(from_last))

    return let(F.when(F.size(geometry) > 0, geometry), bearing)


def bearing_vector(bearing: Column, lat: Column) -> Column:
    """Unit vector (lat, lon) in degree space that points along a bearing."""
    north, scale = F.cos(F.radians(bearing)), F.cos(F.radians(lat))
    east = F.when(scale > 1e-6, F.sin(F.radians(bearing)) / scale).otherwise(0.0)
    norm = F.sqrt(north * north + east * east)
    return point(F.when(norm > 0, north / norm).otherwise(0.0), F.when(norm > 0, east / norm).otherwise(0.0))


def line_points(a: Column, b: Column, n: int) -> Column:
    """X11: n points from a to b, both included, at equal steps."""
    at = lambda i, c: F.round(a[c] + (b[c] - a[c]) * (i / float(n - 1)), 8)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: point(at(i, "lat"), at(i, "lon")))


def spline_points(a: Column, b: Column, bearing_a: Column, bearing_b: Column, n: int = 8, tension: float = 0.4) -> Column:
    """A cubic Hermite curve from a to b; straight where a bearing is missing.

    Bearings point into the roads that end at a and b, so tangents take the opposite way.
    """
    middle = (a["lat"] + b["lat"]) / 2
    gap = F.sqrt(F.pow(b["lat"] - a["lat"], 2) + F.pow(b["lon"] - a["lon"], 2)) * tension
    out_a, out_b = bearing_vector(bearing_a + 180, middle), bearing_vector(bearing_b + 180, middle)

    def at(i: Column, c: str) -> Column:
        t = i / float(n - 1)
        t2, t3 = t * t, t * t * t
        return F.round((2 * t3 - 3 * t2 + 1) * a[c] + (t3 - 2 * t2 + t) * out_a[c] * gap + (3 * t2 - 2 * t3) * b[c] + (t3 - t2) * out_b[c] * gap, 8)

    curve = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: point(at(i, "lat"), at(i, "lon")))
    return F.when(bearing_a.isNull() | bearing_b.isNull(), line_points(a, b, n)).otherwise(curve)


def straightness(geometry: Column) -> Column:
    """Distance of the ends over length, 1 at most; 1 for less than two points or a micrometre."""

    def ratio(g: Column) -> Column:
        a, b = F.get(g, F.lit(0)), F.element_at(g, -1)
        return let(polyline_length(g), lambda m: F.when(m < 1e-6, 1.0).otherwise(F.least(F.lit(1.0), haversine(a["lat"], a["lon"], b["lat"], b["lon"]) / m)))

    return F.when(F.size(geometry) < 2, 1.0).otherwise(let(F.when(F.size(geometry) >= 2, geometry), ratio))


def tile_of(lat: Column, lon: Column, zoom: int) -> Column:
    """Slippy-map tile of a place."""
    n = float(1 << zoom)
    t = F.radians(lat)
    return F.struct(F.floor((lon + 180.0) / 360.0 * n).cast("long").alias("x"), F.floor((1.0 - F.asinh(F.tan(t)) / math.pi) / 2.0 * n).cast("long").alias("y"))


def tile_corner(x: Column, y: Column, zoom: int) -> Column:
    """North-west corner of a slippy-map tile."""
    n = float(1 << zoom)
    return point(F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * y / n)))), x / n * 360.0 - 180.0)


def box_area_km2(min_lon: Column, min_lat: Column, max_lon: Column, max_lat: Column) -> Column:
    """At 111 km a degree."""
    return (max_lat - min_lat) * 111.0 * (max_lon - min_lon) * 111.0 * F.cos(F.radians((min_lat + max_lat) / 2))


def _apart(p: Column, q: Column, tolerance: float) -> Column:
    return (F.abs(p["lat"] - q["lat"]) >= tolerance) | (F.abs(p["lon"] - q["lon"]) >= tolerance)


def join_lines(first: Column, second: Column) -> Column:
    """One polyline after the other; a joint that both have (within 1e-9 degrees) stands once."""
    rest = F.when(_apart(F.element_at(first, -1), F.get(second, F.lit(0)), 1e-9), second).otherwise(F.slice(second, 2, F.greatest(F.size(second) - 1, F.lit(0))))
    return F.when(F.size(first) == 0, second).when(F.size(second) == 0, first).otherwise(F.concat(first, rest))


def close_line(geometry: Column, start: Column, end: Column) -> Column:
    """The polyline with its end nodes, where it stops more than 1e-6 degrees short of them."""
    head = F.when((F.size(geometry) == 0) | _apart(F.get(geometry, F.lit(0)), start, 1e-6), F.array(start)).otherwise(F.array().cast("array<struct<lat:double,lon:double>>"))
    tail = F.when((F.size(geometry) == 0) | _apart(F.element_at(geometry, -1), end, 1e-6), F.array(end)).otherwise(F.array().cast("array<struct<lat:double,lon:double>>"))
    return F.concat(head, geometry, tail)


def snap_size(size: Column, step: int = 32) -> Column:
    """The nearest multiple of step, ties to the even one, a step at least."""
    return F.greatest(F.lit(step), (step * F.rint(size / float(step))).cast("int"))


def band(value: Column, limits: dict[str, float], below: str) -> Column:
    """The first label whose limit the value reaches."""
    out = F.lit(below)
    for label, limit in sorted(limits.items(), key=lambda x: x[1]):
        out = F.when(value >= limit, label).otherwise(out)
    return out


# Grades of scores.
F1_GRADES = {"STRONG": 0.80, "ACCEPTABLE": 0.60, "WEAK": 0.40}, "POOR"
HEALTH_GRADES = {"HEALTHY": 0.80, "ACCEPTABLE": 0.60, "FRAGMENTED": 0.40}, "CRITICAL"
FRAGILITY_GRADES = {"RESILIENT": 0.90, "MODERATE": 0.75}, "FRAGILE"
OVERALL_GRADES = {"EXCELLENT": 0.80, "GOOD": 0.65, "ACCEPTABLE": 0.50, "WEAK": 0.35}, "POOR"


def road_probability(logit: Column) -> Column:
    """Sigmoid; road where it is over 0.5."""
    return 1 / (1 + F.exp(-logit))


def pixels_to_metres(pixels: Column, resolution_m: Column) -> Column:
    """X22."""
    return pixels * resolution_m
