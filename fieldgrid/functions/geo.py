"""Distances, projections to local metres and footprints on a sphere."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Earth radii of the general and the counting distance, metres of a degree in planning and in projection.
RADIUS, RADIUS_COUNTING = 6_371_000.0, 6_371_008.8
METRES_PLANNING, METRES_PROJECTION = 111_320.0, 111_111.0


def clamp(x: Column, low: float, high: float) -> Column:
    """Null stays null, which greatest and least would skip."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = RADIUS) -> Column:
    """Metres; null where a coordinate is null."""
    s = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.atan2(F.sqrt(s), F.sqrt(1 - s))


def valid_coordinate(lat: Column, lon: Column) -> Column:
    """Finite and within the globe; false, not null, for nulls."""
    inside = lat.between(-90, 90) & lon.between(-180, 180) & ~F.isnan(lat) & ~F.isnan(lon)
    return F.coalesce(inside, F.lit(False))


def valid_altitude(metres: Column) -> Column:
    """Finite and from -500 to 50,000; an altitude may be missing."""
    return metres.isNull() | (metres.between(-500, 50_000) & ~F.isnan(metres))


def coordinate_problem(lat: Column, lon: Column, context: str = "computed") -> Column:
    """Why a place is none, as text: not finite (or null), latitude, then longitude out of range; null for a good place."""
    told = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    finite = lambda c: F.coalesce((F.abs(c) < float("inf")) & ~F.isnan(c), F.lit(False))
    invalid = F.concat(F.lit(f"[SAFETY] {context} coordinates are invalid: lat="), told(lat), F.lit(", lon="), told(lon), F.lit(". This may indicate extreme gimbal angles or invalid altitude values."))
    outside = lambda name, c, most: F.concat(F.lit(f"[SAFETY] {context} {name} out of range: "), told(c), F.lit(f". Valid range is -{most} to {most}."))
    return F.when(~finite(lat) | ~finite(lon), invalid).when(~lat.between(-90, 90), outside("latitude", lat, 90)).when(~lon.between(-180, 180), outside("longitude", lon, 180))


def asserted_place(lat: Column, lon: Column, context: str = "computed") -> Column:
    """Struct (lat, lon); a place that is none stops the query with its problem."""
    problem = coordinate_problem(lat, lon, context)
    return F.when(problem.isNull(), F.struct(lat.alias("lat"), lon.alias("lon"))).otherwise(F.raise_error(problem).cast("struct<lat: double, lon: double>"))


def local_metres(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """East and north of an origin, equirectangular."""
    return (lon - lon0) * METRES_PLANNING * F.cos(F.radians(lat0)), (lat - lat0) * METRES_PLANNING


def from_local_metres(x: Column, y: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """Latitude and longitude; near the poles the shrinking of a degree is floored."""
    return lat0 + y / METRES_PLANNING, lon0 + x / (METRES_PLANNING * F.greatest(F.lit(1e-6), F.cos(F.radians(lat0))))


def coverage_radius(altitude: Column, fov: Column) -> Column:
    """Ground radius of an image: 25 m if altitude or field of view is missing, else 12 to 80 m; heights of 0 and less count as 30 m."""
    height = F.when(altitude > 0, altitude).otherwise(30.0)
    radius = clamp(height * F.tan(F.radians(clamp(fov, 1.0, 170.0)) / 2), 12.0, 80.0)
    return F.when(altitude.isNull() | fov.isNull(), 25.0).otherwise(radius)


def ring_area(ring: Column) -> Column:
    """Shoelace area of an array of structs (x, y); fewer than three points have none."""
    n = F.size(ring)
    turned = F.concat(F.slice(ring, F.lit(2), F.greatest(n - 1, F.lit(1))), F.slice(ring, 1, 1))
    twice = F.aggregate(F.zip_with(ring, turned, lambda a, b: a.x * b.y - b.x * a.y), F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))
    return F.when(n >= 3, F.abs(twice) / 2).otherwise(0.0)


def ring_centroid(ring: Column) -> Column:
    """Mean of the vertices, without the closing one: struct (x, y)."""
    n = F.size(ring)
    open_ = F.when((n > 1) & (F.element_at(ring, 1) == F.element_at(ring, -1)), F.slice(ring, F.lit(1), n - 1)).otherwise(ring)
    mean = lambda f: F.aggregate(open_, F.lit(0.0), lambda s, p: s + p[f]) / F.size(open_)
    return F.struct(mean("x").alias("x"), mean("y").alias("y"))


def point_in_ring(x: Column, y: Column, ring: Column, tolerance: float = 1e-9) -> Column:
    """Inside an array of structs (x, y), or on its boundary."""
    n = F.size(ring)
    edges = F.arrays_zip(ring.alias("a"), F.concat(F.slice(ring, F.lit(2), F.greatest(n - 1, F.lit(1))), F.slice(ring, 1, 1)).alias("b"))

    def on(e: Column) -> Column:
        a, b = e["a"], e["b"]
        cross = (b.x - a.x) * (y - a.y) - (b.y - a.y) * (x - a.x)
        return (F.abs(cross) <= tolerance) & x.between(F.least(a.x, b.x), F.greatest(a.x, b.x)) & y.between(F.least(a.y, b.y), F.greatest(a.y, b.y))

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        return ((a.y > y) != (b.y > y)) & (x < (b.x - a.x) * (y - a.y) / (b.y - a.y) + a.x)

    inside = F.size(F.filter(edges, crosses)) % 2 == 1
    return F.coalesce(F.when(n >= 3, F.exists(edges, on) | inside).otherwise(False), F.lit(False))


def slope_degrees(lat1: Column, lon1: Column, h1: Column, lat2: Column, lon2: Column, h2: Column) -> Column:
    """Slope of the terrain between two points; 0 where they coincide."""
    run = haversine(lat1, lon1, lat2, lon2)
    return F.when(run > 0, F.degrees(F.atan(F.abs(h2 - h1) / run))).otherwise(0.0)


def estimated_elevation(lat: Column, lon: Column) -> Column:
    """Where no elevation table has the place: by fixed regions, first the coast's cities, then the range and what lies inland of it."""
    within = lambda south, north, west, east: lat.between(south, north) & lon.between(west, east)
    cities = F.when(within(-28, -26, 152, 154), 50.0).when(within(-35, -32, 150, 152), 100.0).when(within(-39, -36, 144, 146), 150.0)
    return cities.when(lon.between(147, 153), 300.0).when(lon < 147, 200.0).otherwise(100.0)
