"""From pixels to ground coordinates: a camera ray is turned by roll, pitch and compass yaw and met with the ground."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .geo import METRES_PROJECTION, haversine

#: A ray that descends less than this share of its length is too near the horizon.
NEAR_HORIZON = 0.05


def positive(x: Column) -> Column:
    return F.coalesce((x > 0) & ~F.isnan(x) & (x < float("inf")), F.lit(False))


def focal_length(width: Column, fov_degrees: Column) -> Column:
    """Pixels; null outside 0 < field of view < 180 degrees."""
    good = positive(width) & (fov_degrees > 0) & (fov_degrees < 180)
    return F.when(good, width / (2 * F.tan(F.radians(fov_degrees) / 2)))


def intrinsics(f: Column, cx: Column, cy: Column, width: Column, height: Column, fov_degrees: Column) -> Column:
    """Struct (f, cx, cy, from_fov): calibrated values, else those of the field of view with the calibrated or the middle centre; null without either."""
    calibrated = positive(f) & cx.isNotNull() & cy.isNotNull()
    own = F.struct(f.cast("double").alias("f"), cx.cast("double").alias("cx"), cy.cast("double").alias("cy"), F.lit(False).alias("from_fov"))
    focal = focal_length(width, fov_degrees)
    wide = F.struct(focal.alias("f"), F.coalesce(cx.cast("double"), width / 2).alias("cx"), F.coalesce(cy.cast("double"), height / 2).alias("cy"), F.lit(True).alias("from_fov"))
    return F.when(calibrated, own).when(focal.isNotNull() & positive(height), wide)


def ray(tan_x: Column, tan_y: Column, pitch: Column, roll: Column, yaw: Column) -> Column:
    """Struct (east, north, up) of a pixel's ray, of length 1 along the view before it is turned; angles in degrees, yaw clockwise from north."""
    p, r, w = F.radians(pitch), F.radians(roll), F.radians(yaw)
    right = tan_x * F.cos(r) - tan_y * F.sin(r)
    down = tan_x * F.sin(r) + tan_y * F.cos(r)
    forward = F.cos(p) + down * F.sin(p)
    return F.struct(
        (forward * F.sin(w) + right * F.cos(w)).alias("east"),
        (forward * F.cos(w) - right * F.sin(w)).alias("north"),
        (F.sin(p) - down * F.cos(p)).alias("up"),
    )


def descends(v: Column) -> Column:
    return v.up < -NEAR_HORIZON * F.sqrt(v.east * v.east + v.north * v.north + v.up * v.up)


def ground_offset(x: Column, y: Column, camera: Column, pitch: Column, roll: Column, yaw: Column, height: Column) -> Column:
    """Struct (east, north, centre_east, centre_north) in metres of the pixel and of the view's centre; null near the horizon or without a height."""
    own = ray((x - camera.cx) / camera.f, (y - camera.cy) / camera.f, pitch, roll, yaw)
    centre = ray(F.lit(0.0), F.lit(0.0), pitch, roll, yaw)
    good = positive(height) & descends(own) & descends(centre)
    down = lambda v, f: height / -v.up * v[f]
    return F.when(good, F.struct(down(own, "east").alias("east"), down(own, "north").alias("north"), down(centre, "east").alias("centre_east"), down(centre, "north").alias("centre_north")))


def project_pixels(df: DataFrame, x: Column, y: Column, lat: Column, lon: Column, camera: Column, pitch: Column, roll: Column, yaw: Column, height: Column, most_offset: Column | None = None, target_lat: Column | None = None, target_lon: Column | None = None, out: str = "geo") -> DataFrame:
    """df with the struct (lat, lon, offset_m) of a pixel of each row, or null.

    With a laser target, the pixel's offset from the view's centre counts from the target. Places outside the globe and
    offsets over most_offset give null. Steps are columns of their own, so that expressions don't multiply.
    """
    none = F.lit(None).cast("double")
    given = {"x": x, "y": y, "lat": lat, "lon": lon, "camera": camera, "pitch": pitch, "roll": roll, "yaw": yaw, "height": height, "most": none if most_offset is None else most_offset, "tlat": none if target_lat is None else target_lat, "tlon": none if target_lon is None else target_lon}
    c = {k: F.col(f"_geo_{k}") for k in (*given, "o", "at")}
    staged = df.withColumns({f"_geo_{k}": v for k, v in given.items()})
    staged = staged.withColumn("_geo_o", ground_offset(c["x"], c["y"], c["camera"], c["pitch"], c["roll"], c["yaw"], c["height"]))
    o, anchored = c["o"], c["tlat"].isNotNull() & c["tlon"].isNotNull()
    base = lambda own, target: F.when(anchored, c[target]).otherwise(c[own])
    degree = METRES_PROJECTION * F.cos(F.radians(base("lat", "tlat")))
    shift = lambda of, centre: o[of] - F.when(anchored, o[centre]).otherwise(0.0)
    at = F.struct((base("lat", "tlat") + shift("north", "centre_north") / METRES_PROJECTION).alias("lat"), (base("lon", "tlon") + shift("east", "centre_east") / degree).alias("lon"), F.hypot(o.east - o.centre_east, o.north - o.centre_north).alias("offset_m"))
    staged = staged.withColumn("_geo_at", F.when(o.isNotNull() & (F.abs(degree) >= 1e-6), at))
    p = c["at"]
    good = p.lat.between(-90, 90) & p.lon.between(-180, 180) & (~positive(c["most"]) | (p.offset_m <= c["most"]))
    return staged.withColumn(out, F.when(good, p)).drop(*[f"_geo_{k}" for k in (*given, "o", "at")])


def laser_height(distance: Column, pitch: Column, roll: Column, yaw: Column) -> Column:
    """Height above ground by the laser's range along the view; null near the horizon."""
    centre = ray(F.lit(0.0), F.lit(0.0), pitch, roll, yaw)
    return F.when(positive(distance) & descends(centre), distance * -centre.up)


def geoid_height(lat: Column, lon: Column) -> Column:
    """Metres of the geoid over the ellipsoid, by fixed boxes of places."""
    within = lambda south, north, west, east: lat.between(south, north) & lon.between(west, east)
    return F.when(within(-30, -25, 150, 155), 30.0).when(within(-35, -30, 150, 155), 32.0).when(within(-40, -35, 145, 150), 28.0).otherwise(30.0)


def project_rings(df: DataFrame, ring: Column, lat: Column, lon: Column, camera: Column, pitch: Column, roll: Column, yaw: Column, height: Column, most_offset: Column | None = None, out: str = "places") -> DataFrame:
    """df with an array of what project_pixels gives (lat, lon, offset_m) for each pixel (x, y) of the ring, or null in its place; null for a null ring.

    The view's angles are turned once a row, and the pixels stay in their row, whatever their number.
    """
    p, r, w = F.radians(pitch), F.radians(roll), F.radians(yaw)
    given = {"ring": ring, "lat": lat, "lon": lon, "camera": camera, "height": height, "most": F.lit(None).cast("double") if most_offset is None else most_offset}
    given |= {f"{f}_{name}": of(v) for name, v in (("p", p), ("r", r), ("w", w)) for f, of in (("sin", F.sin), ("cos", F.cos))}
    c = {k: F.col(f"_ring_{k}") for k in (*given, "centre", "sound", "degree")}
    staged = df.withColumns({f"_ring_{k}": v for k, v in given.items()})

    def turned(tan_x: Column, tan_y: Column) -> Column:
        return F.struct((tan_x * c["cos_r"] - tan_y * c["sin_r"]).alias("right"), (tan_x * c["sin_r"] + tan_y * c["cos_r"]).alias("down"))

    def pitched(v: Column) -> Column:
        return F.struct((c["cos_p"] + v.down * c["sin_p"]).alias("forward"), v.right.alias("right"), (c["sin_p"] - v.down * c["cos_p"]).alias("up"))

    def headed(v: Column) -> Column:
        return F.struct((v.forward * c["sin_w"] + v.right * c["cos_w"]).alias("east"), (v.forward * c["cos_w"] - v.right * c["sin_w"]).alias("north"), v.up.alias("up"))

    rays = lambda start: F.transform(F.transform(start, pitched), headed)
    down = lambda v, f: c["height"] / -v.up * v[f]
    on_ground = lambda v: F.when(descends(v), F.struct(down(v, "east").alias("east"), down(v, "north").alias("north")))
    staged = staged.withColumn("_ring_centre", F.transform(rays(F.array(turned(F.lit(0.0), F.lit(0.0)))), on_ground)[0])
    staged = staged.withColumn("_ring_degree", METRES_PROJECTION * F.cos(F.radians(c["lat"])))
    staged = staged.withColumn("_ring_sound", positive(c["height"]) & c["centre"].isNotNull() & (F.abs(c["degree"]) >= 1e-6))

    def place(o: Column) -> Column:
        at = F.struct((c["lat"] + o.north / METRES_PROJECTION).alias("lat"), (c["lon"] + o.east / c["degree"]).alias("lon"), F.hypot(o.east - c["centre"].east, o.north - c["centre"].north).alias("offset_m"))
        return F.when(o.isNotNull(), at)

    def checked(v: Column) -> Column:
        return F.when(v.lat.between(-90, 90) & v.lon.between(-180, 180) & (~positive(c["most"]) | (v.offset_m <= c["most"])), v)

    start = F.transform(c["ring"], lambda v: turned((v.x - c["camera"].cx) / c["camera"].f, (v.y - c["camera"].cy) / c["camera"].f))
    found = F.transform(F.transform(F.transform(rays(start), on_ground), place), checked)
    nowhere = F.transform(c["ring"], lambda _: F.lit(None).cast("struct<lat: double, lon: double, offset_m: double>"))
    return staged.withColumn(out, F.when(c["sound"], found).otherwise(nowhere)).drop(*[f"_ring_{k}" for k in c])


def box_polygon(df: DataFrame, x: Column, y: Column, width: Column, height: Column, lat: Column, lon: Column, camera: Column, pitch: Column, roll: Column, yaw: Column, ground: Column, out: str = "polygon") -> DataFrame:
    """df with the closed ring of structs (lat, lon) of a box of pixels on the ground, or null where a corner has no place.

    Each corner goes through a lambda, which ends the code that Spark makes as one method: that of four corners is longer than what the JVM compiles.
    """
    corners = ((x, y), (x + width, y), (x + width, y + height), (x, y + height))
    for i, (cx, cy) in enumerate(corners):
        df = project_pixels(df, cx, cy, lat, lon, camera, pitch, roll, yaw, ground, out=f"_corner_{i}")
        df = df.withColumn(f"_corner_{i}", F.transform(F.array(f"_corner_{i}"), lambda p: p)[0])
    at = [F.struct(F.col(f"_corner_{i}.lat").alias("lat"), F.col(f"_corner_{i}.lon").alias("lon")) for i in (0, 1, 2, 3, 0)]
    whole = F.lit(True)
    for i in range(4):
        whole = whole & F.col(f"_corner_{i}").isNotNull()
    return df.withColumn(out, F.when(whole, F.array(*at))).drop(*[f"_corner_{i}" for i in range(4)])


def cascade_height(laser: Column, given: Column, relative: Column, absolute: Column, geoid: Column, ground: Column, default: float = 100.0) -> Column:
    """Struct (height, method): the first that is positive of laser, given height, relative altitude, absolute altitude over geoid and ground, default."""
    steps = [("lrf", laser), ("provided_height", given), ("relative_altitude", relative), ("absolute_altitude", absolute - geoid - ground)]
    out = F.struct(F.lit(default).alias("height"), F.lit("default").alias("method"))
    for name, value in reversed(steps):
        out = F.when(positive(value), F.struct(value.cast("double").alias("height"), F.lit(name).alias("method"))).otherwise(out)
    return out


def normalise_pixel(x: Column, y: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """Shares of the frame become pixels; both are clamped to the frame."""
    share = x.between(0, 1) & y.between(0, 1)
    fit = lambda v, most: F.greatest(F.lit(0.0), F.least(most.cast("double"), F.when(share, v * most).otherwise(v)))
    return fit(x, width), fit(y, height)


def most_offset(altitude: Column, fov: Column, width: Column, height: Column) -> Column:
    """Metres that a pixel may lie from the view's centre: 250, or three times the frame's half diagonal on the ground."""
    half = F.tan(F.radians(fov) / 2)
    return F.greatest(F.lit(250.0), 3 * altitude * F.hypot(half, half * height / width))


def plausible_target(lat: Column, lon: Column, target_lat: Column, target_lon: Column, distance: Column) -> Column:
    """A laser target not absurdly far from the drone."""
    return F.coalesce(haversine(lat, lon, target_lat, target_lon) <= F.greatest(F.lit(2000.0), 8 * distance + 500), F.lit(False))


def yaw_offset(yaw: Column, offset: Column) -> Column:
    """Yaw with a calibrated offset, which is ignored beyond 45 degrees."""
    return yaw + F.when(F.abs(offset) <= 45, offset).otherwise(0.0)


def missing_parameters(**columns: Column) -> Column:
    """The names whose values are null, in the order given."""
    return F.filter(F.array(*[F.when(c.isNull(), F.lit(name)) for name, c in columns.items()]), lambda x: x.isNotNull())


def geo_quality(gps: Column, dimensions: Column, altitude: Column, gimbal: Column, calibrated: Column, fov: Column, laser: Column) -> Column:
    """Struct (quality, missing) of what a georeference has (booleans): missing without a position; high with dimensions, altitude, gimbal and calibration or laser; medium with the first two."""
    gap = lambda c, name: F.when(~c, F.lit(name))
    listed = F.filter(F.array(gap(dimensions, "image dimensions"), gap(altitude, "altitude"), gap(gimbal, "gimbal angles"), gap(calibrated | fov, "camera calibration")), lambda x: x.isNotNull())
    grade = F.when(~gps, "missing").when(dimensions & altitude & gimbal & (calibrated | laser), "high").when(dimensions & altitude, "medium").otherwise("low")
    return F.struct(grade.alias("quality"), F.when(gps, listed).otherwise(F.array(F.lit("gps"))).alias("missing"))


#: Keys of an image's metadata that tell of calibration, laser and lens.
PRECISION_KEYS = {
    "focal": ("CalibratedFocalLength", "drone-dji:CalibratedFocalLength"), "cx": ("CalibratedOpticalCenterX", "drone-dji:CalibratedOpticalCenterX"), "cy": ("CalibratedOpticalCenterY", "drone-dji:CalibratedOpticalCenterY"),
    "distance": ("LRFTargetDistance", "drone-dji:LRFTargetDistance"), "lat": ("LRFTargetLat", "drone-dji:LRFTargetLat"), "lon": ("LRFTargetLon", "drone-dji:LRFTargetLon"), "dewarp": ("DewarpData", "drone-dji:DewarpData"), "fov": ("FieldOfView", "drone-dji:FieldOfView", "FOV", "CameraFOV"),
}


def precision_status(metadata: Column) -> Column:
    """Struct of what a map of strings says of an image: has_calibration (focal length and centre), has_laser (a positive distance and a place), has_dewarp, and focal, cx, cy and fov, null where no number is there."""
    found = {name: metadata_number(metadata, *keys) for name, keys in PRECISION_KEYS.items() if name != "dewarp"}
    known = lambda *names: F.lit(True) if not names else found[names[0]].isNotNull() & known(*names[1:])
    dewarp = F.coalesce(*[F.when(F.trim(F.element_at(metadata, k)) != "", F.lit(True)) for k in PRECISION_KEYS["dewarp"]], F.lit(False))
    laser = F.coalesce(found["distance"] > 0, F.lit(False)) & known("lat", "lon")
    return F.struct(known("focal", "cx", "cy").alias("has_calibration"), laser.alias("has_laser"), dewarp.alias("has_dewarp"), *[found[k].alias(k) for k in ("focal", "cx", "cy", "fov")])


def place_shift(lat: Column, lon: Column, other_lat: Column, other_lon: Column) -> Column:
    """How far two ways of placing a pixel lie apart, in metres of a flat degree; null where one has no place."""
    return F.hypot(lat - other_lat, lon - other_lon) * METRES_PROJECTION


def metadata_number(metadata: Column, *keys: str) -> Column:
    """The first key of a map of strings whose value is a number."""
    return F.coalesce(*[F.element_at(metadata, k).try_cast("double") for k in keys])
