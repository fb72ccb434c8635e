"""Values of image metadata: a map of strings by key. Each value has several names; the first that holds a number counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .georef import positive

#: The names of each value, in the order in which they are tried.
KEYS = {
    "fov": ("FieldOfView", "drone-dji:FieldOfView", "FOV", "CameraFOV"),
    "calibrated_focal": ("CalibratedFocalLength", "drone-dji:CalibratedFocalLength"),
    "focal_35mm": ("FocalLengthIn35mmFormat", "FocalLengthIn35mmFilm", "drone-dji:FocalLengthIn35mmFormat"),
    "relative_altitude": ("RelativeAltitude", "drone-dji:RelativeAltitude"),
    "absolute_altitude": ("AbsoluteAltitude", "GPSAltitude", "altitude", "drone-dji:AbsoluteAltitude"),
    "altitude_scale": ("GeoAltitudeScale", "geoAltitudeScale"),
    "fov_scale": ("GeoFovScale", "geoFovScale"),
    "yaw_offset": ("GeoYawOffsetDeg", "geoYawOffsetDeg", "YawOffsetDeg"),
    "centre_x": ("CalibratedOpticalCenterX", "drone-dji:CalibratedOpticalCenterX", "OpticalCenterX", "geoOpticalCenterX"),
    "centre_y": ("CalibratedOpticalCenterY", "drone-dji:CalibratedOpticalCenterY", "OpticalCenterY", "geoOpticalCenterY"),
    "width": ("ExifImageWidth", "ImageWidth", "PixelXDimension", "imageWidth"),
    "height": ("ExifImageHeight", "ImageHeight", "PixelYDimension", "imageHeight"),
    "laser_distance": ("LRFTargetDistance", "drone-dji:LRFTargetDistance"),
    "laser_lat": ("LRFTargetLat", "drone-dji:LRFTargetLat"),
    "laser_lon": ("LRFTargetLon", "drone-dji:LRFTargetLon"),
}
#: Least side of an image, field of view where none is known, width of a full frame in millimetres.
LEAST_SIDE, DEFAULT_FOV, FULL_FRAME = 16, 84.0, 36.0


def let(value: Column, then) -> Column:
    """then(value), with value computed once."""
    return F.transform(F.array(value), then)[0]


def _finite(x: Column) -> Column:
    return F.when(_is_finite(x), x)


def _parsed(metadata: Column, keys: tuple[str, ...], good, clean=F.trim) -> Column:
    """The numbers of those of the keys for which good holds, in order, as an array; each text is looked up and parsed once."""
    return F.filter(F.transform(F.array(*[F.element_at(metadata, k) for k in keys]), lambda v: clean(v).try_cast("double")), good)


def _is_finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < float("inf"))


def number(metadata: Column, name: str) -> Column:
    """The first of a value's names that holds a finite number; null without one."""
    return F.get(_parsed(metadata, KEYS[name], _is_finite), F.lit(0))


def read(metadata: Column) -> Column:
    """All named values as a struct; width and height are the largest of their names. The other functions take it."""
    return F.struct(*[(largest if name in ("width", "height") else number)(metadata, name).alias(name) for name in KEYS])


def largest(metadata: Column, name: str) -> Column:
    """The largest positive number of all the names."""
    return F.array_max(_parsed(metadata, KEYS[name], lambda x: _is_finite(x) & (x > 0)))


def scale(values: Column, name: str) -> Column:
    """A factor of 0.5 to 1.5, 1 otherwise."""
    x = values[name]
    return F.when(x.between(0.5, 1.5), x).otherwise(1.0)


def image_side(stored: Column, values: Column, name: str) -> Column:
    """The larger of the stored and the named side, of those of LEAST_SIDE pixels or more."""
    fit = lambda x: F.when(x >= LEAST_SIDE, x.cast("double"))
    return F.greatest(fit(stored), fit(values[name]))


def altitude(stored: Column, values: Column) -> Column:
    """The first positive one of relative, stored and absolute altitude, scaled."""
    tried = [F.when(positive(x), x.cast("double")) for x in (values.relative_altitude, stored, values.absolute_altitude)]
    return F.coalesce(*tried) * scale(values, "altitude_scale")


def _valid_fov(x: Column) -> Column:
    return F.when((x > 0) & (x < 180), x.cast("double"))


def field_of_view(stored: Column, width: Column, values: Column, default: float = DEFAULT_FOV) -> Column:
    """Degrees: a stored value counts first unless it is the default, which gives way to calibration and to the 35 mm equivalent; then calibration, the named value, the 35 mm equivalent, the default. Scaled where that stays valid."""
    focal, film = values.calibrated_focal, values.focal_35mm
    calibrated = _valid_fov(F.when(positive(width) & positive(focal), F.degrees(2 * F.atan(width / 2 / focal))))
    equivalent = _valid_fov(F.when(positive(film), F.degrees(2 * F.atan(FULL_FRAME / (2 * film)))))
    own, named = _valid_fov(stored), _valid_fov(values.fov)
    telling = F.when(F.abs(own - default) >= 0.01, own)
    found = F.coalesce(telling, calibrated, F.when(own.isNotNull(), F.coalesce(equivalent, own)), F.when(own.isNull(), equivalent), named, F.lit(default))
    return let(found, lambda x: F.coalesce(_valid_fov(x * scale(values, "fov_scale")), x))


def yaw(stored: Column, values: Column) -> Column:
    """The gimbal's yaw (0 without) with an offset of at most 45 degrees."""
    offset = values.yaw_offset
    return F.coalesce(_finite(stored.cast("double")), F.lit(0.0)) + F.when(F.abs(offset) <= 45, offset).otherwise(0.0)


def optical_centre(side: Column, values: Column, name: str) -> Column:
    """The named centre within the side, else its middle."""
    x = values[name]
    return F.when(x.between(0, side), x).otherwise(side / 2)


def asset_camera(width: Column, height: Column, stored_altitude: Column, pitch: Column, roll: Column, stored_yaw: Column, fov: Column, metadata: Column) -> Column:
    """All that a projection needs of an asset and its metadata: struct (width, height, altitude, pitch, roll, yaw, fov, cx, cy, focal, laser_distance, laser_lat, laser_lon)."""

    def made(m: Column, w: Column, h: Column) -> Column:
        return F.struct(
            w.alias("width"), h.alias("height"), altitude(stored_altitude, m).alias("altitude"), F.coalesce(pitch, F.lit(-90.0)).alias("pitch"), F.coalesce(roll, F.lit(0.0)).alias("roll"), yaw(stored_yaw, m).alias("yaw"),
            field_of_view(fov, w, m).alias("fov"), optical_centre(w, m, "centre_x").alias("cx"), optical_centre(h, m, "centre_y").alias("cy"), m.calibrated_focal.alias("focal"),
            m.laser_distance.alias("laser_distance"), m.laser_lat.alias("laser_lat"), m.laser_lon.alias("laser_lon"),
        )

    # The metadata is computed once too, not for each name that is looked up in it.
    return let(let(metadata, read), lambda m: let(image_side(width, m, "width"), lambda w: let(image_side(height, m, "height"), lambda h: made(m, w, h))))


def exif_camera(metadata: Column) -> Column:
    """What plain EXIF names say, where 0 counts as missing: struct (lat, lon, altitude, pitch, roll, yaw, fov, width, height)."""

    def made(m: Column) -> Column:
        value = lambda k: F.element_at(m, k).try_cast("double")
        some = lambda *keys: F.get(_parsed(m, keys, lambda x: x != 0, lambda v: v), F.lit(0))
        return F.struct(
            value("GPSLatitude").alias("lat"), value("GPSLongitude").alias("lon"), F.coalesce(some("RelativeAltitude", "GPSAltitude"), F.lit(0.0)).alias("altitude"), F.coalesce(some("GimbalPitchDegree"), F.lit(-90.0)).alias("pitch"),
            F.coalesce(some("GimbalRollDegree"), F.lit(0.0)).alias("roll"), F.coalesce(some("GimbalYawDegree", "FlightYawDegree"), F.lit(0.0)).alias("yaw"), F.coalesce(some("FieldOfView"), F.lit(DEFAULT_FOV)).alias("fov"),
            some("ImageWidth", "ExifImageWidth").alias("width"), some("ImageHeight", "ExifImageHeight").alias("height"),
        )

    return let(metadata, made)


def valid_place(lat: Column, lon: Column) -> Column:
    """Both are finite, and on the globe."""
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180) & ~F.isnan(lat) & ~F.isnan(lon), F.lit(False))


def valid_altitude(x: Column) -> Column:
    """Within -500 to 50,000 m, or not known."""
    return x.isNull() | F.coalesce(x.between(-500, 50_000) & ~F.isnan(x), F.lit(False))


def _named(entries: Column, *parts: str, never: tuple[str, ...] = ()) -> Column:
    """The first number of a map's entries whose name holds all parts and none of `never`, in any case."""
    name = lambda e: F.lower(e.key)

    def fits(e: Column) -> Column:
        good = e.value.isNotNull()
        for p in parts:
            good = good & F.contains(name(e), F.lit(p))
        for p in never:
            good = good & ~F.contains(name(e), F.lit(p))
        return good

    return F.get(F.filter(F.transform(F.filter(entries, fits), lambda e: _finite(F.trim(e.value).try_cast("double"))), lambda x: x.isNotNull()), F.lit(0))


#: What a camera's profile adds to an image's metadata.
PROFILE = {"focal": "CalibratedFocalLength", "centre_x": "CalibratedOpticalCenterX", "centre_y": "CalibratedOpticalCenterY", "fov_scale": "GeoFovScale", "altitude_scale": "GeoAltitudeScale", "yaw_offset": "GeoYawOffsetDeg"}


def with_profile(metadata: Column, profile: Column) -> Column:
    """The map with the values of a profile (a struct of PROFILE's fields, null or with nulls) in place of its own."""
    own = F.create_map(*[x for field, name in PROFILE.items() for x in (F.lit(name), profile[field].cast("string"))])
    given = F.map_filter(own, lambda _, v: v.isNotNull())
    rest = F.map_filter(metadata, lambda k, _: ~F.coalesce(F.map_contains_key(given, k), F.lit(False)))
    return F.map_concat(rest, given)


def ingest(df: DataFrame, exif: str = "exif", xmp: str = "xmp", profile: str | None = None, out: str = "asset") -> DataFrame:
    """df with the struct `out` of what an asset takes from its file's EXIF and XMP maps (see sources.images), and the map full_metadata.

    Position and altitude come from EXIF and, where that has none or bad ones, from the first fitting XMP names; the names that say a
    laser's target or a height are no positions. XMP gives the gimbal and the laser. Places off the globe are dropped as pairs, altitudes outside
    -500 to 50,000 m as well. Then a profile joins the metadata, sides are the largest that any name gives, and altitude is the first positive one of
    relative, own and absolute altitude, scaled. `warnings` lists what was dropped. Steps are columns of their own, so expressions don't multiply.
    """
    entries = F.map_entries(F.coalesce(F.col(xmp), F.create_map().cast("map<string,string>")))
    value = lambda name: _finite(F.trim(F.element_at(F.col(exif), name)).try_cast("double"))
    df = df.withColumns({"_e": entries, "_lat0": value("GPSLatitude"), "_lon0": value("GPSLongitude"), "_alt0": value("GPSAltitude")})
    good = valid_place(F.col("_lat0"), F.col("_lon0"))
    e = F.col("_e")
    never = ("altitude", "relative", "lrf", "laser")
    df = df.withColumns({
        "_lat": F.coalesce(F.when(good, F.col("_lat0")), _named(e, "lat", never=never)), "_lon": F.coalesce(F.when(good, F.col("_lon0")), _named(e, "lon", never=never)),
        "_alt": F.coalesce(F.when(valid_altitude(F.col("_alt0")), F.col("_alt0")), _named(e, "altitude")), "_ld": _named(e, "lrf", "distance"), "_llat": _named(e, "lrf", "lat"), "_llon": _named(e, "lrf", "lon"),
        "_full": F.map_concat(F.map_filter(F.col(exif), lambda k, _: ~F.coalesce(F.map_contains_key(F.col(xmp), k), F.lit(False))), F.coalesce(F.col(xmp), F.create_map().cast("map<string,string>"))),
    })
    df = df.withColumn("full_metadata", with_profile(F.col("_full"), F.col(profile)) if profile else F.col("_full"))
    df = df.withColumn("_m", read(F.col("full_metadata")))
    m, found, laser = F.col("_m"), valid_place(F.col("_lat"), F.col("_lon")), valid_place(F.col("_llat"), F.col("_llon"))
    no_target = F.col("_llat").isNull() | F.col("_llon").isNull()
    angle = lambda name: _finite(F.trim(F.element_at(F.col("full_metadata"), name)).try_cast("double"))
    high = F.when(valid_altitude(F.col("_alt")), F.col("_alt"))
    said = F.array_compact(F.array(
        F.when(F.col("_lat0").isNull() | F.col("_lon0").isNull(), "no position in EXIF").when(~good, "bad position in EXIF"), F.when(~valid_altitude(F.col("_alt0")), "bad altitude in EXIF"),
        F.when(~found & (F.col("_lat").isNotNull() | F.col("_lon").isNotNull()), "bad position"), F.when(~valid_altitude(F.col("_alt")), "bad altitude"), F.when(~no_target & ~laser, "bad laser target"),
    ))
    side = lambda own, name: image_side(own, m, name)
    made = F.struct(
        F.when(found, F.col("_lat")).alias("lat"), F.when(found, F.col("_lon")).alias("lon"), altitude(high, m).alias("altitude"), side(value("ExifImageWidth"), "width").alias("width"), side(value("ExifImageHeight"), "height").alias("height"),
        F.coalesce(angle("GimbalPitchDegree"), _named(e, "gimbal", "pitch")).alias("pitch"), angle("GimbalRollDegree").alias("roll"), angle("GimbalYawDegree").alias("yaw"),
        F.col("_ld").alias("laser_distance"), F.when(no_target | laser, F.col("_llat")).alias("laser_lat"), F.when(no_target | laser, F.col("_llon")).alias("laser_lon"), said.alias("warnings"),
    )
    return df.withColumn(out, made).drop("_e", "_lat0", "_lon0", "_alt0", "_lat", "_lon", "_alt", "_ld", "_llat", "_llon", "_full", "_m")
