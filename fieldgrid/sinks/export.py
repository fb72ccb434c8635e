"""Export files of points: CSV, KML, GeoJSON and the manifest. Every line is made by column functions and written by the tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geo import valid_coordinate
from ..functions.text import csv_field, to_fixed, xml_text

#: The header of the point export, and rows of an export at most.
HEADER = ("ID", "Type", "Class", "Latitude", "Longitude", "Confidence", "Image", "Project", "Location", "Date")
MOST_ROWS = 5000


def csv_line(*fields: Column) -> Column:
    return F.concat_ws(",", *map(csv_field, fields))


def exportable(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """points (id, type, class, lat, lon, confidence, image, project, location, date) with a valid place, and counts of the others by reason."""
    good = valid_coordinate(F.col("lat"), F.col("lon"))
    reason = F.when(F.col("lat").isNull() | F.col("lon").isNull(), "missing coordinates").otherwise("invalid coordinates")
    return points.where(good), points.where(~good).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def guarded(points: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """points, or an error if there are more than an export may hold."""
    n = points.limit(most + 1).count()
    if n > most:
        raise ValueError(f"more than {most} rows to export")
    return points


def csv_rows(points: DataFrame) -> DataFrame:
    share = F.when(F.col("confidence").isNotNull(), F.format_string("%.1f%%", F.col("confidence") * 100))
    line = csv_line(*[F.col(c) for c in ("id", "type", "class")], to_fixed(F.col("lat"), 8), to_fixed(F.col("lon"), 8), share, *[F.col(c) for c in ("image", "project", "location", "date")])
    return points.select("id", line.alias("value"))


def write_csv(points: DataFrame, path: str) -> None:
    """A folder of CSV parts, each with the header."""
    names = dict(zip(("id", "type", "class", "lat", "lon", "confidence", "image", "project", "location", "date"), HEADER, strict=True))
    share = F.when(F.col("confidence").isNotNull(), F.format_string("%.1f%%", F.col("confidence") * 100))
    shown = points.withColumns({"lat": to_fixed(F.col("lat"), 8), "lon": to_fixed(F.col("lon"), 8), "confidence": share})
    shown.select(*[F.col(k).alias(v) for k, v in names.items()]).write.option("header", True).option("escape", '"').csv(path)


def placemark(name: Column, description: Column, lat: Column, lon: Column) -> Column:
    at = F.concat_ws(",", to_fixed(lon, 8), to_fixed(lat, 8), F.lit("0"))
    return F.concat(F.lit("<Placemark><name>"), xml_text(name), F.lit("</name><description>"), xml_text(description), F.lit("</description><Point><coordinates>"), at, F.lit("</coordinates></Point></Placemark>"))


#: Lines of a part of KML at most: readers take a part whole.
KML_LINES = 20_000


def write_kml(points: DataFrame, path: str, lines: int = KML_LINES) -> None:
    """A folder of text parts of at most so many lines, between the document's first and last lines, in the order of ids."""
    rows = points.select(F.lit(1).alias("o"), F.col("id").cast("string").alias("id"), placemark(F.col("class"), F.concat_ws(" ", "type", "image"), F.col("lat"), F.col("lon")).alias("value"))
    ends = points.sparkSession.createDataFrame([(0, "", '<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document>'), (2, "", "</Document></kml>")], "o int, id string, value string")
    rows.union(ends).orderBy("o", "id").select("value").write.option("maxRecordsPerFile", lines).text(path)


def geojson(points: DataFrame) -> DataFrame:
    """A feature of JSON for each point."""
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"), F.struct("id", "class", "confidence").alias("properties"))
    return points.select("id", F.to_json(feature).alias("value"))


#: The headers of a mission pack's tables.
MISSION_HEADER = (
    "mission_sequence", "mission_name", "zone_count", "total_area_ha", "chemical_liters", "estimated_distance_m", "estimated_duration_min", "route_baseline_distance_m", "route_optimized_distance_m", "route_saved_distance_m", "route_saved_pct",
    "weather_decision", "weather_risk_score", "planned_start_utc", "planned_end_utc", "avg_wind_mps", "max_gust_mps", "max_precip_prob_pct",
)
ZONE_HEADER = ("zone_id", "mission_sequence", "species", "detection_count", "avg_confidence", "priority_score", "area_ha", "recommended_dose_l_per_ha", "recommended_liters", "centroid_lat", "centroid_lon", "recommendation_source")


def mission_lines(missions: DataFrame) -> DataFrame:
    """Rows (plan_id, mission, value): a line of a mission pack's missions.csv for each mission (plan_id, mission, zones, area_ha, litres, minutes, distance_before_m, distance_m, and, or null, decision, score, start, end, mean_wind, max_gust, max_precip)."""
    fixed = lambda c, digits: to_fixed(F.col(c), digits)
    saved = F.col("distance_before_m") - F.col("distance_m")
    share = F.when(F.col("distance_before_m") > 0, saved / F.col("distance_before_m") * 100).otherwise(0.0)
    time = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    line = csv_line(
        F.col("mission"), F.concat(F.lit("Mission "), F.col("mission")), F.col("zones"), fixed("area_ha", 4), fixed("litres", 3), fixed("distance_m", 1), fixed("minutes", 1), fixed("distance_before_m", 1), fixed("distance_m", 1), to_fixed(saved, 1), to_fixed(share, 2),
        F.col("decision"), fixed("score", 3), time("start"), time("end"), fixed("mean_wind", 2), fixed("max_gust", 2), fixed("max_precip", 1),
    )
    return missions.select("plan_id", "mission", line.alias("value"))


def zone_lines(zones: DataFrame) -> DataFrame:
    """Rows (plan_id, sequence, value): a line of a mission pack's zones.csv for each zone (plan_id, sequence, mission or null, species, detections, mean_confidence, priority, area_ha, dose_per_ha, litres, centroid_lat, centroid_lon, dose_source)."""
    fixed = lambda c, digits: to_fixed(F.col(c), digits)
    line = csv_line(
        F.col("sequence"), F.col("mission"), F.col("species"), F.col("detections"), fixed("mean_confidence", 3), fixed("priority", 3), fixed("area_ha", 4), fixed("dose_per_ha", 3), fixed("litres", 3), fixed("centroid_lat", 7), fixed("centroid_lon", 7), F.col("dose_source"),
    )
    return zones.select("plan_id", "sequence", line.alias("value"))


def mission_folder(stops: DataFrame) -> DataFrame:
    """Rows (plan_id, mission, value): a KML folder for each mission of stops (plan_id, mission, stop, species, lat, lon): its route, if it has two stops or more, and a place for each stop, in order."""
    at = lambda x: F.concat_ws(",", x.lon.cast("string"), x.lat.cast("string"), F.lit("0"))
    listed = F.array_sort(F.collect_list(F.struct("stop", "lat", "lon", "species")))
    name = F.concat(F.lit("Mission "), F.col("mission").cast("string"))
    route = F.concat(F.lit("<Placemark><name>"), name, F.lit(" Route</name><LineString><tessellate>1</tessellate><coordinates>"), F.array_join(F.transform("s", at), " "), F.lit("</coordinates></LineString></Placemark>"))
    places = F.array_join(F.transform("s", lambda x: F.concat(F.lit("<Placemark><name>"), xml_text(x.species), F.lit("</name><Point><coordinates>"), at(x), F.lit("</coordinates></Point></Placemark>"))), "")
    rows = stops.groupBy("plan_id", "mission").agg(listed.alias("s"))
    return rows.select("plan_id", "mission", F.concat(F.lit("<Folder><name>"), name, F.lit("</name>"), F.when(F.size("s") > 1, route).otherwise(""), places, F.lit("</Folder>")).alias("value"))


def write_mission_pack(missions: DataFrame, zones: DataFrame, stops: DataFrame, path: str) -> None:
    """Folders missions.csv, zones.csv, missions.kml and manifest.json under a path, each with a folder of text for each plan."""
    header = lambda names: F.lit(",".join(names))
    for name, lines, order, head in (("missions.csv", mission_lines(missions), "mission", MISSION_HEADER), ("zones.csv", zone_lines(zones), "sequence", ZONE_HEADER)):
        whole = lines.groupBy("plan_id").agg(F.array_sort(F.collect_list(F.struct(order, "value"))).alias("v"))
        whole.select("plan_id", F.concat_ws("\n", header(head), F.transform("v", lambda x: x.value)).alias("value")).write.partitionBy("plan_id").text(f"{path}/{name}")
    folders = mission_folder(stops).groupBy("plan_id").agg(F.array_sort(F.collect_list(F.struct("mission", "value"))).alias("v"))
    kml = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document>'), F.array_join(F.transform("v", lambda x: x.value), ""), F.lit("</Document></kml>"))
    folders.select("plan_id", kml.alias("value")).write.partitionBy("plan_id").text(f"{path}/missions.kml")
    counts = missions.groupBy("plan_id").agg(F.count("*").alias("missions"), F.sum("area_ha").alias("area_ha")).join(zones.groupBy("plan_id").agg(F.count("*").alias("zones")), "plan_id", "left")
    counts.select("plan_id", F.to_json(F.struct("missions", "zones", "area_ha")).alias("value")).write.partitionBy("plan_id").text(f"{path}/manifest.json")


def manifest(points: DataFrame, skipped: DataFrame, groups: DataFrame) -> DataFrame:
    """One row: exported and skipped rows, the three commonest reasons, and how many rows groups (id, leader) merged."""
    total = points.agg(F.count("*").alias("exported"))
    why = skipped.orderBy(F.col("n").desc(), "reason").limit(3).agg(F.sum("n").alias("skipped"), F.array_sort(F.collect_list(F.struct("n", "reason"))).alias("reasons"))
    merged = groups.agg(F.count("*").alias("input"), F.countDistinct("leader").alias("output"))
    return total.join(why).join(merged)
