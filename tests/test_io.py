"""Readers, writers, pixels and streams."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldgrid.functions import pixels
from fieldgrid.operators import reporting
from fieldgrid.sinks import export, shapefile, tables
from fieldgrid.sources import readers
from fieldgrid.streaming import surveys


def test_candidates(spark, tmp_path):
    rows = [{"image": "a", "class": "w", "similarity": 0.8, "bbox": [1, 2, 11, 22]}, {"image": "a", "class": "w", "x": 100, "y": 50}, {"image": "a", "class": "w", "x": 100, "y": 50, "boxSize": 10, "confidence": 0.3}, {"image": "b", "class": "w", "polygon": [[0, 0], [4, 0], [4, 2]]}, {"image": "b", "class": "none"}]
    (tmp_path / "c.json").write_text("\n".join(map(json.dumps, rows)))
    got = sorted(tuple(r) for r in readers.candidates(spark, str(tmp_path / "c.json")).collect())
    assert got == [("a", "w", 0.3, 95, 45, 105, 55), ("a", "w", 0.5, 76, 26, 124, 74), ("a", "w", 0.8, 1, 2, 11, 22), ("b", "w", 0.5, 0, 0, 4, 2)]


def test_kml_and_geojson(spark, tmp_path):
    (tmp_path / "a.kml").write_text("<kml><Point><coordinates>153.1,-27.2,0</coordinates></Point><Polygon><coordinates>\n 0,0 4,0 4,4 0,0 </coordinates></Polygon><x><coordinates>bad</coordinates></x></kml>")
    points = [(r.n, r.lat, r.lon) for r in readers.kml_points(spark, str(tmp_path / "a.kml")).collect()]
    assert points == [(0, -27.2, 153.1), (1, 0.0, 0.0)]
    rings = readers.kml_rings(spark, str(tmp_path / "a.kml")).collect()
    assert len(rings) == 1 and [tuple(p) for p in rings[0].ring] == [(0, 0), (4, 0), (4, 4), (0, 0)]
    square = [[0, 0], [1, 0], [1, 1], [0, 0]]
    polygon = {"type": "Polygon", "coordinates": [square, square]}
    cases = {
        "p": polygon, "m": {"type": "MultiPolygon", "coordinates": [[square], [square]]}, "f": {"type": "Feature", "geometry": polygon},
        "c": {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": polygon}, {"type": "Feature", "geometry": {"type": "MultiPolygon", "coordinates": [[square], [square]]}}, {"type": "Feature", "geometry": None}]}, "l": {"type": "LineString", "coordinates": [[0, 0]]},
    }
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in cases.items()] + [("x", "junk"), ("n", None)], "k string, j string")
    got = {r.k: len(r.g) for r in df.select("k", readers.geojson_rings(F.col("j")).alias("g")).collect()}
    assert got == {"p": 1, "m": 2, "f": 1, "c": 3, "l": 0, "x": 0, "n": 0}


def test_forecast_elevation_and_sessions(spark):
    rows = spark.createDataFrame([(["2024-01-01T00:00", "2024-01-01T01:00", "2024-01-05T00:00", "2024-01-01T02:00"], [1.0, -2.0, 3.0, 4.0], [1.0, 2.0, 3.0, 4.0], [1.0, 200.0, 3.0], [1.0, 2.0, 3.0, 4.0])], "time array<string>, wind array<double>, gust array<double>, precip array<double>, temp array<double>")
    got = readers.hourly_forecast(rows, "2024-01-01 00:30:00", 48).orderBy("ts").collect()
    assert [(r.ts.hour, r.wind, r.precip) for r in got] == [(0, 1.0, 1.0), (1, 0.0, 100.0), (2, 4.0, 0.0)]  # a missing value counts as 0
    places = spark.createDataFrame([(1, -27.0, 153.0), (2, -28.0, 153.0)], "id int, lat double, lon double")
    known = spark.createDataFrame([(-27.0000001, 153.0, 55.0)], "lat double, lon double, elevation double")
    assert {r.id: r.elevation for r in readers.with_elevation(places, known).collect()} == {1: 55.0, 2: 50.0}
    sessions = spark.createDataFrame([("s", ["a", "b"], ["j"]), ("t", [], ["j", "k"]), ("u", None, None)], "session_id string, asset_ids array<string>, job_ids array<string>")
    found = readers.session_assets(sessions, spark.createDataFrame([("j", "x"), ("k", "y"), ("j", "x")], "job_id string, asset_id string"))
    assert sorted(map(tuple, found.collect())) == [("s", "a"), ("s", "b"), ("t", "x"), ("t", "y")]


def points(spark):
    rows = [(1, "AI", 'La,"n', -27.5, 153.25, 0.876, "i.jpg", "P", "here", "2024-01-02"), (2, "AI", "W<", None, 153.0, 0.5, "i", "P", None, "2024-01-02"), (3, "M", "W", 95.0, 1.0, None, "i", "P", None, "2024-01-03"), (4, "M", "W", 1.0, 2.0, None, "i", "P", None, "2024-01-03")]
    return spark.createDataFrame(rows, "id long, type string, class string, lat double, lon double, confidence double, image string, project string, location string, date string").withColumn("date", F.to_date("date"))


def test_exports(spark, tmp_path):
    good, skipped = export.exportable(points(spark))
    assert {r.reason: r.n for r in skipped.collect()} == {"missing coordinates": 1, "invalid coordinates": 1}
    assert [r.value for r in export.csv_rows(good).orderBy("id").collect()] == ['1,AI,"La,""n",-27.50000000,153.25000000,87.6%,i.jpg,P,here,2024-01-02', "4,M,W,1.00000000,2.00000000,,i,P,,2024-01-03"]
    export.write_csv(good, str(tmp_path / "csv"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).columns == list(export.HEADER)
    export.write_kml(good, str(tmp_path / "kml"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "kml")).collect()]
    assert len(lines) == 4 and any("153.25000000,-27.50000000,0" in x and "La,&quot;n" in x for x in lines)
    assert json.loads(export.geojson(good).orderBy("id").first().value)["geometry"]["coordinates"] == [153.25, -27.5]
    m = export.manifest(good, skipped, spark.createDataFrame([(1, 1), (2, 1)], "id int, leader int")).first()
    assert (m.exported, m.skipped, m.input, m.output) == (2, 2, 2, 1)
    with pytest.raises(ValueError):
        export.guarded(good, 1)
    assert shapefile.write(good, str(tmp_path / "points")) == 2
    data = (tmp_path / "points.shp").read_bytes()
    assert struct.unpack(">i", data[24:28])[0] * 2 == len(data) and struct.unpack("<dd", data[112:128]) in {(153.25, -27.5), (2.0, 1.0)}
    dbf = (tmp_path / "points.dbf").read_bytes()
    assert struct.unpack("<I", dbf[4:8])[0] == 2 and b"88" in dbf


def test_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.replace_by_key(spark.createDataFrame([(1, "a"), (2, "b")], "run long, v string"), path, "run")
    for _ in range(2):
        tables.replace_by_key(spark.createDataFrame([(2, "c"), (2, "d")], "run long, v string"), path, "run")
    assert sorted((r.run, r.v) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c"), (2, "d")]
    tables.write_label_files(spark.createDataFrame([(7, "0 1 2 3 4\n1 1 1 1 1")], "asset_id long, lines string"), spark.createDataFrame([(7, "val")], "asset_id long, split string"), str(tmp_path / "l"))
    assert (tmp_path / "l" / "labels" / "val" / "7.txt").read_text() == "0 1 2 3 4\n1 1 1 1 1\n"
    assert tables.data_yaml(spark.createDataFrame([(1, "b"), (0, "a")], "class_id int, class string")).first().value.endswith("names:\n  0: a\n  1: b")
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string"), spark.createDataFrame([(2, "z"), (3, "w")], "id int, v string")
    assert {r.entity_id: r.action for r in tables.audit_rows(a, b, "id", "E", "u", "2024-01-01").collect()} == {"1": "DELETE", "2": "UPDATE", "3": "CREATE"}


def test_vegetation(spark):
    image = np.full((40, 60, 3), 120, np.uint8)
    image[10:20, 30:40] = (20, 200, 20)
    image[0, 0] = (0, 255, 0)
    df = spark.createDataFrame([(1, bytearray(image.tobytes()), 60, 40, 0.0, 0.0, 60.0, 40.0), (2, bytearray(image.tobytes()), 60, 40, 30.0, 10.0, 40.0, 20.0), (3, bytearray(image.tobytes()), 60, 40, 100.0, 0.0, 120.0, 9.0), (4, None, 60, 40, 0.0, 0.0, 1.0, 1.0)], "id int, p binary, w int, h int, x1 double, y1 double, x2 double, y2 double")
    args = ["p", "w", "h", "x1", "y1", "x2", "y2"]
    got = {r.id: r for r in df.select("id", pixels.green_fraction(*args).alias("f"), pixels.green_centre(*args).alias("c")).collect()}
    assert abs(got[1].f - 101 / 2400) < 1e-9 and got[2].f == 1 and got[3].f is None and got[4].f is None
    assert abs(got[1].c.x - 35) < 0.6 and abs(got[1].c.y - 15) < 0.6 and got[3].c.x is None
    gate = {r.m: r.g for r in spark.createDataFrame([(0.01,), (0.06,), (0.5,), (0.95,)], "m double").select("m", pixels.green_threshold(F.col("m")).alias("g")).collect()}
    assert gate == {0.01: None, 0.06: 0.05, 0.5: 0.25, 0.95: 0.4}


def test_stream_equals_batch(spark, tmp_path):
    rows = [(1, "Morning A", "2024-01-01 01:00:00"), (1, "morning a", "2024-01-01 05:00:00"), (1, None, "2024-01-02 05:00:00"), (2, "Morning A", "2024-01-03 05:00:00")]
    df = spark.createDataFrame(rows, "project_id long, flight_session string, t string").select("project_id", "flight_session", F.to_timestamp("t").alias("flight_date"))
    df.write.parquet(str(tmp_path / "in"))
    stream = surveys.running_surveys(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("surveys").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.project_id, r.survey_key): r.assets for r in spark.table("surveys").collect()}
    assert got == {(1, "morning-a"): 2, (1, "date-2024-01-02"): 1, (2, "morning-a"): 1}


def test_rollup_and_shards(spark):
    rows = [(1, "COMPLETED", 5), (1, "FAILED", 1), (2, "RUNNING", 0), (3, "FAILED", 0), (4, "CANCELLED", 0)]
    df = spark.createDataFrame(rows, "parent_id int, status string, processed int").selectExpr("*", "10 AS total", "timestamp'2024-01-01' AS started_at", "timestamp'2024-01-02' AS ended_at")
    got = {r.parent_id: (r.status, r.warnings, r.ended_at is None) for r in reporting.rollup_shards(df).collect()}
    assert got == {1: ("COMPLETED", True, False), 2: ("RUNNING", False, True), 3: ("FAILED", False, False), 4: ("CANCELLED", False, False)}
    shards = reporting.shards(spark.range(2200).select("id", F.lit(0).alias("g")), "id", "g").groupBy("shard").count().collect()
    assert sorted(r["count"] for r in shards) == [200, 500, 500, 500, 500]


def test_kml_parts_are_bounded_and_keep_their_order(spark, tmp_path):
    rows = spark.range(95).select(F.format_string("%03d", "id").alias("id"), F.lit("ai").alias("type"), F.lit("c").alias("class"), (F.col("id") / 10).alias("lat"), F.lit(1.0).alias("lon"), F.lit("i").alias("image"))
    path = str(tmp_path / "kml")
    export.write_kml(rows, path, 10)
    parts = sorted(p for p in (tmp_path / "kml").iterdir() if p.name.startswith("part"))
    texts = [p.read_text().splitlines() for p in parts]
    assert max(map(len, texts)) <= 10
    whole = [x for t in texts for x in t]
    assert len(whole) == 97 and whole[0].startswith("<?xml") and whole[-1] == "</Document></kml>"
    assert sorted(r.lat for r in readers.kml_points(spark, path).collect()) == [i / 10 for i in range(95)]


def test_assets_of_sessions_are_distinct_without_an_exchange_of_the_result(spark):
    sessions = spark.createDataFrame([(1, "batch_review", None, [1, 2, 2]), (2, "batch_review", [], [2, 1]), (3, "batch_review", [9, 9, None], [1]), (4, "single", None, [1]), (5, "batch_review", [10], None), (5, "batch_review", None, [1]), (6, None, None, [1]), (7, "batch_review", None, [3, None])], "session_id long, workflow string, asset_ids array<long>, job_ids array<long>")
    suggestions = spark.createDataFrame([(1, 10), (1, 10), (1, 11), (2, 11), (2, 12), (None, 13)], "job_id long, asset_id long")
    found = readers.session_assets(sessions, suggestions)
    both = {10, 11, 12}
    assert sorted(map(tuple, found.collect())) == sorted([(s, a) for s in (1, 2) for a in both] + [(3, 9), (5, 10), (5, 11)])
    assert found._jdf.queryExecution().optimizedPlan().nodeName() == "Union"
