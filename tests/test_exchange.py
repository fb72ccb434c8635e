"""Packages and files of odd rows, numbers, and folded results."""

import json
import os
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldgrid.operators import dataset, planning
from fieldgrid.operators.numbering import numbered
from fieldgrid.plans import exchange, flows, rasters, sources
from fieldgrid.sinks import packages, shapefile
from fieldgrid.sources import readers, shapefiles
from fieldgrid.sources.bridge import Bridge
from fieldgrid.streaming import results


def test_numbers_are_dense_and_in_order(spark):
    rows = [(k, v) for k in (5, 3, None, 3, 3, 9, -1) for v in ("b", "a", None)] * 20
    df = spark.createDataFrame(rows, "k long, n string").repartition(6)
    for ranges in (None, 1, 7):
        found = numbered(df, F.col("k").desc_nulls_last(), "n", out="place", start=10, ranges=ranges).orderBy("place").collect()
        assert [r.place for r in found] == list(range(10, 10 + len(rows)))
        assert [(r.k, r.n) for r in found] == sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or ""))
    assert numbered(df.limit(0), "k").count() == 0


def test_shapefiles_of_odd_rows(spark, tmp_path):
    place = "id string, class string, confidence {}, asset string, project string, location string, notes string, created date, lat double, lon double"
    a = spark.createDataFrame([("1", "c" * 80, 0.875, None, "P", None, "é" * 200, None, -27.5, 153.25), ("2", "x", None, "a", "P", "l", None, None, 95.0, 1.0), ("3", None, float("nan"), "a", "P", "l", None, None, None, 1.0)], place.format("double"))
    b = spark.createDataFrame([("4", "w", "LIKELY", "a", "P", "l", "n", None, 1.0, 2.0), ("5", "w", "?", "a", "P", "l", "n", None, 3.0, 4.0)], place.format("string"))
    found = shapefile.features(a, b)
    assert shapefile.write_zipped(found.coalesce(1), f"file://{tmp_path}/z", 2).agg(F.sum("n"), F.count("*")).first()[:] == (3, 2)
    assert shapefile.write_zipped(found.limit(0), f"file://{tmp_path}/z").count() == 0
    got = {r.attributes["ID"]: r for r in shapefiles.shapefiles(spark, f"{tmp_path}/z").collect()}
    assert set(got) == {"1", "4", "5"} and [got[k].attributes["CONFIDENCE"] for k in ("1", "4", "5")] == ["88", "75", "0"]
    assert got["1"].attributes["CLASS"] == "c" * 50 and got["1"].attributes["NOTES"] == "é" * 127 and got["1"].parts[0][0] == (153.25, -27.5)
    # Lines, polygons, points and null shapes; a deleted row; broken files.
    record = lambda i, body: struct.pack(">ii", i, len(body) // 2) + body
    poly = struct.pack("<i4dii", 5, 0, 0, 1, 1, 2, 6) + struct.pack("<ii", 0, 3) + np.arange(12.0).tobytes()
    bodies = [poly, struct.pack("<i", 0), struct.pack("<i4di", 8, 0, 0, 1, 1, 2) + np.arange(4.0).tobytes(), struct.pack("<idd", 11, 1.0, 2.0) + bytes(16)]
    shp = struct.pack(">i", 9994) + bytes(96) + b"".join(record(i, x) for i, x in enumerate(bodies))
    dbf = struct.pack("<BBBBIHH20x", 3, 1, 1, 1, 4, 65, 4) + b"N".ljust(11, b"\0") + b"C" + bytes(4) + bytes([3, 0]) + bytes(14) + b"\r" + b" a  " + b"*b  " + b" c  " + b" d  "
    with zipfile.ZipFile(tmp_path / "many.zip", "w") as z:
        z.writestr("in/Layer.SHP", shp)
        z.writestr("in/Layer.dbf", dbf)
        z.writestr("in/bad.shp", shp[:-10])
        z.writestr("note.txt", "x")
    (tmp_path / "bare.shp").write_bytes(shp)
    (tmp_path / "no.zip").write_bytes(b"PK\3\4 nothing")
    rows = shapefiles.shapefiles(spark, str(tmp_path)).where("path NOT LIKE '%/z/%'").collect()
    own = {(r.layer, r.n): r for r in rows if r.problem is None}
    assert [len(p) for p in own["in/Layer", 0].parts] == [3, 3] and own["in/Layer", 0].attributes == {"N": "a"} and own["in/Layer", 2].kind == "points"
    assert ("in/Layer", 1) not in own and own["bare", 1].kind == "null" and own["in/Layer", 3].parts[0][0] == (1.0, 2.0) and own["bare", 3].attributes == {}
    assert sorted((r.layer or "", r.n) for r in rows if r.problem) == [("", None), ("in/bad", 3)]
    for i in range(0, len(shp), 3):
        list(shapefiles.parse("x.shp", shp[:i]))


def test_coco_of_odd_rows(spark, tmp_path):
    images = spark.createDataFrame([(i, f"f{9 - i}", 10, 20) for i in range(6)], "asset_id long, file_name string, width int, height int")
    labels = spark.createDataFrame([(0, 5, "b", 1.0, 1.0, 3.0, 4.0), (0, 4, "a", 0.0, 0.0, 1.0, 1.0), (0, 4, "a", 0.0, 0.0, 1.0, 1.0), (3, 1, "z", 0.0, 0.0, 2.0, 2.0), (4, 1, None, 0.0, 0.0, 2.0, 2.0), (5, 1, "a", None, 0.0, 2.0, 2.0), (77, 1, "a", 0.0, 0.0, 2.0, 2.0)], "asset_id long, id long, class string, x1 double, y1 double, x2 double, y2 double")
    assert packages.write_coco(images, labels, f"file://{tmp_path}/c", ("z",), 1) == 2
    parts = [json.loads((tmp_path / "c" / f"coco-{i:06d}.json").read_text()) for i in range(2)]
    assert [[(i["id"], i["file_name"]) for i in p["images"]] for p in parts] == [[(1, "f6")], [(2, "f9")]]
    assert [[(a["id"], a["image_id"], a["category_id"], a["area"]) for a in p["annotations"]] for p in parts] == [[(1, 1, 0, 4.0)], [(2, 2, 1, 1.0), (3, 2, 1, 1.0), (4, 2, 2, 6.0)]]
    assert all([c["name"] for c in p["categories"]] == ["z", "a", "b"] for p in parts) and (tmp_path / "c" / "classes.txt").read_text() == "z\na\nb"
    assert packages.write_coco(images, labels.limit(0), f"file://{tmp_path}/d") == 0


def test_bundles_tell_what_was_changed(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, None)], "asset_id long, name string")
    found = packages.bundles(a, {"s": spark.createDataFrame([(1, 2, 'q"'), (1, 1, "é"), (9, 1, "z")], "asset_id long, id long, v string"), "t": spark.createDataFrame([], "asset_id long, id long")})
    assert packages.write_bundles(found, f"file://{tmp_path}/b") == 4
    one = json.loads((tmp_path / "b" / "1.json").read_text())
    assert one["asset"] == {"asset_id": 1, "name": "x"} and one["evidence"]["s"]["rows"] == [{"id": 1, "v": "é"}, {"id": 2, "v": 'q"'}] and one["evidence"]["t"]["count"] == 0
    (tmp_path / "b" / "2.json").write_text("{}")
    (tmp_path / "b" / "3.json").write_text("{}")
    assert {r.name: r.sound for r in packages.verified_bundles(spark, f"{tmp_path}/b").collect()} == {"1": True, "2": False, "3": False}


def test_labels_up_to_a_time(spark):
    labels = [(1, 7, "2024-01-01 10:00:00"), (1, 7, "2024-01-01 11:00:00"), (1, 8, "2024-01-01 11:00:00"), (1, 9, "2024-01-05 00:00:00"), (2, 7, "2024-01-01 00:00:00"), (1, 5, None), (None, 5, "2024-01-01 00:00:00")]
    asked = [(1, t) for t in ("2024-01-01 09:59:59", "2024-01-01 10:00:00", "2024-01-01 11:00:00", "2024-01-03 00:00:00", "2024-01-06 00:00:00", None)] + [(3, "2024-01-06 00:00:00"), (1, "2024-01-01 11:00:00")]
    df = lambda rows, names: spark.createDataFrame(rows, names).withColumn("t", F.to_timestamp("t"))
    got = dataset.labels_up_to(df(asked, "project_id long, t string"), df(labels, "project_id long, asset_id long, t string").withColumnRenamed("t", "created_at"), "t").collect()
    assert sorted((r.project_id, str(r.t), r.n_labels, r.n_images) for r in got) == sorted((p, str(t), *{"2024-01-01 10:00:00": (1, 1), "2024-01-01 11:00:00": (3, 2), "2024-01-03 00:00:00": (3, 2), "2024-01-06 00:00:00": (4, 3)}.get(t if p == 1 else "", (0, 0))) for p, t in asked)


def test_folded_results_replace_and_count_once(spark, tmp_path):
    path = f"file://{tmp_path}/r"
    batch = lambda *rows: spark.createDataFrame([(j, a, p, None, ok, [("c", 0.5)] * n if n is not None else None) for j, a, p, ok, n in rows], results.RESULT)
    first, second = batch((1, 1, 9, True, 2), (1, 2, 9, False, 0), (1, 1, 9, True, 3), (None, 4, 9, True, 1), (2, 1, 9, None, None)), batch((1, 1, 9, True, 5), (1, 3, 9, True, 1))
    for b, n in ((first, 0), (first, 0), (second, 1), (first.limit(0), 2), (second, 1)):
        results.fold_batch(b, n, path)
    counters = results.job_counters(spark, path)
    assert sorted(tuple(r) for r in counters.collect()) == [(9, 1, 3, 1, 6), (9, 2, 1, 1, 0)]
    assert {(r.job_id, r.asset_id): len(r.boxes or ()) for r in results.present_results(spark, path).collect()} == {(1, 1): 5, (1, 2): 0, (1, 3): 1, (2, 1): 0}
    jobs = spark.createDataFrame([(1, 9, 3), (2, 9, 1), (3, 9, 4)], "job_id long, parent_id long, total long").withColumns({"started_at": F.lit(None).cast("timestamp"), "ended_at": F.lit(None).cast("timestamp")})
    states = results.job_states(counters, jobs)
    assert {r.job_id: r.status for r in states.collect()} == {1: "COMPLETED", 2: "FAILED", 3: "RUNNING"}
    assert results.parent_states(states).first().status == "RUNNING" and results.parent_states(states.where("job_id < 3")).first().status == "COMPLETED"


def test_plan_of_changes_is_whole(spark):
    """Every zone is a stop of one mission within the limits; launches are the forecast's; zones lie in what the layers allow."""
    t = Bridge(spark, "/root/testdata/sf0.001")
    plan = flows._plan(t)
    zones, stops, flights = plan.zones.collect(), plan.missions.collect(), plan.flights.collect()
    assert zones and sorted((z.project_id, z.sequence) for z in zones) == sorted((s.project_id, s.sequence) for s in stops)
    limits = planning.Plan()
    for f in flights:
        own = [z for s in stops if (s.project_id, s.mission) == (f.project_id, f.mission) for z in zones if (z.project_id, z.sequence) == (s.project_id, s.sequence)]
        assert len(own) == f.stops <= limits.zones and (len(own) == 1 or (sum(z.area_ha for z in own) <= limits.area_ha + 1e-9 and sum(z.litres for z in own) <= limits.litres + 1e-9))
        assert f.end > f.start >= f.launch
    hours = {r.ts for r in t.forecast.collect()}
    assert {f.launch for f in flights} <= hours and {(f.project_id, f.mission) for f in flights} == {(s.project_id, s.mission) for s in stops}
    centre = {r.project_id: (r.center_lat, r.center_lon) for r in t.project.collect()}
    for z in zones:
        lat, lon = centre[z.project_id]
        assert 0 <= z.centroid_lat - lat <= 0.0038 and 0 <= z.centroid_lon - lon <= 0.0038
        assert abs(z.litres - z.area_ha * z.dose_per_ha) < 1e-9
    by_project = {}
    for z in sorted(zones, key=lambda z: (z.project_id, z.sequence)):
        by_project.setdefault(z.project_id, []).append(z.priority)
    assert all(p == sorted(p, reverse=True) for p in by_project.values())


def test_many_small_files_go_into_archives(spark, tmp_path, monkeypatch):
    rows = [(f"a/{i}.json", f"text {i}" if i % 10 else None) for i in range(500)]
    folder = f"file://{tmp_path}/archives"
    df = spark.createDataFrame(rows, "name string, value string").repartition(7)
    for _ in range(2):  # a repeated write replaces its archives
        assert packages.write_archives(df, folder) == 500
    got = readers.archived(spark, folder).collect()
    assert sorted((r.path.split(".tar.gz/")[1], bytes(r.content).decode()) for r in got) == sorted((n, v or "") for n, v in rows)
    assert len(list((tmp_path / "archives").iterdir())) <= 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert packages.write_archives(df.limit(0), f"file://{tmp_path}/none") == 0 and readers.archived(spark, f"file://{tmp_path}/none").count() == 0
    monkeypatch.setattr(readers, "MEMBERS", 10)
    assert readers.archived(spark, folder).count() == 500


@pytest.mark.parametrize("module, name", [(exchange, "evidence_bundles"), (rasters, "ingested_images"), (sources, "label_files")])
def test_queries_of_many_files_write_few(spark, tmp_path, monkeypatch, module, name):
    monkeypatch.setattr(module, "scratch", lambda spark, tag: f"file://{tmp_path}/{tag}")
    found = getattr(module, name)(Bridge(spark, "/root/testdata/sf0.001")).count()
    files = sum(len(files) for _, _, files in os.walk(tmp_path))
    assert found > 100 and 0 < files <= 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_shapefile_pads_a_text_once_for_all_its_rows():
    import numpy as np
    import pyarrow as pa

    from fieldgrid.sinks import shapefile
    from fieldgrid.sources import shapefiles

    texts = ["é" * 200, "", "é" * 200]
    made = shapefile._files(np.array([150.0, 151.0, 152.0]), np.array([-20.0, -21.0, -22.0]), [pa.array(texts) for _ in shapefile.ALL_FIELDS])
    rows = shapefiles.attributes(made["dbf"])
    assert [r["NOTES"] for r in rows] == ["é" * 127, "", "é" * 127] and [r["CONFIDENCE"] for r in rows] == ["é" * 5, "", "é" * 5]
    assert [shapefiles.shape(b)[1][0][0]["x"] for b in shapefiles.records(made["shp"])] == [150.0, 151.0, 152.0]
