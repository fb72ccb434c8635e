"""Masks, vegetation, image files and footprints against plain restatements."""

import json
import struct
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldgrid.functions import metadata, pixels
from fieldgrid.operators import footprints, geometry, masks, terrain, vegetation
from fieldgrid.plans import rasters, shapes
from fieldgrid.sinks.images import exif_block, jpeg_head, write_image_heads, xmp_packet
from fieldgrid.sources import images
from fieldgrid.sources.bridge import Bridge

SF = "/root/testdata/sf0.001"
EIGHT = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy]
FOUR = [(1, 0), (-1, 0), (0, 1), (0, -1)]


@pytest.fixture(scope="module")
def t(spark):
    return Bridge(spark, SF)


def patches(cells, steps):
    """Sets of cells (x, y) that steps connect."""
    left, out = set(cells), []
    while left:
        found, todo = set(), [left.pop()]
        while todo:
            x, y = todo.pop()
            found.add((x, y))
            near = {(x + a, y + b) for a, b in steps} & left
            left -= near
            todo += near
        out.append(found)
    return out


def outer_border(cells):
    """Cells of a patch that touch by a side the outside that reaches around it."""
    xs, ys = [x for x, _ in cells], [y for _, y in cells]
    frame = {(x, y) for x in range(min(xs) - 1, max(xs) + 2) for y in range(min(ys) - 1, max(ys) + 2)}
    outside = next(p for p in patches(frame - cells, FOUR) if (min(xs) - 1, min(ys) - 1) in p)
    return {c for c in cells if any((c[0] + a, c[1] + b) in outside for a, b in FOUR)}, frame - outside


def random_masks(seed, n, side=14):
    rng = np.random.default_rng(seed)
    for i in range(n):
        m = rng.random((rng.integers(1, side), rng.integers(1, side))) < rng.choice([0.15, 0.4, 0.6, 0.85])
        if i % 3 == 0 and min(m.shape) > 4:
            m[1:-1, 1:-1] = True
        yield m


def test_labels_borders_and_runs():
    for m in random_masks(1, 300):
        cells = {(x, y) for y, x in zip(*np.nonzero(m), strict=True)}
        want = sorted(map(sorted, patches(cells, EIGHT)))
        label = masks.labelled(m)
        got = sorted(sorted((x, y) for y, x in zip(*np.nonzero(label == i), strict=True)) for i in range(1, label.max() + 1))
        assert [list(map(tuple, g)) for g in got] == want
        assert (masks.from_runs(masks.run_lengths(m), *m.shape) == m).all()
        for i in range(1, label.max() + 1):
            own = {(x, y) for y, x in zip(*np.nonzero(label == i), strict=True)}
            ring = masks.border(label == i)
            edge, filled = outer_border(own)
            assert {tuple(p) for p in ring.tolist()} == edge
            steps = np.abs(np.roll(ring, -1, axis=0) - ring).max(1)
            assert len(ring) == 1 or (steps == 1).all()
            # A walk through middles that meets no pixel twice encloses, by Pick's theorem, all filled pixels.
            if len(edge) == len(ring) > 2:
                assert masks.twice_area(ring) == 2 * (len(filled) - len(ring)) + len(ring) - 2
            assert masks.twice_area(masks.corners(ring)) == masks.twice_area(ring)


def test_simplified_rings_stay_near():
    rng = np.random.default_rng(2)
    for _ in range(100):
        turn = np.sort(rng.random(rng.integers(3, 60))) * 2 * np.pi
        ring = np.round(np.stack([np.cos(turn), np.sin(turn)], 1) * rng.integers(3, 90, (len(turn), 1))).astype(int)
        tolerance = rng.random() * 10
        kept = masks.simplified(ring, tolerance)
        rows = [tuple(p) for p in ring.tolist()]
        places = [rows.index(tuple(p)) for p in kept.tolist()]
        assert set(places) <= set(range(len(ring)))
        if len(kept) > 1:
            chords = list(zip(kept, np.roll(kept, -1, axis=0), strict=True))
            for p in ring:
                assert min(abs((b - a)[0] * (p - a)[1] - (b - a)[1] * (p - a)[0]) / max(np.hypot(*(b - a)), 1e-9) for a, b in chords) <= tolerance + 1e-9


def test_mask_shapes_of_odd_rows(spark):
    m = np.zeros((20, 30), np.uint8)
    m[2:14, 3:25] = 1
    m[16:20, 0:4] = 7
    rows = [(1, m.tobytes(), 30, 20, "x"), (2, None, 30, 20, "x"), (3, b"", 0, 0, "x"), (4, bytes(600), 30, 20, "x"), (5, m.tobytes(), 30, 21, "x"), (None, m.tobytes(), 30, 20, "x"), (6, b"\1", 1, 1, None)]
    df = spark.createDataFrame(rows, "id long, mask binary, width int, height int, key string")
    got = {r.id: r for r in masks.shapes(df).collect()}
    assert tuple(got[1].box) == (0, 2, 24, 19) and got[1].pixels == 12 * 22 + 16 and got[1] [4:] == got[None][4:]
    assert sorted((p.x, p.y) for p in got[1].outline) == [(3, 2), (3, 13), (24, 2), (24, 13)] and (got[1].area, got[1].cx, got[1].cy) == (231.0, 13.5, 7.5)
    assert got[2][1:] == got[3][1:] == got[5][1:] == (None,) * 7
    assert got[4].pixels == 0 and got[4].runs == [] and got[4].box is None and got[6].runs == [1, 1] and got[6].outline is None
    assert masks.shapes(df.limit(0)).count() == 0


def test_green_shares_of_an_image_are_one_row(spark, t):
    rng = np.random.default_rng(6)
    pictures = [(i, rng.integers(0, 255, 30 * 20 * 3).astype(np.uint8).tobytes() if i else None, 30, 20) for i in range(4)]
    boxes = [(n, int(rng.integers(0, 5)), *(float(v) for v in rng.uniform(-8, 34, 4).round(1))) for n in range(200)] + [(200, 1, 0.0, 0.0, float("nan"), 9.0)]
    images, found = spark.createDataFrame(pictures, "asset_id long, pixels binary, width int, height int"), spark.createDataFrame(boxes, "id long, asset_id long, x1 double, y1 double, x2 double, y2 double")
    raw = {i: p for i, p, *_ in pictures}
    mask = lambda i, box: pixels.green_mask(raw[i], 30, 20, box) if raw[i] and not np.isnan(box).any() else np.zeros(0)
    want = {n: float(m.mean()) if (m := mask(i, box)).size else None for n, i, *box in boxes if i in raw}
    got = vegetation.green_shares(found, images).collect()
    assert {s.id: s.green for r in got for s in r.shares} == want and len(got) == 4 and None in want.values() and any(want.values())
    plan = lambda query: query(t)._jdf.queryExecution().toString()
    assert all("ArrowEvalPython" not in plan(q) for q in (rasters.green_fractions, rasters.green_thresholds))


def test_masks_of_boxes_and_run_lengths_are_not_drawn(spark, t):
    rng = np.random.default_rng(4)
    side = lambda n: int(rng.integers(-3, n + 4))
    rows = [(i, [(side(30), side(20), side(30), side(20)) for _ in range(rng.integers(0, 9))]) for i in range(300)] + [(300, None), (301, [(0, 0, 30, 20)])]
    df = spark.createDataFrame(rows, "id long, boxes array<struct<x1: int, y1: int, x2: int, y2: int>>").withColumns({"width": F.lit(30), "height": F.lit(20)})
    told = lambda found: sorted(map(repr, found.collect()))
    of = lambda made: masks.shapes(made, least_area=2.0)
    want = told(of(df.withColumn("mask", masks.drawn(F.col("boxes"), 30, 20))))
    assert told(of(df.withColumnRenamed("boxes", "mask"))) == want and sum("outline=None" not in r for r in want) > 100
    runs = masks.shapes(df.withColumnRenamed("boxes", "mask"), outlines=False)
    assert told(of(runs.select("id", F.col("runs").alias("mask"), F.lit(30).alias("width"), F.lit(20).alias("height")))) == want
    odd = spark.createDataFrame([(1, [595, 20, 1, 2, 2, 3]), (2, None), (3, [])], "id long, mask array<int>").withColumns({"width": F.lit(30), "height": F.lit(20)})
    assert {r.id: (r.runs, r.pixels) for r in masks.shapes(odd).collect()} == {1: ([1, 4, 595, 6], 10), 2: (None, None), 3: ([], 0)}
    null = spark.createDataFrame([(1, [None, (1, 1, 3, 2)])], df.select("id", F.col("boxes").alias("mask")).schema).withColumns({"width": F.lit(30), "height": F.lit(20)})
    assert masks.shapes(null).first().runs == [32, 2]
    for query in (rasters.mask_shapes, rasters.mask_outlines):
        assert "ArrowEvalPython" not in query(t)._jdf.queryExecution().toString()


def test_mask_outlines_of_the_whole_table(t):
    boxes = defaultdict(set)
    for r in t.detection.collect():
        boxes[r.asset_id] |= {(x, y) for x in range(r.x1 // 25, (r.x2 - 1) // 25 + 1) for y in range(r.y1 // 25, (r.y2 - 1) // 25 + 1)}
    found = {r.asset_id: r for r in rasters.mask_outlines(t).collect()}
    assert set(found) == set(boxes)
    big = 0
    for k, cells in boxes.items():
        want = max(len(outer_border(p)[1]) - len(outer_border(p)[0]) / 2 - 1 for p in patches(cells, EIGHT))
        ring = json.loads(found[k].outline) if found[k].outline else None
        if ring and len(patches(cells, EIGHT)) == len(cells):
            raise AssertionError("single pixels have no outline")
        if ring:
            big += 1
            at = np.array([(p["x"], p["y"]) for p in ring])
            assert found[k].area == masks.twice_area(at) / 2 and {tuple(p) for p in at.tolist()} <= cells
            assert (found[k].cx, found[k].cy) == tuple(at.mean(0)) and found[k].area >= 0.7 * want
        else:
            assert want < 5  # where a walk passes a pixel twice, its area is less than Pick's
    assert big > 150


def plants(t):
    """Pictures by image as sets of green pixels."""
    green = defaultdict(set)
    for r in t.detection.collect():
        x, y = (r.x1 + r.x2) // 100, (r.y1 + r.y2) // 100
        green[r.asset_id] |= {(a, b) for a in range(max(0, x - 2), min(80, x + 2)) for b in range(max(0, y - 2), min(60, y + 2))}
    return green


def test_recentred_candidates_of_the_whole_table(t):
    green, want = plants(t), []
    for r in t.detection.collect():
        x = (r.x1 + r.x2) // 100 + r.detection_id % 5 - 2 + (9 if r.detection_id % 3 == 0 else 0)
        y = (r.y1 + r.y2) // 100 - r.detection_id % 4
        l, u, e, d = max(0, x - 6), max(0, y - 6), min(80, x + 6), min(60, y + 6)
        own = {(a, b) for a, b in green[r.asset_id] if l <= a < e and u <= b < d}
        share = len(own) / ((e - l) * (d - u))
        if share < 0.08:
            continue
        best = max(patches(own, FOUR), key=lambda p: (len(p), -max(b * 100 + a for a, b in p)))
        if len(best) >= max(3, 0.005 * (e - l) * (d - u)):
            px, py = (sum(c) / len(best) + 0.5 for c in zip(*best, strict=True))
            nx, ny = (max(0, min(most - 12, int(np.floor(p - 6 + 0.5)))) for p, most in ((px, 80), (py, 60)))
            want.append((r.asset_id, r.detection_id, nx, ny, nx + 12, ny + 12, round(px, 9), round(py, 9), True))
        else:
            want.append((r.asset_id, r.detection_id, x - 6, y - 6, x + 6, y + 6, float(x), float(y), False))
    got = [(r.asset_id, r.id, r.x1, r.y1, r.x2, r.y2, round(r.px, 9), round(r.py, 9), r.moved) for r in rasters.recentred_candidates(t).collect()]
    assert sorted(got) == sorted(want) and len(want) > 3000


def test_clean_masks_of_the_whole_table(t):
    by_image = defaultdict(list)
    for r in t.detection.collect():
        by_image[r.asset_id].append((-(r.confidence or 0.0), r.detection_id, (r.x1 + r.x2) // 2, (r.y1 + r.y2) // 2, 60 + r.detection_id % 20, 50 + r.detection_id % 15))
    kept = []
    for k, rows in by_image.items():
        own = []
        for c, i, x, y, a, b in sorted(rows):  # a diamond about its own plant is green
            ring = np.array([(x, y - b), (x + a, y), (x, y + b), (x - a, y)]) / 50
            if not any(max(geometry.sampled_overlaps(ring, o)) >= 0.5 and (geometry.sampled_overlaps(ring, o)[0] >= 0.5 or geometry.sampled_overlaps(ring, o)[1] >= 0.7) for o in own):
                own.append(ring)
                kept.append((k, i))
    assert sorted((r.asset_id, r.id) for r in rasters.clean_masks(t).collect()) == sorted(kept)


def test_vegetation_of_odd_rows(spark):
    picture = bytes([40, 160, 40]) * 50 + bytes([150, 120, 90]) * 50
    shown = spark.createDataFrame([(1, bytearray(picture), 10, 10), (2, None, 10, 10), (3, bytearray(b"short"), 10, 10)], "asset_id long, pixels binary, width int, height int")
    rows = [(k, i, None, *b) for k in (1, 2, 3, 4, None) for i, b in enumerate([(0.0, 0.0, 4.0, 10.0), (0.0, 6.0, 4.0, 10.0), (-9.0, -9.0, -1.0, -1.0), (8.0, 0.0, 30.0, 3.0)])]
    c = spark.createDataFrame(rows, "asset_id long, id long, confidence double, x1 double, y1 double, x2 double, y2 double")
    got = {r.id: r for r in vegetation.gate_candidates(c, shown, 0.2).collect()}
    assert set(got) == {0, 3} and got[0].green == 0.5 and (got[0].px, got[0].py, got[0].y1) == (2.0, 2.5, 0.0) and got[3].green == 1.0
    assert vegetation.gate_candidates(c.limit(0), shown, 0.2).count() == 0
    p = lambda *at: [{"x": float(x), "y": float(y)} for x, y in at]
    rings = [(1, 1, 0.5, p((0, 0), (6, 0), (6, 4), (0, 4))), (1, 2, 0.9, p((0, 0), (6, 0), (6, 5), (0, 5))), (1, 3, None, p((7, 0), (9, 0), (9, 3))), (1, 4, 0.8, p((0, 6), (9, 6), (9, 9))), (1, 5, 0.8, None), (1, 6, 0.7, p((1, 1)))]
    kept = vegetation.clean_masks(spark.createDataFrame(rings, "asset_id long, id long, confidence double, ring array<struct<x: double, y: double>>"), shown, 0.4)
    assert sorted(r.id for r in kept.collect()) == [2, 3]
    s = vegetation.green_summary(kept).first()
    assert (s.masks, s.median, s.alarm) == (2, 1.0, False)


def test_terrain_of_odd_rows(spark):
    schema = "id long, x double, y double, lat double, lon double, camera struct<f: double, cx: double, cy: double, from_fov: boolean>, pitch double, roll double, yaw double, laser double, given double, relative double, takeoff double, absolute double, target double"
    base = (50.0, 50.0, -27.0, 153.0, (100.0, 50.0, 50.0, False), -90.0, 0.0, 0.0)
    nan = float("nan")
    rows = [
        (1, *base, 12.0, 99.0, None, None, None, None), (2, *base, -1.0, 30.0, None, None, None, None), (3, *base, None, None, 40.0, None, None, None), (4, *base, None, None, 40.0, 25.0, None, None), (5, *base, None, None, nan, None, 95.0, None),
        (6, *base, None, None, None, None, 40.0, None), (7, *base, *[None] * 6), (8, *base[:5], -1.0, 0.0, 0.0, None, 30.0, None, None, None, None), (9, *base[:2], None, None, *base[4:], None, 30.0, None, None, None, None), (10, *base[:2], 10.0, 153.0, *base[4:], None, None, None, None, 90.0, None),
    ]
    df = spark.createDataFrame(rows, schema)
    grid = spark.createDataFrame([(-54000, 306000, 20.0), (-54000, 306000, 22.0), (None, 1, 3.0)], "cy long, cx long, elevation double")
    got = {r.id: (r.height, r.method, ",".join(r.flags)) for r in terrain.ground_places(df, grid, 0.0005).collect()}
    assert got == {
        1: (12.0, "lrf", ""), 2: (30.0, "provided_height", ""), 3: (40.0, "relative_altitude_dem", "takeoff_reference_unknown"), 4: (45.0, "relative_altitude_dem", ""), 5: (45.0, "absolute_altitude_geoid_dem", ""),
        6: (None, "absolute_altitude_geoid_dem", ""), 7: (100.0, "default_altitude", "default_altitude"), 8: (None, "provided_height", ""), 9: (None, "provided_height", ""), 10: (100.0, "default_altitude", "estimated_elevation,default_altitude"),
    }
    assert terrain.ground_places(df.limit(0), grid, 0.0005).count() == 0


def test_image_files(spark, tmp_path):
    big = struct.pack(">HI", 42, 8)
    tiff = b"MM" + big + struct.pack(">H", 3) + struct.pack(">HHIHxx", 256, 3, 1, 640) + struct.pack(">HHII", 257, 4, 1, 480) + struct.pack(">HHII", 700, 1, 18, 50) + bytes(4) + b'<r a:Focal="1.5"/> \0'
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + bytes(4)
    png = images.PNG_MARK + chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 9, 8, 2, 0, 0, 0)) + chunk(b"eXIf", exif_block(7, 9, 1.5, -2.25, -3.0)) + chunk(b"iTXt", b"XML:com.adobe.xmp\0\0\0\0\0" + xmp_packet({"A": "x & y"})) + chunk(b"IDAT", b"") + chunk(b"iTXt", b"")
    whole = jpeg_head(40, 30, -27.5, 153.25, None, {"GimbalPitchDegree": "-90"})
    files = {"a.tif": tiff, "b.png": png, "c.jpg": whole, "d.jpg": whole[:60], "e.jpg": b"", "f.png": b"text", "g.jpg": whole[:30] + b"\xff" * 40 + whole[70:], "h.txt": whole}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: r for r in images.image_metadata(spark, str(tmp_path)).collect()}
    assert set(got) == set(files) - {"h.txt", "e.jpg"}  # Spark lists no empty files
    assert (got["a.tif"].width, got["a.tif"].height, got["a.tif"].problem) == (640, 480, None) and got["a.tif"].xmp == {"Focal": "1.5"}
    assert (got["b.png"].width, got["b.png"].height) == (7, 9) and got["b.png"].xmp == {"A": "x & y"} and {k: float(v) for k, v in got["b.png"].exif.items() if k.startswith("GPS")} == {"GPSLatitude": 1.5, "GPSLongitude": -2.25, "GPSAltitude": -3.0}
    assert float(got["c.jpg"].exif["GPSLatitude"]) == -27.5 and "GPSAltitude" not in got["c.jpg"].exif and got["c.jpg"].problem is None
    assert all(got[n].problem for n in ("d.jpg", "f.png")) and images.parse(b"")[4]
    for i in range(len(whole)):  # no cut or flip of a byte stops a job
        images.parse(whole[:i])
        images.parse(whole[:i] + bytes([whole[i] ^ 0xFF]) + whole[i + 1 :])
        images.parse(tiff[: i % len(tiff)])
        images.parse(png[: i % len(png)])


def test_ingest_order_and_profile(spark):
    rows = [
        (1, {"GPSLatitude": "-27.5", "GPSLongitude": "153", "GPSAltitude": "60000", "ExifImageWidth": "4000"}, {"RelativeAltitude": "+30.0", "GpsLatitude": "1", "GimbalPitchDegree": "-80", "LRFTargetDistance": "9", "LRFTargetLat": "99", "LRFTargetLon": "1"}),
        (2, {}, {"RelativeAltitude": "5", "CalibratedX": "1", "gpslatitude": "-20", "GpsLongitude": "140"}),
        (3, {"GPSLatitude": "-27.5"}, {}), (4, None, None),
    ]
    df = spark.createDataFrame([(*r, (2.0, None, None, None, 1.2, 5.0) if r[0] == 1 else None) for r in rows], "id long, exif map<string,string>, xmp map<string,string>, profile struct<focal: double, centre_x: double, centre_y: double, fov_scale: double, altitude_scale: double, yaw_offset: double>")
    got = {r.id: r for r in metadata.ingest(df, profile="profile").collect()}
    a = got[1].asset
    assert (a.lat, a.lon, round(a.altitude, 9), a.width, a.pitch, a.laser_distance, a.laser_lat) == (-27.5, 153.0, 36.0, 4000.0, -80.0, 9.0, None) and a.warnings == ["bad altitude in EXIF", "bad laser target"]
    assert got[1].full_metadata["CalibratedFocalLength"] == "2.0" and got[1].full_metadata["GeoAltitudeScale"] == "1.2" and "GeoFovScale" not in got[1].full_metadata
    assert (got[2].asset.lat, got[2].asset.lon, got[2].asset.altitude) == (-20.0, 140.0, 5.0)
    assert got[3].asset.lat is None and got[3].asset.warnings == ["no position in EXIF"] and got[4].asset.warnings == ["no position in EXIF"]


def rings_of(cells):
    """Outer rings and holes of a set of cells: patches by sides, and holes of the complement by sides and corners."""
    parts = patches(cells, FOUR)
    holes = 0
    for p in parts:
        xs, ys = [x for x, _ in p], [y for _, y in p]
        frame = {(x, y) for x in range(min(xs) - 1, max(xs) + 2) for y in range(min(ys) - 1, max(ys) + 2)}
        holes += len(patches(frame - p, EIGHT)) - 1
    return len(parts), holes


def test_dissolved_cells(spark):
    rng = np.random.default_rng(3)
    shape = {k: {(int(x), int(y)) for x, y in zip(*np.nonzero(rng.random((n, n)) < share), strict=True)} for k, (n, share) in enumerate([(1, 1.0), (3, 1.0), (12, 0.5), (15, 0.7), (20, 0.85), (9, 0.3)])}
    shape[6] = {(x, y) for x in range(-4, 5) for y in range(-4, 5)} - {(x, y) for x in range(-2, 3) for y in range(-2, 3)} | {(0, 0)}
    rows = [(k, y, x) for k, cells in shape.items() for x, y in cells]
    df = spark.createDataFrame(rows + rows[:9] + [(None, 1, 1), (0, None, 3)], "survey_id long, cy long, cx long")
    found = defaultdict(list)
    for r in footprints.dissolved(df, "survey_id").collect():
        ring = np.array([(p.x, p.y) for p in r.ring])
        turned = np.roll(ring, -1, axis=0)
        assert (ring[:, 0] * turned[:, 1] - turned[:, 0] * ring[:, 1]).sum() == 2 * r.area and np.abs(turned - ring).sum() == r.edges
        found[r.survey_id].append(r)
    assert set(found) == set(shape)
    for k, cells in shape.items():
        outer, holes = rings_of(cells)
        assert sum(r.area for r in found[k]) == len(cells)
        assert (sum(r.area > 0 for r in found[k]), sum(r.area < 0 for r in found[k])) == (outer, holes)
        assert sum(r.edges for r in found[k]) == sum((x + a, y + b) not in cells for x, y in cells for a, b in FOUR)
        own = defaultdict(int)
        for r in found[k]:
            own[r.part] += r.area
        assert sorted(own.values()) == sorted(map(len, patches(cells, FOUR)))
    text = {r.survey_id: json.loads(r.geometry) for r in footprints.multipolygons(footprints.dissolved(df, "survey_id"), "survey_id", 0.5).collect()}
    assert [len(p) for p in sorted(text[6]["coordinates"], key=len)] == [1, 2] and text[1]["coordinates"][0][0] == [[0, 0], [1.5, 0], [1.5, 1.5], [0, 1.5], [0, 0]]
    assert footprints.dissolved(df.limit(0), "survey_id").count() == 0


def test_footprint_shapes_have_the_footprints_cells(spark):
    t = Bridge(spark, SF)
    cells = {(r.project_id, r.survey_id): r.cells for r in shapes.footprint_rings(t).collect()}
    assert {(r.project_id, r.survey_id): r.cells for r in shapes.footprint_shapes(t).collect()} == cells


def test_written_heads_are_read_back(spark, tmp_path):
    rows = [("a", 10, 20, 1.25, -2.5, -3.0, {"x": "1"}), ("b", 10, 20, None, None, None, None)]
    df = spark.createDataFrame(rows, "name string, width int, height int, lat double, lon double, altitude double, xmp map<string,string>")
    for _ in range(2):  # a repeated task replaces its files
        assert write_image_heads(df, f"file://{tmp_path}/i").agg(F.count("*")).first()[0] == 2
    got = {r.path[-5]: r for r in images.image_metadata(spark, f"{tmp_path}/i").collect()}
    assert (got["a"].width, got["a"].height, got["a"].xmp) == (10, 20, {"x": "1"}) and float(got["a"].exif["GPSAltitude"]) == -3.0 and set(got["b"].exif) == {"ExifImageWidth", "ExifImageHeight"}


def test_masks_and_pictures_leave_kernels_in_chunks():
    from collections.abc import Iterator

    import pandas as pd

    from fieldgrid.operators import masks
    from fieldgrid.plans import rasters

    pieces = list(masks.chunked(iter([pd.Series(range(10)), pd.Series([], dtype=object), pd.Series([3])]), 4, lambda v: bytes([v])))
    assert [len(p) for p in pieces] == [4, 4, 2, 1] and b"".join(x for p in pieces for x in p) == bytes([*range(10), 3])
    found = rasters._painted.func(iter([pd.Series([b"\0\1"] * 600)]))
    assert isinstance(found, Iterator)
    pictures = list(found)
    assert [len(p) for p in pictures] == [256, 256, 88] and set(pictures[0]) == {bytes([150, 120, 90, 40, 160, 40])}


def test_boxes_and_rings_together_are_as_one_by_one():
    rng = np.random.default_rng(3)
    sizes = [(80, 60), (300, 20), (7, 90), (1, 1)]
    pictures = [rng.choice(np.array([[40, 160, 40], [150, 120, 90], [0, 0, 0]], np.uint8), w * h, p=(0.55, 0.4, 0.05)).tobytes() for w, h in sizes]
    base = np.cumsum([0, *map(len, pictures[:-1])])
    own = rng.integers(0, len(sizes), 600)
    width, height = np.array(sizes)[own].T
    low = np.stack([width, height], 1) * rng.uniform(-0.3, 1.0, (600, 2))
    boxes = np.concatenate([low, low + rng.choice([1, 8, 40, 400], (600, 1)) * rng.uniform(0, 1, (600, 2))], 1)
    boxes[:3] = (0, 0, 300, 90), (0, 0, np.inf, np.inf), (np.nan, 0, 5, 5)
    many = pixels.Boxes(np.frombuffer(b"".join(pictures), np.uint8), base[own], width, height, boxes)
    shares, centres = many.shares(), many.centres()
    assert shares[2] == 0 and np.isnan(centres[2]).all()
    for i in set(range(600)) - {1, 2}:
        mask = pixels.green_mask(pictures[own[i]], *sizes[own[i]], boxes[i])
        centre = pixels.patch_centre(pictures[own[i]], *sizes[own[i]], boxes[i])
        assert shares[i] == (mask.mean() if mask.size else 0.0)
        assert tuple(centres[i]) == centre if centre else np.isnan(centres[i]).all()
    count = rng.integers(0, 7, 600)
    points = np.repeat(low, count, 0) + rng.choice([3, 30, 300], count.sum())[:, None] * rng.uniform(0, 1, (count.sum(), 2))
    rings = geometry.Rings(points, np.cumsum(count) - count, count)
    split = np.split(points, np.cumsum(count)[:-1])
    for n in range(3, 7):
        at = np.flatnonzero(count == n)
        got = pixels.ring_shares(np.frombuffer(b"".join(pictures), np.uint8), base[own[at]], width[at], height[at], rings.stack(at))
        assert got.tolist() == [pixels.ring_share(pictures[own[i]], *sizes[own[i]], split[i]) for i in at]
    a, b = rng.integers(0, 600, (2, 3000))
    assert list(zip(*map(np.ndarray.tolist, rings.overlaps(a, b)), strict=True)) == [geometry.sampled_overlaps(split[i], split[k]) for i, k in zip(a, b, strict=True)]


def test_vegetation_of_sides_and_points_without_numbers(spark):
    shown = spark.createDataFrame([(1, bytearray([40, 160, 40] * 100), 10, 10)], "asset_id long, pixels binary, width int, height int")
    rows = [(1, 1, 0.5, None, 0.0, 4.0, 4.0), (1, 2, 0.5, 0.0, 0.0, float("nan"), 4.0), (1, 3, None, 0.0, 0.0, 4.0, 4.0)]
    c = spark.createDataFrame(rows, "asset_id long, id long, confidence double, x1 double, y1 double, x2 double, y2 double")
    assert [(r.id, r.confidence, r.green) for r in vegetation.gate_candidates(c, shown, 0.2).collect()] == [(3, None, 1.0)]
    p = lambda *at: [{"x": x, "y": y} for x, y in at]
    rings = [(1, 1, 0.5, p((0.0, 0.0), (6.0, None), (6.0, 4.0))), (1, 2, 0.9, p((0.0, 0.0), (6.0, 0.0), (6.0, 5.0))), (1, 3, 0.9, [None, *p((6.0, 0.0), (6.0, 5.0))])]
    kept = vegetation.clean_masks(spark.createDataFrame(rings, "asset_id long, id long, confidence double, ring array<struct<x: double, y: double>>"), shown, 0.4)
    assert [r.id for r in kept.collect()] == [2]


def test_metadata_is_made_and_parsed_once(spark):
    df = spark.range(4).withColumns({"w": F.lit(4000), "up": F.lit(30.0)})
    made = F.create_map(F.lit("FieldOfView"), F.when(F.col("id") > 0, F.lit("NaN")), F.lit("FOV"), F.lit(" 70 "), F.lit("GimbalPitchDegree"), F.lit("0"), F.lit("ImageWidth"), F.lit("Infinity"), F.lit("imageWidth"), F.lit("5000"))
    for c, names in ((metadata.asset_camera(F.col("w"), F.col("w"), F.col("up"), F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(None).cast("double"), made), ("fov", "width")), (metadata.exif_camera(made), ("pitch",))):
        found = df.select("id", c.alias("c"))
        assert found._jdf.queryExecution().optimizedPlan().toString().count("map(FieldOfView") == 1
        got = {tuple(r.c[n] for n in names) for r in found.collect()}
        assert got == ({(70.0, 5000.0)} if len(names) == 2 else {(-90.0,)})
