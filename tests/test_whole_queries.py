"""Registered queries without SQL, over their whole tables, against plain-Python restatements."""

import math
import random
from collections import Counter, defaultdict, namedtuple

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldgrid.operators import planning, resolution, spatial, temporal
from fieldgrid.plans import analytics, flows, quality, registry
from fieldgrid.sources.bridge import Bridge
from fieldgrid.streaming import results

SF = "/root/testdata/sf0.001"
R = 6_371_000.0


@pytest.fixture(scope="module")
def t(spark):
    return Bridge(spark, SF)


def reviewed(t):
    return [r for r in t.detection.collect() if not r.rejected and (r.verified or r.user_corrected) and r.confidence is not None and r.confidence >= 0.45]


@pytest.fixture(scope="module")
def good(t):
    return reviewed(t)


def far(a, b, radius=R):
    """Metres from one place (lat, lon) to rows of places."""
    a, b = np.radians(np.array(a, float)), np.radians(np.atleast_2d(np.array(b, float)))
    s = np.sin((b[:, 0] - a[0]) / 2) ** 2 + np.cos(a[0]) * np.cos(b[:, 0]) * np.sin((b[:, 1] - a[1]) / 2) ** 2
    return 2 * radius * np.arctan2(np.sqrt(s), np.sqrt(1 - s))


def greedy(costs):
    """Pairs taken from (cost, a, b) in order, each side once."""
    used, out = set(), {}
    for c, a, b in sorted(costs):
        if (0, a) not in used and (1, b) not in used:
            used |= {(0, a), (1, b)}
            out[a, b] = c
    return out


def pairs(left, right, reach, same=lambda a, b: True):
    """All pairs within reach; only rows of nearly the latitude are measured."""
    right = sorted(right, key=lambda b: b.lat)
    at = np.array([(b.lat, b.lon) for b in right])
    out = []
    for a in left:
        lo, hi = np.searchsorted(at[:, 0], [a.lat - reach / 111_000, a.lat + reach / 111_000])
        d = far((a.lat, a.lon), at[lo:hi]) if hi > lo else np.zeros(0)
        out += [(float(d[i]), a, right[lo + i]) for i in np.flatnonzero(d <= reach).tolist() if same(a, right[lo + i])]
    return out


def test_survey_f1(t, good):
    base, other = ([r for r in good if r.survey_id == s] for s in ("baseline", "comparison"))
    hits = len(greedy((d, a.detection_id, b.detection_id) for d, a, b in pairs(base, other, 3.0)))
    r = quality.survey_f1(t).first()
    assert (r.predicted, r.surveyed, r.matched) == (len(base), len(other), hits) and hits
    assert math.isclose(r.f1, 2 * hits / (len(base) + len(other)))


def test_temporal_queries(spark):
    t = Bridge(spark, "/root/testdata/sf0.01")  # the smallest tables have no match
    good = reviewed(t)
    columns = ("detection_id", "class_name", "confidence", "lat", "lon", "asset_id", "created_at")
    signal = namedtuple("signal", columns)
    base, other = (one_of_each([signal(*(r[c] for c in columns)) for r in good if r.survey_id == s]) for s in ("baseline", "comparison"))
    near = pairs(base, other, 3.0, lambda a, b: a.class_name == b.class_name)
    taken = greedy((0.7 * d / 8, a.detection_id, b.detection_id) for d, a, b in near)
    want = Counter(("PERSISTENT", a, b) for a, b in taken)
    used_a, used_b = {a for a, _ in taken}, {b for _, b in taken}
    images = [(r.gps_lat, r.gps_lon, max(12.0, min(80.0, r.altitude * math.tan(math.radians(84) / 2)))) for r in t.asset.collect() if r.survey_id == "comparison"]
    reach = np.array([i[2] for i in images])
    for r in base:
        if r.detection_id not in used_a:
            want["RESOLVED" if (far((r.lat, r.lon), [i[:2] for i in images]) <= reach).any() else "UNOBSERVED", r.detection_id, None] += 1
    want += Counter(("NEW", None, r.detection_id) for r in other if r.detection_id not in used_b)
    changes = analytics.temporal_changes(t).cache()
    found = changes.collect()
    assert Counter((r.change_type, r.baseline_id, r.comparison_id) for r in found) == want and taken
    place = {r.detection_id: (r.lat, r.lon) for r in other}
    everywhere = np.array([*place.values()])
    for r in [r for r in found if r.comparison_id is not None][:300]:
        n = int((far(place[r.comparison_id], everywhere) <= 15).sum()) - 1
        risk = min(1.0, max(0.0, 0.6 * r.confidence + 0.3 * min(1.0, n / 5) + (0.2 if r.change_type == "PERSISTENT" else 0.0)))
        assert abs(r.risk - risk) < 1e-9
    totals = temporal.summary(changes).collect()
    kinds = Counter(r.change_type for r in found)
    assert [sum(r[c] for r in totals) for c in ("n_new", "n_persistent", "n_resolved", "n_unobserved")] == [kinds[k] for k in ("NEW", "PERSISTENT", "RESOLVED", "UNOBSERVED")]
    spots = temporal.hotspots(changes).collect()
    assert sum(s["items"] for s in spots) == len(other) and all(0 <= s.priority <= 1 for s in spots)


def one_of_each(rows):
    best = {}
    for r in rows:
        key = tuple((v is not None, v) for v in r[1:])
        if r[0] not in best or key < best[r[0]][0]:
            best[r[0]] = key, r
    return [r for _, r in best.values()]


def duplicate_leaders(rows, reach=1.8):
    """Seeds in order; each takes what is near all its members and of another image. Only rows of nearly a seed's latitude are measured."""
    rows = sorted(rows, key=lambda r: (-(r[3] or 0.0), r[6], r[0]))
    at = np.array([(r[4], r[5]) for r in rows])
    north = np.argsort(at[:, 0], kind="stable")
    lats = at[north, 0]
    leader, left = {}, set(range(len(rows)))
    for i, seed in enumerate(rows):
        if i not in left:
            continue
        members = [i]
        near = np.sort(north[slice(*np.searchsorted(lats, [at[i, 0] - reach / 100_000, at[i, 0] + reach / 100_000]))])
        for j in near[far(at[i], at[near]) <= reach].tolist():
            r = rows[j]
            if j in left and j != i and r[2] == seed[2] and all(rows[m][1] != r[1] for m in members) and (far(at[j], at[members]) <= reach).all():
                members.append(j)
        left -= set(members)
        leader |= {rows[m][0]: seed[0] for m in members}
    return leader


@pytest.fixture(scope="module")
def larger(spark):
    """Tables that have groups of duplicates, their good rows, and the leader of each of their ids."""
    t = Bridge(spark, "/root/testdata/sf0.01")
    good = reviewed(t)
    columns = ("detection_id", "asset_id", "class_name", "confidence", "lat", "lon", "created_at")
    return t, good, duplicate_leaders(one_of_each([tuple(r[c] for c in columns) for r in good]))


def test_deduplicated_detections(larger):
    t, good, leader = larger
    members = Counter(leader[r.detection_id] for r in good)
    got = analytics.deduplicated_detections(t).collect()
    found = {r.id: r.members for r in got}
    assert found == members and sum(n > 1 for n in Counter(leader.values()).values()) > 5
    places = defaultdict(list)
    for r in good:
        places[leader[r.detection_id]].append((max(r.confidence, 0.05), r.lat, r.lon))
    for r in got:
        w = sum(p[0] for p in places[r.id])
        assert math.isclose(r.lat, sum(p[0] * p[1] for p in places[r.id]) / w, rel_tol=1e-12) and math.isclose(r.lon, sum(p[0] * p[2] for p in places[r.id]) / w, rel_tol=1e-12)


def biases(rows, leader, least_points, least_anchors, most=1.6, metres=111_111.0):
    """Shifts (lat, lon) of images: rows are (id, image, confidence, lat, lon)."""
    groups, images = defaultdict(list), defaultdict(list)
    for r in rows:
        groups[leader[r[0]]].append(r)
        images[r[1]].append(r)
    mean = {k: [sum(max(r[2], 0.05) * r[i] for r in g) / sum(max(r[2], 0.05) for r in g) for i in (3, 4)] for k, g in groups.items() if len(g) > 1}
    own = {}
    for image, found in images.items():
        tied = [(max(r[2], 0.05), (mean[leader[r[0]]][0] - r[3]) * metres, (mean[leader[r[0]]][1] - r[4]) * metres * math.cos(math.radians(r[3])), r[3]) for r in found if leader[r[0]] in mean]
        if len(found) >= least_points and len(tied) >= least_anchors:
            w = sum(x[0] for x in tied)
            own[image] = [sum(x[0] * x[1] for x in tied) / w, sum(x[0] * x[2] for x in tied) / w, len(tied), sum(x[3] for x in tied) / len(tied)]
    total = sum(o[2] for o in own.values())
    g = [sum(o[i] * o[2] for o in own.values()) / total for i in (0, 1)] if own else []
    out = {}
    for image, (dy, dx, _, lat) in own.items():
        dy, dx = dy - g[0], dx - g[1]
        fit = min(1.0, most / max(math.hypot(dx, dy), 1e-12))
        out[image] = dy * fit / metres, dx * fit / (metres * math.cos(math.radians(lat)))
    return out


def test_image_biases(larger):
    t, good, leader = larger
    rows = [(r.detection_id, r.asset_id, r.confidence, r.lat, r.lon) for r in good]
    found = analytics._good(t).withColumnRenamed("detection_id", "id").select("id", "asset_id", "class_name", "confidence", "lat", "lon", "created_at")
    want = biases(rows, leader, 1, 1)
    got = {r.asset_id: (r.shift_lat, r.shift_lon) for r in resolution.image_bias(found, least_points=1, least_anchors=1).collect()}
    assert set(got) == set(want) and len(want) > 10
    assert all(abs(a - b) < 1e-12 for k in want for a, b in zip(got[k], want[k], strict=True))
    assert {r.asset_id for r in analytics.image_biases(t).collect()} == set(biases(rows, leader, 4, 3))


def test_counted_objects(t, good):
    means, leader = [], Counter()
    for i, lat, lon, _ in sorted(one_of_each([(r.detection_id, r.lat, r.lon, r.created_at) for r in good]), key=lambda r: (-r[3].toordinal(), r[0])):
        near = np.flatnonzero(far((lat, lon), [m[:2] for m in means], 6_371_008.8) <= 2.0) if means else []
        if len(near):
            m = means[near[0]]
            m[0], m[1], m[2] = (m[0] * m[2] + lat) / (m[2] + 1), (m[1] * m[2] + lon) / (m[2] + 1), m[2] + 1
        else:
            means.append(m := [lat, lon, 1, i])
        leader[m[3]] += 1
    assert {r.leader: r.n for r in analytics.counted_objects(t).collect()} == leader and max(leader.values()) > 1


def hull_area(points):
    points = sorted(set(points))
    if len(points) < 3:
        return 0.0

    def chain(seq):
        out = []
        for p in seq:
            while len(out) >= 2 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    ring = chain(points) + chain(points[::-1])
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))) / 2


def test_treatment_zones(t, good):
    plan = planning.Plan()
    groups = defaultdict(list)
    for r in good:
        groups[r.project_id, r.class_name.lower()].append(r)
    want = Counter()
    for key, rows in groups.items():
        lat0, lon0 = (sum(round(getattr(r, c) * 1e9) for r in rows) / len(rows) / 1e9 for c in ("lat", "lon"))
        local = [((r.lon - lon0) * 111_320 * math.cos(math.radians(lat0)), (r.lat - lat0) * 111_320) for r in rows]
        cells = defaultdict(list)
        for x, y in local:
            cells[math.floor(x / plan.cell_m), math.floor(y / plan.cell_m)].append((x, y))
        left = set(cells)
        while left:
            stack, part = [left.pop()], []
            while stack:
                c = stack.pop()
                part += cells[c]
                beside = {(c[0] + i, c[1] + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & left
                left -= beside
                stack += beside
            if len(part) >= plan.least_detections:
                area = hull_area(part) or (2 * max(4.0, plan.cell_m / 2)) ** 2
                want[(*key, len(part), round(max(0.0001, area / 10_000), 6))] += 1
    got = Counter((r.project_id, r.species_key, r.detections, round(r.area_ha, 6)) for r in analytics.treatment_zones(t).collect())
    assert sum(got.values()) == sum(want.values()) and sum((got & want).values()) >= 0.98 * sum(want.values())  # roundings of the sixth place may differ


def tour(order, places, back):
    path = [places[0], *(places[i] for i in order), *([places[0]] if back else [])]
    return sum(float(far(a, [b])[0]) for a, b in zip(path[:-1], path[1:], strict=True))


def test_treatment_missions(t):
    plan = planning.Plan()
    zones = defaultdict(list)
    for z in analytics.treatment_zones(t).collect():
        zones[z.project_id].append(z)
    starts = {p.project_id: (p.center_lat, p.center_lon) for p in t.project.collect()}
    got = defaultdict(list)
    for r in analytics.treatment_missions(t).collect():
        got[r.project_id, r.mission].append(r)
    for project, own in list(zones.items())[:8]:
        own = sorted(own, key=lambda z: (-z.priority, z.sequence))
        number = 0
        while own:
            number += 1
            stops = [own.pop(0)]
            while own and len(stops) < plan.zones:
                here, rest = starts[project], list(stops)
                while rest:
                    last = min(rest, key=lambda z: float(far(here, [(z.centroid_lat, z.centroid_lon)])[0]))
                    rest.remove(last)
                    here = (last.centroid_lat, last.centroid_lon)
                fits = [z for z in own if sum(s.area_ha for s in stops) + z.area_ha <= plan.area_ha and sum(s.litres for s in stops) + z.litres <= plan.litres]
                if not fits:
                    break
                own.remove(nearest := min(fits, key=lambda z: float(far(here, [(z.centroid_lat, z.centroid_lon)])[0])))
                stops.append(nearest)
            mission = sorted(got[project, number], key=lambda r: r.stop)
            assert {r.sequence for r in mission} == {z.sequence for z in stops}
            at = {z.sequence: (z.centroid_lat, z.centroid_lon) for z in stops}
            places = [starts[project], *(at[r.sequence] for r in mission)]
            length = tour(range(1, len(places)), places, plan.return_to_start)
            assert math.isclose(mission[0].distance_m, length, rel_tol=1e-9, abs_tol=1e-6) and mission[0].distance_m <= mission[0].distance_before_m + 1e-6
            if len(mission) >= 4:  # no reversal of a stretch gains more than the least gain, or eight sweeps were made
                gains = [length - tour([*range(1, i), *range(k, i - 1, -1), *range(k + 1, len(places))], places, plan.return_to_start) for i in range(1, len(mission)) for k in range(i + 1, len(mission) + 1)]
                assert max(gains) <= 0.1 + 1e-6
    assert sum(len(v) for v in got.values()) == sum(map(len, zones.values()))


def test_covered_places_anywhere_on_the_globe(spark):
    rng = np.random.default_rng(1)
    signals, images = [], []
    for k, (lat, lon) in enumerate([(-27, 153), (0, 179.9999), (89.9995, 10), (-89.9999, -170), (60, 5)]):
        at = lambda lat=lat, lon=lon: (float(np.clip(lat + rng.normal() * 0.0015, -90, 90)), float((lon + rng.normal() * 0.0015 / max(math.cos(math.radians(lat)), 0.01) + 180) % 360 - 180))
        signals += [(k * 1000 + i, *at()) for i in range(200)]
        images += [(len(images) + i, *at(), float(rng.integers(5, 90)), 84.0) for i in range(40)]
    reach = np.clip(np.array([r[3] for r in images]) * math.tan(math.radians(42)), 12, 80)
    want = {i for i, lat, lon in signals if (far((lat, lon), [r[1:3] for r in images]) <= reach).any()}
    found = temporal.covered(spark.createDataFrame([*signals, (99_999, None, 1.0)], "id long, lat double, lon double"), spark.createDataFrame([*images, (-1, None, None, 1.0, 84.0)], "asset_id long, gps_lat double, gps_lon double, altitude double, camera_fov double"))
    assert sorted(r.id for r in found.collect()) == sorted(want) and 300 < len(want) < 990


def test_places_of_signals_are_computed_once(spark):
    plan = registry.QUERIES["survey_signals"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("zip_with(") == 2  # the rings of labels by hand and of suggestions


def test_batches_of_a_stream_have_files_for_several_tasks(spark, monkeypatch):
    seen, fold = [], results.fold_batch
    monkeypatch.setattr(flows.results, "fold_batch", lambda batch, number, path: (seen.append((number, batch.select(F.input_file_name()).distinct().count())), fold(batch, number, path)))
    flows._streamed(registry.Bridge(spark, "/root/testdata/sf0.001"))
    many = max(1, spark.sparkContext.defaultParallelism // 2)
    assert seen == [(n, many) for n in range(4) for _ in range(2)]


def test_large_islands_are_matched_by_halves_of_the_distance(spark, monkeypatch):
    rng = random.Random(9)
    made = lambda first: spark.createDataFrame([(first + i % 55, -27 + rng.randrange(30) * 1e-6, 153 + rng.randrange(30) * 1e-6) for i in range(60)], "id long, lat double, lon double")
    one, two = made(0).cache(), made(100).cache()
    told = lambda: sorted((r.a, r.b, r.cost) for r in spatial.match_nearest(one, two, 3.0).collect())
    whole, asked = told(), []
    monkeypatch.setattr(spatial, "WALKED", 20)
    monkeypatch.setattr(spatial, "HALVES", 2)
    halved = spatial._matched
    monkeypatch.setattr(spatial, "_matched", lambda *a: asked.append(a[1]) or halved(*a))
    assert told() == whole and len(whole) > 40 and {3.0, 1.5, 0.75} <= set(asked)
