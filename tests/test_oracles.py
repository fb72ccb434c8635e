"""Every registered query with SQL equals DuckDB on the same tables."""

import math
import os

import duckdb
import pytest

from fieldgrid.plans import analytics, exchange, flows, imagery, options, quality, rasters, registry, reporting, reports, shapes, sources  # noqa: F401

SF, SMALLER = "/root/testdata/sf0.01", "/root/testdata/sf0.001"
#: Queries that draw pictures or write many files: the smaller tables have enough of each case.
HEAVY = {"mask_shapes", "gated_candidates", "green_fractions", "green_thresholds", "footprint_rings", "terrain_places", "ingested_images", "label_files", "evidence_bundles", "streamed_results", "streamed_parents", "coco_images", "coco_annotations"}


@pytest.fixture(scope="module")
def con():
    def connect(folder):
        c = duckdb.connect()
        c.execute("SET TimeZone = 'UTC'")
        for t in os.listdir(folder):
            c.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{t}'")
        return c

    return {folder: connect(folder) for folder in (SF, SMALLER)}


def same(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and (math.isclose(a, b, rel_tol=1e-12) or (math.isnan(a) and math.isnan(b))))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, con, name):
    folder = SMALLER if name in HEAVY else SF
    want = con[folder].sql(registry.ORACLES[name])
    columns = sorted(want.columns)
    got = registry.QUERIES[name](spark, folder)
    assert sorted(got.columns) == columns
    key = lambda r: tuple((x is None, str(x)) for x in r)
    a = sorted(map(tuple, got.select(*columns).collect()), key=key)
    b = sorted((tuple(r[want.columns.index(c)] for c in columns) for r in want.fetchall()), key=key)
    assert len(a) == len(b) > 0
    for x, y in zip(a, b, strict=True):
        assert all(map(same, x, y)), (x, y)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_runs(spark, name):
    registry.QUERIES[name](spark, SMALLER).collect()


def test_whole_tables_are_covered(spark):
    sf = "/root/testdata/sf0.001"
    assets = registry.Bridge(spark, sf).asset
    assert registry.QUERIES["all_annotation_counts"](spark, sf).count() == assets.count()
    cover = registry.QUERIES["all_survey_coverage"](spark, sf)
    assert {(r.project_id, r.survey_id) for r in cover.collect()} == {tuple(r) for r in assets.select("project_id", "survey_id").distinct().collect()}
