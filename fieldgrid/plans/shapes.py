"""Footprints of surveys as shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import footprints, temporal
from ..sources.bridge import Bridge
from .registry import query

_REACH = "greatest(12.0E0, least(80.0E0, altitude * tan(radians(camera_fov) / 2)))"
_CELLS = f"""a AS (SELECT project_id, survey_id, gps_lat AS lat, gps_lon AS lon, {_REACH} AS reach FROM {{asset}}),
  s AS (SELECT *, unnest(range(floor((lat - reach / 111000.0E0) / 0.00005E0)::BIGINT, floor((lat + reach / 111000.0E0) / 0.00005E0)::BIGINT + 1)) AS cy FROM a),
  r AS (SELECT *, unnest(range(floor((lon - reach / 111000.0E0 / cos(radians(lat))) / 0.00005E0)::BIGINT, floor((lon + reach / 111000.0E0 / cos(radians(lat))) / 0.00005E0)::BIGINT + 1)) AS cx FROM s),
  d AS (SELECT *, pow(sin(radians((cy + 0.5) * 0.00005E0 - lat) / 2), 2) + cos(radians(lat)) * cos(radians((cy + 0.5) * 0.00005E0)) * pow(sin(radians((cx + 0.5) * 0.00005E0 - lon) / 2), 2) AS s FROM r),
  c AS (SELECT DISTINCT project_id, survey_id, cy, cx FROM d WHERE 2 * 6371000.0E0 * atan2(sqrt(s), sqrt(1 - s)) <= reach)"""


def _rings(t: Bridge) -> DataFrame:
    images = t.asset.withColumn("survey_id", F.struct("project_id", "survey_id"))
    return footprints.dissolved(temporal.covered_cells(images), "survey_id")


@query(f"""WITH {_CELLS}, q AS (SELECT project_id, survey_id, cy + v AS y, cx + h AS x, count(*) AS n, sum(CASE WHEN v = h THEN 1 ELSE 2 END) AS m FROM c, (VALUES (0), (1)) t(v), (VALUES (0), (1)) u(h) GROUP BY ALL),
  e AS (SELECT project_id, survey_id, (count(*) FILTER (WHERE n = 1) - count(*) FILTER (WHERE n = 3) + 2 * count(*) FILTER (WHERE n = 2 AND m IN (2, 4)))::BIGINT // 4 AS euler FROM q GROUP BY ALL),
  h AS (SELECT project_id, survey_id, count(*) AS n FROM c JOIN c k USING (project_id, survey_id) WHERE k.cy = c.cy AND k.cx = c.cx + 1 GROUP BY ALL),
  v AS (SELECT project_id, survey_id, count(*) AS n FROM c JOIN c k USING (project_id, survey_id) WHERE k.cx = c.cx AND k.cy = c.cy + 1 GROUP BY ALL),
  b AS (SELECT project_id, survey_id, count(*) AS cells FROM c GROUP BY ALL)
  SELECT project_id, survey_id, cells, 4 * cells - 2 * (h.n + v.n) AS edges, euler AS outer_less_holes FROM b JOIN e USING (project_id, survey_id) JOIN h USING (project_id, survey_id) JOIN v USING (project_id, survey_id)""")
def footprint_rings(t: Bridge) -> DataFrame:
    """Cells, length and outer rings less holes of each survey's footprint, from its rings; SQL counts them from cells and their corners."""
    sums = _rings(t).groupBy("survey_id").agg(F.sum("area").alias("cells"), F.sum("edges").alias("edges"), F.sum(F.signum("area")).cast("long").alias("outer_less_holes"))
    return sums.select("survey_id.project_id", "survey_id.survey_id", "cells", "edges", "outer_less_holes")


@query()
def footprint_shapes(t: Bridge) -> DataFrame:
    """The footprints as GeoJSON."""
    found = footprints.multipolygons(_rings(t), "survey_id", 0.00005)
    return found.select("survey_id.project_id", "survey_id.survey_id", "geometry", "cells")
