"""Domain tables over the driver's TPC-H-like tables: the same SQL serves Spark and the comparison in DuckDB.

Text in braces names a table. Literals with E0 are doubles in both engines.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession

TABLES = {
    "project": """SELECT n_nationkey AS project_id, n_regionkey AS team_id, n_name AS name,
  -27.0E0 + n_nationkey * 0.01E0 AS center_lat, 153.0E0 + n_nationkey * 0.01E0 AS center_lon FROM {nation}""",
    "asset": """SELECT o_orderkey AS asset_id, c_nationkey AS project_id, o_orderdate AS flight_date,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS flight_session,
  CASE WHEN o_orderkey % 2 = 0 THEN 'baseline' ELSE 'comparison' END AS survey_id,
  -27.0E0 + c_nationkey * 0.01E0 + ((o_orderkey * 7919) % 997) * 0.000004E0 AS gps_lat,
  153.0E0 + c_nationkey * 0.01E0 + ((o_orderkey * 104729) % 991) * 0.000004E0 AS gps_lon,
  20.0E0 + (o_orderkey % 41) AS altitude, 84.0E0 AS camera_fov, 4000 AS image_w, 3000 AS image_h,
  -90.0E0 + (o_orderkey % 31) AS gimbal_pitch, 0.0E0 AS gimbal_roll, (o_orderkey % 360) * 1.0E0 AS gimbal_yaw
FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    "detection": """SELECT l_orderkey * 10 + l_linenumber AS detection_id, l_orderkey AS asset_id, project_id, survey_id, p_type AS class_name,
  CASE WHEN l_partkey % 50 = 0 THEN NULL ELSE l_quantity / 50.0E0 END AS confidence,
  l_linestatus = 'F' AS verified, l_returnflag = 'R' AS rejected, l_returnflag = 'A' AS user_corrected,
  gps_lat + ((l_partkey * 31 + l_linenumber * 17) % 101 - 50) * 0.000001E0 AS lat,
  gps_lon + ((l_suppkey * 37 + l_linenumber * 13) % 103 - 51) * 0.000001E0 AS lon,
  (l_partkey * 13) % 3900 AS x1, (l_suppkey * 29) % 2900 AS y1,
  (l_partkey * 13) % 3900 + 20 + l_partkey % 60 AS x2, (l_suppkey * 29) % 2900 + 20 + l_suppkey % 60 AS y2, l_shipdate AS created_at
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey JOIN {asset} ON l_orderkey = asset_id""",
    "manual": """SELECT c_custkey AS annotation_id, a.asset_id, a.project_id, c_mktsegment AS weed_type,
  CASE WHEN c_custkey % 3 = 0 THEN 'CERTAIN' WHEN c_custkey % 3 = 1 THEN 'LIKELY' ELSE 'UNCERTAIN' END AS confidence,
  c_acctbal > 0 AS verified, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE a.flight_date END AS verified_at, a.flight_date AS created_at
FROM {customer} JOIN {asset} a ON c_custkey = a.asset_id""",
    "pending": """SELECT event_id AS pending_id, a.asset_id, a.project_id, event_type AS weed_type,
  CASE WHEN value > 100 THEN 1.0E0 ELSE value / 100.0E0 END AS confidence,
  CASE WHEN event_id % 3 = 0 THEN 'PENDING' WHEN event_id % 3 = 1 THEN 'ACCEPTED' ELSE 'REJECTED' END AS status, ts AS created_at
FROM {events} JOIN {asset} a ON event_id = a.asset_id""",
    "forecast": """SELECT date_trunc('hour', ts) AS ts, max(value) % 14 AS wind, max(value) % 19 AS gust, min(value) % 100 AS precip, max(value) % 40 AS temp
FROM {events} GROUP BY date_trunc('hour', ts)""",
}
RAW = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


class Bridge:
    """The tables of a folder, as DataFrames made on demand."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.table = cache(self._table)

    def _table(self, name: str) -> DataFrame:
        if name not in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        used = [t for t in (*RAW, *TABLES) if "{" + t + "}" in TABLES[name]]
        return self.spark.sql(TABLES[name], **{t: self.table(t) for t in used})

    def __getattr__(self, name: str) -> DataFrame:
        return self.table(name)


def with_bridge(sql: str) -> str:
    """The SQL for DuckDB, with the bridge tables that it names as common table expressions before its own."""
    need: list[str] = []

    def visit(text: str) -> None:
        for t in TABLES:
            if t not in need and ("{" + t + "}") in text:
                visit(TABLES[t])
                need.append(t)

    visit(sql)
    fill = {t: t for t in (*RAW, *TABLES)}
    put = lambda text: _fill(text, fill)
    ctes = [f"{t} AS ({put(TABLES[t])})" for t in need]
    body = put(sql).strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join([*ctes, body[15:]])
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join([*ctes, body[5:]])
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body


def _fill(text: str, names: dict[str, str]) -> str:
    for k, v in names.items():
        text = text.replace("{" + k + "}", v)
    return text
