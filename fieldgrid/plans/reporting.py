"""Lists, counts, joins and set operations over the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text
from ..functions.geo import valid_coordinate
from ..operators import reporting as r
from ..sinks.tables import audit_rows
from ..sources.bridge import Bridge
from .registry import query


@query("""SELECT count(*) AS total, count(*) FILTER (WHERE verified) AS verified, count(*) FILTER (WHERE rejected) AS rejected, count(*) FILTER (WHERE NOT verified AND NOT rejected) AS pending,
  count(*) FILTER (WHERE confidence >= 0.8) AS high, count(*) FILTER (WHERE confidence >= 0.5 AND confidence < 0.8) AS medium, count(*) FILTER (WHERE confidence < 0.5 OR confidence IS NULL) AS low FROM {detection}""")
def detection_stats(t: Bridge) -> DataFrame:
    return r.detection_stats(t.detection)


@query("SELECT weed_type, count(*) AS n FROM {manual} WHERE verified GROUP BY weed_type")
def verified_class_counts(t: Bridge) -> DataFrame:
    return t.manual.where("verified").groupBy("weed_type").agg(F.count("*").alias("n"))


@query("""SELECT s.status, count(p.pending_id) AS n FROM (VALUES ('PENDING'), ('ACCEPTED'), ('REJECTED'), ('EXPIRED')) s(status)
  LEFT JOIN {pending} p ON p.status = s.status AND p.confidence > 0.3E0 GROUP BY s.status""")
def suggestion_status_counts(t: Bridge) -> DataFrame:
    states = t.spark.createDataFrame([(s,) for s in ("PENDING", "ACCEPTED", "REJECTED", "EXPIRED")], "status string")
    counts = t.pending.where("confidence > 0.3").groupBy("status").agg(F.count("*").alias("n"))
    return states.join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("""SELECT project_id, asset_id, row_number() OVER (PARTITION BY project_id ORDER BY flight_date, asset_id) AS version FROM {asset}""")
def backfilled_versions(t: Bridge) -> DataFrame:
    number = F.row_number().over(Window.partitionBy("project_id").orderBy("flight_date", "asset_id"))
    return t.asset.select("project_id", "asset_id", number.cast("long").alias("version"))


@query("SELECT project_id, max(asset_id) + 1 AS next_version FROM {asset} GROUP BY project_id")
def next_versions(t: Bridge) -> DataFrame:
    return t.asset.groupBy("project_id").agg((F.max("asset_id") + 1).alias("next_version"))


@query("""SELECT p.project_id, p.name, count(DISTINCT a.asset_id) AS assets, count(d.detection_id) AS detections FROM {project} p
  LEFT JOIN {asset} a ON a.project_id = p.project_id LEFT JOIN {detection} d ON d.asset_id = a.asset_id GROUP BY p.project_id, p.name""")
def project_counts(t: Bridge) -> DataFrame:
    per = lambda df, n: df.groupBy("project_id").agg(F.count("*").alias(n))
    joined = t.project.join(per(t.asset, "assets"), "project_id", "left").join(per(t.detection, "detections"), "project_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return joined.select("project_id", "name", zero("assets"), zero("detections"))


_LABELS = """SELECT 'ai' AS source, detection_id AS id, project_id, class_name AS class_raw, confidence AS score, CASE WHEN rejected THEN 'rejected' WHEN verified OR user_corrected THEN 'accepted' ELSE 'pending' END AS status FROM {detection}
  UNION ALL SELECT 'manual', annotation_id, project_id, weed_type, CASE confidence WHEN 'CERTAIN' THEN 0.95 WHEN 'LIKELY' THEN 0.75 ELSE 0.5 END, CASE WHEN verified THEN 'accepted' WHEN verified_at IS NOT NULL THEN 'rejected' ELSE 'pending' END FROM {manual}
  UNION ALL SELECT 'suggestion', pending_id, project_id, weed_type, confidence, lower(status) FROM {pending}"""


@query(f"""SELECT source, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'accepted') AS accepted, count(*) FILTER (WHERE status = 'rejected') AS rejected, count(*) AS total
  FROM ({_LABELS}) GROUP BY source""")
def review_summary(t: Bridge) -> DataFrame:
    return r.review_summary(r.labels(t.detection, t.manual, t.pending))


@query(f"""SELECT project_id, source, status, count(*) AS n, min(id) AS first_id FROM ({_LABELS}) WHERE status = 'pending' AND score >= 0.4 GROUP BY ALL""")
def review_items(t: Bridge) -> DataFrame:
    found = r.labels(t.detection, t.manual, t.pending).where((F.col("status") == "pending") & (F.col("score") >= 0.4))
    return found.groupBy("project_id", "source", "status").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query("SELECT d.project_id, count(*) AS n, count(DISTINCT class_name) AS classes FROM {detection} d WHERE d.project_id IN (SELECT project_id FROM {project} WHERE team_id IN (1, 3)) GROUP BY d.project_id")
def team_scope(t: Bridge) -> DataFrame:
    return r.in_teams(t.detection, t.project, [1, 3]).groupBy("project_id").agg(F.count("*").alias("n"), F.countDistinct("class_name").alias("classes"))


@query("""SELECT detection_id, asset_id, class_name, confidence FROM {detection} WHERE NOT verified AND NOT rejected AND NOT user_corrected AND confidence < 0.7 ORDER BY confidence, detection_id LIMIT 50 OFFSET 100""")
def needs_review_page(t: Bridge) -> DataFrame:
    found = t.detection.where(r.needs_review() & (F.col("confidence") < 0.7)).select("detection_id", "asset_id", "class_name", "confidence")
    return r.page(found, [F.col("confidence"), F.col("detection_id")], 3)


@query("""SELECT ceil(count(*) / 50.0)::BIGINT AS pages, count(*) AS total FROM {detection} WHERE NOT verified AND NOT rejected AND NOT user_corrected AND confidence < 0.7""")
def needs_review_pages(t: Bridge) -> DataFrame:
    return t.detection.where(r.needs_review() & (F.col("confidence") < 0.7)).agg(F.ceil(F.count("*") / 50).cast("long").alias("pages"), F.count("*").alias("total"))


@query("SELECT a.asset_id, a.project_id FROM {asset} a WHERE NOT EXISTS (SELECT 1 FROM {detection} d WHERE d.asset_id = a.asset_id AND d.class_name LIKE 'PROMO%')")
def assets_without_class(t: Bridge) -> DataFrame:
    return t.asset.select("asset_id", "project_id").join(t.detection.where(F.col("class_name").startswith("PROMO")).select("asset_id"), "asset_id", "left_anti")


@query("""WITH c AS (SELECT asset_id, bool_or(verified OR rejected OR user_corrected) AS reviewed FROM {detection} WHERE class_name = (SELECT min(class_name) FROM {detection}) GROUP BY asset_id)
  SELECT a.project_id, count(*) AS assets, count(c.asset_id) AS with_results, count(*) FILTER (WHERE c.reviewed) AS reviewed, count(*) FILTER (WHERE NOT c.reviewed) AS replaceable, count(*) FILTER (WHERE c.asset_id IS NULL) AS eligible
  FROM {asset} a LEFT JOIN c ON a.asset_id = c.asset_id GROUP BY a.project_id""")
def rerun_eligibility(t: Bridge) -> DataFrame:
    name = t.detection.agg(F.min("class_name")).first()[0]
    return r.rerun_eligibility(t.asset, t.detection, name)


@query("""SELECT class_name, count(*) AS n FROM {detection} WHERE verified OR rejected OR user_corrected OR class_name NOT LIKE '%BRASS' GROUP BY class_name""")
def without_drafts(t: Bridge) -> DataFrame:
    drafts = t.detection.where(~F.col("verified") & ~F.col("rejected") & ~F.col("user_corrected") & F.col("class_name").endswith("BRASS")).select("detection_id")
    return t.detection.join(drafts, "detection_id", "left_anti").groupBy("class_name").agg(F.count("*").alias("n"))


@query("""SELECT a.asset_id, coalesce(n, 0) AS annotations, coalesce(v, 0) AS verified FROM {asset} a LEFT JOIN (SELECT asset_id, count(*) AS n, count(*) FILTER (WHERE verified) AS v FROM {manual} GROUP BY asset_id) m ON a.asset_id = m.asset_id""")
def asset_annotation_counts(t: Bridge) -> DataFrame:
    return all_annotation_counts(t)


@query("""SELECT a.asset_id, coalesce(n, 0) AS annotations, coalesce(v, 0) AS verified FROM {asset} a LEFT JOIN (SELECT asset_id, count(*) AS n, count(*) FILTER (WHERE verified) AS v FROM {manual} GROUP BY asset_id) m ON a.asset_id = m.asset_id""")
def all_annotation_counts(t: Bridge) -> DataFrame:
    counts = t.manual.groupBy("asset_id").agg(F.count("*").alias("n"), F.count_if("verified").alias("v"))
    zero = lambda c, name: F.coalesce(c, F.lit(0)).cast("long").alias(name)
    return t.asset.join(counts, "asset_id", "left").select("asset_id", zero("n", "annotations"), zero("v", "verified"))


@query("""WITH k AS (SELECT *, CASE WHEN trim(coalesce(flight_session, '')) <> '' THEN regexp_replace(regexp_replace(lower(trim(flight_session)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') ELSE 'date-' || strftime(flight_date, '%Y-%m-%d') END AS survey_key FROM {asset})
  SELECT project_id, survey_key, count(*) AS assets, min(flight_date)::TIMESTAMP AS first_at, max(flight_date)::TIMESTAMP AS last_at, min(asset_id) AS first_asset FROM k GROUP BY project_id, survey_key""")
def survey_groups(t: Bridge) -> DataFrame:
    keyed = t.asset.withColumn("survey_key", text.survey_key(F.col("flight_session"), F.col("flight_date")))
    return keyed.groupBy("project_id", "survey_key").agg(F.count("*").alias("assets"), F.min("flight_date").cast("timestamp").alias("first_at"), F.max("flight_date").cast("timestamp").alias("last_at"), F.min("asset_id").alias("first_asset"))


@query("""SELECT project_id, asset_id, ((row_number() OVER (PARTITION BY project_id ORDER BY asset_id) - 1) // 500)::INTEGER AS shard FROM {asset}""")
def asset_shards(t: Bridge) -> DataFrame:
    return r.shards(t.asset.select("project_id", "asset_id"), "asset_id", "project_id")


_CHILDREN = "SELECT o_custkey AS parent_id, CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'P' THEN 'FAILED' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'RUNNING' ELSE 'COMPLETED' END END AS status, o_orderkey % 500 AS processed, 500 AS total, o_orderdate AS started_at, o_orderdate AS ended_at FROM {orders}"


@query(f"""WITH c AS ({_CHILDREN}), s AS (SELECT parent_id, count(*) AS shards, sum(processed)::BIGINT AS processed, sum(total)::BIGINT AS total, count(*) FILTER (WHERE status = 'COMPLETED') AS completed, count(*) FILTER (WHERE status = 'FAILED') AS failed,
  count(*) FILTER (WHERE status = 'CANCELLED') AS cancelled, bool_and(status IN ('COMPLETED', 'FAILED', 'CANCELLED')) AS over, min(started_at) AS started_at, max(ended_at) AS last_end FROM c GROUP BY parent_id)
  SELECT parent_id, shards, processed, total, completed, failed, cancelled, started_at, CASE WHEN NOT over THEN 'RUNNING' WHEN completed > 0 THEN 'COMPLETED' WHEN cancelled = shards THEN 'CANCELLED' ELSE 'FAILED' END AS status,
  over AND completed > 0 AND completed < shards AS warnings, CASE WHEN over THEN last_end END AS ended_at FROM s""")
def shard_rollup(t: Bridge) -> DataFrame:
    return r.rollup_shards(t.spark.sql(_CHILDREN, orders=t.orders))


@query("""SELECT user_id, event_type AS last_type, event_id AS last_id FROM {events} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def latest_outcomes(t: Bridge) -> DataFrame:
    last = r.latest_of(t.events.select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"])
    return last.select("user_id", F.col("event_type").alias("last_type"), F.col("event_id").alias("last_id"))


@query("SELECT project_id, class_name, count(*) AS n, rank() OVER (PARTITION BY project_id ORDER BY count(*) DESC, class_name) AS place FROM {detection} GROUP BY project_id, class_name QUALIFY place <= 3")
def top_classes(t: Bridge) -> DataFrame:
    counts = t.detection.groupBy("project_id", "class_name").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("project_id").orderBy(F.col("n").desc(), "class_name"))
    return counts.withColumn("place", place.cast("long")).where("place <= 3")


@query("""SELECT project_id, string_agg(c, ',' ORDER BY c) AS both_surveys FROM (SELECT project_id, class_name AS c FROM {detection} WHERE survey_id = 'baseline' INTERSECT SELECT project_id, class_name FROM {detection} WHERE survey_id = 'comparison') GROUP BY project_id""")
def classes_in_both_surveys(t: Bridge) -> DataFrame:
    of = lambda s: t.detection.where(F.col("survey_id") == s).select("project_id", "class_name")
    return of("baseline").intersect(of("comparison")).groupBy("project_id").agg(F.array_join(F.array_sort(F.collect_set("class_name")), ",").alias("both_surveys"))


@query("""SELECT project_id, class_name FROM {detection} WHERE survey_id = 'comparison' AND confidence > 0.97 AND verified EXCEPT SELECT project_id, class_name FROM {detection} WHERE survey_id = 'baseline' AND confidence > 0.97 AND verified""")
def added_classes(t: Bridge) -> DataFrame:
    of = lambda s: t.detection.where((F.col("survey_id") == s) & (F.col("confidence") > 0.97) & F.col("verified")).select("project_id", "class_name")
    return of("comparison").exceptAll(of("baseline").distinct()).distinct().join(of("baseline").distinct(), ["project_id", "class_name"], "left_anti")


@query("SELECT DISTINCT asset_id FROM {pending} WHERE status = 'ACCEPTED' UNION SELECT DISTINCT asset_id FROM {manual} WHERE verified")
def review_assets(t: Bridge) -> DataFrame:
    return t.pending.where("status = 'ACCEPTED'").select("asset_id").union(t.manual.where("verified").select("asset_id")).distinct()


@query("""SELECT class_name, quantile_cont(confidence, 0.1) AS p10, quantile_cont(confidence, 0.5) AS p50, quantile_cont(confidence, 0.9) AS p90 FROM {detection} WHERE confidence IS NOT NULL GROUP BY class_name""")
def confidence_percentiles(t: Bridge) -> DataFrame:
    p = F.percentile("confidence", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    return t.detection.where("confidence IS NOT NULL").groupBy("class_name").agg(p.alias("p")).select("class_name", *[F.col("p")[i].alias(n) for i, n in enumerate(("p10", "p50", "p90"))])


@query("""SELECT class_name, l[(floor((len(l) - 1) * 0.5) + 1)::INTEGER] AS p50, l[(floor((len(l) - 1) * 0.95) + 1)::INTEGER] AS p95 FROM (SELECT class_name, list(x2 - x1 ORDER BY x2 - x1) AS l FROM {detection} GROUP BY class_name)""")
def nearest_rank_percentiles(t: Bridge) -> DataFrame:
    rows = t.detection.select("class_name", (F.col("x2") - F.col("x1")).alias("v"))
    # Values are counted first, so a list has a row for each different value.
    counts = rows.groupBy("class_name", "v").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("class_name").orderBy("v"))
    whole = F.sum("n").over(Window.partitionBy("class_name"))
    ranked = counts.withColumns({"upto": upto, "whole": whole})
    at = lambda q, name: F.min(F.when(F.col("upto") > F.floor((F.col("whole") - 1) * q), F.col("v"))).alias(name)
    return ranked.groupBy("class_name").agg(at(0.5, "p50"), at(0.95, "p95"))


@query("""SELECT count(*) FILTER (WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180) AS valid, count(*) AS total FROM {detection}""")
def valid_places(t: Bridge) -> DataFrame:
    return t.detection.agg(F.count_if(valid_coordinate(F.col("lat"), F.col("lon"))).alias("valid"), F.count("*").alias("total"))


@query("""WITH base AS (SELECT o_orderkey AS id, o_orderstatus AS status FROM {orders} WHERE o_orderkey % 3 <> 0), new AS (SELECT o_orderkey AS id, 'N' AS status FROM {orders} WHERE o_orderkey % 3 = 0 OR o_orderkey % 2 = 0)
  SELECT status, count(*) AS n FROM (SELECT * FROM base WHERE id NOT IN (SELECT id FROM new) UNION ALL SELECT * FROM new) GROUP BY status""")
def upserted(t: Bridge) -> DataFrame:
    base = t.orders.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    new = t.orders.where("o_orderkey % 3 = 0 OR o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"), F.lit("N").alias("status"))
    return r.upsert(base, new, ["id"]).groupBy("status").agg(F.count("*").alias("n"))


@query("""WITH base AS (SELECT o_orderkey AS id, o_orderstatus AS status FROM {orders} WHERE o_orderkey % 3 <> 0), new AS (SELECT o_orderkey AS id, 'N' AS status FROM {orders} WHERE o_orderkey % 3 = 0 OR o_orderkey % 2 = 0)
  SELECT status, count(*) AS n FROM (SELECT * FROM base UNION ALL SELECT * FROM new WHERE id NOT IN (SELECT id FROM base)) GROUP BY status""")
def inserted_ignoring(t: Bridge) -> DataFrame:
    base = t.orders.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    new = t.orders.where("o_orderkey % 3 = 0 OR o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"), F.lit("N").alias("status"))
    return r.insert_ignore(base, new, ["id"]).groupBy("status").agg(F.count("*").alias("n"))


@query("""SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, max(event_id) AS last_id FROM {events} WHERE ts < TIMESTAMP '2100-01-01' GROUP BY event_type ORDER BY n DESC, event_type LIMIT 3""")
def top_reasons(t: Bridge) -> DataFrame:
    return t.events.where("ts < timestamp'2100-01-01'").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.max("event_id").alias("last_id")).orderBy(F.col("n").desc(), "event_type").limit(3)


@query("""SELECT * FROM (SELECT 'manual' AS source, annotation_id AS id, asset_id FROM {manual} WHERE verified ORDER BY annotation_id LIMIT 20 OFFSET 20)
  UNION ALL SELECT * FROM (SELECT 'suggestion', pending_id, asset_id FROM {pending} WHERE status = 'ACCEPTED' ORDER BY pending_id LIMIT 20 OFFSET 20)""")
def annotation_export_page(t: Bridge) -> DataFrame:
    """Each source is paged on its own, so a page holds up to twice its size."""
    a = t.manual.where("verified").select(F.lit("manual").alias("source"), F.col("annotation_id").alias("id"), "asset_id")
    b = t.pending.where("status = 'ACCEPTED'").select(F.lit("suggestion").alias("source"), F.col("pending_id").alias("id"), "asset_id")
    return r.page(a, [F.col("id")], 2, 20).unionByName(r.page(b, [F.col("id")], 2, 20))


@query("""WITH a AS (SELECT p_partkey AS id, p_type AS v FROM {part} WHERE p_partkey % 3 <> 0), b AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 'x' ELSE p_type END AS v FROM {part} WHERE p_partkey % 4 <> 0 OR p_partkey % 3 = 0)
  SELECT action, count(*) AS n FROM (SELECT CASE WHEN a.id IS NULL THEN 'CREATE' WHEN b.id IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS action FROM a FULL JOIN b ON a.id = b.id WHERE a.v IS DISTINCT FROM b.v) GROUP BY action""")
def audit_actions(t: Bridge) -> DataFrame:
    k = F.col("p_partkey")
    a = t.part.where(k % 3 != 0).select(k.alias("id"), F.col("p_type").alias("v"))
    b = t.part.where((k % 4 != 0) | (k % 3 == 0)).select(k.alias("id"), F.when(k % 5 == 0, "x").otherwise(F.col("p_type")).alias("v"))
    return audit_rows(a, b, "id", "part", "u", "2024-01-01").groupBy("action").agg(F.count("*").alias("n"))


@query("""SELECT coalesce(status, 'none') AS status, count(*) AS assets FROM (SELECT a.asset_id, p.status FROM {asset} a LEFT JOIN {pending} p ON a.asset_id = p.asset_id QUALIFY row_number() OVER (PARTITION BY a.asset_id ORDER BY p.created_at DESC, p.pending_id DESC) = 1) GROUP BY 1""")
def latest_suggestion_status(t: Bridge) -> DataFrame:
    last = r.latest_of(t.pending.select("asset_id", "created_at", "pending_id", "status"), "asset_id", ["created_at", "pending_id"])
    return t.asset.select("asset_id").distinct().join(last, "asset_id", "left").groupBy(F.coalesce("status", F.lit("none")).alias("status")).agg(F.count("*").alias("assets"))


@query("""SELECT p.project_id, count(a.asset_id) AS accepted, round(sum(CAST(round(a.confidence * 100) AS BIGINT))::BIGINT / 100.0E0, 2) AS score FROM {project} p LEFT JOIN {detection} a ON p.project_id = a.project_id AND NOT a.rejected AND (a.verified OR a.user_corrected) AND a.created_at >= TIMESTAMP '1995-01-01' AND a.created_at < TIMESTAMP '1996-01-01' GROUP BY p.project_id""")
def accepted_in_range(t: Bridge) -> DataFrame:
    found = t.detection.where(r.accepted() & (F.col("created_at") >= "1995-01-01") & (F.col("created_at") < "1996-01-01"))
    sums = found.groupBy("project_id").agg(F.count("*").alias("accepted"), F.round(F.sum(F.round(F.col("confidence") * 100).cast("long")) / 100, 2).alias("score"))
    return t.project.select("project_id").join(sums, "project_id", "left").select("project_id", F.coalesce("accepted", F.lit(0)).cast("long").alias("accepted"), "score")
