"""Filters, counts, lists and version bookkeeping over detections, labels and suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import confidence_of_level
from .numbering import numbered


def accepted(verified: str = "verified", rejected: str = "rejected", corrected: str = "user_corrected") -> Column:
    """The gate of every operational output."""
    return ~F.col(rejected) & (F.col(verified) | F.col(corrected))


def needs_review(verified: str = "verified", rejected: str = "rejected", corrected: str = "user_corrected") -> Column:
    return ~F.col(rejected) & ~F.col(verified) & ~F.col(corrected)


def detection_status() -> Column:
    return F.when(F.col("rejected"), "rejected").when(F.col("verified") | F.col("user_corrected"), "accepted").otherwise("pending")


def manual_status() -> Column:
    return F.when(F.col("verified"), "accepted").when(F.col("verified_at").isNotNull(), "rejected").otherwise("pending")


def suggestion_status() -> Column:
    return F.lower("status")


def detection_stats(detections: DataFrame) -> DataFrame:
    """Seven counts in one pass; a null confidence is low."""
    c = F.col("confidence")
    return detections.agg(
        F.count("*").alias("total"), F.count_if("verified").alias("verified"), F.count_if("rejected").alias("rejected"), F.count_if(~F.col("verified") & ~F.col("rejected")).alias("pending"),
        F.count_if(c >= 0.8).alias("high"), F.count_if((c >= 0.5) & (c < 0.8)).alias("medium"), F.count_if((c < 0.5) | c.isNull()).alias("low"),
    )


def labels(detections: DataFrame, manual: DataFrame, pending: DataFrame) -> DataFrame:
    """All three sources as rows (source, id, asset_id, project_id, class_raw, score, status, created_at)."""
    a = detections.select(F.lit("ai").alias("source"), F.col("detection_id").alias("id"), "asset_id", "project_id", F.col("class_name").alias("class_raw"), F.col("confidence").alias("score"), detection_status().alias("status"), F.col("created_at").cast("timestamp").alias("created_at"))
    b = manual.select(F.lit("manual").alias("source"), F.col("annotation_id").alias("id"), "asset_id", "project_id", F.col("weed_type").alias("class_raw"), confidence_of_level(F.col("confidence")).alias("score"), manual_status().alias("status"), F.col("created_at").cast("timestamp").alias("created_at"))
    c = pending.select(F.lit("suggestion").alias("source"), F.col("pending_id").alias("id"), "asset_id", "project_id", F.col("weed_type").alias("class_raw"), F.col("confidence").alias("score"), suggestion_status().alias("status"), F.col("created_at").cast("timestamp").alias("created_at"))
    return a.unionByName(b).unionByName(c)


def review_summary(found: DataFrame) -> DataFrame:
    """Counts of each source by status, and in total, in one pass."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return found.groupBy("source").agg(n("pending"), n("accepted"), n("rejected"), F.count("*").alias("total"))


def session_summaries(scope: DataFrame, found: DataFrame) -> DataFrame:
    """review_summary of each session (scope: session_id, asset_id) in one query over all of them."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return scope.distinct().join(found, "asset_id").groupBy("session_id", "source").agg(n("pending"), n("accepted"), n("rejected"), F.count("*").alias("total"))


def page(rows: DataFrame, order: list[Column], number: int, size: int = 50, most: int = 200) -> DataFrame:
    """A page, counted from 1, of at most `most` rows."""
    size = max(1, min(size, most))
    return rows.orderBy(*order).offset((max(1, min(number, 1_000_000)) - 1) * size).limit(size)


def in_teams(rows: DataFrame, projects: DataFrame, teams: list[int]) -> DataFrame:
    """The rows of projects that belong to one of the teams."""
    return rows.join(projects.where(F.col("team_id").isin(*teams)).select("project_id"), "project_id", "left_semi")


def rerun_eligibility(assets: DataFrame, detections: DataFrame, class_name: str) -> DataFrame:
    """For each project its images, those with results of a class, with reviewed ones, with drafts alone, and without any."""
    of = detections.where(F.col("class_name") == class_name).groupBy("asset_id").agg(F.bool_or(F.col("verified") | F.col("rejected") | F.col("user_corrected")).alias("reviewed"))
    joined = assets.select("project_id", "asset_id").join(of, "asset_id", "left")
    has = F.col("reviewed").isNotNull()
    return joined.groupBy("project_id").agg(F.count("*").alias("assets"), F.count_if(has).alias("with_results"), F.count_if(has & F.col("reviewed")).alias("reviewed"), F.count_if(has & ~F.col("reviewed")).alias("replaceable"), F.count_if(~has).alias("eligible"))


def insert_ignore(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """table with the new rows whose keys it lacks; of new rows with equal keys one."""
    return table.unionByName(new.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti"))


def upsert(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """table with new rows in place of those with the same keys."""
    return table.join(new.select(*keys), keys, "left_anti").select(*table.columns).unionByName(new)


def latest_of(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")


def shards(ids: DataFrame, key: str, group: str, size: int = 500) -> DataFrame:
    """ids with the number of their shard of `size`, in order of the key within a group; null is a group too.

    Ranges of group and key are numbered, so a group isn't one task's; groups' first numbers are met by the group.
    """
    placed = numbered(ids, group, key, out="_n")
    first = placed.groupBy(F.col(group).alias("_g")).agg(F.min("_n").alias("_first"))
    return placed.join(first, F.col(group).eqNullSafe(F.col("_g"))).select(*ids.columns, F.floor((F.col("_n") - F.col("_first")) / size).cast("int").alias("shard"))


def rollup_shards(children: DataFrame, parent: str = "parent_id") -> DataFrame:
    """A row for each parent of shard rows (parent_id, status, processed, total, started_at, ended_at): sums, first start, last end once all are over, and the status that follows."""
    is_ = lambda s: F.count_if(F.col("status") == s)
    over = F.bool_and(F.col("status").isin("COMPLETED", "FAILED", "CANCELLED"))
    out = children.groupBy(parent).agg(F.count("*").alias("shards"), F.sum("processed").alias("processed"), F.sum("total").alias("total"), is_("COMPLETED").alias("completed"), is_("FAILED").alias("failed"), is_("CANCELLED").alias("cancelled"), over.alias("over"), F.min("started_at").alias("started_at"), F.max("ended_at").alias("last_end"))
    status = F.when(~F.col("over"), "RUNNING").when(F.col("completed") > 0, "COMPLETED").when(F.col("cancelled") == F.col("shards"), "CANCELLED").otherwise("FAILED")
    return out.withColumns({"status": status, "warnings": F.col("over") & (F.col("completed") > 0) & (F.col("completed") < F.col("shards")), "ended_at": F.when(F.col("over"), F.col("last_end"))}).drop("last_end", "over")


def terminal_states(outcomes: DataFrame, key: str = "job_id") -> DataFrame:
    """A row for each job of asset outcomes (job_id, outcome): how it ended, and its failures as text ("2 oom; 1 prepare error"), commonest first."""
    failed = F.col("outcome").isin("oom", "inference_error", "prepare_error")
    counts = outcomes.groupBy(key, "outcome").agg(F.count("*").alias("n"))
    told = F.concat(F.col("n").cast("string"), F.lit(" "), F.replace("outcome", F.lit("_"), F.lit(" ")))
    listed = F.transform(F.array_sort(F.collect_list(F.when(failed, F.struct((-F.col("n")).alias("minus"), "outcome", told.alias("told"))))), lambda x: x.told)
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    out = counts.groupBy(key).agg(n(failed).alias("failures"), n(~failed).alias("successes"), n(F.col("outcome").isin("oom", "inference_error")).alias("inferred"), F.array_join(listed, "; ").alias("message"))
    state = F.when(F.col("failures") == 0, "completed").when(F.col("successes") > 0, "completed_partial").when(F.col("inferred") > 0, "failed_inference").otherwise("failed_prepare")
    return out.select(key, state.alias("state"), F.when(state.startswith("failed"), "FAILED").otherwise("COMPLETED").alias("status"), F.when(F.col("failures") > 0, F.col("message")).alias("message"))


def stage_summaries(log: DataFrame, key: str = "job_id") -> DataFrame:
    """A row for each job of a log (job_id, at, stage, asset_id, outcome, state, message): latest stage, state and message, and assets by their latest outcome."""
    last = lambda value, when: F.max_by(value, F.when(when, F.col("at")))
    stage = F.col("stage")
    whole = log.groupBy(key).agg(last("stage", stage != "terminal").alias("latest_stage"), last("state", stage == "terminal").alias("state"), last("message", F.col("message").isNotNull()).alias("last_message"))
    latest = log.where("asset_id IS NOT NULL AND outcome IS NOT NULL").groupBy(key, "asset_id").agg(F.max_by("outcome", "at").alias("outcome"))
    kinds = ("success", "zero_detections", "oom", "inference_error", "prepare_error")
    counts = latest.groupBy(key).agg(*[F.count_if(F.col("outcome") == k).alias(k) for k in kinds])
    return whole.join(counts, key, "left").select(key, "latest_stage", "state", "last_message", *[F.coalesce(k, F.lit(0)).cast("long").alias(k) for k in kinds])


def leaderboard(models: DataFrame) -> DataFrame:
    """Finished models with any metric, ranked by map50 (a missing one last), then the latest."""
    metrics = F.coalesce(*[F.col(c) for c in ("map50", "map5095", "precision", "recall", "f1")]).isNotNull()
    found = models.where(F.col("status").isin("READY", "ACTIVE", "ARCHIVED") & metrics)
    return found.withColumn("rank", F.row_number().over(Window.orderBy(F.coalesce("map50", F.lit(-1.0)).desc(), F.col("created_at").desc(), "model_id")))


def class_metrics(models: DataFrame) -> DataFrame:
    """Rows (model_id, class, precision, recall, map50) of JSON text `metrics`: an object of records by class, or an array of records with class or name; map50 also goes by mAP50."""
    record = "map<string, string>"
    listed = models.where(F.ltrim("metrics").startswith("[")).select("model_id", F.explode(F.from_json("metrics", f"array<{record}>")).alias("m")).select("model_id", F.coalesce(F.col("m")["class"], F.col("m")["name"]).alias("class"), "m")
    mapped = models.where(F.ltrim("metrics").startswith("{")).select("model_id", F.explode(F.from_json("metrics", f"map<string, {record}>")).alias("class", "m"))
    number = lambda *keys: F.coalesce(*[F.col("m")[k].try_cast("double") for k in keys])
    return listed.unionByName(mapped).where("class IS NOT NULL").select("model_id", "class", number("precision").alias("precision"), number("recall").alias("recall"), number("mAP50", "map50").alias("map50"))


def reconciled(versions: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """versions whose training began over so many hours before as_of are READY again."""
    stuck = (F.col("status") == "TRAINING") & (F.col("updated_at") < F.to_timestamp(F.lit(as_of)) - F.make_interval(hours=F.lit(hours)))
    return versions.withColumn("status", F.when(stuck, "READY").otherwise(F.col("status")))


def feature_flag(features: Column, name: str) -> Column:
    """A boolean of a JSON object's text; false where it isn't there."""
    return F.coalesce(F.get_json_object(features, f"$.{name}") == "true", F.lit(False))


def audit_of(log: DataFrame, entity: str, entity_id: str | None = None, most: int = 100) -> DataFrame:
    """The latest audit rows of a kind of entity, or of one."""
    found = log.where(F.col("entity") == entity)
    if entity_id is not None:
        found = found.where(F.col("entity_id") == entity_id)
    return found.orderBy(F.col("at").desc(), "entity_id").limit(most)
