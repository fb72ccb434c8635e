"""Training sets from the label sources: one label of equal ones, splits, manifests and comparisons of versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import box, polygon
from ..functions.text import sanitised_class


def boxed_labels(detections: DataFrame, least: float = 0.0) -> DataFrame:
    """Accepted detections as rows (asset_id, id, source, class, x, y, w, h): shares of the image; a null confidence counts as 0 under a positive limit."""
    good = detections.where(~F.col("rejected") & (F.col("verified") | F.col("user_corrected")) & (F.coalesce("confidence", F.lit(0.0)) >= least))
    b = box.normalised(box.corner(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")), F.lit(4000), F.lit(3000))
    return good.select("asset_id", F.col("detection_id").alias("id"), F.lit("ai").alias("source"), sanitised_class(F.col("class_name")).alias("class"), b.alias("b")).select("asset_id", "id", "source", "class", "b.x", "b.y", "b.w", "b.h")


def one_of_equal(labels: DataFrame) -> DataFrame:
    """Of labels with one image, class and box to four places, the first by source (ai, manual, suggestion) and id."""
    rank = F.when(F.col("source") == "ai", 0).when(F.col("source") == "manual", 1).otherwise(2)
    key = ["asset_id", "class", *[F.round(c, 4) for c in ("x", "y", "w", "h")]]
    return labels.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy(rank, "id"))).where("n = 1").drop("n")


def split(assets: DataFrame, train: float = 0.7, val: float = 0.2, seed: int = 42, group: str | None = None) -> DataFrame:
    """assets with `split`: by rank of a seeded hash of the id; sizes of train and val are rounded down. Shares are normalised.

    Without a group all rows are ranked together, which needs two passes: hashes are ranked within 256 ranges of theirs, and ranges are
    offset by their counts.
    """
    whole = assets.withColumn("h", F.xxhash64(F.lit(seed), "asset_id"))
    part = F.shiftrightunsigned("h", 56)
    keys = [group] if group else []
    counts = whole.groupBy(*keys, part.alias("range")).agg(F.count("*").alias("n"))
    before = Window.partitionBy(*keys).orderBy("range") if keys else Window.orderBy("range")
    offsets = counts.select(*keys, "range", (F.sum("n").over(before) - F.col("n")).alias("offset"), F.sum("n").over(Window.partitionBy(*keys)).alias("all"))
    ranked = whole.withColumn("range", part).withColumn("r", F.row_number().over(Window.partitionBy(*keys, "range").orderBy("h", "asset_id"))).join(offsets, [*keys, "range"])
    place = F.col("offset") + F.col("r") - 1
    cut = F.floor(F.col("all") * train), F.floor(F.col("all") * train) + F.floor(F.col("all") * val)
    return ranked.withColumn("split", F.when(place < cut[0], "train").when(place < cut[1], "val").otherwise("test")).drop("h", "range", "r", "offset", "all")


def yolo_lines(labels: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows (asset_id, lines): the label file of each image, a line for each label; classes are rows (class, class_id)."""
    line = F.format_string("%d %.6f %.6f %.6f %.6f", "class_id", "x", "y", "w", "h")
    rows = labels.join(classes, "class").select("asset_id", "id", line.alias("line"))
    return rows.groupBy("asset_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "line"))), lambda x: x.line), "\n").alias("lines"))


def class_ids(labels: DataFrame) -> DataFrame:
    """Classes numbered from 0 by count, most first, then name. There are few classes, so one task ranks them."""
    counts = labels.groupBy("class").agg(F.count("*").alias("n"))
    return counts.withColumn("class_id", F.row_number().over(Window.orderBy(F.col("n").desc(), "class")) - 1)


def manifest(labels: DataFrame) -> DataFrame:
    """Rows (asset_id, n_labels, checksum): SHA-256 of an image's labels as JSON, with six places, in order of their ids."""
    row = F.to_json(F.struct("id", "class", *[F.col(c).cast("decimal(10,6)").alias(c) for c in ("x", "y", "w", "h")]))
    return labels.groupBy("asset_id").agg(F.count("*").alias("n_labels"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", row.alias("j")))), lambda x: x.j), "\n"), 256).alias("checksum"))


def all_boxed_labels(detections: DataFrame, manual: DataFrame, pending: DataFrame, least: float = 0.0, use: tuple[str, ...] = ("ai", "manual", "suggestion")) -> DataFrame:
    """boxed_labels of three sources, before one_of_equal: detections, labels by hand (annotation_id, asset_id, weed_type, ring of pixels x, y) and accepted suggestions (pending_id, asset_id, weed_type, confidence, x1..y2). Rings of fewer than three points and boxes without an extent go."""
    a = boxed_labels(detections, least)
    ring = polygon.extent(F.col("ring"))
    sized = lambda b: box.normalised(b, F.lit(4000), F.lit(3000))

    def rows(df: DataFrame, id_: str, source: str, b: Column) -> DataFrame:
        found = df.withColumn("b", b).where("b IS NOT NULL").select("asset_id", F.col(id_).alias("id"), F.lit(source).alias("source"), sanitised_class(F.col("weed_type")).alias("class"), sized(F.col("b")).alias("n"))
        return found.where("class <> ''").select("asset_id", "id", "source", "class", "n.x", "n.y", "n.w", "n.h")

    corner = box.corner(*[F.col(c) for c in ("x1", "y1", "x2", "y2")])
    c = pending.where((F.col("status").isNull() | (F.col("status") == "ACCEPTED")) & (F.col("confidence").isNull() | (F.col("confidence") >= least)))
    every = a.unionByName(rows(manual, "annotation_id", "manual", ring)).unionByName(rows(c, "pending_id", "suggestion", F.when(box.valid(corner), corner)))
    return every.where(F.col("source").isin(*use))


def create_versions(requests: DataFrame, versions: DataFrame, labels: DataFrame) -> DataFrame:
    """New rows of versions for requests (project_id, request_key, requested_at): versions (project_id, request_key, version, snapshot_at, n_labels, n_images).

    A request whose key a project's version has, or an earlier request of the same key, makes none; the others are numbered on from the project's last version in
    the order of their time and key. A version holds the labels (project_id, asset_id, created_at) made up to its request (labels_up_to).
    """
    once = requests.groupBy("project_id", "request_key").agg(F.min("requested_at").alias("requested_at")).join(versions.select("project_id", "request_key"), ["project_id", "request_key"], "left_anti")
    last = versions.groupBy("project_id").agg(F.max("version").alias("last"))
    number = F.row_number().over(Window.partitionBy("project_id").orderBy("requested_at", "request_key"))
    made = once.withColumn("n", number).join(last, "project_id", "left").select("project_id", "request_key", (F.coalesce("last", F.lit(0)) + F.col("n")).cast("long").alias("version"), F.col("requested_at").alias("snapshot_at"))
    return labels_up_to(made, labels, "snapshot_at").select("project_id", "request_key", "version", "snapshot_at", "n_labels", "n_images")


def labels_up_to(rows: DataFrame, labels: DataFrame, at: str) -> DataFrame:
    """rows (project_id, at, others) with the longs n_labels and n_images: the project's labels (project_id, asset_id, created_at) made up to `at`, and their different images.

    Times with their numbers of labels, and of images that have their first label then, are summed up within days, and days are offset by the
    sums of those before; labels aren't met by rows one by one. A null time of a row counts nothing, of a label isn't counted.
    """
    dated = labels.where("created_at IS NOT NULL").select("project_id", "asset_id", F.col("created_at").cast("timestamp").alias("t"))
    made = dated.groupBy("project_id", "t").agg(F.count("*").alias("l"), F.lit(0).cast("long").alias("i"))
    first = dated.groupBy("project_id", "asset_id").agg(F.min("t").alias("t")).groupBy("project_id", "t").agg(F.lit(0).cast("long").alias("l"), F.count("*").alias("i"))
    none = F.lit(0).cast("long")
    asked = rows.select("project_id", F.col(at).cast("timestamp").alias("t")).dropna().distinct().select("project_id", "t", none.alias("l"), none.alias("i"), F.lit(1).alias("asks"))
    steps = made.unionByName(first).withColumn("asks", F.lit(0)).unionByName(asked).withColumn("day", F.to_date("t"))
    so_far = Window.partitionBy("project_id", "day").orderBy("t")  # rows of one time count together
    within = steps.select("project_id", "day", "t", "asks", F.sum("l").over(so_far).alias("l"), F.sum("i").over(so_far).alias("i")).where("asks = 1")
    before = Window.partitionBy("project_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = steps.groupBy("project_id", "day").agg(F.sum("l").alias("l"), F.sum("i").alias("i")).select("project_id", "day", F.sum("l").over(before).alias("l0"), F.sum("i").over(before).alias("i0"))
    total = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    found = within.join(days, ["project_id", "day"]).select("project_id", F.col("t").alias("_t"), total("l", "l0").alias("n_labels"), total("i", "i0").alias("n_images"))
    met = rows.withColumn("_t", F.col(at).cast("timestamp")).join(found, ["project_id", "_t"], "left").drop("_t")
    return met.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_labels", "n_images")})


def compare_versions(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: images of two versions (asset_id, class), those in both, and classes added and removed."""
    images = a.select("asset_id").distinct().withColumn("a", F.lit(1)).join(b.select("asset_id").distinct().withColumn("b", F.lit(1)), "asset_id", "full")
    counts = images.agg(F.count("a").alias("images_a"), F.count("b").alias("images_b"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("images_both"))
    classes = lambda df, name: df.agg(F.collect_set("class").alias(name))
    sets = classes(a, "ca").join(classes(b, "cb"))
    out = counts.join(sets)
    return out.select("images_a", "images_b", "images_both", F.array_join(F.array_sort(F.array_except("cb", "ca")), ",").alias("added"), F.array_join(F.array_sort(F.array_except("ca", "cb")), ",").alias("removed"))
