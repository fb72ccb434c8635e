"""Shards by jump consistent hashing: a stable key and the number of shards decide, and a new shard takes rows only into itself.

DataFrame functions only. Nothing keeps a ring table; texts move once, to the files of their shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from .common import scratch

#: Multiplier of the 64-bit congruential generator whose states a key jumps by, in its published form.
MULTIPLIER = 2862933555777941757
LOW = 0xFFFFFFFF


def _product(a: Column, b: int) -> Column:
    """The lower 32 bits of a and b, both below 2^32, without leaving 64 bits."""
    return a * (b & 0xFFFF) + F.shiftleft((a * (b >> 16)).bitwiseAND(0xFFFF), 16)


def jump(key: Column, shards: int) -> Column:
    """The shard, from 0, of a key among `shards`: an int.

    The generator starts from the first 64 bits of the key's MD5 as text; null counts as the empty key. 64-bit products are put together
    from halves, since overflow is an error in Spark. A key makes about ln(shards) jumps, but the fold has `shards` steps.
    """
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    high, low = (F.conv(F.substring(digest, i, 8), 16, 10).cast("long") for i in (1, 9))
    start = F.struct(high.alias("h"), low.alias("l"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))

    def step(s: Column, _: Column) -> Column:
        below, above = s.l * (MULTIPLIER & 0xFFFF), s.l * ((MULTIPLIER & LOW) >> 16)
        whole = below + F.shiftleft(above.bitwiseAND(0xFFFF), 16) + 1
        carry = F.shiftright(whole, 32) + F.shiftright(above, 16)
        h = (carry + _product(s.h, MULTIPLIER & LOW) + _product(s.l, MULTIPLIER >> 32)).bitwiseAND(LOW)
        ahead = ((s.j + 1) * (F.lit(float(1 << 31)) / (F.shiftright(h, 1) + 1))).cast("long")
        return F.when(s.j < shards, F.struct(h.alias("h"), whole.bitwiseAND(LOW).alias("l"), s.j.alias("b"), ahead.alias("j"))).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step).b.cast("int")


def write(df: DataFrame, folder: str, shards: int, key: str = "doc_id", files: int | None = None) -> None:
    """The rows of df, whole, as files in the folders shard=0 and on of `folder`.

    A file's rows are in the order of their keys (nulls first), and files of one shard follow each other by their column block. Ranges
    are cut by shard, key and row number, so a key or shard with very many rows is spread over files. Columns of df lie in the
    struct `row`, where no name can clash; `at` tells rows with equal keys apart. An empty table writes no rows.
    """
    own = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    named = df.select(own.alias("row"), jump(F.col(f"`{key}`"), shards).alias("shard"), F.monotonically_increasing_id().alias("at"))
    _put(named, folder, key, max(shards, files or named.rdd.getNumPartitions()))


def _put(rows: DataFrame, folder: str, key: str, files: int, mode: str = "errorifexists") -> None:
    order = "shard", F.col(f"row.`{key}`"), "at"
    ranged = rows.repartitionByRange(files, *order).sortWithinPartitions(*order).withColumn("block", F.spark_partition_id())
    ranged.write.mode(mode).option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("shard").parquet(folder)


def append(spark: SparkSession, folder: str, schema: StructType, shards: int, grown: int, key: str = "doc_id") -> None:
    """Make the `shards` of a folder `grown`: the rows that belong to the new shards are written there, and no others are touched.

    Files of old shards keep what has moved, and `read` passes over it. A repeated call replaces what it wrote.
    """
    rows = read(spark, folder, schema, shards, key)
    moved = rows.withColumn("shard", jump(F.col(f"row.`{key}`"), grown)).where(F.col("shard") >= shards).drop("block")
    _put(moved, folder, key, max(grown - shards, moved.rdd.getNumPartitions() * (grown - shards) // grown), "overwrite")


def read(spark: SparkSession, folder: str, schema: StructType, shards: int, key: str = "doc_id") -> DataFrame:
    """Rows (row, at, block, shard) of a folder that holds `shards` shards; schema is that of the written table.

    The hash is asked again, so rows that have moved to an appended shard are read there only.
    """
    layout = StructType().add("row", schema).add("at", LongType()).add("block", IntegerType()).add("shard", IntegerType())
    return spark.read.schema(layout).parquet(folder).where(F.col("shard") == jump(F.col(f"row.`{key}`"), shards))


def slots(rows: DataFrame, order: str) -> DataFrame:
    """rows (shard, block, at, `order`, others) with `slot`: the place in the shard by block, order and at, gapless from 0.

    Rows are numbered within blocks, and a block starts at the sum of those before it, so no task gets a shard; only the
    counts of a shard's blocks (one for each file) meet in one.
    """
    counts = rows.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("shard", "block").orderBy(order, "at"))
    return rows.withColumn("place", place).join(starts, ["shard", "block"]).withColumn("slot", F.col("base") + F.col("place") - 1).drop("base", "place")


def sharded(df: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """Write df's shards and read them back: rows (key, size, text_crc32, shard, slot, grown_shard), one for each row of df.

    size is the text's bytes and one, text_crc32 of its bytes (null: none), grown_shard the shard among one more. Repeated and null keys
    share a shard. Columns of df may have any names.
    """
    spark = df.sparkSession
    folder = folder or scratch(spark, "shards")
    write(df, folder, shards, key)
    k, t = F.col(f"row.`{key}`"), F.coalesce(F.col(f"row.`{text}`").cast("string"), F.lit(""))
    found = read(spark, folder, df.schema, shards, key).select(
        "shard", "block", "at", k.alias("k"), (F.octet_length(t).cast("long") + 1).alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), jump(k, shards + 1).alias("grown_shard")
    )
    columns = [F.col("k").alias(key), "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard"]
    return slots(found, "k").select(*columns)
