"""Exact deduplication over an extendible-hash index (operator 5), in built-in expressions only.

Every row has a 64-bit key of its text. Buckets are key prefixes; as long as one holds more distinct
keys than fit, its prefix grows by a bit and the directory doubles. A key that several rows share is a
chain; only then are texts fetched (by a bitmap of bounded size, so that other texts stay where they are),
and compared byte by byte as grouping keys, reduced before any shuffle so that thousands of copies arrive
as one row per task. The index is written in key order, one
owner task per range of buckets, and every row looks itself up in it.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.shared import Store, likely

BUCKET_KEYS = 4096


DEEPEST = 40


def prefix(key: str, depth: int) -> Column:
    """The first `depth` bits of the address of a key, which is spread evenly whatever the keys are."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(5), key), 64 - depth) if depth else F.lit(0).cast("long")


def directory(keys: DataFrame, bucket_keys: int = BUCKET_KEYS) -> tuple[DataFrame, int]:
    """Slots of the directory with their bucket (first slot, local depth), and the global depth.

    `keys` has distinct values of `key`. Each round counts the keys per prefix and splits only the
    buckets that are too full.
    """
    spark = keys.sparkSession
    depth = min(DEEPEST, max(0, math.ceil(math.log2(max(1, keys.count()) / bucket_keys))))
    found, pending = [], keys.select("key")
    while True:
        fill = pending.groupBy(prefix("key", depth).alias("slot")).count()
        full = fill.where((F.col("count") > bucket_keys) & F.lit(depth < DEEPEST)).select("slot")
        found.append((depth, fill.where((F.col("count") <= bucket_keys) | F.lit(depth == DEEPEST)).select("slot")))
        if full.isEmpty():
            break
        pending = pending.withColumn("slot", prefix("key", depth)).join(full, "slot", "left_semi").select("key")
        depth += 1
    slots = spark.createDataFrame([], "slot long, bucket long, depth int")
    for local, part in found:
        copies = 1 << (depth - local)
        first = F.col("slot") * copies
        slots = slots.union(
            part.select(
                F.explode(F.sequence(first, first + copies - 1)).alias("slot"),
                first.alias("bucket"),
                F.lit(local).alias("depth"),
            )
        )
    return slots, depth


def exact_groups(
    docs: DataFrame,
    bucket_keys: int = BUCKET_KEYS,
    key_of: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, bucket, depth: one row for each of `docs`.

    Reads doc_id and text, other columns are ignored. A null text is empty. In a group of equal texts the
    largest doc_id stays; null ids never do unless all are null, when keep_id is null and each is kept.
    Rows with equal id and equal text share their verdict. An empty table gives no rows.
    """
    store = Store(docs.sparkSession, "exact")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("body"))
    rows = rows.select("doc_id", "body", key_of(F.col("body")).cast("long").alias("key"))
    entries = store.put(rows.select("doc_id", "key", F.sha2("body", 256).alias("text_sha256")), "entries")
    keys = store.put(entries.groupBy("key").agg(F.count("*").alias("chain")), "keys")

    chained = keys.where("chain > 1").select("key")
    classes = (
        likely(rows, "key", chained)
        .groupBy("key", "body")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .select("key", F.sha2("body", 256).alias("member_sha256"), "keep_id", "group_size")
    )
    slots, depth = directory(keys, bucket_keys)
    placed = keys.withColumn("slot", prefix("key", depth)).join(slots, "slot")
    index = placed.join(classes, "key", "left").select(
        "bucket", "depth", "key", "chain", "member_sha256", "keep_id", "group_size"
    )
    index = store.put(index.repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key"), "index")

    own = (F.col("chain") == 1) | (F.col("member_sha256") == F.col("text_sha256"))
    single = F.col("chain") == 1
    keep = F.when(single, F.col("doc_id")).otherwise(F.col("keep_id"))
    return (
        entries.join(index.withColumnRenamed("key", "at"), (F.col("key") == F.col("at")) & own)
        .select(
            "doc_id",
            keep.alias("keep_id"),
            F.when(single, F.lit(1)).otherwise(F.col("group_size")).cast("long").alias("group_size"),
            F.col("doc_id").eqNullSafe(keep).alias("kept"),
            "text_sha256",
            "bucket",
            "depth",
        )
    )
