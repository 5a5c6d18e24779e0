"""Sharding by a histogram sort (operator 8), in built-in expressions only.

Rows are ordered by a 64-bit key of their text, so equal texts are neighbours. Splitters are found by
counting: each round sums the exact bytes in 256 cells of every key interval that still holds a boundary,
and refines the cells around the targets until the splitters are within tolerance. Then the rows move once.

A group of equal texts above the tolerance would make the order too coarse. There can only be few: they are
counted first, put whole on the emptiest shards, and the splitters give the other rows to what is left. A
group above one shard's share is spread row by row, as no balanced assignment keeps it whole.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.shared import Store

SHARDS = 8
TOLERANCE = 0.01  # of a shard's share
PROBE_BITS = 8
BLOCK_ROWS = 50_000
LOWEST = -(1 << 63)


def fill_levels(loads: list[int], light: int) -> list[int]:
    """How much of `light` each shard takes so that all loads end as even as they can."""
    level, left, order = 0, light, sorted(loads)
    for i, load in enumerate(order):
        above = order[i + 1] if i + 1 < len(order) else None
        if above is None or left <= (above - load) * (i + 1):
            level = load + left // (i + 1)
            break
        left -= (above - load) * (i + 1)
    takes = [max(0, level - load) for load in loads]
    for i in sorted(range(len(loads)), key=lambda s: loads[s])[: light - sum(takes)]:
        takes[i] += 1
    return takes


def splitters(rows: DataFrame, targets: list[int], tolerance: float) -> list[int]:
    """Keys below which about `targets` bytes lie; `rows` has `key` (as unsigned) and `size`.

    Each answer sums at most 256 cells per boundary that is still open.
    """
    found = [None] * len(targets)
    base = {0: 0}  # prefix of an open interval: bytes below it
    at = {b: 0 for b in range(len(targets))}
    bits = 0
    while at:
        cell = F.shiftrightunsigned("key", 64 - bits - PROBE_BITS)
        inside = rows if not bits else rows.where(F.shiftrightunsigned("key", 64 - bits).isin(list(base)))
        sums = {r["cell"]: r["bytes"] for r in inside.groupBy(cell.alias("cell")).agg(F.sum("size").alias("bytes")).collect()}
        bits += PROBE_BITS
        opened, still = {}, {}
        for b, start in at.items():
            below, first = base[start], (start << PROBE_BITS) if bits > PROBE_BITS else 0
            for c in range(first, first + (1 << PROBE_BITS)):
                here = sums.get(c if c < 1 << 63 else c - (1 << 64), 0)
                if below + here >= targets[b] or c == first + (1 << PROBE_BITS) - 1:
                    break
                below += here
            under, over = targets[b] - below, below + here - targets[b]
            if bits == 64 or min(abs(under), abs(over)) <= tolerance:
                found[b] = (c if abs(under) <= abs(over) else c + 1) << (64 - bits)
            else:
                opened[c], still[b] = below, c
        base, at = opened, still
    return found


def shards(docs: DataFrame, count: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: one row for each of `docs`.

    Reads doc_id and text, other columns are ignored. A null text has no bytes, and each row counts one
    byte besides its text. Rows equal in id and text are interchangeable. Slots follow the key order within
    a shard and have no gaps. An empty table gives no rows.
    """
    spark = docs.sparkSession
    store = Store(spark, "shards")
    body = F.coalesce("text", F.lit(""))
    rows = store.put(
        docs.select(
            "doc_id",
            (F.octet_length(body) + 1).cast("long").alias("size"),
            F.crc32(body).alias("text_crc32"),
            F.xxhash64(body).alias("text_key"),
            F.xxhash64(F.lit(8), "doc_id").alias("row_key"),
        ),
        "rows",
    )
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    share = max(1, total / count)
    groups = rows.groupBy("text_key").agg(F.sum("size").alias("bytes"), F.count("*").alias("copies"))
    large = groups.where((F.col("bytes") > tolerance * share) & (F.col("copies") > 1)).collect()  # count/tolerance at most
    loads, fixed, spread = [0] * count, {}, []
    for group in sorted(large, key=lambda g: (-g["bytes"], g["text_key"])):
        shard = min(range(count), key=loads.__getitem__)
        if loads[shard] + group["bytes"] > share * (1 + tolerance):
            spread.append(group["text_key"])
        else:
            loads[shard] += group["bytes"]
            fixed[group["text_key"]] = shard

    values = ", ".join(f"({key}L, {shard})" for key, shard in [*fixed.items(), *((k, -1) for k in spread)])
    known = spark.sql(f"SELECT * FROM VALUES {values or '(0L, -2)'} AS t(text_key, fixed)".replace("(-9223372036854775808L", "(bigint('-9223372036854775808')"))
    rows = rows.join(F.broadcast(known.where("fixed > -2")), "text_key", "left").withColumn(
        "key", F.when(F.col("fixed").isNull(), F.col("text_key")).otherwise(F.col("row_key"))
    )
    takes = fill_levels(loads, total - sum(loads))
    targets = [sum(takes[: s + 1]) for s in range(count - 1)]
    free = rows.where("fixed IS NULL OR fixed < 0").select("key", "size")
    cuts = splitters(free, targets, tolerance * share / 4) if n else [0] * (count - 1)
    place = F.col("key").bitwiseXOR(F.lit(LOWEST))  # signed order of the unsigned key
    above = [(place >= F.lit(cut + LOWEST)).cast("int") for cut in cuts if cut < 1 << 64]
    between = sum(above[1:], above[0]) if above else F.lit(0)
    shard = F.when(F.col("fixed") >= 0, F.col("fixed")).otherwise(between).cast("int")

    bits = max(3, math.ceil(math.log2(max(1, n / count / BLOCK_ROWS))))
    rows = rows.withColumn("shard", shard).withColumn("place", place)
    rows = rows.withColumn("block", F.shiftrightunsigned("key", 64 - bits))
    fill = rows.groupBy("shard", "block").agg(F.count("*").alias("held"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = fill.select("shard", "block", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "block").orderBy("place", "doc_id", "text_crc32", "size")
    return (
        rows.withColumn("nth", F.row_number().over(inside))
        .join(starts, ["shard", "block"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("start") + F.col("nth") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )
