"""Per-key facts and ordered positions for keys that may hold a large share of all rows.

Nothing here brings all rows of one key into one task. A key is spread over (key, salt) or
(key, block) parts; each part is reduced first, and only the reduced parts of a key meet.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.session import fan_out

SALT = "_salt"
BLOCK = "_block"
SENT_KEYS = 500_000  # keys that every task may hold


def with_salt(df: DataFrame, row_id: list[str]) -> DataFrame:
    return df.withColumn(SALT, F.pmod(F.xxhash64(*row_id), F.lit(fan_out(df.sparkSession))).cast("int"))


def with_key_facts(
    df: DataFrame,
    keys: list[str],
    row_id: list[str],
    facts: dict[str, tuple[Column, Callable[[Column], Column]]],
) -> DataFrame:
    """Adds one aggregate per entry of `facts` to every row of its key.

    An entry is (partial aggregate over rows, function that merges partials), for example
    (F.min("x"), F.min). The rows are reduced per (key, salt), the partials of a key (at most
    one per salt) are merged, and the result returns to the rows over (key, salt).
    """
    salted = with_salt(df, row_id)
    partial = salted.groupBy(*keys, SALT).agg(*[part.alias(name) for name, (part, _) in facts.items()])
    whole = Window.partitionBy(*keys)
    merged = partial.select(
        *keys, SALT, *[merge(F.col(name)).over(whole).alias(name) for name, (_, merge) in facts.items()]
    )
    return salted.join(merged, [*keys, SALT]).drop(SALT)


def attach(df: DataFrame, facts: DataFrame, keys: list[str], row_id: list[str], how: str = "inner") -> DataFrame:
    """Join one row per key to rows whose keys may be hot; `facts` is copied once per salt in use."""
    salted = with_salt(df, row_id)
    spread = salted.select(*keys, SALT).distinct().join(facts, keys)
    return salted.join(spread, [*keys, SALT], how).drop(SALT)


def keep_only(rows: DataFrame, wanted: DataFrame, unwanted: DataFrame, key: str, limit: int = SENT_KEYS) -> DataFrame:
    """The rows whose key is in `wanted`; `wanted` and `unwanted` together hold every key once.

    Wide rows stay where they are if either list is short enough to be sent to all tasks, which is
    counted first; otherwise they meet the wanted keys in a shuffle.
    """
    if unwanted.limit(limit + 1).count() <= limit:
        return rows.join(F.broadcast(unwanted.select(key)), key, "left_anti")
    if wanted.limit(limit + 1).count() <= limit:
        return rows.join(F.broadcast(wanted.select(key)), key, "left_semi")
    return rows.join(wanted.select(key), key, "left_semi")


def running_before(
    df: DataFrame, keys: list[str], order: str, amount: Column, name: str, width: int
) -> DataFrame:
    """Exclusive running sum of `amount` per key in `order` (an integer column, unique per key).

    Rows are cut into blocks of `width` order values. A block is summed on its own; only the block
    totals of a key are added up in order.
    """
    blocks = df.withColumn(BLOCK, F.floor(F.col(order) / width)).withColumn("_amount", amount)
    totals = blocks.groupBy(*keys, BLOCK).agg(F.sum("_amount").alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, BLOCK, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys, BLOCK).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = blocks.withColumn("_local", F.coalesce(F.sum("_amount").over(inside), F.lit(0)))
    return (
        local.join(starts, [*keys, BLOCK])
        .withColumn(name, F.col("_start") + F.col("_local"))
        .drop(BLOCK, "_amount", "_start", "_local")
    )


def last_rows_before(
    df: DataFrame, keys: list[str], order: str, n: int, value: Column, name: str, width: int = 512
) -> DataFrame:
    """Array of the last `n` values before each row of its key, oldest first.

    Rows get a dense position per key; blocks of `width` positions also receive the last `n`
    rows of the block before, so that each window sees its whole look-back and no block exceeds
    width + n rows.
    """
    placed = running_before(df.withColumn("_value", value), keys, order, F.lit(1), "_pos", 4096)
    block = F.floor(F.col("_pos") / width)
    near_end = F.col("_pos") % width >= width - n
    targets = F.when(near_end, F.array(block, block + 1)).otherwise(F.array(block))
    copies = placed.withColumn(BLOCK, F.explode(targets))
    window = Window.partitionBy(*keys, BLOCK).orderBy("_pos").rowsBetween(-n, -1)
    return (
        copies.withColumn(name, F.collect_list("_value").over(window))
        .where(F.col(BLOCK) == block)
        .drop(BLOCK, "_value", "_pos")
    )


def first_rows_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str) -> DataFrame:
    """The first `n` rows of each key with their rank; the group limit cuts rows before the shuffle."""
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(rank) <= n)
