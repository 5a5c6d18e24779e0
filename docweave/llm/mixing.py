"""Mixing sources to target weights by Pareto order sampling (operator 3).

Targets come from a table with one row per source. A source that is to give r times its words gives
floor(r) certain copies of every document; the rest are drawn without replacement, with unequal probabilities:
a document's inclusion follows its size, at most 1, and the expected words are the rest of the target. Documents are
ranked by random odds over inclusion odds, and the first ones that fill the target are taken. The cut in the ranking
is found from sums over narrow cells of the rank variable, so that only one cell of a source is sorted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.shared import Store

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
CELL_ROWS = 2000
WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """source, source_size, target from rows of (source, source_size).

    Sources in code point order, null last, weigh as `weights` repeats. All sizes are shared by weight; a
    source stops at `most` times its size, and the others share what it leaves: with sources ordered by
    limit over weight, exactly a first run of them stops.
    """
    everything = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    rows = sizes.select("source", "source_size", weight.cast("double").alias("weight"))
    rows = rows.withColumn("limit", (F.col("source_size") * most).cast("double"))
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(earlier), F.lit(0.0))
    weights_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))
    rows = rows.withColumn("level", left / weights_left)
    free = F.col("limit") / F.col("weight") >= F.col("level")
    level = F.max(F.when(free, F.col("level"))).over(everything)
    even = F.coalesce(level * F.col("weight"), F.col("limit"))
    return rows.select("source", "source_size", F.least(even, F.col("limit")).alias("target"))


def uniform(seed: int = 3) -> Column:
    """A number between 0 and 1 that only depends on id and text."""
    text = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("~")), F.md5(F.coalesce("text", F.lit(""))))
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def measures() -> list[Column]:
    """doc_id, source, size, text_key, chance of a row."""
    return [F.col("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("text_key"), uniform().alias("chance")]


def place(size: Column, chance: Column, least: Column, slope: Column) -> Column:
    """Rank variable between 0 and 1: random odds over inclusion odds, as a share of both; inclusion 0 comes last."""
    inclusion = F.when(size >= least, 1.0).otherwise(F.coalesce(slope * size, F.lit(0.0)))
    against, odds = chance * (1 - inclusion), (1 - chance) * inclusion
    return F.when(size == 0, 1.0).otherwise(against / (against + odds))


def inclusions(rows: DataFrame, shares: DataFrame) -> DataFrame:
    """`shares` with `least` and `slope`: documents of `least` words and more are included for certain, others by slope * size.

    With sizes in falling order, the certain ones are a first run: each size of it is at least one over the slope that
    the sizes from it on would need to reach what is left of the rest. Rows are counted by size first; a source has
    as many rows here as it has different sizes.
    """
    exact = F.col("n") * F.col("size").cast("decimal(12,0)")
    by_size = rows.where("size > 0").groupBy("source", "size").agg(F.count("*").cast("decimal(12,0)").alias("n"))
    later = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    larger = Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    by_size = by_size.select(
        F.col("source").alias("of"), "size",
        F.coalesce(F.sum(exact).over(larger), F.lit(0)).cast("double").alias("above"),
        F.sum(exact * F.col("size").cast("decimal(12,0)")).over(later).cast("double").alias("squares"),
    )
    own = by_size.join(shares.select(F.col("source").alias("at"), "rest"), F.col("of").eqNullSafe(F.col("at"))).where("rest > 0")
    own = own.withColumn("slope", (F.col("rest") - F.col("above")) / F.col("squares"))
    free = F.col("slope") * F.col("size") < 1  # then it holds for all smaller sizes too
    first = own.where(free).groupBy("of").agg(F.max(F.struct("size", "slope")).alias("first"))
    found = shares.join(first, F.col("source").eqNullSafe(F.col("of")), "left")
    slope = F.coalesce(F.col("first.slope"), F.lit(0.0))
    return found.withColumns({"least": F.col("first.size") + 1, "slope": F.greatest(slope, F.lit(0.0))}).drop("of", "first")


def plan(rows: DataFrame, store: Store, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """source, source_size, target, certain, least, slope, last: what each source gives; one row per source.

    `rows` hold the `measures`. `certain` is the number of copies of every document, `last` the place (rank,
    doc_id, text_key) of the last document drawn besides.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    sizes = store.put(sizes, "sizes")
    largest = sizes.agg(F.coalesce(F.max("docs"), F.lit(1))).first()[0]
    cells = max(1, math.ceil(largest / CELL_ROWS))
    shares = targets(sizes.select("source", "source_size"), weights, most)
    times = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    shares = shares.withColumn("certain", F.floor(times).cast("long"))
    shares = shares.withColumn("rest", F.col("target") - F.col("certain") * F.col("source_size"))
    shares = store.put(inclusions(rows, store.put(shares, "rests")), "shares")

    joined = rows.join(shares.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    ranked = joined.withColumn("rank", place(F.col("size"), F.col("chance"), F.col("least"), F.col("slope")))
    ranked = ranked.withColumn("cell", F.least(F.lit(cells - 1), F.floor(F.col("rank") * cells)).cast("int"))
    sums = ranked.groupBy("source", "cell").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    before = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("below", F.coalesce(F.sum("words").over(before), F.lit(0)))
    state = F.when(F.col("below") + F.col("words") <= F.col("rest"), 1).when(F.col("below") >= F.col("rest"), 0)
    sums = sums.select(
        F.col("source").alias("of"), F.col("cell").alias("at"), "below", F.coalesce(state, F.lit(2)).alias("state")
    )
    placed = ranked.join(sums, F.col("source").eqNullSafe(F.col("of")) & (F.col("cell") == F.col("at"))).drop("of", "at")
    fates = ["source", "rank", "doc_id", "text_key", "below", "rest"]
    inside = Window.partitionBy("source").orderBy("rank", "doc_id", "text_key").rowsBetween(Window.unboundedPreceding, -1)
    cut = placed.where("state = 2").groupBy(*fates).agg(F.sum("size").alias("words"))  # equal rows count as one
    reached = F.col("below") + F.coalesce(F.sum("words").over(inside), F.lit(0)) + F.col("words") / 2
    drawn = cut.withColumn("reached", reached).where(F.col("reached") <= F.col("rest")).select(*fates)
    drawn = placed.where("state = 1").select(*fates).unionByName(drawn)
    last = drawn.groupBy("source").agg(F.max(F.struct("rank", "doc_id", "text_key")).alias("last"))
    last = last.withColumnRenamed("source", "of")
    found = shares.join(last, F.col("source").eqNullSafe(F.col("of")), "left").drop("of", "rest")
    return store.put(found, "plan")


def copies(rows: DataFrame, shares: DataFrame) -> DataFrame:
    """`rows`, which have the columns of `measures`, with source_size, target and how often each row is taken."""
    shares = shares.withColumnRenamed("source", "_of")
    joined = rows.join(shares, F.col("source").eqNullSafe(F.col("_of")))
    here = F.struct(place(F.col("size"), F.col("chance"), F.col("least"), F.col("slope")).alias("rank"), "doc_id", "text_key")
    drawn = F.coalesce(here <= F.col("last"), F.lit(False)).cast("long")
    return joined.withColumn("copies", F.when(F.col("size") > 0, F.col("certain") + drawn).otherwise(0))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken: one row for each of `docs`.

    Reads doc_id, text and source; other columns are ignored. A null or empty text has no words and takes none. A
    null source is a source of its own. Ties in the ranking go by id, then by text; rows equal in both share one
    fate. An empty table gives no rows.
    """
    store = Store(docs.sparkSession, "mix")
    rows = store.put(docs.select(*measures()), "rows")
    return copies(rows, plan(rows, store, weights, most)).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken")
    )


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it. The texts stay where they are."""
    store = Store(docs.sparkSession, "mix")
    shares = plan(store.put(docs.select(*measures()), "rows"), store, weights, most)
    own = docs.select(F.struct(*docs.columns).alias("_row"), *measures())
    taken = copies(own, shares).where("copies > 0")
    each = taken.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return each.select(*[F.col("_row")[c].alias(c) for c in docs.columns])


ORACLE_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         (CAST('0x' || substr(md5('3|' || doc_id || '|' || md5(coalesce(text, ''))), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0 AS chance
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight
  FROM d GROUP BY source),
total AS (SELECT CAST(sum(source_size) AS DOUBLE) AS words FROM s),
rounds AS (  -- a source above its limit stops there, the others share what is left
  SELECT 0 AS round, source, FALSE AS stopped FROM s
  UNION ALL
  SELECT round + 1, source, stopped OR 3.0 * source_size < level * weight
  FROM (SELECT r.round, r.source, r.stopped, s.source_size, s.weight,
               (SELECT words FROM total) - sum(CASE WHEN r.stopped THEN 3.0 * s.source_size ELSE 0 END) OVER () AS rest,
               ((SELECT words FROM total) - sum(CASE WHEN r.stopped THEN 3.0 * s.source_size ELSE 0 END) OVER ())
               / sum(CASE WHEN r.stopped THEN 0 ELSE s.weight END) OVER () AS level
        FROM rounds r JOIN s ON r.source IS NOT DISTINCT FROM s.source) WHERE round < 40),
final AS (
  SELECT s.source, s.source_size, CASE WHEN r.stopped THEN 3.0 * s.source_size ELSE s.weight *
         (((SELECT words FROM total) - sum(CASE WHEN r.stopped THEN 3.0 * s.source_size ELSE 0 END) OVER ())
          / sum(CASE WHEN r.stopped THEN 0 ELSE s.weight END) OVER ()) END AS target
  FROM rounds r JOIN s ON r.source IS NOT DISTINCT FROM s.source WHERE round = 40),
t AS (SELECT *, CAST(floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) AS BIGINT) AS certain FROM final),
m AS (  -- larger documents are certain, the others follow their size up to what is left
  SELECT source, arg_max(steep, size) AS slope, max(size) + 1 AS least
  FROM (SELECT z.source, z.size,
               (t.target - t.certain * t.source_size
                - CAST(coalesce(sum(z.words) OVER (PARTITION BY z.source ORDER BY z.size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
               / CAST(sum(z.words * z.size) OVER (PARTITION BY z.source ORDER BY z.size) AS DOUBLE) AS steep
        FROM (SELECT source, size, CAST(count(*) AS HUGEINT) * size AS words FROM d WHERE size > 0 GROUP BY source, size) z
        JOIN t ON z.source IS NOT DISTINCT FROM t.source WHERE t.target > t.certain * t.source_size)
  WHERE steep * size < 1 GROUP BY source),
i AS (
  SELECT d.*, CASE WHEN d.size >= m.least THEN 1.0::DOUBLE ELSE coalesce(greatest(m.slope, 0) * d.size, 0) END AS inclusion
  FROM d LEFT JOIN m ON d.source IS NOT DISTINCT FROM m.source),
r AS (SELECT *, CASE WHEN size = 0 THEN 1 ELSE chance * (1 - inclusion) / (chance * (1 - inclusion) + (1 - chance) * inclusion) END AS rank FROM i),
k AS (
  SELECT r.doc_id, r.size, t.source_size, t.target, t.certain, t.target - t.certain * t.source_size AS rest,
         sum(r.size) OVER (PARTITION BY r.source ORDER BY r.rank, r.doc_id ROWS UNBOUNDED PRECEDING) - r.size / 2.0 AS reached
  FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (certain + CASE WHEN reached <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM k
"""
