"""Positions, n-tiles and neighbours in one order over all rows, without bringing them into one task.

Rows are range partitioned and sorted; a row's position is its place in its partition plus the sizes of the partitions
before. Only those sizes are collected: one number per partition. Neighbours are looked up inside a partition, and the few
rows at the edges of partitions are carried over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.session import fan_out, written

PART, AT, SIZE, BEFORE = "_part", "_at", "_size", "_before"


class Ordered:
    """Rows in a total order: the last columns of `order` have to tell all rows apart, or ties fall as they come."""

    def __init__(self, rows: DataFrame, order: list[str | Column], parts: int | None = None):
        self.columns = rows.columns
        dealt = rows.repartitionByRange(parts or fan_out(rows.sparkSession), *order).sortWithinPartitions(*order)
        # Written once: a partition that is computed again could be cut elsewhere.
        placed = written(dealt.withColumns({PART: F.spark_partition_id(), AT: F.monotonically_increasing_id() % (1 << 33)}), "ordered")
        sizes = sorted((r[PART], r["count"]) for r in placed.groupBy(PART).count().collect())  # one row a partition
        self.total, offsets = 0, []
        for part, size in sizes:
            offsets.append((part, size, self.total))
            self.total += size
        known = rows.sparkSession.createDataFrame(offsets, f"{PART} int, {SIZE} long, {BEFORE} long")
        self.rows = placed.join(F.broadcast(known), PART)

    def _shown(self, rows: DataFrame, *names: str) -> DataFrame:
        return rows.select(*[c for c in self.columns if c not in names], *names)

    def positions(self, name: str = "position") -> DataFrame:
        """Adds the place of each row, from 1."""
        return self._shown(self.rows.withColumn(name, F.col(BEFORE) + F.col(AT) + 1), name)

    def tiles(self, n: int, name: str = "tile") -> DataFrame:
        """Adds the number (from 1) of the row's part among n parts of nearly equal size, the larger ones first."""
        size, more = divmod(self.total, n)
        place = F.col(BEFORE) + F.col(AT)
        large = F.floor(place / (size + 1)) + 1
        small = F.floor((place - more * (size + 1)) / max(1, size)) + 1 + more
        return self._shown(self.rows.withColumn(name, F.when(place < more * (size + 1), large).otherwise(small).cast("int")), name)

    def neighbours(self, wanted: dict[str, tuple[str, int]]) -> DataFrame:
        """Adds for each name the value of a column so many rows before (negative) or after; null beyond the ends."""
        rows = self.rows.withColumn("_place", F.col(BEFORE) + F.col(AT))
        inside = Window.partitionBy(PART).orderBy(AT)
        for name, (column, step) in wanted.items():
            k = abs(step)
            near = F.lag(column, k).over(inside) if step < 0 else F.lead(column, k).over(inside)
            crosses = F.col(AT) < k if step < 0 else F.col(AT) >= F.col(SIZE) - k
            edge = F.col(AT) >= F.col(SIZE) - k if step < 0 else F.col(AT) < k
            # At most k rows of each partition.
            carried = self.rows.where(edge).select((F.col(BEFORE) + F.col(AT) - step).alias("_place"), F.col(column).alias("_carried"))
            rows = rows.withColumn("_near", near).join(F.broadcast(carried), "_place", "left")
            rows = rows.withColumn(name, F.when(crosses, F.col("_carried")).otherwise(F.col("_near"))).drop("_near", "_carried")
        return self._shown(rows, *wanted)
