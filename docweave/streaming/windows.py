"""Event-time operators: windows behind a watermark, late rows, sessions, interval joins, deduplication.

Each works on a stream and, with the same arguments, on a table; `tests` hold the two against each other. State is
bounded by the watermark: what can no longer change is put out and forgotten.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.operators.skew import attach, with_key_facts
from docweave.sources.versions import Tables

LOCAL_SESSIONS = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"
HEAVY_ROWS = 100_000


def _marked(rows: DataFrame, time: str, delay: str | None) -> DataFrame:
    return rows.withWatermark(time, delay) if delay and rows.isStreaming else rows


def windows(
    rows: DataFrame, time: str, width: str, keys: list[str], measures: list[Column], delay: str | None = None, slide: str | None = None
) -> DataFrame:
    """window_start, window_end, keys, measures: tumbling windows, or sliding ones with `slide`.

    In a stream a window comes out once, when the watermark (latest time seen less `delay`) has passed its end; rows
    that come later than that are left out, and `LateRows` counts them. A key is reduced per task before the shuffle.
    """
    span = F.window(time, width, slide) if slide else F.window(time, width)
    found = _marked(rows, time, delay).groupBy(span.alias("_span"), *keys).agg(*measures)
    return found.select(F.col("_span.start").alias("window_start"), F.col("_span.end").alias("window_end"), *found.columns[1:])


def sessions(rows: DataFrame, time: str, gap: str, keys: list[str], measures: list[Column], delay: str | None = None) -> DataFrame:
    """session_start, session_end, keys, measures: rows of a key at most `gap` apart (the end is last + gap).

    Sessions are merged inside each task before the shuffle, so that a key with very many rows arrives as few sessions.
    """
    rows.sparkSession.conf.set(LOCAL_SESSIONS, "true")
    found = _marked(rows, time, delay).groupBy(F.session_window(time, gap).alias("_span"), *keys).agg(*measures)
    return found.select(F.col("_span.start").alias("session_start"), F.col("_span.end").alias("session_end"), *found.columns[1:])


def unique(rows: DataFrame, id_: list[str], time: str, delay: str) -> DataFrame:
    """The first row of each id; in a stream an id is remembered until the watermark passes the time of its row plus `delay`."""
    if rows.isStreaming:
        return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(id_)
    return rows.dropDuplicates(id_)


@dataclass
class LateRows:
    """The rows that `windows` leaves out, counted per window into a versioned table.

    For `foreachBatch` of a query on the same input as the windows. The watermark of a micro-batch is the latest time of
    all micro-batches before it, less the delay. Counts, latest time and number of the micro-batch are one commit, so a
    micro-batch that is run again after a failure counts once.
    """

    tables: Tables
    time: str
    width: str
    delay: str
    keys: list[str]
    slide: str | None = None

    def __call__(self, batch: DataFrame, number: int) -> None:
        state = self.tables.state()
        done, latest = state["properties"].get("batch", -1), state["properties"].get("latest")
        if number <= done:
            return
        micros = F.unix_micros(F.col(self.time))
        newest = batch.agg(F.max(micros)).first()[0]
        change = self.tables.change(state["version"])
        if latest is not None and newest is not None:
            span = F.window(self.time, self.width, self.slide) if self.slide else F.window(self.time, self.width)
            limit = F.timestamp_micros(F.lit(latest)) - F.expr(f"INTERVAL {self.delay}")
            late = batch.withColumn("_span", span).where(F.col("_span.end") <= limit)
            counted = late.groupBy(F.col("_span.start").alias("window_start"), F.col("_span.end").alias("window_end"), *self.keys).agg(
                F.count("*").alias("n_late")
            )
            counted = counted.withColumn("batch", F.lit(number).cast("long"))
            change.replace("late", counted, counted.select("batch").limit(0), "batch", ["window_start", *self.keys])
        change.properties |= {"batch": number, "latest": max(x for x in (latest, newest, -(2**62)) if x is not None)}
        change.commit(f"micro-batch {number}")

    def counts(self) -> DataFrame | None:
        """window_start, window_end, keys, n_late over all micro-batches; None where no row could be late yet."""
        found = self.tables.read("late")
        if found is None:
            return None
        return found.groupBy("window_start", "window_end", *self.keys).agg(F.sum("n_late").alias("n_late"))


def interval_join(
    left: DataFrame, right: DataFrame, keys: list[str], times: tuple[str, str], low: str, high: str,
    how: str = "inner", delays: tuple[str, str] | None = None, row_id: list[str] | None = None, parts: int = 1, heavy: int = HEAVY_ROWS,
) -> DataFrame:
    """Pairs of a left and a right row of equal keys with left time + low <= right time <= left time + high.

    `how` is 'inner' or 'left'; the two sides share no column names but the keys. In a stream both sides are kept until the
    watermarks (`delays`) rule out a partner; left rows without one come out then. There a key may be spread over `parts`:
    each left row (told apart by `row_id`) belongs to one, and right rows go to all of them. In a batch, time is cut into
    bins as wide as the interval; a bin with over `heavy` left rows of a key is split, and only its right rows are copied.
    """
    begin, end = times
    row_id = row_id or [begin]
    earliest, last = F.expr(f"`{begin}` + INTERVAL {low}"), F.expr(f"`{begin}` + INTERVAL {high}")
    if left.isStreaming or right.isStreaming:
        a = left.withWatermark(begin, delays[0]).withColumn("_part", F.pmod(F.xxhash64(*row_id), F.lit(parts)))
        b = right.withWatermark(end, delays[1]).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        renamed = {k: f"_right_{k}" for k in keys}
        b = b.withColumnsRenamed(renamed)
        same = F.col("_part") == F.col("_other")
        for k, r in renamed.items():
            same = same & (F.col(k) == F.col(r))
        inside = same & (F.col(end) >= earliest) & (F.col(end) <= last)
        return a.join(b, inside, {"left": "left_outer"}.get(how, how)).drop("_part", "_other", *renamed.values())
    alone = F.exists(F.array(*[F.col(c).isNull() for c in (begin, *keys)]), lambda x: x)  # these meet nothing
    joined = _binned(left.where(~alone), right, keys, begin, end, earliest, last, low, high, how, row_id, heavy)
    return joined if how == "inner" else joined.unionByName(left.where(alone), allowMissingColumns=True)


def _binned(left, right, keys, begin, end, earliest, last, low, high, how, row_id, heavy) -> DataFrame:
    spark = left.sparkSession
    width = max(1, spark.range(1).select(F.expr(f"unix_micros(timestamp'1970-01-01' + INTERVAL {high}) - unix_micros(timestamp'1970-01-01' + INTERVAL {low})")).first()[0])
    bin_of = lambda t: F.floor(F.unix_micros(t) / width)
    counted = with_key_facts(left.withColumn("_bin", bin_of(earliest)), [*keys, "_bin"], row_id, {"_n": (F.count("*"), F.sum)})
    split = counted.withColumn("_parts", F.ceil(F.col("_n") / heavy)).withColumn("_part", F.pmod(F.xxhash64(*row_id), F.col("_parts")))
    # An interval from a bin ends in that bin or the next one, so a right row serves its bin and the one before.
    here = bin_of(F.col(end))
    served = right.withColumn("_bin", F.explode(F.array(here, here - 1)))
    many = split.where(F.col("_parts") > 1).select(*keys, "_bin", F.col("_parts").alias("_copies")).distinct()
    right_id = [c for c in right.columns]
    served = attach(served, many, [*keys, "_bin"], right_id, "left")
    served = served.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("_copies", F.lit(1)) - 1))).drop("_copies")
    on = [*keys, "_bin", "_part"]
    renamed = served.withColumnsRenamed({c: f"_right{c}" for c in on})
    meets = (F.col(end) >= earliest) & (F.col(end) <= last)
    for c in on:
        meets = meets & (F.col(c) == F.col(f"_right{c}"))
    joined = split.join(renamed, meets, {"left": "left_outer"}.get(how, how))
    return joined.drop("_bin", "_n", "_parts", "_part", *[f"_right{c}" for c in on])
