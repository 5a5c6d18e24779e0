"""Units used in the sliding window before each event, as plain windowed sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WINDOW_US = 60_000_000


def window_usage(events: DataFrame, key: str, window_us: int = WINDOW_US) -> DataFrame:
    """Adds `used`: units of the key in the window up to and including the event (age < window).

    Time is cut into spans of one window; a span also receives the events of the span before, so
    a busy key is spread over its spans.
    """
    span = F.floor(F.col("ts_us") / window_us)
    copies = events.withColumn("_span", F.explode(F.array(span, span + 1)))
    frame = Window.partitionBy(key, "_span").orderBy("ts_us").rangeBetween(-(window_us - 1), 0)
    summed = copies.withColumn("used", F.sum("units").over(frame))
    return summed.where(F.col("_span") == span).drop("_span")
