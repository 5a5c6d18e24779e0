"""Threads that end when they have been idle for their time to live, in a stream with timers and as a batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

import docweave
from docweave.session import ROCKSDB

STATE = T.StructType([T.StructField(n, T.LongType()) for n in ("first", "last", "n")])


class IdleThreads(StatefulProcessor):
    """First time, last time and number of messages of each open thread; a timer ends it `ttl` after its last message."""

    def __init__(self, ttl_us: int):
        self.ttl_us = ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("thread", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.kept.get() if self.kept.exists() else None
        ended = []
        # One number per message; the messages of a key in one micro-batch need not come in order.
        for at in sorted(t for part in rows for t in part["at_us"].tolist()):
            if state and at - state[1] > self.ttl_us:
                ended.append(state)
                state = None
            state = (at, at, 1) if state is None else (min(state[0], at), max(state[1], at), state[2] + 1)
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.kept.update(state)
        self.handle.registerTimer((state[1] + self.ttl_us) // 1000 + 1)
        yield self._out(key, ended)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self.kept.get() if self.kept.exists() else None
        self.kept.clear()
        yield self._out(key, [state] if state else [])

    def _out(self, key, ended: list) -> pd.DataFrame:
        rows = [(key[0], *state) for state in ended]
        return pd.DataFrame(rows, columns=["thread", "first_us", "last_us", "n_messages"]).astype("int64")

    def close(self) -> None:
        pass


def idle_threads(rows: DataFrame, key: str, time: str, ttl: str, delay: str = "0 seconds") -> DataFrame:
    """thread, first_us, last_us, n_messages of the threads that have ended: the next message, or the watermark, came
    more than `ttl` after the last one. `key` is a whole number. State and timer of an ended thread are gone.

    The batch form takes the latest time less `delay` for the watermark.
    """
    given = rows.select(F.col(key).cast("long").alias("thread"), F.col(time).alias("at"), F.unix_micros(F.col(time)).alias("at_us"))
    spark = rows.sparkSession
    ttl_us = spark.range(1).select(F.expr(f"unix_micros(timestamp'1970-01-01' + INTERVAL {ttl}) - unix_micros(timestamp'1970-01-01')")).first()[0]
    if not rows.isStreaming:
        return _ended(given, ttl_us, delay)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    cloudpickle.register_pickle_by_value(docweave)  # the worker that sets up the state does not see added files
    try:
        return given.withWatermark("at", delay).groupBy("thread").transformWithStateInPandas(
            IdleThreads(ttl_us), outputStructType="thread long, first_us long, last_us long, n_messages long",
            outputMode="Append", timeMode="EventTime",
        )
    finally:
        cloudpickle.unregister_pickle_by_value(docweave)


def _ended(given: DataFrame, ttl_us: int, delay: str) -> DataFrame:
    """Sessions merged per task first, so that a busy thread is many rows in no task."""
    spans = given.groupBy("thread", F.session_window("at", f"{ttl_us} microseconds").alias("s")).agg(
        F.min("at_us").alias("first_us"), F.max("at_us").alias("last_us"), F.count("*").alias("n_messages")
    )
    mark = given.agg(F.unix_micros(F.max("at") - F.expr(f"INTERVAL {delay}"))).first()[0]  # one number
    later = F.lead("first_us").over(Window.partitionBy("thread").orderBy("first_us"))
    passed = F.floor((F.col("last_us") + ttl_us) / 1000) + 1 <= F.floor(F.lit(mark) / 1000)
    return spans.withColumn("_later", later).where(F.col("_later").isNotNull() | passed).select(
        "thread", "first_us", "last_us", "n_messages"
    )
