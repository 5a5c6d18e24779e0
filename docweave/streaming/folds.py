"""Rows of a shard applied in order to a small state, and the batch driver for it.

In a batch, rows are shuffled by shard and sorted, and reach the state one Arrow batch at a time, so memory
is bounded by the state however long a shard is. `live` keeps the same states in a stream.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


class Expiry:
    """Replies kept for `ttl_us` after they were made: which lookups of one key find one.

    The state is the time of the last lookup that made a reply. All lookups up to its end find it; the next
    one after that makes a new one, so a long row of times is crossed in steps of one lifetime.
    """

    SCHEMA = T.StructType([T.StructField("made", T.LongType())])

    def __init__(self, ttl_us: int):
        self.ttl_us, self.made = ttl_us, None

    def found(self, times: np.ndarray) -> np.ndarray:
        """For times in order: whether each finds a reply."""
        hit = np.ones(len(times), bool)
        at = 0 if self.made is None else int(np.searchsorted(times, self.made + self.ttl_us, side="right"))
        while at < len(times):
            hit[at], self.made = False, int(times[at])
            at = max(at + 1, int(np.searchsorted(times, self.made + self.ttl_us, side="right")))
        return hit

    def values(self) -> tuple:
        return (self.made,)

    def restore(self, made: int | None) -> None:
        self.made = made


class Thread:
    """One conversation: message count, waiting for answers, rounds of questions asked."""

    SCHEMA = T.StructType(
        [T.StructField("messages", T.LongType()), T.StructField("awaiting", T.BooleanType()), T.StructField("rounds", T.IntegerType())]
    )

    def __init__(self, max_rounds: int = 1, enabled: bool = True):
        self.max_rounds, self.enabled = max_rounds, enabled
        self.messages, self.awaiting, self.rounds = 0, False, 0

    def turn(self, symptom: bool, need_more: bool) -> tuple[int, bool, int]:
        self.messages += 1
        if symptom:
            asks = self.enabled and not self.awaiting and self.rounds < self.max_rounds and need_more
            self.awaiting = bool(asks)
            self.rounds += bool(asks)
        return self.messages, self.awaiting, self.rounds

    def values(self) -> tuple:
        return self.messages, self.awaiting, self.rounds

    def restore(self, messages: int, awaiting: bool, rounds: int) -> None:
        self.messages, self.awaiting, self.rounds = messages, awaiting, rounds


def expiry_rows(state: Expiry, rows: pd.DataFrame) -> pd.DataFrame:
    return rows.assign(hit=state.found(rows["ts_us"].to_numpy(np.int64)))


def thread_rows(state: Thread, rows: pd.DataFrame) -> pd.DataFrame:
    states = [state.turn(bool(s), bool(n)) for s, n in zip(rows["symptom"], rows["need_more"])]
    count, awaiting, rounds = zip(*states) if states else ((), (), ())
    return rows.assign(
        n_messages=pd.Series(count, index=rows.index, dtype="int64"),
        awaiting=pd.Series(awaiting, index=rows.index, dtype=bool),
        rounds=pd.Series(rounds, index=rows.index, dtype="int32"),
    )


def output_schema(df: DataFrame, added: str) -> T.StructType:
    return T.StructType(df.schema.fields + T._parse_datatype_string(added).fields)


def fold(df: DataFrame, shard: str, order: list[str], fresh: Callable, step: Callable, added: str) -> DataFrame:
    """Applies the rows of each shard in order to a fresh state, adding the columns `added`."""
    columns = [f.name for f in output_schema(df, added).fields]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for batch in batches:
            for value, rows in batch.groupby(shard, sort=False, dropna=False):
                if state is None or value != current:
                    current, state = value, fresh()
                yield step(state, rows)[columns]

    return (
        df.repartition(shard).sortWithinPartitions(shard, *order).mapInPandas(scan, output_schema(df, added))
    )
