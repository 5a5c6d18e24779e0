"""The states of `folds` as Structured Streaming operators: typed and kept by Spark."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

import docweave
from docweave.session import ROCKSDB, shared_folder
from docweave.streaming.folds import output_schema


class OrderedState(StatefulProcessor):
    """Keeps one state per shard; rows of a micro-batch are applied in order."""

    def __init__(self, fresh: Callable, step: Callable, order: list[str], columns: list[str]):
        self.fresh, self.step, self.order, self.columns = fresh, step, order, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("state", self.fresh().SCHEMA)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.fresh()
        if self.kept.exists():
            state.restore(*self.kept.get())
        batch = pd.concat(list(rows)).sort_values(self.order, kind="stable").reset_index(drop=True)
        out = self.step(state, batch)
        self.kept.update(state.values())
        yield out[self.columns]

    def close(self) -> None:
        pass


def apply(stream: DataFrame, shard: str, order: list[str], fresh: Callable, step: Callable, added: str) -> DataFrame:
    """The streaming twin of `folds.fold`. Events of a shard must arrive in order of micro-batches."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    schema = output_schema(stream, added)
    processor = OrderedState(fresh, step, order, [f.name for f in schema.fields])
    # The worker that sets up the state does not see added Python files: send the code itself.
    cloudpickle.register_pickle_by_value(docweave)
    try:
        return stream.groupBy(shard).transformWithStateInPandas(
            processor, outputStructType=schema, outputMode="Append", timeMode="None"
        )
    finally:
        cloudpickle.unregister_pickle_by_value(docweave)


def drained(result: DataFrame, name: str) -> DataFrame:
    """Runs a stream over everything available, into a table in the shared folder."""
    spark: SparkSession = result.sparkSession
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    query = (
        result.writeStream.format("parquet")
        .option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{folder}/out")
