"""A folder that streams read, filled arrival by arrival; every arrival is one run of each stream from its checkpoint."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from docweave.session import shared_folder


class Feed:
    def __init__(self, spark: SparkSession, schema: T.StructType, name: str):
        self.spark, self.schema = spark, schema
        self.folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.arrivals = 0

    def arrive(self, rows: DataFrame) -> None:
        rows.select(*self.schema.names).write.mode("append").parquet(f"{self.folder}/in")
        self.arrivals += 1

    def stream(self) -> DataFrame:
        return self.spark.readStream.schema(self.schema).parquet(f"{self.folder}/in")

    def run(self, result: DataFrame, name: str = "out") -> dict:
        """Takes what is new through `result` into a table; returns the figures of the last micro-batch."""
        writer = result.writeStream.format("parquet").option("path", f"{self.folder}/{name}")
        return self._ended(writer, name)

    def run_each(self, function: Callable[[DataFrame, int], None], name: str) -> dict:
        """Hands each micro-batch of what is new to `function` with its number."""
        return self._ended(self.stream().writeStream.foreachBatch(function), name)

    def _ended(self, writer, name: str) -> dict:
        query = writer.option("checkpointLocation", f"{self.folder}/state-{name}").trigger(availableNow=True).start()
        query.awaitTermination()
        return query.lastProgress or {}

    def output(self, result: DataFrame, name: str = "out") -> DataFrame:
        return self.spark.read.schema(result.schema).parquet(f"{self.folder}/{name}")
