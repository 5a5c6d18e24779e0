"""Tables in the cluster's shared folder, and chunks of Arrow text for numpy."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.session import shared_folder

CHUNK_BYTES = 1_000_000
FILTER_BITS = 20


class Store:
    """Tables that one run writes to the shared folder; `drop` deletes those that nothing reads any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.schemas = {}

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Writes `df` once; the table that is read back has no lineage and outlives lost executors."""
        df.write.parquet(f"{self.root}/{name}")
        self.schemas[name] = df.schema
        return self.get(name)

    def get(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.schemas[name]).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string array and its n + 1 offsets, from 0; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, places, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    ends = np.frombuffer(places, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def chunks(batch: pa.RecordBatch, name: str, size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch with about `size` bytes in column `name`; a longer row stands alone."""
    _, ends = text_bytes(batch.column(name))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + size, side="right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def marked(rows: DataFrame, key: str, wanted: DataFrame, name: str, bits: int = FILTER_BITS) -> DataFrame:
    """Adds whether the long `key` may be in `wanted` (never false where it is), without moving any row.

    A bitmap of 64 * 2**bits places goes to all tasks: at most 2**bits rows of 16 bytes, whatever the
    input. With very many keys it fills up and lets more rows pass, so a join on the key has to follow.
    """
    mixed = f"xxhash64(20, `{key}`)"
    word = F.expr(f"shiftrightunsigned({mixed}, {64 - bits})")
    at, own, held = (f"_{x}_{uuid.uuid4().hex}" for x in ("at", "word", "bits"))
    bitmap = wanted.groupBy(word.alias(own)).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({mixed} & 63 AS INT))")).alias(held))
    found = rows.withColumn(at, word).join(F.broadcast(bitmap), F.col(at) == F.col(own), "left")
    there = F.expr(f"coalesce((shiftrightunsigned({held}, cast({mixed} & 63 AS INT)) & 1) = 1, false)")
    return found.select(*[F.col(f"`{c}`") for c in rows.columns], there.alias(name))


def likely(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows whose `key` is in `wanted`, and by chance a few others."""
    return marked(rows, key, wanted, "_likely").where("_likely").drop("_likely")
