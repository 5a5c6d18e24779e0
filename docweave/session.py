"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def local_session(cores: str = "8", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("docweave")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
MOST_BATCH_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Hands this package to the executors' Python workers, once per application, in batches of bounded size.

    Spark cuts batches by rows alone, so a worker's memory would follow the length of the texts. A given limit stays.
    """
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, str(MOST_BATCH_BYTES))
    application = spark.sparkContext.applicationId
    if application not in _shipped:
        root = Path(__file__).resolve().parent
        archive = shutil.make_archive(f"{tempfile.mkdtemp()}/{root.name}", "zip", root.parent, root.name)
        spark.sparkContext.addPyFile(archive)
        _shipped.add(application)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Only a local session, as in tests, gets one of its own where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = current.get() if current.isDefined() else None
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="docweave-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


@dataclass
class _Run:
    """What a run of `stages` deletes at its end: tables by their folders, and values sent to the tasks."""

    tables: dict[str, str] = field(default_factory=dict)
    values: list[Broadcast] = field(default_factory=list)


_runs: list[_Run] = []


@contextmanager
def stages(spark: SparkSession, *kept: str, gone: tuple[str, ...] | None = None) -> Iterator[None]:
    """Deletes at its end the tables that `written` has made inside, but those of the names in `kept`.

    If `gone` is given, only tables of these names are deleted. Tables left are the business of the run around this one.
    What `sent` has sent inside is taken back.
    """
    _runs.append(_Run())
    try:
        yield
    finally:
        run = _runs.pop()
        for value in run.values:
            value.destroy()
        for path, name in run.tables.items():
            if name not in kept if gone is None else name in gone:
                place = spark._jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
            elif _runs:
                _runs[-1].tables[path] = name


def sent(spark: SparkSession, value) -> Broadcast:
    """The value for all tasks, up to the end of the innermost run of `stages`; what reads it must be written by then."""
    found = spark.sparkContext.broadcast(value)
    if _runs:
        _runs[-1].values.append(found)
    return found


def _place(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if _runs:
        _runs[-1].tables[path] = name
    return path


def _write(df: DataFrame, path: str, by: str | None = None) -> None:
    """Adds the rows of `df` to the table at `path`. Inside `stages`, the shuffle files of this write go with its end."""
    conf, before = df.sparkSession.conf, df.sparkSession.conf.get(SHUFFLE_CLEANUP, None)
    if _runs:
        conf.set(SHUFFLE_CLEANUP, "true")
    try:
        writer = df.write.mode("append").option("compression", "zstd")
        (writer.partitionBy(by) if by else writer).parquet(path)
    finally:
        if _runs and before is not None:
            conf.set(SHUFFLE_CLEANUP, before)
        elif _runs:
            conf.unset(SHUFFLE_CLEANUP)


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write `df` once as parquet in the shared folder and return the table read back.

    Used where several later steps read the same expensive intermediate result. It cuts the
    lineage, survives lost executors and keeps column pruning for every reader. `by` names a column
    whose values are folders of their own, so that readers of some of them skip the others.
    """
    path = _place(df.sparkSession, name)
    _write(df, path, by)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def gathered(spark: SparkSession, parts: Iterable[Callable[[], DataFrame]], name: str) -> DataFrame:
    """One table, as of `written`, of several parts; what was written to build a part is deleted before the next is built."""
    path, schema = _place(spark, name), None
    for build in parts:
        with stages(spark):
            df = build()
            _write(df, path)
            schema = schema or df.schema
    return spark.read.schema(schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores, where an input of few splits feeds work that is heavy per row.

    An input with at least as many splits as cores, as any large table has, stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def fan_out(spark: SparkSession) -> int:
    """Into how many parts a hot key is split: as many as there are shuffle partitions."""
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
