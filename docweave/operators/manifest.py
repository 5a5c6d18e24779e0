"""The ingestion state table: skip decision, upsert, summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("filename", T.StringType()),
        T.StructField("file_hash", T.StringType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("duplicate_of", T.StringType()),
        T.StructField("chunks", T.IntegerType()),
        T.StructField("points", T.IntegerType()),
        T.StructField("pages", T.IntegerType()),
        T.StructField("loader", T.StringType()),
        T.StructField("strategy", T.StringType()),
        T.StructField("embedding_provider", T.StringType()),
        T.StructField("embedding_model", T.StringType()),
        T.StructField("embedding_dim", T.IntegerType()),
        T.StructField("ingested_at", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("warnings", T.ArrayType(T.StringType())),
    ]
)
# Defaults of fields missing from a stored record.
DEFAULTS = {"content_hash": "", "status": "pending", "chunks": 0, "points": 0, "pages": 0, "embedding_dim": 0}


def parse_records(raw: Column) -> Column:
    """Tolerant read of one stored record: unknown keys dropped, missing keys defaulted."""
    record = F.from_json(raw, SCHEMA, {"mode": "PERMISSIVE"})
    fields = [
        F.coalesce(record[f.name], F.lit(DEFAULTS[f.name]).cast(f.dataType)).alias(f.name)
        if f.name in DEFAULTS
        else record[f.name].alias(f.name)
        for f in SCHEMA.fields
    ]
    return F.when(record["filename"].isNotNull(), F.struct(*fields))


def skip_decision(files: DataFrame, manifest: DataFrame, dim: int) -> DataFrame:
    """Adds `skip` and `reason` to (filename, file_hash, ...); names are unique on both sides."""
    known = manifest.select(
        "filename",
        F.col("file_hash").alias("_hash"),
        F.col("status").alias("_status"),
        F.col("duplicate_of").alias("_twin"),
        F.col("points").alias("_points"),
        F.col("embedding_dim").alias("_dim"),
        F.lit(True).alias("_known"),
    )
    joined = files.join(known, "filename", "left")
    same = F.coalesce(F.col("_hash"), F.lit("")) == F.col("file_hash")
    points, recorded_dim = F.coalesce("_points", F.lit(0)), F.coalesce("_dim", F.lit(0))
    rules = [
        (F.col("_known").isNull(), False, F.lit("not ingested before")),
        ((F.col("_status") == "duplicate") & same, True, F.concat(F.lit("duplicate of "), F.col("_twin"))),
        (F.col("_status") != "ok", False, F.concat(F.lit("previous status was '"), F.col("_status"), F.lit("'"))),
        (points <= 0, False, F.lit("recorded as ok but has no indexed points")),
        (~same, False, F.lit("file changed on disk")),
        (
            (recorded_dim != 0) & (recorded_dim != dim),
            False,
            F.concat(F.lit("embedding dim changed "), recorded_dim.cast("string"), F.lit(f" -> {dim}")),
        ),
        (F.lit(True), True, F.lit("unchanged since last successful ingest")),
    ]
    skip = F.coalesce(*[F.when(test, F.lit(answer)) for test, answer, _ in rules])
    reason = F.coalesce(*[F.when(test, text) for test, _, text in rules])
    return joined.withColumns({"skip": skip, "reason": reason}).drop(
        "_hash", "_status", "_twin", "_points", "_dim", "_known"
    )


def latest_records(log: DataFrame, key: str = "filename", at: str = "ingested_at") -> DataFrame:
    """The newest record of each key; a key written many times is reduced before the shuffle."""
    newest = F.max_by(F.struct(*log.columns), F.struct(*[F.col(c) for c in (at, *_orderable(log, at))]))
    return log.groupBy(key).agg(newest.alias("_r")).select("_r.*")


def _orderable(log: DataFrame, at: str) -> list[str]:
    return [f.name for f in log.schema.fields if f.name != at and isinstance(f.dataType, T.AtomicType)]


def merged(manifest: DataFrame, new_records: DataFrame) -> DataFrame:
    """New records replace those of the same file name."""
    untouched = manifest.join(new_records.select("filename"), "filename", "left_anti")
    return untouched.unionByName(new_records)


def summary(manifest: DataFrame) -> DataFrame:
    """Files, chunks and points per status, with the totals in the row of status 'all'."""
    counted = manifest.rollup("status").agg(
        F.grouping("status").alias("_all"),
        F.count("*").alias("files"),
        F.sum("chunks").cast("bigint").alias("chunks"),
        F.sum("points").cast("bigint").alias("points"),
    )
    return counted.withColumn("status", F.when(F.col("_all") == 1, "all").otherwise(F.col("status"))).drop("_all")


def summary_sets(manifest: DataFrame, by: list[str]) -> DataFrame:
    """Files, chunks and points for every combination of the columns `by`, and for all without some or any of them.

    One pass: a row is expanded into its sets and reduced per task before the shuffle. `level` tells which columns a row
    leaves out, bit by bit from the last one, so that a null of the data is not taken for one of them.
    """
    return manifest.cube(*by).agg(
        F.grouping_id().cast("int").alias("level"),
        F.count("*").alias("files"),
        F.sum("chunks").cast("bigint").alias("chunks"),
        F.sum("points").cast("bigint").alias("points"),
    )


def indexed_sources(manifest: DataFrame) -> DataFrame:
    return manifest.where(F.col("status") == "ok").select("filename")
