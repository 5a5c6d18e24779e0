"""Where an ingestion run keeps its points and its state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docweave.operators import manifest, sketches, store
from docweave.session import written
from docweave.sources.versions import Tables


class Versioned:
    """Both in one folder of versions: a run writes the buckets of its files, and commits points and state together."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.tables = spark, Tables(spark, root, buckets)
        self.base = 0

    def open(self, dim: int, wipe: bool) -> None:
        """Pins the version that the run builds on."""
        self.base = self.tables.latest()
        found = self.tables.property("dim", self.base)
        if not wipe and found not in (None, dim):
            raise store.DimensionMismatch(f"table has {found} dimensions, the backend {dim}")

    def state(self) -> DataFrame:
        found = self.tables.read("state", self.base)
        return self.spark.createDataFrame([], manifest.SCHEMA) if found is None else found

    def save(self, points: DataFrame, touched: DataFrame, records: DataFrame, dim: int, wipe: bool) -> DataFrame:
        """Commits one version; returns the new state."""
        change = self.tables.change(self.base)
        change.properties["dim"] = dim
        if wipe:
            change.overwrite("points", points, "source")
            change.overwrite("sketches", sketches.of_sources(points), "source")
            change.overwrite("state", records, "filename")
        else:
            change.replace("points", points, touched, "source", ["id"])
            change.replace("sketches", sketches.of_sources(points), touched, "source", ["source"])
            change.replace("state", records, records.select("filename"), "filename", ["filename"])
        return self.tables.read("state", change.commit("wiped" if wipe else "ingested"))

    def points(self, version: int | None = None) -> DataFrame | None:
        return self.tables.read("points", version)

    def overview(self, version: int | None = None) -> DataFrame | None:
        """Chunks, distinct texts and quantiles of chunk lengths of a version, from the sketches of its sources."""
        held = self.tables.read("sketches", version)
        return None if held is None else sketches.overview(sketches.merged(held))


class PlainFiles:
    """Each in a plain parquet folder that every run rewrites as a whole: for small tables that other tools read."""

    def __init__(self, spark: SparkSession, points_path: str, state_path: str):
        self.spark, self.points_path, self.state_path = spark, points_path, state_path
        self.old = spark.createDataFrame([], manifest.SCHEMA)

    def open(self, dim: int, wipe: bool) -> None:
        store.ensure_table(self.spark, self.points_path, dim, wipe)

    def state(self) -> DataFrame:
        if store.table_exists(self.spark, self.state_path):
            return self.spark.read.schema(manifest.SCHEMA).parquet(self.state_path)
        return self.spark.createDataFrame([], manifest.SCHEMA)

    def save(self, points: DataFrame, touched: DataFrame, records: DataFrame, dim: int, wipe: bool) -> DataFrame:
        kept = self.spark.createDataFrame([], manifest.SCHEMA) if wipe else written(self.state(), "state")
        if wipe or not store.table_exists(self.spark, self.points_path):
            store.write_points(points, self.points_path, overwrite=True)
        else:
            old = self.spark.read.schema(points.schema).parquet(self.points_path)
            store.write_points(written(store.replace_sources(old, points, touched), "table"), self.points_path, overwrite=True)
        state = written(manifest.merged(kept, records), "records")
        state.write.mode("overwrite").parquet(self.state_path)
        return state
