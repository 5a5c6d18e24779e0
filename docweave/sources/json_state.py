"""JSON inputs and outputs: stored records, evaluation sets, processed snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

SAMPLE = (
    "struct<id:bigint,domain:string,source_doc:string,question:string,reference:string,"
    "relevant_contexts:array<string>,expected_tools:array<string>,actual_response:string,"
    "actual_contexts:array<string>,actual_tools_called:array<string>,actual_citations:array<string>>"
)
CASE = "struct<id:string,category:string,input:string,expected_blocked:boolean>"
DATASET = f"rag_samples array<{SAMPLE}>, guardrails_samples array<{CASE}>"


def read_dataset(spark: SparkSession, path: str, part: str = "rag_samples") -> DataFrame:
    """One row per sample of an evaluation file."""
    whole = spark.read.schema(DATASET).option("multiLine", "true").json(path)
    return whole.select(F.explode(part).alias("s")).select("s.*")


def read_results(spark: SparkSession, path: str, part: str = "rag_samples") -> DataFrame | None:
    """The same for stored results; None if there are none yet."""
    try:
        return read_dataset(spark, path, part)
    except AnalysisException:
        return None


def samples_from_json(raw: DataFrame, column: str = "raw") -> DataFrame:
    parsed = raw.select(F.from_json(column, DATASET).alias("d"))
    return parsed.select(F.explode("d.rag_samples").alias("s")).select("s.*")


def snapshot_rows(docs: DataFrame) -> DataFrame:
    """What was parsed and chunked, one nested row per file, ready for a JSON sink."""
    return docs.select(
        "filename", "loader", "page_count", "char_count", "extractors", "strategy",
        F.size("chunks").alias("chunk_count"), "chunks",
    )


def write_snapshots(docs: DataFrame, path: str) -> None:
    snapshot_rows(docs).write.mode("overwrite").json(path)
