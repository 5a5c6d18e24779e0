"""From documents to packed training sequences: each stage is one operator of the llm subpackage.

A stage takes all rows that the one before it kept, and all but the last return the columns of documents:
rejected documents go, repeated lines go (n_chars follows), one document of each near-duplicate group stays,
documents are taken as often as their source's target wants, and what is left is packed. Each result is
written to the shared folder and read again, so that a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm import lines, mixing, packing, quality, sketching
from docweave.llm.queries import vocabulary
from docweave.llm.shared import Store
from docweave.session import ship


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = quality.classify(docs, labels, name="_log_ratio", verdict="_kept")
    return judged.where("_kept").select(*docs.columns)


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    rest = lines.near_lines(docs, name="_removed")
    size = F.when(F.col("_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return rest.select(*[size.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return sketching.without_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return mixing.mixture(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pieces(docs, vocabulary())


STAGES = [("quality", good), ("lines", fresh_lines), ("near_duplicates", unique), ("mixing", mixed), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store.put(stage(spark, docs, sf_dir), name)
    return docs
