"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm import bpe, exact, forest, lines, mixing, packing, quality, rtree, scoring, sharding, sketching, suffixes, variants

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def vocabulary() -> str:
    """Where the public byte-level vocabulary lies; the same place on every machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op3_mixing", mixing.ORACLE_SQL)
def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, folder))
    return mixed.select("doc_id", "size", "source_size", F.col("target"), "taken")


@query(
    "op5_exact",
    """SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
              doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
       FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
)
def op5_exact(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_groups(documents(spark, folder)).drop("bucket", "depth")


@query("op7_packing")
def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pieces(documents(spark, folder), vocabulary())


@query("op8_sharding")
def op8_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shards(documents(spark, folder))


@query("op9_near_duplicates")
def op9_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return sketching.near_groups(documents(spark, folder), threshold=0.85, words=3)


@query("op10_forest")
def op10_forest(spark: SparkSession, folder: str) -> DataFrame:
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    return forest.nearest(vectors, vectors.where("vec_id % 20 = 0"))


@query("op4_quality")
def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.classify(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))
    return judged.select("doc_id", "log_ratio", "kept")


@query("op6_lines")
def op6_lines(spark: SparkSession, folder: str) -> DataFrame:
    rest = lines.near_lines(documents(spark, folder))
    return rest.select("doc_id", "removed_lines", F.sha2(F.coalesce("text", F.lit("")), 256).alias("rest_sha256"))


@query("op2_suffixes")
def op2_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    rest = suffixes.without_repeats(documents(spark, folder))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return rest.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op1_attention")
def op1_attention(spark: SparkSession, folder: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    return scoring.scores(documents(spark, folder), held_out, vocabulary())


@query("op11_variants", variants.ORACLE_SQL)
def op11_variants(spark: SparkSession, folder: str) -> DataFrame:
    return variants.variants(documents(spark, folder))


@query("op12_bpe")
def op12_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = bpe.decode(bpe.encode(documents(spark, folder), ranks, public_tokenizers.PATTERN), ranks)
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op13_negatives", rtree.ORACLE_SQL)
def op13_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Whole numbers of 1/256; every seventh label is one off, so that some nearest rows carry another label."""
    value = F.col("embedding").cast("array<double>")
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").where(finite).select(
        "vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"),
        F.transform(value, lambda x: F.floor(x * 256.0)).alias("vector"),
    )
    return rtree.hard_negatives(rows, F.col("vec_id") % 50 == 0)
