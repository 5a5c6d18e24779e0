"""The coarse cell index: recall measured against exact search, exact with all cells."""

import numpy as np
from pyspark.sql import functions as F

from docweave.operators.cells import CellIndex, centroids, unit
from docweave.operators.search import top_k

FOLDER = "/root/testdata/sf0.1"


def clustered(spark, seed=3, clusters=40, each=60, dim=16):
    pick = np.random.default_rng(seed)
    middle = pick.standard_normal((clusters, dim)) * 4
    points = [(f"p{c}_{i}", (middle[c] + pick.standard_normal(dim) * 0.5).tolist()) for c in range(clusters) for i in range(each)]
    return spark.createDataFrame(points, "id string, vector array<double>")


def recall_of(found, exact):
    a, b = {(r.qid, r.id) for r in found.collect()}, {(r.qid, r.id) for r in exact.collect()}
    return len(a & b) / len(b)


def test_clustered_vectors_need_few_cells(spark):
    corpus = clustered(spark)
    odd = spark.createDataFrame([("n", None), ("short", [1.0]), ("zero", [0.0] * 16)], "id string, vector array<double>")
    index = CellIndex.build(corpus.unionByName(odd), 16, cells=40)
    assert index.table.count() == 2401 and index.table.select("id").distinct().count() == 2401
    asked = corpus.where(F.col("id").endswith("_7")).withColumnRenamed("id", "qid")
    probes, recall = index.tuned(asked, 10)
    assert recall >= 0.9 and index.read(asked, probes) < 0.5
    assert recall_of(index.search(asked, 10, probes), top_k(asked, corpus, 16, 10)) >= 0.9


def test_all_cells_are_exact_and_ties_go_by_id(spark):
    corpus = clustered(spark, clusters=6, each=20).unionByName(spark.createDataFrame([(f"t{i}", [1.0] * 16) for i in range(30)], "id string, vector array<double>"))
    index = CellIndex.build(corpus, 16, cells=7)
    asked = corpus.where("id IN ('t3', 'p1_1', 'p5_0')").withColumnRenamed("id", "qid")
    columns = ["qid", "id", "rank"]
    found, exact = index.search(asked, 12, 7), top_k(asked, corpus, 16, 12)
    assert sorted(map(tuple, found.select(*columns).collect())) == sorted(map(tuple, exact.select(*columns).collect()))


def test_empty_and_tiny_tables(spark):
    corpus = clustered(spark, clusters=1, each=3)
    asked = corpus.withColumnRenamed("id", "qid")
    one = CellIndex.build(corpus, 16)
    assert one.tuned(asked, 5)[1] >= 0.9 and one.search(asked, 5, len(one.centres)).count() == 9
    none = CellIndex.build(corpus.limit(0), 16)
    assert none.search(asked, 5, 1).count() == 0 and none.tuned(asked, 5) == (1, 1.0)
    assert one.search(asked.limit(0), 5, 1).count() == 0


def test_recall_on_the_given_vectors(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    corpus = rows.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    asked = corpus.where("id % 20 = 0").withColumnRenamed("id", "qid")
    index = CellIndex.build(corpus, 64)
    probes, recall = index.tuned(asked, 20)
    assert recall >= 0.9 and probes <= len(index.centres)
    assert recall_of(index.search(asked, 20, probes), top_k(asked, corpus, 64, 20)) >= 0.9


def test_lloyd_steps_find_separate_directions():
    pick = np.random.default_rng(1)
    middle = unit(np.eye(5))
    points = unit(np.repeat(middle, 50, axis=0) + pick.standard_normal((250, 5)) * 0.05)
    found = centroids(points, 25)
    assert np.allclose((points @ found.T).max(axis=1), 1, atol=0.05) and np.allclose((found**2).sum(axis=1), 1)
