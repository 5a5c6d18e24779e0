"""A coarse index of the vector table: cells around centroids, probed until a wanted recall is met.

Centroids come from Lloyd's steps on a sample of bounded size; every row is put into the cell of its nearest centroid, and
the table is written by cell. A question reads the cells whose centroids are nearest to it, as vectors of one length, so
nearness is the cosine. How many cells that takes is measured, not guessed: a part of the questions is also answered
exactly, and the number of probes doubles until the share of exact results that the cells give reaches the target. With
all cells probed the answer is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.operators.search import top_k
from docweave.session import written

SAMPLE_PER_CELL, MOST_SAMPLED = 64, 65_536  # rows that centroids are fitted on
MOST_CELLS = 4096
STEPS = 8
JUDGED = 200  # questions that are also answered exactly, to measure recall
PART_ROWS = 16_384  # rows of a cell that one task takes


def unit(rows: np.ndarray) -> np.ndarray:
    norms = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def matrix(column, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return unit(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim))


def centroids(points: np.ndarray, cells: int, steps: int = STEPS, seed: int = 8) -> np.ndarray:
    """Directions of the cells: Lloyd's steps by cosine from a random start; a cell that loses all points keeps its place."""
    pick = np.random.default_rng(seed)
    centres = points[np.sort(pick.permutation(len(points))[:cells])].copy()
    for _ in range(steps):
        mine = (points @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, mine, points)
        held = np.bincount(mine, minlength=len(centres)) > 0
        centres[held] = unit(sums[held])
    return centres


@dataclass
class CellIndex:
    """The vector table by cell: `table` has id, vector, cell and part; `centres` one direction per cell."""

    table: DataFrame
    centres: np.ndarray
    dim: int

    @classmethod
    def build(cls, corpus: DataFrame, dim: int, cells: int | None = None) -> CellIndex:
        """corpus: (id, vector). Rows whose vector is null or of another length take no part; cells default to the root of the rows."""
        rows = corpus.select("id", "vector").where(F.size("vector") == dim)
        n = rows.count()
        cells = min(MOST_CELLS, max(1, cells or math.isqrt(n)), max(1, n))
        wanted = min(MOST_SAMPLED, max(cells, cells * SAMPLE_PER_CELL))
        # A share of the rows by hash, the same whatever the partitioning; twice the wanted number is never reached.
        share = min(1.0, 1.1 * wanted / max(1, n))
        sample = rows.where(F.pmod(F.xxhash64("id", F.lit(8)), F.lit(1 << 30)) < int(share * (1 << 30))).select("vector").limit(2 * wanted).toArrow()
        points = matrix(sample.column("vector"), dim) if sample.num_rows else np.zeros((1, dim))
        centres = centroids(points, min(cells, len(points)))
        sent = rows.sparkSession.sparkContext.broadcast(centres)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 2048):
                    part = batch.slice(at, 2048)
                    cell = (matrix(part.column("vector"), dim) @ sent.value.T).argmax(axis=1) if part.num_rows else np.zeros(0)
                    yield part.append_column("cell", pa.array(cell.astype(np.int32)))

        kind = rows.schema["id"].dataType.simpleString()
        placed = rows.withColumn("vector", F.col("vector").cast("array<double>")).mapInArrow(place, f"id {kind}, vector array<double>, cell int")
        placed = written(placed, "placed")
        sizes = placed.groupBy("cell").count().select("cell", F.ceil(F.col("count") / PART_ROWS).alias("parts"))
        dealt = placed.join(F.broadcast(sizes), "cell")  # at most MOST_CELLS rows
        dealt = dealt.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
        return cls(written(dealt, "cells", by="cell"), centres, dim)

    def search(self, questions: DataFrame, k: int, probes: int) -> DataFrame:
        """qid, id, score, rank: the k nearest in the `probes` cells nearest to each question; ties by id.

        questions: (qid, vector). A question meets the parts of its cells, and each part gives its k best.
        """
        dim, sent = self.dim, questions.sparkSession.sparkContext.broadcast(self.centres)

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                near = matrix(batch.column("vector"), dim) @ sent.value.T
                cells = np.argsort(-near, axis=1, kind="stable")[:, :probes]
                row = np.repeat(np.arange(len(cells)), cells.shape[1])
                columns = [batch.column(c).take(pa.array(row)) for c in ("qid", "vector")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(cells.ravel().astype(np.int32))], names=["qid", "vector", "cell"])

        qid, id_ = (rows.schema[c].dataType.simpleString() for rows, c in ((questions, "qid"), (self.table, "id")))
        asked = questions.select("qid", F.col("vector").cast("array<double>").alias("vector")).where(F.size("vector") == dim)
        visits = asked.mapInArrow(choose, f"qid {qid}, vector array<double>, cell int")
        parts = self.table.select(F.col("cell").alias("cell"), F.col("part").alias("part")).distinct()
        visits = visits.join(F.broadcast(parts), "cell")

        def score(left: pa.Table, right: pa.Table) -> pa.Table:
            out = {"qid": [], "id": [], "score": []}
            if left.num_rows and right.num_rows:
                held, ids = matrix(right.column("vector"), dim), right.column("id").to_pylist()
                place = np.argsort(np.argsort(np.array(ids, dtype=object if isinstance(ids[0], str) else None), kind="stable"), kind="stable")
                for at in range(0, left.num_rows, 256):
                    part = left.slice(at, 256)
                    scores = np.round(matrix(part.column("vector"), dim) @ held.T, 8)
                    for name, row in zip(part.column("qid").to_pylist(), scores):
                        best = np.lexsort((place, -row))[:k]
                        out["qid"] += [name] * len(best)
                        out["id"] += [ids[i] for i in best]
                        out["score"] += row[best].tolist()
            return pa.table({c: pa.array(v, left.schema.field("qid").type if c == "qid" else right.schema.field("id").type if c == "id" else pa.float64()) for c, v in out.items()})

        met = visits.groupBy("cell", "part").cogroup(self.table.groupBy("cell", "part"))
        found = met.applyInArrow(score, f"qid {qid}, id {id_}, score double")
        order = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def tuned(self, questions: DataFrame, k: int, target: float = 0.9, judged: int = JUDGED) -> tuple[int, float]:
        """The smallest power of two of probes (or all cells) whose recall reaches the target on `judged` questions, and it."""
        some = written(questions.select("qid", "vector").orderBy(F.xxhash64("qid")).limit(judged), "judged")
        exact = written(top_k(some, self.table.select("id", "vector"), self.dim, k).select("qid", "id"), "exact")
        wanted, probes = exact.count(), 1
        while True:
            probes = min(probes, len(self.centres))
            hits = self.search(some, k, probes).select("qid", "id").join(exact, ["qid", "id"], "left_semi").count()
            recall = hits / wanted if wanted else 1.0
            if recall >= target or probes == len(self.centres):
                return probes, recall
            probes *= 2

    def read(self, questions: DataFrame, probes: int) -> float:
        """The share of the table's rows that a question reads on average, by the sizes of the cells nearest to it."""
        sizes = np.zeros(len(self.centres))
        for row in self.table.groupBy("cell").count().collect():  # at most MOST_CELLS rows
            sizes[row["cell"]] = row["count"]
        dim, sent = self.dim, questions.sparkSession.sparkContext.broadcast((self.centres, sizes))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                near = matrix(batch.column("vector"), dim) @ sent.value[0].T
                rows = sent.value[1][np.argsort(-near, axis=1, kind="stable")[:, :probes]].sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(rows)], names=["n"])

        asked = questions.select(F.col("vector").cast("array<double>").alias("vector")).where(F.size("vector") == dim)
        mean = asked.mapInArrow(count, "n double").agg(F.avg("n")).first()[0]
        return (mean or 0.0) / max(1.0, sizes.sum())
