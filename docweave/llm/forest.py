"""Nearest neighbours by inner product with a hash-prefix forest (operator 10).

Vectors get one more component that makes all of them equally long, so that the largest inner product is
the smallest angle. Each tree is a sorted array of 64-bit hash strings (signs of random projections). A
query descends in every tree to its longest matching prefix by binary search; then all trees ascend
together, one bit at a time, until the entries that share the prefix are enough. Those candidates are
scored exactly on the original vectors.

The index is dealt into shards by a hash, each with a forest of its own that fits a task, and the queries
come in blocks. Copies of a vector are one entry that keeps as many of its smallest ids as can be asked for.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.shared import Store

TREES, BITS = 16, 64
SHARD_ROWS, QUERY_ROWS = 8192, 4096
HITS = 1.5


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (doubles) of the rows that take part: not null, finite, not all zero, of the usual length."""
    value = F.col("embedding").cast("array<double>")
    sound = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(value, lambda x: x != 0)
    rows = vectors.where("vec_id IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), value.alias("embedding")).where(sound)
    usual = rows.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1)
    return rows.join(F.broadcast(usual.select("dim")), F.size("embedding") == F.col("dim")).drop("dim")


def planes(dim: int, trees: int) -> np.ndarray:
    return np.random.default_rng(10).standard_normal((dim, trees * BITS)).astype(np.float32)


def strings(points: np.ndarray, normals: np.ndarray) -> np.ndarray:
    """One 64-bit hash string per point and tree."""
    signs = (points.astype(np.float32) @ normals > 0).reshape(len(points), -1, BITS)
    return np.packbits(signs, axis=2).view(">u8")[:, :, 0].astype(np.uint64)


class Forest:
    def __init__(self, points: np.ndarray, trees: int, longest: float):
        rest = np.sqrt(np.maximum(0, longest**2 - (points**2).sum(1)))
        self.normals = planes(points.shape[1] + 1, trees)
        keys = strings(np.c_[points, rest], self.normals).T
        self.order = np.argsort(keys, axis=1, kind="stable")
        self.keys = np.take_along_axis(keys, self.order, 1)

    def candidates(self, queries: np.ndarray, hits: int):
        """For each query the entries under the longest prefix that all trees can share with `hits` entries."""
        asked = strings(np.c_[queries, np.zeros(len(queries))], self.normals).T
        n = self.keys.shape[1]
        low = np.zeros((len(self.keys), len(queries)), np.int64)
        high, open_ = np.full_like(low, n), np.ones(len(queries), bool)
        for bits in range(1, BITS + 1):  # as long as the next prefix still has enough, it is the better one
            shift = np.uint64(BITS - bits)
            first = (asked[:, open_] >> shift) << shift
            last = first | ((np.uint64(1) << shift) - np.uint64(1))
            a = np.array([np.searchsorted(k, x) for k, x in zip(self.keys, first)])
            b = np.array([np.searchsorted(k, x, side="right") for k, x in zip(self.keys, last)])
            enough = (b - a).sum(0) >= hits
            here = np.flatnonzero(open_)[enough]
            low[:, here], high[:, here] = a[:, enough], b[:, enough]
            open_[np.flatnonzero(open_)[~enough]] = False
            if not open_.any():
                break
        for q in range(len(queries)):
            yield np.unique(np.concatenate([o[x:y] for o, x, y in zip(self.order, low[:, q], high[:, q])]))


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 20, trees: int = TREES, hits: float = HITS, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of all `vectors` for each row of `queries`.

    Both have vec_id and embedding; other columns are ignored. `queries` are rows of `vectors`, and none is
    its own neighbour. Score is the inner product in double precision; equal scores go by the smaller vec_id.
    `hits` is how many entries the trees offer together, as a share of a shard. Rows with a null id, or vectors
    that are null, zero, of unusual length or not finite, take no part. Rows sharing id and vector are one. An
    empty table gives no rows, and fewer candidates than k give all.
    """
    store = Store(vectors.sparkSession, "forest")
    rows = store.put(usable(vectors).distinct(), "rows")
    smallest = Window.partitionBy("embedding").orderBy("vec_id")
    few = rows.withColumn("nth", F.row_number().over(smallest)).where(F.col("nth") <= k + 1)
    entries = few.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    entries = store.put(entries.select(F.col("ids")[0].alias("entry"), "ids", "embedding"), "entries")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    n, longest = entries.agg(F.count("*"), F.coalesce(F.max(norm), F.lit(0.0))).first()

    asked = queries.where("vec_id IS NOT NULL").select(F.col("vec_id").cast("long").alias("query_id")).distinct()
    asked = asked.join(rows.withColumnRenamed("vec_id", "query_id"), "query_id")
    asked = store.put(asked.join(entries.select("embedding", "entry"), "embedding").select("query_id", "entry"), "asked")
    points = store.put(asked.select("entry").distinct().join(entries, "entry").select("entry", "embedding"), "points")
    shards, blocks = max(1, math.ceil(n / shard_rows)), max(1, math.ceil(points.count() / QUERY_ROWS))
    dealt = lambda c, m: F.pmod(F.xxhash64(F.lit(m), c), F.lit(m)).cast("int")
    index = entries.withColumn("shard", dealt("entry", shards)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    block = points.withColumn("block", dealt("entry", blocks)).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"entry": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            dim = len(left.column("embedding")[0])
            held, wanted = (t.column("embedding").combine_chunks().flatten().to_numpy().reshape(-1, dim) for t in (left, right))
            ids = left.column("ids").combine_chunks()
            sizes, flat = np.diff(ids.offsets.to_numpy()), ids.flatten().to_numpy()
            starts = np.cumsum(sizes) - sizes
            found = Forest(held, trees, longest).candidates(wanted, max(k + 1, math.ceil(hits * len(held))))
            for name, query, near in zip(right.column("entry").to_pylist(), wanted, found):
                score = held[near] @ query
                if len(near) > k + 1:
                    best = np.argpartition(-score, k)[: k + 1]
                    best = np.flatnonzero(score >= score[best].min())
                    near, score = near[best], score[best]
                size = sizes[near]
                nth = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                each, score = flat[np.repeat(starts[near], size) + nth], np.repeat(score, size)
                order = np.lexsort((each, -score))[: k + 1]
                out["entry"].append(np.full(len(order), name))
                out["vec_id"].append(each[order])
                out["score"].append(score[order])
        kinds = {"entry": np.int64, "vec_id": np.int64, "score": np.float64}
        return pa.table({c: pa.array(np.concatenate([np.zeros(0, kinds[c]), *v]).astype(kinds[c])) for c, v in out.items()})

    found = index.groupBy("shard", "block").cogroup(block.groupBy("shard", "block"))
    found = found.applyInArrow(search, "entry long, vec_id long, score double")
    order = [F.desc("score"), F.col("vec_id")]
    found = found.withColumn("nth", F.row_number().over(Window.partitionBy("entry").orderBy(*order))).where(F.col("nth") <= k + 1)
    found = store.put(found.drop("nth"), "found")
    pairs = asked.join(found, "entry").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).cast("int")
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
