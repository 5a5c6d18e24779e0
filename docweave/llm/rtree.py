"""Hard negatives by a sort-tile-recursive R-tree over integer vectors (operator 13).

A minimum bounding box gives each coordinate of an inner product an interval, and their sums bound the score of all
points below it. Search is best first by upper bound: boxes strictly below the k-th score found so far, or wholly
outside the wanted score window, are never opened. All arithmetic is in whole numbers, so ties are exact.

The tree has its top on the cluster: entries are range partitioned by label and first coordinates into shards (slabs),
whose boxes form a directory of bounded size; each shard packs its rows into a tree of its own inside a task.
Anchors visit shards in the order of their bounds, in waves of 1, 2, 4, ... shards; after each wave the k-th scores
found rule out further shards, so candidates grow with the logarithm of the number of shards. A shard's anchors come
in blocks. Equal vectors of one label are one entry with as many of its smallest ids as can be asked for.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.shared import Store
from docweave.operators.ordering import Ordered

LEAF, FANOUT = 128, 16
SHARD_ROWS, MOST_SHARDS = 16_384, 1 << 14  # the directory has a box of two vectors per shard
BLOCK_ANCHORS = 4096
LOWEST, HIGHEST = -(2**62), 2**62


def tiled(points: np.ndarray, rows: np.ndarray, axes: list[int], leaf: int) -> list[np.ndarray]:
    """Sort-tile-recursive packing: leaves of at most `leaf` rows, tiled along one axis after the other."""
    pages = -(-len(rows) // leaf)
    if pages <= 1 or not axes:
        return [rows]
    slabs = math.ceil(pages ** (1 / len(axes)))
    size = -(-pages // slabs) * leaf
    rows = rows[np.argsort(points[rows, axes[0]], kind="stable")]
    return [x for at in range(0, len(rows), size) for x in tiled(points, rows[at : at + size], axes[1:], leaf)]


def bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest inner product of each query with any point of each box."""
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    return up @ low.T + down @ high.T, up @ high.T + down @ low.T


class Tree:
    """A packed R-tree; no leaf holds two labels. `kind` is the label range, `below` the child range of each node."""

    def __init__(self, points: np.ndarray, labels: np.ndarray, leaf: int = LEAF, fanout: int = FANOUT):
        leaves = []
        for label in np.unique(labels):
            rows = np.flatnonzero(labels == label)
            spread = np.ptp(points[rows], axis=0)
            use = max(1, math.ceil(math.log2(max(2, len(rows) / leaf))))
            leaves += tiled(points, rows, np.argsort(-spread, kind="stable")[:use].tolist(), leaf)
        self.order = np.concatenate(leaves)
        self.points, ends = points[self.order], np.cumsum([len(x) for x in leaves])
        starts, kinds = np.r_[0, ends[:-1]], labels[self.order]
        parts = (np.minimum.reduceat(self.points, starts), np.maximum.reduceat(self.points, starts), kinds[starts], kinds[starts])
        levels, below = [parts], [np.c_[starts, ends]]
        while len(levels[-1][0]) > 1:
            n = len(levels[-1][0])
            at = np.arange(0, n, fanout)
            lo, hi, first, last = levels[-1]
            base = sum(len(x[0]) for x in levels[:-1])
            below.append(np.c_[at, np.minimum(at + fanout, n)] + base)
            levels.append((np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.minimum.reduceat(first, at), np.maximum.reduceat(last, at)))
        self.low, self.high, self.first, self.last = (np.concatenate([x[i] for x in levels]) for i in range(4))
        self.below, self.leaves = np.concatenate(below), len(leaves)

    def search(self, query, label, least, low, high, ids, sizes, lows, highs, k: int, same: bool) -> list[list[tuple[int, int]]]:
        """For each score window the k best (score, id) in it, of rows with the label or of all others."""
        best = [[] for _ in lows]
        lows = lows.copy()
        root = len(self.low) - 1
        heap = [(-int(high[root]), root)]
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound < lows.min():
                break
            if not ((high[node] >= lows) & (low[node] <= highs)).any():
                continue
            a, b = self.below[node]
            if node >= self.leaves:
                for child in range(a, b):
                    fits = self.first[child] <= label <= self.last[child] if same else not self.first[child] == label == self.last[child]
                    if fits and high[child] >= least and high[child] >= lows.min():
                        heapq.heappush(heap, (-int(high[child]), child))
                continue
            if (self.first[node] == label) != same:
                continue
            score = self.points[a:b] @ query
            good = (score >= lows[:, None]) & (score <= highs[:, None])
            for slot in np.flatnonzero(good.any(1)):
                here = np.flatnonzero(good[slot])
                if len(here) > k:  # only rows that can be among the k best; ties stay
                    here = here[score[here] >= np.partition(score[here], len(here) - k)[len(here) - k]]
                found = [(-int(score[i]), int(x)) for i in here for x in ids[a + i][: sizes[a + i]]]
                best[slot] = heapq.nsmallest(k, best[slot] + found)
                if len(best[slot]) == k:
                    lows[slot] = max(lows[slot], -best[slot][-1][0])
        return [[(-s, x) for s, x in found] for found in best]


def matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def sound(rows: DataFrame) -> DataFrame:
    """vec_id, label, vector of the rows that take part, each once."""
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("vector").cast("array<long>").alias("vector"))
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL").where(F.forall("vector", lambda x: x.isNotNull()))
    usual = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1)
    return rows.join(F.broadcast(usual.select("dim")), F.size("vector") == F.col("dim")).drop("dim").distinct()


class Index:
    """Entries dealt into shards, and the directory of the shards' boxes."""

    def __init__(self, rows: DataFrame, copies: int, store: Store, shard_rows: int, block: int):
        self.store, self.block = store, block
        smallest = Window.partitionBy("label", "vector").orderBy("vec_id")
        few = rows.withColumn("nth", F.row_number().over(smallest)).where(F.col("nth") <= copies)
        entries = few.groupBy("label", "vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
        entries = store.put(entries.withColumn("entry", F.monotonically_increasing_id()), "entries")
        n = entries.count()
        shards = min(MOST_SHARDS, max(1, -(-n // shard_rows)))
        order = ["label", F.get("vector", F.lit(0)), F.get("vector", F.lit(1)), "entry"]
        placed = Ordered(entries, order, shards).positions("shard")  # shards of equal size, however the rows are dealt
        per = max(1, -(-n // shards))
        self.entries = store.put(placed.withColumn("shard", F.floor((F.col("shard") - 1) / per).cast("int")), "shards")

        def box(rows: pa.Table) -> pa.Table:
            points, labels = matrix(rows.column("vector")), rows.column("label").to_numpy()
            out = {"shard": pa.array([rows.column("shard")[0].as_py()], pa.int32()), "first": [labels.min()], "last": [labels.max()]}
            return pa.table(out | {"low": [points.min(0).tolist()], "high": [points.max(0).tolist()]})

        found = self.entries.groupBy("shard").applyInArrow(box, "shard int, first long, last long, low array<long>, high array<long>")
        held = found.orderBy("shard").toArrow()  # at most MOST_SHARDS boxes
        self.shards = held.column("shard").to_numpy()
        first, last = held.column("first").to_numpy(), held.column("last").to_numpy()
        low, high = (matrix(held.column(c)) if len(self.shards) else np.zeros((0, 0), np.int64) for c in ("low", "high"))
        self.directory = rows.sparkSession.sparkContext.broadcast((self.shards, first, last, low, high))

    def best(self, asked: DataFrame, k: int, same: bool, name: str) -> DataFrame:
        """entry, slot, vec_id, score, nth: the first k of each window of each asked entry.

        asked: (entry, label, vector, lows, highs); window number `slot` holds scores from lows[slot] to highs[slot].
        """
        n, blocks = len(self.shards), max(1, -(-asked.count() // self.block))
        order = Window.partitionBy("entry", "slot").orderBy(F.desc("score"), "vec_id")
        found, wave = None, 0
        while (1 << wave) <= n:
            now = asked
            if found is not None:
                kth = found.where(F.col("nth") == k).groupBy("entry").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("kth"))
                raised = F.transform("lows", lambda x, i: F.greatest(x, F.try_element_at("kth", i)))
                now = asked.join(kth, "entry", "left").withColumn("lows", F.when(F.col("kth").isNull(), F.col("lows")).otherwise(raised)).drop("kth")
            visits = self._visits(now, (1 << wave) - 1, (2 << wave) - 1, same)
            more = self._searched(visits, blocks, k, same)
            every = more if found is None else found.drop("nth").unionByName(more)
            ranked = every.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)
            found, wave = self.store.put(ranked, f"{name}{wave}"), wave + 1
        if found is None:
            found = asked.select("entry", F.lit(0).alias("slot"), F.lit(None).cast("long").alias("vec_id"), F.lit(None).cast("long").alias("score"), F.lit(1).alias("nth")).limit(0)
        return found

    def _visits(self, asked: DataFrame, begin: int, end: int, same: bool) -> DataFrame:
        """Each asked entry with the shards on its places begin..end by bound that can still hold a wanted score."""
        directory = self.directory

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shards, first, last, low, high = directory.value
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    least, most = bounds(matrix(part.column("vector")), low, high)
                    label = part.column("label").to_numpy()[:, None]
                    fits = (first <= label) & (label <= last) if same else ~((first == label) & (last == label))
                    place = np.argsort(np.where(fits, -most, HIGHEST), axis=1, kind="stable")[:, begin:end]
                    row, _ = np.indices(place.shape)
                    row, place = row.ravel(), place.ravel()
                    lows, highs = part.column("lows").to_pylist(), part.column("highs").to_pylist()
                    useful = [
                        fits[r, s] and any(most[r, s] >= x and least[r, s] <= y for x, y in zip(lows[r], highs[r]))
                        for r, s in zip(row.tolist(), place.tolist())
                    ]
                    row, place = row[np.array(useful, bool)], place[np.array(useful, bool)]
                    columns = [part.column(c).take(pa.array(row)) for c in ("entry", "label", "vector", "lows", "highs")]
                    yield pa.RecordBatch.from_arrays([pa.array(shards[place], pa.int32()), *columns], names=["shard", "entry", "label", "vector", "lows", "highs"])

        kinds = "shard int, entry long, label long, vector array<long>, lows array<long>, highs array<long>"
        return asked.select("entry", "label", "vector", "lows", "highs").mapInArrow(choose, kinds)

    def _searched(self, visits: DataFrame, blocks: int, k: int, same: bool) -> DataFrame:
        def search(asked: pa.Table, held: pa.Table) -> pa.Table:
            out = []
            if asked.num_rows and held.num_rows:
                tree = Tree(matrix(held.column("vector")), held.column("label").to_numpy())
                lists = held.column("ids").to_pylist()
                ids = [lists[i] for i in tree.order]
                sizes = [len(x) for x in ids]
                queries, labels = matrix(asked.column("vector")), asked.column("label").to_pylist()
                entries, lows, highs = (asked.column(c).to_pylist() for c in ("entry", "lows", "highs"))
                for at in range(0, len(queries), 256):
                    least, most = bounds(queries[at : at + 256], tree.low, tree.high)
                    for i in range(at, min(at + 256, len(queries))):
                        low, high = np.array(lows[i], np.int64), np.array(highs[i], np.int64)
                        found = tree.search(queries[i], labels[i], low.min(), least[i - at], most[i - at], ids, sizes, low, high, k, same)
                        out += [(entries[i], slot, x, s) for slot, rows in enumerate(found) for s, x in rows]
            columns = [*zip(*out)] if out else [[], [], [], []]
            kinds = [("entry", pa.int64()), ("slot", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())]
            return pa.table({name: pa.array(x, kind) for (name, kind), x in zip(kinds, columns)})

        block = F.pmod(F.xxhash64("entry"), F.lit(blocks)).cast("int")
        left = visits.withColumn("block", block).groupBy("shard", "block")
        every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
        right = self.entries.withColumn("block", every).groupBy("shard", "block")
        return left.cogroup(right).applyInArrow(search, "entry long, slot int, vec_id long, score long")


def hard_negatives(
    rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, window: tuple[int, int] = (50, 95),
    shard_rows: int = SHARD_ROWS, block: int = BLOCK_ANCHORS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Reads vec_id, label, vector (whole numbers); `anchor` tells which rows are anchors; other columns are ignored. For
    each anchor and each of its first `positives` other rows of the same label, the first `negatives` rows of other
    labels whose score is at least window[0] and at most window[1] per cent of the positive's. A score is the inner
    product with the anchor, exact where it and its bounds fit 63 bits; higher first, ties by the smaller vec_id.

    Rows with a null id, label, vector or component, or a vector of unusual length, take no part. Rows equal in id, label
    and vector are one; rows that share only the id are several, and none of them is positive to another. An anchor
    without another row of its label, or without a negative in the window, gives no row, as does an empty table.
    """
    store = Store(rows.sparkSession, "negatives")
    marked = rows.where(anchor).select("vec_id", "label", "vector")
    points = store.put(sound(rows), "rows")
    index = Index(points, max(positives + 1, negatives), store, shard_rows, block)
    anchors = sound_anchors(marked, points).join(index.entries.select("label", "vector", "entry"), ["label", "vector"])
    anchors = store.put(anchors, "anchors")
    distinct = anchors.select("entry", "label", "vector").dropDuplicates(["entry"])
    asked = store.put(distinct.withColumns({"lows": F.array(F.lit(LOWEST)), "highs": F.array(F.lit(HIGHEST))}), "asked")
    near = index.best(asked, positives + 1, True, "positives").select("entry", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    first = Window.partitionBy("label", "vector", "anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    pairs = anchors.withColumnRenamed("vec_id", "anchor_id").join(near, "entry").where("anchor_id <> positive_id")
    pairs = pairs.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= positives)
    pairs = store.put(pairs.select("entry", "anchor_id", "positive_id", "positive_score"), "pairs")

    low, high = (F.col("positive_score") * F.lit(x) for x in window)
    windows = pairs.select("entry", "positive_score").distinct().select(
        "entry", "positive_score",
        (-_hundredth(-low)).alias("low"), _hundredth(high).alias("high"),
    ).where("low <= high")
    listed = windows.groupBy("entry").agg(F.sort_array(F.collect_list(F.struct("positive_score", "low", "high"))).alias("w"))
    listed = store.put(asked.select("entry", "label", "vector").join(listed, "entry"), "windows")
    wanted = listed.select("entry", "label", "vector", F.col("w.low").alias("lows"), F.col("w.high").alias("highs"))
    far = index.best(wanted, negatives, False, "negatives")
    scores = listed.select("entry", F.posexplode("w.positive_score").alias("slot", "positive_score"))
    far = far.join(scores, ["entry", "slot"])
    return pairs.join(far, ["entry", "positive_score"]).select(
        "anchor_id", "positive_id", F.col("nth").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )


def sound_anchors(marked: DataFrame, points: DataFrame) -> DataFrame:
    """The anchors among the rows that take part."""
    cast = marked.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("vector").cast("array<long>").alias("vector"))
    return points.join(cast.distinct(), ["vec_id", "label", "vector"], "left_semi")


def _hundredth(x: Column) -> Column:
    """A whole number over 100, rounded down."""
    return F.call_function("div", x - F.pmod(x, F.lit(100)), F.lit(100))


ORACLE_SQL = """
WITH marked AS (
  SELECT DISTINCT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
    list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(256 * x) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS vec_id,
    CAST(list_inner_product(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) AS BIGINT) AS score
  FROM marked a JOIN marked b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 3
"""
