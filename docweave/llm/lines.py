"""Near-duplicate lines by a segment-partition edit join (operator 6).

Two lines within k edits share one of k + 1 segments of the shorter one, near the same place; k is the share of
its length that may differ, at most `distance`. Every line files its segments under their length and number and
probes the substrings that can match the segments of lines up to k shorter. Lines that meet are compared in
blocks: letter counts rule out most pairs, a banded bit-parallel edit distance decides. A line whose group, equal
or near-equal lines linked in any number of steps, has occurred before (in order of document and line) is removed.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.graph import components
from docweave.llm.shared import Store, likely, marked
from docweave.llm.sketching import groups, in_blocks, runs
from docweave.llm.spans import Powers, mix

DISTANCE = 2
SIMILARITY = 0.9
LETTERS = 32
CELLS = 1 << 21  # letters, padding included, that are compared at a time
HEAVY = 2000  # places of a group from which on it is spread over several tasks
PARTS = 32


def edits(length: np.ndarray, distance: int, similarity: float) -> np.ndarray:
    """How many edits the shorter of two lines allows: its share 1 - similarity, rounded down, at most `distance`."""
    return np.minimum(distance, (length * (1 - similarity) + 1e-9).astype(np.int64))


def segments(length: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the `parts` nearly even segments of lines of the given lengths, one row per line."""
    base, longer = length // parts, length % parts
    nth = np.arange(parts)
    size = base[:, None] + (nth >= parts - longer[:, None])
    return np.cumsum(size, axis=1) - size, size


def keys_of(lines: list[str], distance: int, similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """Line numbers and hashes of all segments and probes of `lines`."""
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    up, down = Powers.get(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(mix(codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], out=sums[1:])
    length = np.fromiter(map(len, lines), np.int64, len(lines))
    first = np.cumsum(length) - length
    found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    for most in range(1, distance + 1):
        parts = most + 1
        for shorter in range(parts):
            fit = np.flatnonzero((length > shorter) & (edits(length - shorter, distance, similarity) == most))
            other = length[fit] - shorter
            start, size = segments(other, parts)
            for i in range(parts):
                low = max(-i, shorter - (most - i))
                high = min(i, shorter + most - i)
                for shift in range(low, high + 1):
                    at = start[:, i] + shift
                    inside = (at >= 0) & (at + size[:, i] <= length[fit])
                    begin = first[fit][inside] + at[inside]
                    code = (sums[begin + size[:, i][inside]] - sums[begin]) * down[begin]
                    found.append((fit[inside], mix(code + mix(other[inside].astype(np.uint64) * np.uint64(64) + np.uint64(i)))))
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def inner(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both without their common beginning and end, which no edit distance counts; the longer one first."""
    if len(a) < len(b):
        a, b = b, a
    other = np.flatnonzero(a[: len(b)] != b)
    start = int(other[0]) if len(other) else len(b)
    a, b = a[start:], b[start:]
    other = np.flatnonzero(a[len(a) - len(b) :] != b)
    end = len(b) - 1 - int(other[-1]) if len(other) else len(b)
    return a[: len(a) - end], b[: len(b) - end]


def within(left: list[str], right: list[str], distance: int) -> np.ndarray:
    """Whether the edit distance of each pair is at most `distance`. Pairs are taken by length, CELLS letters at a time."""
    codes = [[np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) for x in side] for side in (left, right)]
    pairs = [inner(a, b) for a, b in zip(*codes)]
    size = np.array([len(a) for a, _ in pairs], np.int64)
    order, out, start = np.argsort(size, kind="stable"), np.zeros(len(pairs), bool), 0
    while start < len(order):
        padded = size[order[start:]] + 2 * distance + 1
        stop = start + max(1, int(np.searchsorted(padded * np.arange(1, len(padded) + 1), CELLS, side="right")))
        some = order[start:stop]
        out[some] = banded([pairs[k] for k in some], distance)
        start = stop
    return out


def banded(pairs: list[tuple[np.ndarray, np.ndarray]], distance: int) -> np.ndarray:
    """Whether the pairs, longer ones first, are within `distance` edits, all advancing one letter at a time.

    A word holds the differences along the column of the matrix, of which only the 2 * distance + 1 cells
    around the diagonal matter; the band moves down by one cell per letter.
    """
    n = len(pairs)
    rows = np.array([len(a) for a, _ in pairs], np.int64)
    columns = np.array([len(b) for _, b in pairs], np.int64)
    wide = int(rows.max(initial=0))
    down, along = np.zeros((n, wide + 2 * distance + 1), np.uint32), np.zeros((n, wide + 1), np.uint32)
    for k, (a, b) in enumerate(pairs):
        down[k, distance : distance + len(a)] = a + np.uint32(1)
        along[k, : len(b)] = b + np.uint32(1)
    one, top = np.uint64(1), 2 * distance
    mask = np.uint64((1 << (top + 1)) - 1)
    rise = np.full(n, ((1 << (distance + 1)) - 1) << distance, np.uint64)  # cells that grow by one down the column
    fall = np.zeros(n, np.uint64)
    cost = np.full(n, distance, np.int64)
    ok = rows - columns <= distance
    for j in range(int(columns.max(initial=0))):
        match = np.zeros(n, np.uint64)
        for b in range(top + 1):
            match |= (down[:, j + b] == along[:, j]).astype(np.uint64) << np.uint64(b)
        match[along[:, j] == 0] = 0
        same = ((((match & rise) + rise) ^ rise) | match | fall) & mask
        grow = fall | (~(same | rise) & mask)
        sink = same & rise
        live = j < columns
        corner = j < rows - distance  # the lowest cell of the band still lies inside the matrix
        cost += np.where(live & corner, ((same >> np.uint64(top)) & one) == 0, 0)
        place = np.clip(top - 1 - (j - (rows - distance)), 0, top).astype(np.uint64)
        edge = live & ~corner
        cost += np.where(edge, (grow >> place) & one, 0).astype(np.int64) - np.where(edge, (sink >> place) & one, 0).astype(np.int64)
        shifted = same >> one
        rise, fall = sink | (~(shifted | grow) & mask), shifted & grow
    return ok & (cost <= distance)


def letter_counts(lines: list[str]) -> np.ndarray:
    """How often each of LETTERS groups of letters occurs in a line."""
    out = np.zeros((len(lines), LETTERS), np.int32)
    for k, line in enumerate(lines):
        codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32) % LETTERS
        out[k] = np.bincount(codes, minlength=LETTERS)
    return out


def cut(rows: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """`rows` in runs of at most `size`."""
    return (rows[at : at + size] for at in range(0, len(rows), size))


def near_lines(docs: DataFrame, distance: int = DISTANCE, similarity: float = SIMILARITY, name: str = "removed_lines") -> DataFrame:
    """The columns of `docs`, text without repeated lines, and in `name` how many lines each row lost.

    Reads doc_id and text; a column of `docs` called `name` is replaced. Lines end at a line feed. Blank lines stay.
    Other lines are near when the edits between them are at most `distance` and at most the share 1 - `similarity` of
    the shorter one, whatever their length. Of a group the first line in order of doc_id (null first) and place stays. Rows equal in id and text lose the same lines. A null text
    stays null, a text may become empty. Lines count as equal by a 64-bit hash and their length. An empty table
    gives no rows.
    """
    spark = docs.sparkSession
    store = Store(spark, "lines")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), "text").where("text IS NOT NULL")
    split = rows.select("doc_id", "row_key", F.posexplode(F.split("text", "\n", -1)).alias("place", "line"))
    split = split.where(F.col("line").rlike(r"[^\x20\x09-\x0D]")).withColumn("line_key", F.xxhash64("line", F.length("line")))
    places = store.put(split.select("doc_id", "row_key", "place", "line_key"), "places")

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, first = np.unique(batch.column("line_key").to_numpy(), return_index=True)
            for at in range(0, len(ids), 4000):
                part = first[at : at + 4000]
                line, key = keys_of(batch.column("line").take(pa.array(part)).to_pylist(), distance, similarity)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[at : at + 4000][line])], names=["segment", "line_key"])

    filed = split.select("line_key", "line").mapInArrow(file, "segment long, line_key long")
    filed = store.put(filed, "filed")
    shared = filed.groupBy("segment").agg(F.min("line_key").alias("low"), F.max("line_key").alias("high")).where("low < high")
    shared = store.put(shared.select("segment"), "shared")
    met = store.put(likely(filed, "segment", shared).distinct().join(shared, "segment", "left_semi"), "met")
    store.drop("filed")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "group"):
            ids = table.column("line_key").to_numpy()
            text = table.column("line").to_pylist()
            size, counts = np.array([len(x) for x in text], np.int64), letter_counts(text)
            most = edits(size, distance, similarity)
            left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for start, stop in runs(table, "group"):
                for x in range(start, stop - 1):
                    near = np.flatnonzero(np.abs(size[x + 1 : stop] - size[x]) <= np.minimum(most[x + 1 : stop], most[x])) + x + 1
                    near = near[np.abs(counts[near] - counts[x]).sum(1) <= 2 * np.minimum(most[near], most[x])]
                    left.append(np.full(len(near), x))
                    right.append(near)
            left, right = np.concatenate(left), np.concatenate(right)
            least = np.minimum(most[left], most[right])
            for part in (p for k in range(1, distance + 1) for p in cut(np.flatnonzero(least == k), 2000)):
                a, b = left[part], right[part]
                close = within([text[x] for x in a], [text[x] for x in b], int(least[part[0]]))
                yield pa.RecordBatch.from_arrays([pa.array(ids[a[close]]), pa.array(ids[b[close]])], names=["a", "b"])

    texts = likely(split.select("line_key", "line"), "line_key", met).dropDuplicates(["line_key"])
    pairs = in_blocks(met, "segment", "line_key").select("line_key", "group").join(texts, "line_key")
    pairs = pairs.repartition(partitions, "group").sortWithinPartitions("group")
    links = store.put(pairs.select("group", "line_key", "line").mapInArrow(verify, "a long, b long").distinct(), "links")
    linked = components(links, store, "link").withColumnRenamed("vertex", "line_key")
    known = places.join(linked, "line_key", "left").withColumn("component", F.coalesce("component", "line_key"))
    firsts = known.groupBy("component").agg(F.min(F.struct("doc_id", "place")).alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = store.put(firsts, "firsts")
    heavy = firsts.where(F.col("n") >= HEAVY).select("component")
    spread = marked(known, "component", heavy, "_heavy").withColumn("part", F.when(F.col("_heavy"), F.pmod("row_key", F.lit(PARTS).cast("long"))).otherwise(F.lit(0).cast("long")))
    each = F.when(F.col("_heavy"), F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    firsts = marked(firsts, "component", heavy, "_heavy").select("component", "first", F.explode(each).alias("part"))
    again = spread.join(firsts, ["component", "part"]).where(~F.struct("doc_id", "place").eqNullSafe(F.col("first")))
    lost = again.groupBy("row_key").agg(F.collect_set("place").alias("lost"))  # at most the lines of one text
    lost = store.put(lost, "lost")

    key, gone, touched = (f"_{uuid.uuid4().hex}" for _ in range(3))
    whole = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    parted = marked(whole, key, lost.select(F.col("row_key").alias(key)), touched)
    rest = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(gone, i)), "\n")
    found = parted.where(F.col(touched)).join(lost.toDF(key, gone), key, "left")
    removed = F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long")

    def columns(text, n):
        return [text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns if c != name] + [n.alias(name)]

    changed = found.select(*columns(F.when(F.col(gone).isNull(), F.col("text")).otherwise(rest), removed))
    return parted.where(~F.col(touched)).select(*columns(F.col("text"), F.lit(0).cast("long"))).union(changed)
