"""Near-duplicate documents by SetSketch registers (operator 9).

A register is the truncated logarithm of the smallest of a set's exponential random numbers; a base just
above 1 keeps it sensitive to locality, and the registers of a union are the maxima of the parts'.
Documents with the same shingle set form a class, represented by its smallest id. Classes that agree in a
band of registers meet; the joint likelihood of two sketches estimates their similarity, and estimates
within reach of the threshold join classes to neighbourhoods. In a neighbourhood every pair is compared on
the full sets, in blocks of bounded size, and each block reports a spanning forest of its links: all
components survive, and no list of pairs is ever written.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.graph import components
from docweave.llm.shared import Store, chunks, likely, marked, text_bytes
from docweave.llm.spans import mix, shingles

BANDS, PER_BAND = 24, 4
REGISTERS = BANDS * PER_BAND
BASE, RATE, LIMIT = 1.001, 20.0, (1 << 16) - 2
BLOCK = 512


def registers(rows: np.ndarray, values: np.ndarray) -> np.ndarray:
    """REGISTERS numbers per run of equal `rows`: floor(1 - log_base(smallest exponential)), truncated."""
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    found = np.empty((len(first), REGISTERS), np.uint16)
    odd = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64), 9) | np.uint64(1)
    for k in range(REGISTERS):
        scattered = (values ^ (odd[k] >> np.uint64(7))) * odd[k]
        scattered ^= scattered >> np.uint64(31)
        scattered *= odd[k]
        most = np.maximum.reduceat(scattered, first)
        smallest = -np.log1p(-((~most).astype(np.float64) + 1) / 2.0**64) / RATE
        found[:, k] = np.clip(np.floor(1 - np.log(smallest) / math.log(BASE)), 0, LIMIT + 1)
    return found


def similarity(more: np.ndarray, less: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Likeliest Jaccard similarity, from how many registers are larger and smaller and the set sizes."""
    u, v = left / (left + right), right / (left + right)
    chance = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / math.log(BASE)
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)

    def likelihood(j: np.ndarray) -> np.ndarray:
        up, down = chance(u - v * j), chance(v - u * j)
        return more * np.log(up) + less * np.log(down) + (REGISTERS - more - less) * np.log(np.maximum(1 - up - down, 1e-12))

    for _ in range(30):  # the likelihood has one peak
        third = (high - low) / 3
        better = likelihood(low + third) < likelihood(high - third)
        low, high = np.where(better, low + third, low), np.where(better, high, high - third)
    return (low + high) / 2


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest member reachable for each of n members over the links (left, right)."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, left, before[right])
        np.minimum.at(label, right, before[left])
        label = label[label]
        if (label == before).all():
            return label


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups from rows sorted by the binary column `key`; a group may span batches."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key)
        last, start = keys[-1], batch.num_rows - 1
        low, high = 0, batch.num_rows - 1
        while low < high:  # where the last group begins
            middle = (low + high) // 2
            low, high = (low, middle) if keys[middle] == last else (middle + 1, high)
        start = low
        if held and (start > 0 or held[0].column(key)[-1] != last):
            yield pa.Table.from_batches([*held, batch.slice(0, start)])
            held = []
        elif start > 0:
            yield pa.Table.from_batches([batch.slice(0, start)])
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def runs(table: pa.Table, key: str) -> Iterator[tuple[int, int]]:
    keys = table.column(key).combine_chunks()
    codes = keys.dictionary_encode().indices.to_numpy()
    cuts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1], True])
    return zip(cuts[:-1].tolist(), cuts[1:].tolist())


def in_blocks(rows: DataFrame, key: str, member: str) -> DataFrame:
    """Adds `group`: every two rows of a key meet in one group of at most 2 * BLOCK rows or so.

    A key with few rows is one group. A larger one is dealt into blocks by a hash of the member, and a row
    goes to the group of each two blocks that has its own.
    """
    sizes = rows.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1")
    sizes = sizes.select(F.col(key).alias("_key"), F.ceil(F.col("_n") / BLOCK).cast("int").alias("_blocks"))
    placed = rows.join(sizes, F.col(key) == F.col("_key"))
    own = F.pmod(F.xxhash64(F.lit(5), member), F.col("_blocks")).cast("int")
    every = F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda o: F.struct(F.least(own, o).alias("x"), F.greatest(own, o).alias("y")))
    group = F.encode(F.concat_ws(".", F.col(key).cast("string"), F.col("_pair.x").cast("string"), F.col("_pair.y").cast("string")), "UTF-8")
    return placed.withColumn("_pair", F.explode(every)).select(*rows.columns, group.alias("group"))


def near_groups(docs: DataFrame, threshold: float = 0.8, words: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each of `docs`.

    Reads doc_id and text, other columns are ignored. Documents are linked when the Jaccard similarity of
    their sets of `words`-word shingles is at least `threshold`; A-Z count as a-z; with fewer words the
    sequence is one shingle. A null or empty text, or one without words, has an empty set and no links. The
    smallest id of a component stays. Ids may be whole numbers or strings. Rows with the same id are one document to
    the graph: each of its texts links it, and they link to each other. A null id is not linked: its component is
    null and it is kept. An empty table gives no rows.
    """
    store = Store(docs.sparkSession, "near")
    wanted = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    margin = threshold - 4.5 * math.sqrt(threshold * (1 - threshold) / REGISTERS)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                row, value = shingles(*text_bytes(part.column("text")), words)
                n = np.bincount(row, minlength=part.num_rows)
                some = np.flatnonzero(n)
                first = np.cumsum(n[some]) - n[some]
                marks = np.zeros((2, part.num_rows), np.uint64)
                held = np.empty((0, REGISTERS), np.uint16)
                if len(some):
                    marks[:, some] = [np.add.reduceat(mix(value, seed), first) for seed in (1, 2)]
                    held = registers(row, value)
                sketches = np.full(part.num_rows, None, object)
                sketches[some] = [x.tobytes() for x in held]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), part.column("text_key"), pa.array(n.astype(np.int64)),
                        *[pa.array(m.view(np.int64)) for m in marks], pa.array(sketches.tolist(), pa.binary()),
                    ],
                    names=["doc_id", "text_key", "n_shingles", "mark1", "mark2", "sketch"],
                )

    rows = store.put(
        wanted.mapInArrow(sketch, f"doc_id {kind}, text_key long, n_shingles long, mark1 long, mark2 long, sketch binary"), "sketches"
    )
    marks = ["n_shingles", "mark1", "mark2"]
    # A class is a set of shingles. One row shows it: that of the smallest id, and of its texts that of the smallest hash.
    shown = F.min(F.struct("doc_id", "text_key")).alias("shown")
    classes = rows.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*marks).agg(shown)
    classes = store.put(classes.select(*marks, "shown.*", F.monotonically_increasing_id().alias("vertex")), "classes")
    own = rows.select(*marks, "doc_id", "text_key", "sketch").join(classes, [*marks, "doc_id", "text_key"])
    own = store.put(own.select("vertex", "n_shingles", "sketch").dropDuplicates(["vertex"]), "vertices")

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                held = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint16).reshape(-1, BANDS, PER_BAND)
                code = np.zeros(held.shape[:2], np.uint64)
                for k in range(PER_BAND):
                    code = mix(code * np.uint64(65_599) + held[:, :, k].astype(np.uint64), k + 1)
                code = mix(code, 11) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(batch.column("vertex").to_numpy(), BANDS)), pa.array(code.ravel().view(np.int64))],
                    names=["vertex", "band"],
                )

    bands = own.select("vertex", "sketch").mapInArrow(band, "vertex long, band long")
    meetings = store.put(in_blocks(bands, "band", "vertex").select("vertex", "group"), "meetings")

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "group"):
            ids = table.column("vertex").to_numpy()
            sizes = table.column("n_shingles").to_numpy().astype(np.float64)
            held = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint16).reshape(-1, REGISTERS)
            starts, stops = map(np.array, zip(*runs(table, "group")))
            pairs = [few_pairs(starts, stops)]
            for start, stop in zip(starts, stops):
                if stop - start > SMALL:
                    pairs += many_pairs(held, start, stop)
            left, right = map(np.concatenate, zip(*pairs))
            close = np.zeros(len(left), bool)
            for at in range(0, len(left), 50_000):
                a, b = left[at : at + 50_000], right[at : at + 50_000]
                x, y = held[a], held[b]
                found = similarity((x > y).sum(1), (x < y).sum(1), sizes[a], sizes[b])
                close[at : at + 50_000] = found >= margin
            label = forest(len(ids), left[close], right[close])
            member = np.flatnonzero(label != np.arange(len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[label[member]]), pa.array(ids[member])], names=["a", "b"])

    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    met = meetings.join(own, "vertex").repartition(partitions, "group").sortWithinPartitions("group")
    hints = store.put(met.select("group", "vertex", "n_shingles", "sketch").mapInArrow(estimate, "a long, b long").distinct(), "hints")
    near = store.put(components(hints, store, "hint"), "neighbourhoods")
    store.drop("meetings")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "group"):
            ids = table.column("vertex").to_numpy()
            roots, members = [], []
            for start, stop in runs(table, "group"):
                row, value = shingles(*text_bytes(table.column("text").slice(start, stop - start)), words)
                label = linked(row, value, stop - start, threshold)
                member = np.flatnonzero(label != np.arange(stop - start))
                roots.append(ids[start + label[member]])
                members.append(ids[start + member])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(roots)), pa.array(np.concatenate(members))], names=["a", "b"])

    key = ["doc_id", "text_key"]
    asked = near.join(classes.select("vertex", *key), "vertex")
    found = likely(wanted.where("doc_id IS NOT NULL"), "text_key", asked.select("text_key")).join(asked.select(*key, "vertex"), key)
    texts = in_blocks(near, "component", "vertex").select("vertex", "group").join(found.select("vertex", "text"), "vertex")
    texts = texts.select("group", "vertex", "text").repartition(partitions, "group").sortWithinPartitions("group")
    members = store.put(rows.select("doc_id", *marks).join(classes.select(*marks, "vertex"), marks, "left").select("doc_id", "n_shingles", "vertex"), "members")
    several = members.where("doc_id IS NOT NULL AND vertex IS NOT NULL").groupBy("doc_id").agg(F.min("vertex").alias("a"), F.max("vertex").alias("z"))
    same = members.join(several.where("a < z").select("doc_id", "a"), "doc_id").select("a", F.col("vertex").alias("b")).where("a <> b")
    links = store.put(texts.mapInArrow(confirm, "a long, b long").union(same).distinct(), "links")
    found = components(links, store, "link")
    named = found.join(classes.select("vertex", "doc_id"), "vertex").groupBy("component").agg(F.min("doc_id").alias("smallest"))
    labels = store.put(found.join(named, "component").select("vertex", "smallest"), "labels")
    held = members.join(labels, "vertex", "left").join(classes.select("vertex", F.col("doc_id").alias("first")), "vertex", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("smallest", "first", "doc_id"))
    return held.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"),
    )


def spare(docs: DataFrame, *names: str) -> list[str]:
    """The names, made longer where `docs` has them already."""
    return [next(x for k in range(len(docs.columns) + 1) if (x := name + "_" * k) not in docs.columns) for name in names]


def without_near_copies(docs: DataFrame, threshold: float = 0.8, words: int = 5) -> DataFrame:
    """The rows of `docs` but those of near_groups that do not stay; of rows equal in id and text one stays.

    Other texts stay where they are, and so do all rows without id.
    """
    store = Store(docs.sparkSession, "unique")
    gone, row, maybe = spare(docs, "_gone", "_row", "_maybe")
    lost = near_groups(docs, threshold, words).where("NOT kept").select("doc_id").distinct()
    lost = store.put(lost.withColumn(gone, F.xxhash64("doc_id")), "gone")
    keyed = docs.withColumns({gone: F.xxhash64("doc_id"), row: F.xxhash64("doc_id", "text")})
    again = store.put(keyed.where("doc_id IS NOT NULL").groupBy(row).count().where("count > 1").select(row), "again")
    rows = marked(keyed, gone, lost, maybe)
    rest = rows.where(maybe).join(lost.select("doc_id"), "doc_id", "left_anti")
    kept = rows.where(f"NOT {maybe}").select(*keyed.columns).union(rest.select(*keyed.columns))
    if again.isEmpty():
        return kept.select(*docs.columns)
    rows = marked(kept, row, again, maybe)
    some = F.col(maybe) & F.col("doc_id").isNotNull()
    return rows.where(~some).select(*docs.columns).union(rows.where(some).dropDuplicates(["doc_id", "text"]).select(*docs.columns))


SMALL = 24


def few_pairs(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs inside the runs of at most SMALL rows."""
    sizes = stops - starts
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for size in range(2, SMALL + 1):
        first = starts[sizes == size]
        if len(first):
            x, y = np.triu_indices(size, 1)
            left.append((first[:, None] + x).ravel())
            right.append((first[:, None] + y).ravel())
    return np.concatenate(left), np.concatenate(right)


def many_pairs(held: np.ndarray, start: int, stop: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of one larger run that agree in at least half of their registers."""
    mine = held[start:stop]
    for row in range(0, stop - start, 64):
        same = np.zeros((len(mine[row : row + 64]), stop - start), np.uint8)
        for k in range(REGISTERS):
            same += mine[row : row + 64, k, None] == mine[None, :, k]
        x, y = np.nonzero(same >= REGISTERS // 2)
        x = x + row
        yield start + x[x < y], start + y[x < y]


def linked(row: np.ndarray, value: np.ndarray, n: int, threshold: float) -> np.ndarray:
    """Smallest member of each member's group, by comparing all pairs of n full sets.

    Only shingles in two sets or more can meet; they are counted as products of 0/1 slabs of bounded width.
    """
    size = np.bincount(row, minlength=n).astype(np.float64)
    _, code, times = np.unique(value, return_inverse=True, return_counts=True)
    shared = times[code] > 1
    row, code = row[shared], code[shared]
    _, code = np.unique(code, return_inverse=True)
    both = np.zeros((n, n), np.float32)
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    width = 2048
    for first in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        low, high = np.searchsorted(code, [first, first + width])
        slab = np.zeros((n, width), np.float32)
        slab[row[low:high], code[low:high] - first] = 1
        both += slab @ slab.T
    whole = size[:, None] + size[None, :] - both
    left, right = np.nonzero((100 * both.astype(np.float64) >= round(100 * threshold, 6) * whole) & (both > 0))
    return forest(n, left[left < right], right[left < right])
