"""Removal of long byte strings that occur more than once, by a hash-compared suffix sort (operator 2).

Sorting the suffixes of all text is not needed to find strings of LENGTH bytes: each such string is filed under
one of its own halves, the one with the smallest hash, so that equal strings meet under equal halves and
every hundredth place or so stands for all strings around it. Places whose whole surroundings are equal
are counted without moving text. For the others, each group of places is sorted twice, by what follows and by
what precedes the half. Prefix polynomial hashes and binary search give the common extension of two
places in logarithmic time, a merge sort orders them with it, and neighbours are verified byte by byte. The
extensions of neighbours then tell which strings around the place occur again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.shared import Store, chunks, likely, marked, text_bytes
from docweave.llm.sketching import groups
from docweave.llm.spans import Prefix, mix

LENGTH = 400
PIECE = 1_000_000  # bytes hashed at a time of a single long text
BATCH_BYTES = 256_000  # of texts hashed, or of surroundings sorted, at a time; numbers take about 100 times as much
GROUP_ROWS = 8_000  # sorted in one task: about 4 MB of surroundings
COMPARED = 500  # neighbours whose bytes are compared at a time


def smallest_ahead(value: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` neighbours, from running minima of blocks in both directions."""
    n = len(value)
    padded = np.r_[value, np.full(-n % width, np.iinfo(np.uint64).max, np.uint64)].reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def places(data: np.ndarray, ends: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """Where halves are filed: row, place, first and last string start it stands for, hashes of half and surroundings."""
    gram = length // 2
    width = length - gram + 1
    none = {k: np.zeros(0, np.int64) for k in ("row", "place", "first", "last", "gram", "around")}
    if len(data) < length:
        return none
    one, two = Prefix(data), Prefix(data, 1)
    n = len(data) - gram + 1
    code = mix(one.spans(slice(0, n), slice(gram, gram + n)))
    low = np.uint64((1 << 24) - 1)
    ahead = smallest_ahead((code & ~low) | np.arange(n, dtype=np.uint64), width)
    row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))[: len(ahead)]
    inside = np.flatnonzero(np.arange(len(ahead)) + length <= ends[row + 1])
    if not len(inside):
        return none
    at = (ahead[inside] & low).astype(np.int64)
    new = np.r_[True, (at[1:] != at[:-1]) | (row[inside][1:] != row[inside][:-1]) | (inside[1:] != inside[:-1] + 1)]
    begin = np.flatnonzero(new)
    stop = np.r_[begin[1:], len(inside)] - 1
    first, last, at, row = inside[begin], inside[stop], at[begin], row[inside[begin]]
    base = ends[row]
    return {
        "row": row, "place": at - base, "first": first - base, "last": last - base,
        "gram": code[at].view(np.int64), "around": mix(two.spans(first, last + length), 7).view(np.int64),
    }


def common(one: Prefix, other: np.ndarray, mine: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How far the bytes from places `mine` and `other` agree, up to `most`, by binary search on hashes."""
    low, high = np.zeros(len(mine), np.int64), most.copy()
    while (low < high).any():
        middle = (low + high + 1) // 2
        same = one.spans(mine, mine + middle) == one.spans(other, other + middle)
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    return low


def ordered(data: np.ndarray, at: np.ndarray, size: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes (`at`, `size` bytes each) inside their groups, and common bytes with the one before.

    A merge sort from the bottom up; in each round every member finds its rank in the neighbouring run of its
    group by binary search, all members at once. Groups are runs of equal numbers. Should the hashes have
    misled, which the bytes of neighbours show, the suffixes are sorted as bytes.
    """
    one = Prefix(data)
    n = len(at)

    def before(x: np.ndarray, y: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether suffix y stands before suffix x; on equality, `ties`."""
        most = np.minimum(size[x], size[y])
        shared = common(one, at[y], at[x], most)
        ended = shared == most
        edge = np.minimum(shared, np.maximum(most - 1, 0))
        top = len(data) - 1
        less = data[np.minimum(at[y] + edge, top)] < data[np.minimum(at[x] + edge, top)]
        return np.where(ended, (size[y] < size[x]) | ((size[y] == size[x]) & ties), less)

    order = np.arange(n)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.zeros(0, np.int64)
    lengths = np.diff(np.r_[starts, n])
    base, whole = np.repeat(starts, lengths), np.repeat(lengths, lengths)
    inner = np.arange(n) - base
    width = 1
    while n and width < lengths.max():
        active = np.flatnonzero(whole > width)
        run = inner[active] // width
        other = run ^ 1
        low = np.minimum(other * width, whole[active])
        high = np.minimum((other + 1) * width, whole[active])
        own, edge = order[active], low.copy()
        later = run & 1  # a member of the later run goes behind its equals
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            middle = (low[open_] + high[open_]) // 2
            rival = order[base[active[open_]] + middle]
            behind = before(own[open_], rival, later[open_] == 1)
            low[open_] = np.where(behind, middle + 1, low[open_])
            high[open_] = np.where(behind, high[open_], middle)
        target = base[active] + (run // 2) * 2 * width + inner[active] % width + (low - edge)
        merged = order.copy()
        merged[target] = own
        order, width = merged, 2 * width
    previous, here = order[:-1], order[1:]
    shared = np.where(
        group[previous] == group[here], common(one, at[previous], at[here], np.minimum(size[previous], size[here])), -1
    )
    if not agrees(data, at[previous], at[here], np.minimum(size[previous], size[here]), shared):
        texts = [data[a : a + s].tobytes() for a, s in zip(at, size)]
        order = np.array(sorted(range(n), key=lambda x: (group[x], texts[x])), np.int64)
        shared = np.array([alike(texts[x], texts[y]) if group[x] == group[y] else -1 for x, y in zip(order[:-1], order[1:])], np.int64)
    return order, np.r_[-1, shared][:n]


def alike(x: bytes, y: bytes) -> int:
    n = min(len(x), len(y))
    other = np.flatnonzero(np.frombuffer(x, np.uint8, n) != np.frombuffer(y, np.uint8, n))
    return int(other[0]) if len(other) else n


def agrees(data: np.ndarray, left: np.ndarray, right: np.ndarray, most: np.ndarray, shared: np.ndarray) -> bool:
    """Whether neighbours really have `shared` equal bytes, then differ, and stand in order."""
    for at in range(0, len(left), COMPARED):
        some = slice(at, at + COMPARED)
        a, b, n = left[some], right[some], np.maximum(shared[some], 0)
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        if (data[np.repeat(a, n) + nth] != data[np.repeat(b, n) + nth]).any():
            return False
        differ = np.flatnonzero((shared[some] >= 0) & (n < most[some]))
        if (data[(a + n)[differ]] >= data[(b + n)[differ]]).any():
            return False
    return True


def again(around: list[bytes], place: np.ndarray, last: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Members and string starts (from the first one a member stands for) whose string another member has too.

    `place` is where the half begins in a member's bytes, `last` the last start it stands for.
    """
    n = len(around)
    sizes = np.fromiter(map(len, around), np.int64, n)
    data = np.frombuffer(b"".join(around), np.uint8)
    offset = np.cumsum(sizes) - sizes
    right, right_shared = ordered(data, offset + place, sizes - place, group)
    back = np.ascontiguousarray(data[::-1])
    left, left_shared = ordered(back, len(data) - (offset + place), place, group)
    members, starts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    by_right, by_left = np.empty(n, np.int64), np.empty(n, np.int64)
    for lead in range(int(place.max(initial=0)) + 1):
        start = place - lead
        valid = np.flatnonzero((start >= 0) & (start <= last))
        if len(valid):
            by_right[right] = np.cumsum(right_shared < length - lead)
            by_left[left] = np.cumsum(left_shared < lead)
            both = by_right[valid] * (n + 1) + by_left[valid]
            order = np.argsort(both, kind="stable")
            same = both[order][1:] == both[order][:-1]
            found = valid[order[np.r_[False, same] | np.r_[same, False]]]
            members.append(found)
            starts.append(start[found])
    return np.concatenate(members), np.concatenate(starts)


def portions(table: pa.Table, key: str, name: str, size: int) -> Iterator[pa.Table]:
    """Row ranges of a table sorted by `key`, of whole groups and about `size` bytes in column `name`; a larger group stands alone."""
    keys = table.column(key).to_numpy()
    cuts = np.r_[np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]), len(keys)]
    held = np.r_[0, np.cumsum(pc.binary_length(table.column(name)).to_numpy())][cuts]
    at = 0
    while at < len(cuts) - 1:
        stop = max(at + 1, int(np.searchsorted(held, held[at] + size, side="right")) - 1)
        yield table.slice(cuts[at], cuts[stop] - cuts[at])
        at = stop


def intervals(key: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, first and end bytes of the runs that the strings at `start` cover."""
    order = np.lexsort((start, key))
    key, start = key[order], start[order]
    new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (start[1:] > start[:-1] + length)][: len(key)])
    stop = np.r_[new[1:], len(key)] - 1
    return (key[new], start[new], start[stop] + length) if len(new) else (key, start, start)


def repeats(docs: DataFrame, length: int = LENGTH, group_rows: int = GROUP_ROWS) -> DataFrame:
    """text_key, spans: for each text of `docs` with repeated strings, the byte ranges that they cover.

    `text_key` is the hash of (doc_id, text) that finds the row; spans are [start, end) pairs, sorted, apart.
    """
    spark = docs.sparkSession
    store = Store(spark, "repeats")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    rows = docs.where("text IS NOT NULL").select(F.xxhash64("doc_id", "text").alias("text_key"), "text")

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", BATCH_BYTES):
                data, ends = text_bytes(part.column("text"))
                keys = part.column("text_key").to_numpy()
                for at in range(0, max(1, len(data)), PIECE):  # more than one only for a single long text
                    edges = np.clip(ends - at, 0, PIECE + length - 1)
                    found = places(data[at : at + PIECE + length - 1], edges, length)
                    moved = at - ends[found["row"]].clip(max=at)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[found["row"]]), *[pa.array(found[c] + moved) for c in ("place", "first", "last")],
                         pa.array(found["gram"]), pa.array(found["around"])],
                        names=["text_key", "place", "first", "last", "gram", "around"],
                    )

    kinds = "text_key long, place long, first long, last long, gram long, around long"
    filed = store.put(rows.mapInArrow(file, kinds), "places")
    classes = filed.groupBy("gram", "around").agg(
        F.count("*").alias("n"), F.min(F.struct("text_key", "place", "first", "last")).alias("one")
    )
    classes = store.put(classes, "classes")
    equal = classes.where("n > 1").select("gram", "around")
    whole = filed.join(equal, ["gram", "around"], "left_semi")
    covered = whole.select("text_key", F.col("first").alias("start"), (F.col("last") + length).alias("end"))

    several = classes.groupBy("gram").agg(F.count("*").alias("variants")).where("variants > 1")
    asked = classes.join(several, "gram").select(
        "gram", "variants", (F.col("n") > 1).alias("known"), "one.text_key", "one.place", "one.first", "one.last"
    )
    asked = store.put(asked, "asked")
    wanted = asked.groupBy("text_key").agg(F.collect_list(F.struct("gram", "variants", "known", "place", "first", "last")).alias("at"))
    texts = likely(rows, "text_key", asked).dropDuplicates(["text_key"]).join(wanted, "text_key")
    cut = texts.select("text_key", F.encode("text", "UTF-8").alias("bytes"), F.explode("at").alias("at")).select(
        "at.gram", "at.variants", "at.known", "text_key", "at.first",
        (F.col("at.place") - F.col("at.first")).alias("lead"), (F.col("at.last") - F.col("at.first")).alias("tail"),
        F.substring("bytes", (F.col("at.first") + 1).cast("int"), (F.col("at.last") - F.col("at.first") + length).cast("int")).alias("around"),
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in (part for whole in groups(batches, "gram") for part in portions(whole, "gram", "around", 2 * BATCH_BYTES)):
            column = lambda c: table.column(c).to_numpy()
            gram = column("gram")
            group = np.cumsum(np.r_[False, gram[1:] != gram[:-1]])
            member, start = again(table.column("around").to_pylist(), column("lead"), column("tail"), group, length)
            new = ~column("known")[member]
            member, start = member[new], start[new]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in intervals(column("text_key")[member], column("first")[member] + start, length)],
                names=["text_key", "start", "end"],
            )

    small = cut.where(F.col("variants") <= group_rows).drop("variants").repartition(partitions, "gram")
    covered = covered.union(small.sortWithinPartitions("gram").mapInArrow(compare, "text_key long, start long, end long"))

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "around", 20_000):
                around = part.column("around").to_pylist()
                data = np.frombuffer(b"".join(around), np.uint8)
                n = part.column("tail").to_numpy() + 1
                offset = np.cumsum(n + length - 1) - (n + length - 1)
                row = np.repeat(np.arange(len(n)), n)
                nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                begin = offset[row] + nth
                codes = [mix(Prefix(data, s).spans(begin, begin + length), s).view(np.int64) for s in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("text_key").take(pa.array(row)), pa.array(part.column("first").to_numpy()[row] + nth),
                     part.column("known").take(pa.array(row)), *map(pa.array, codes)],
                    names=["text_key", "start", "known", "code1", "code2"],
                )

    if not asked.where(F.col("variants") > group_rows).isEmpty():  # too many for a task: count string by string
        large = cut.where(F.col("variants") > group_rows).select("text_key", "first", "known", "tail", "around")
        each = store.put(large.mapInArrow(strings, "text_key long, start long, known boolean, code1 long, code2 long"), "strings")
        twice = each.groupBy("code1", "code2").agg(F.count("*").alias("n")).where("n > 1")
        found = each.where("NOT known").join(twice, ["code1", "code2"], "left_semi")
        covered = covered.union(found.select("text_key", "start", (F.col("start") + length).alias("end")))
    order = Window.partitionBy("text_key").orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = covered.distinct().withColumn("apart", F.when(F.col("start") <= reached, 0).otherwise(1))
    spans = apart.withColumn("nth", F.sum("apart").over(order)).groupBy("text_key", "nth").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    listed = spans.groupBy("text_key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    return store.put(listed, "spans")


def without_repeats(docs: DataFrame, length: int = LENGTH, group_rows: int = GROUP_ROWS) -> DataFrame:
    """doc_id, n_bytes, spans, kept (the remaining bytes): one row for each of `docs`.

    Reads doc_id and text; other columns are ignored. Removes each byte that lies in a string of `length` bytes
    that also starts anywhere else, in the same text or another one; all strings are judged on the
    input. A null text is empty, and texts shorter than `length` stay whole. Rows equal in id and text are
    copies of each other, and lose all that is long enough. An empty table gives no rows.
    """
    found = repeats(docs, length, group_rows)
    body = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = marked(docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("text_key")), "text_key", found, "touched")
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    rest = rows.where("NOT touched").select("doc_id", F.octet_length(body).cast("long").alias("n_bytes"), none.alias("spans"), body.alias("kept"))
    touched = rows.where("touched").join(found, "text_key", "left").select("doc_id", body.alias("body"), F.coalesce("spans", none).alias("spans"))
    size = F.octet_length("body").cast("long")
    starts = F.concat(F.array(F.lit(0).cast("long")), F.col("spans.end"))
    stops = F.concat(F.col("spans.start"), F.array(size))
    piece = lambda x: F.substring(F.col("body"), (x["0"] + 1).cast("int"), (x["1"] - x["0"]).cast("int"))
    parts = F.transform(F.arrays_zip(starts.alias("0"), stops.alias("1")), lambda x: F.hex(piece(x)))
    return rest.union(touched.select("doc_id", size, "spans", F.unhex(F.array_join(parts, "")).alias("kept")))
