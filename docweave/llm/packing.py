"""Packing by concatenating and cutting (operator 7).

The first pass turns every text into ids and keeps, per partition, where each document starts. Sums over
the partitions' totals give every partition its place in one endless row of ids. The second pass cuts that
row at every multiple of the sequence length; a document that crosses a cut gives a record on either side.
Ids are written once in between, as 16 bits each, so that no text is split into tokens twice.
"""

from __future__ import annotations

import base64
import functools
import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.shared import Store, chunks

LENGTH = 1024
END = 0
MOST_PARTS = 1 << 20  # partitions whose places are sent to all tasks; beyond, the ids move to them


@functools.lru_cache(maxsize=4)
def tokenizer(path: str) -> Callable[[str], np.ndarray]:
    """Ids of a byte-level BPE file as `tokenizers` gives them, computed by the faster tiktoken."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as file:
        found = json.load(file)
    letters = byte_letters()
    special = {entry["content"]: entry["id"] for entry in found["added_tokens"]}
    ranks = {
        bytes(letters[c] for c in word): place for word, place in found["model"]["vocab"].items() if word not in special
    }
    model = tiktoken.Encoding("ids", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: model.encode_to_numpy(text, allowed_special="all")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}


def pieces(docs: DataFrame, vocabulary: str, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, on request ids: a row per piece.

    Reads doc_id and text, other columns are ignored. A null or empty text is the end id alone; every document
    ends with id 0. All sequences are full but the last. Equal rows are packed one by one. Texts of any length
    are cut into as many pieces as they need. An empty table gives no rows.
    """
    store = Store(docs.sparkSession, "packing")

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, at, part = tokenizer(vocabulary), 0, TaskContext.get().partitionId()
        for batch in batches:
            for rows in chunks(batch, "text"):
                ids = [encode(text or "") for text in rows.column("text").to_pylist()]
                sizes = np.array([len(x) + 1 for x in ids], np.int64)
                starts = at + np.cumsum(sizes) - sizes
                at += int(sizes.sum())
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("doc_id"), pa.array(np.full(len(ids), part, np.int32)), pa.array(starts),
                        pa.array(sizes), pa.array([np.append(x, END).astype("<u2").tobytes() for x in ids], pa.binary()),
                    ],
                    names=["doc_id", "part", "at", "doc_tokens", "ids"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    wanted = docs.select("doc_id", "text")
    rows = wanted.mapInArrow(ids_of, f"doc_id {kind}, part int, at long, doc_tokens long, ids binary")
    rows = store.put(rows, "ids")
    totals = rows.groupBy("part").agg(F.sum("doc_tokens").alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    bases = store.put(bases, "bases")
    if bases.count() <= MOST_PARTS:  # 12 bytes a partition, so that no ids are moved
        bases = F.broadcast(bases)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = batch.column("first").to_numpy()
            sizes = batch.column("doc_tokens").to_numpy()
            counts = (first + sizes - 1) // length - first // length + 1
            row = np.repeat(np.arange(len(first)), counts)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            begin = np.where(nth == 0, first[row], (first[row] // length + nth) * length)
            end = np.minimum((begin // length + 1) * length, first[row] + sizes[row])
            held = batch.column("ids")
            parts = [
                np.frombuffer(held[int(r)].as_buffer(), "<u2")[b - f : e - f].astype("<u4").tobytes()
                for r, f, b, e in zip(row, first[row], begin, end)
            ]
            out = [
                batch.column("doc_id").take(pa.array(row)), pa.array(begin - first[row]), pa.array(end - begin),
                pa.array([zlib.crc32(x) for x in parts], pa.int64()), pa.array(sizes[row]),
                pa.array(begin // length), pa.array(begin % length), *([pa.array(parts, pa.binary())] if with_ids else []),
            ]
            yield pa.RecordBatch.from_arrays(out, names=[name.split()[0] for name in schema.split(", ")])

    schema = (
        f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
        + ", ids binary" * with_ids
    )
    placed = rows.join(bases, "part").select("doc_id", (F.col("base") + F.col("at")).alias("first"), "doc_tokens", "ids")
    return placed.mapInArrow(cut, schema)
