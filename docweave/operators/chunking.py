"""Chunk strategies, their validation and cascade, and page attribution."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Sequence
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.config import effective_overlap
from docweave.functions import text as tx
from docweave.functions.binding import let
from docweave.operators.cleaning import JOINER
from docweave.operators.skew import running_before
from docweave.operators.unfold import unfold

# Separators of the recursive strategy, widest first.
SEPARATORS = ["\n\n\n", "\n\n", "\n", ". ", "? ", "! ", "; ", ", ", " ", ""]
PROBE_CHARS = 60
Splitter = Callable[[str, int, int], list[str]]
STRATEGIES = ["recursive", "paragraph", "window"]


def _pieces(text: str, separator: str) -> list[str]:
    """Cut before every separator, so that it heads the piece it opens."""
    if not separator:
        return list(text)
    cuts, at = [0], text.find(separator)
    while at >= 0:
        cuts.append(at)
        at = text.find(separator, at + len(separator))
    return [text[a:b] for a, b in pairwise([*cuts, len(text)]) if b > a]


def _pack(pieces: list[str], size: int, overlap: int) -> list[str]:
    """Greedy packing up to `size`; the next pack starts with a tail of at most `overlap`."""
    packed, held, used = [], deque(), 0
    for piece in pieces:
        if held and used + len(piece) > size:
            packed.append("".join(held).strip())
            while held and (used > overlap or used + len(piece) > size):
                used -= len(held.popleft())
        held.append(piece)
        used += len(piece)
    packed.append("".join(held).strip())
    return [p for p in packed if p]


def split_recursive(text: str, size: int, overlap: int, level: int = 0) -> list[str]:
    """Split at the widest separator present, going narrower only for oversized pieces."""
    while level < len(SEPARATORS) - 1 and SEPARATORS[level] not in text:
        level += 1
    chunks, small = [], []
    for piece in _pieces(text, SEPARATORS[level]):
        if len(piece) < size:
            small.append(piece)
            continue
        if small:
            chunks += _pack(small, size, overlap)
            small = []
        if level + 1 < len(SEPARATORS):
            chunks += split_recursive(piece, size, overlap, level + 1)
        else:
            chunks.append(piece)
    return chunks + (_pack(small, size, overlap) if small else [])


def recursive_chunks(text: Column, size: int, overlap: int) -> Column:
    @F.arrow_udf(T.ArrayType(T.StringType()))
    def split(texts: pa.Array) -> pa.Array:
        rows = (None if t is None else split_recursive(t, size, overlap) for t in (v.as_py() for v in texts))
        return pa.array(rows, pa.list_(pa.string()))

    return split(text)


def window_starts(length: Column, size: int, overlap: int) -> Column:
    """0-based starts of the windows over a text of this length."""
    step = max(1, size - overlap)
    extra = F.greatest(F.lit(0), F.ceil((length - size) / step).cast("int"))
    return F.transform(F.sequence(F.lit(0), extra), lambda k: k * step)


def window_chunks(text: Column, size: int, overlap: int) -> Column:
    pieces = F.transform(
        window_starts(F.length(text), size, overlap),
        lambda start: tx.strip(text.substr(start + 1, F.lit(size))),
    )
    return F.filter(pieces, lambda p: p != "")


def paragraph_chunks(text: Column, size: int, overlap: int) -> Column:
    """Greedy paragraph packing; an oversized paragraph is windowed on its own."""
    paragraphs = F.filter(F.transform(F.split(text, r"(?U)\n\s*\n"), tx.strip), lambda p: p != "")
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def flushed(state: Column) -> Column:
        rest = tx.strip(state["open"])
        return F.when(rest == "", state["done"]).otherwise(F.concat(state["done"], F.array(rest)))

    def tail(state: Column) -> Column:
        return F.right(state["open"], F.lit(overlap)) if overlap else F.lit("")

    def step(state: Column, para: Column) -> Column:
        oversized = F.struct(
            F.concat(flushed(state), window_chunks(para, size, overlap)).alias("done"), F.lit("").alias("open")
        )
        fitting = F.struct(state["done"].alias("done"), F.concat(state["open"], para, F.lit(JOINER)).alias("open"))
        opened = F.struct(flushed(state).alias("done"), F.concat(tail(state), para, F.lit(JOINER)).alias("open"))
        # An oversized paragraph leaves the buffer as it is when the buffer is blank.
        blank_kept = F.struct(oversized["done"].alias("done"), state["open"].alias("open"))
        return (
            F.when(
                F.length(para) > size, F.when(tx.strip(state["open"]) == "", blank_kept).otherwise(oversized)
            )
            .when(F.length(state["open"]) + F.length(para) + 2 <= size, fitting)
            .otherwise(opened)
        )

    return F.aggregate(paragraphs, empty, step, flushed)


def rejection(chunks: Column, source_length: Column, size: int) -> Column:
    """Why a set of chunks is unusable; null when it is fine."""
    return let(F.transform(chunks, lambda c: F.length(c)), lambda lengths: _rejection(chunks, lengths, source_length, size))


def _rejection(chunks: Column, lengths: Column, source_length: Column, size: int) -> Column:
    longest = F.array_max(lengths)
    total = F.aggregate(lengths, F.lit(0), lambda a, n: a + n)
    share = F.bround(total * 100.0 / source_length).cast("int").cast("string")
    return (
        F.when(chunks.isNull(), F.lit("strategy unavailable"))
        .when(F.size(chunks) == 0, F.lit("produced zero chunks"))
        .when(F.forall(chunks, tx.is_blank), F.lit("all chunks are blank"))
        .when(longest > 2 * size, F.format_string(f"longest chunk is %d chars (limit {2 * size})", longest))
        .when(
            (source_length > 0) & (total < source_length * 0.5),
            F.format_string("retained only %d/%d chars (%s)", total, source_length, F.concat(share, F.lit("%"))),
        )
    )


def page_starts(pages: Column) -> Column:
    """Where each page begins in the joined text: array<struct<start, number>>."""
    return F.aggregate(
        pages,
        F.struct(
            F.lit(0).alias("at"), F.array().cast("array<struct<start:int,number:int>>").alias("starts")
        ),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["text"]) + len(JOINER)).alias("at"),
            F.concat(
                acc["starts"], F.array(F.struct(acc["at"].alias("start"), p["number"].cast("int").alias("number")))
            ).alias("starts"),
        ),
        lambda acc: acc["starts"],
    )


def page_at(starts: Column, offset: Column) -> Column:
    at_or_before = F.filter(starts, lambda s: s["start"] <= F.greatest(offset, F.lit(0)))
    return F.try_element_at(at_or_before, F.lit(-1))["number"]


def page_label(start: Column, end: Column) -> Column:
    single = end.isNull() | (end == start)
    return (
        F.when(start.isNull(), F.lit("n/a"))
        .when(single, start.cast("string"))
        .otherwise(F.concat_ws("-", start.cast("string"), end.cast("string")))
    )


def locate(text: str, parts: Sequence[str], overlap: int) -> list[int]:
    """The places of `positions` for one text."""
    found, cursor = [], 0
    for part in parts:
        tries = ((part, cursor), (part, 0), (part[:PROBE_CHARS], cursor))
        at = next((p for p in (text.find(*t) for t in tries) if p >= 0), -1)
        found.append(at)
        if at >= 0:
            cursor = at + max(1, len(part) - overlap)
    return found


def positions(full: Column, chunks: Column, overlap: int) -> Column:
    """Where each chunk lies in the text, -1 if nowhere.

    A chunk is searched from a cursor that follows the chunk before, then from the beginning, then
    by its first characters from the cursor.
    """

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def find(texts: pa.Array, lists: pa.Array) -> pa.Array:
        rows = (locate(text.as_py(), parts.as_py() or (), overlap) for text, parts in zip(texts, lists))
        return pa.array(rows, pa.list_(pa.int32()))

    return find(full, chunks)


def _with_recursive(docs: DataFrame, size: int, overlap: int, splitter: Splitter | None) -> DataFrame:
    """Adds the joined text and what the splitter makes of it; null where the splitter fails.

    As a partition-wise pass this also ends the projections before it, which the optimizer would
    otherwise copy into every use of the text below.
    """
    joined = docs.withColumn("_full", F.array_join(F.transform("pages", lambda p: p["text"]), JOINER))
    schema = T.StructType(joined.schema.fields + [T.StructField("_recursive", T.ArrayType(T.StringType()))])

    def attempt(text: str | None) -> list[str] | None:
        if splitter is None or not (text or "").strip():
            return None
        try:
            return splitter(text, size, overlap)
        except Exception:  # a failing strategy gives way to the next one
            return None

    def split(batches):
        for batch in batches:
            rows = (attempt(text.as_py()) for text in batch.column("_full"))
            yield batch.append_column("_recursive", pa.array(rows, pa.list_(pa.string())))

    return joined.mapInArrow(split, schema)


def chunk_documents(
    docs: DataFrame,
    size: int = 1400,
    overlap: int = 200,
    min_chars: int = 120,
    splitter: Splitter | None = split_recursive,
) -> DataFrame:
    """Adds `strategy` and `chunks ARRAY<STRUCT<index, text, page_start, page_end, char_count>>`.

    The first strategy whose output validates is taken; `splitter` may be replaced or missing. The
    narrower strategies are built only where needed.
    """
    overlap = effective_overlap(size, overlap)
    tried = _with_recursive(docs, size, overlap, splitter)
    full, length = F.col("_full"), F.length("_full")
    text = F.when(~tx.is_blank(full), full)

    def accepted(name: str):
        return lambda chunks: F.when(
            rejection(chunks, length, size).isNull(),
            F.struct(F.lit(name).alias("strategy"), chunks.alias("chunks")),
        )

    nothing = F.struct(F.lit("none").alias("strategy"), F.array().cast("array<string>").alias("chunks"))
    choice = F.coalesce(
        let(F.col("_recursive"), accepted("recursive")),
        let(paragraph_chunks(text, size, overlap), accepted("paragraph")),
        let(window_chunks(text, size, overlap), accepted("window")),
        nothing,
    )
    trimmed = let(
        choice,
        lambda c: F.struct(
            c["strategy"].alias("strategy"),
            F.filter(F.transform(c["chunks"], tx.strip), lambda t: F.length(t) >= min_chars).alias("kept"),
        ),
    )
    kept = tried.withColumn("_choice", trimmed).withColumns(
        {"strategy": F.col("_choice.strategy"), "_kept": F.col("_choice.kept")}
    )
    placed = kept.withColumn("_at", positions(full, F.col("_kept"), overlap)).withColumn(
        "_starts", page_starts(F.col("pages"))
    )

    def page(offset: Column, at: Column) -> Column:
        return F.when(at >= 0, page_at(F.col("_starts"), offset))

    def chunk(text: Column, at: Column, index: Column) -> Column:
        return F.struct(
            index.alias("index"),
            text.alias("text"),
            page(at, at).alias("page_start"),
            page(at + F.length(text) - 1, at).alias("page_end"),
            F.length(text).alias("char_count"),
        )

    # Results of Python functions are handed to lambdas as arguments: inside one they cannot run.
    paired = F.zip_with("_kept", "_at", lambda text, at: F.struct(text.alias("text"), at.alias("at")))
    attributed = F.transform(paired, lambda c, i: chunk(c["text"], c["at"], i))
    helpers = [c for c in placed.columns if c.startswith("_")]
    return placed.withColumn("chunks", attributed).drop(*helpers)


def explode_chunks(docs: DataFrame, *keep: str) -> DataFrame:
    """One row per chunk with its page label."""
    rows = unfold(docs, "chunks", "c", *keep, "strategy")
    return rows.select(
        *keep,
        "strategy",
        F.col("c.index").alias("chunk_index"),
        F.col("c.text").alias("text"),
        F.col("c.page_start").alias("page_start"),
        F.col("c.page_end").alias("page_end"),
        F.col("c.char_count").alias("char_count"),
        page_label(F.col("c.page_start"), F.col("c.page_end")).alias("page_label"),
    )


def page_index(pages: DataFrame, doc: str = "doc", number: str = "number", width: int = 4096) -> DataFrame:
    """Adds the start offset of every page (doc, number, n_chars) in its joined document."""
    return running_before(pages, [doc], number, F.col("n_chars") + len(JOINER), "start_offset", width)


def page_lookup(index: DataFrame, offsets: DataFrame, doc: str = "doc", width: int = 8192) -> DataFrame:
    """The page each offset falls on (as-of): an equi-join on (document, offset range).

    A page is listed under every range it touches, so a document of any length spreads over its
    ranges. `offsets` has (doc, offset, ...); offsets lie within the document.
    """
    spans = index.select(
        doc, "number", "start_offset", (F.col("start_offset") + F.col("n_chars") + len(JOINER)).alias("_end")
    ).withColumn(
        "_range",
        F.explode(F.sequence(F.floor(F.col("start_offset") / width), F.floor((F.col("_end") - 1) / width))),
    )
    wanted = offsets.withColumn("_range", F.floor(F.col("offset") / width))
    inside = (F.col("offset") >= F.col("start_offset")) & (F.col("offset") < F.col("_end"))
    return wanted.join(spans, [doc, "_range"]).where(inside).drop("_range", "_end", "start_offset")
