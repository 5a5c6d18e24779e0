"""Table functions for lateral joins, and the functions that `spark.sql` knows after `register`."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from docweave.config import effective_overlap
from docweave.operators import chunking
from docweave.operators.cleaning import JOINER
from docweave.session import ship

CHUNKS = "chunk_index int, text string, char_count int, position int"
PAGE = "number int"


class RecursiveChunks:
    """The chunks of a text by the recursive strategy that have at least `least` characters, and where each lies (-1:
    nowhere); none of a null or blank text."""

    def eval(self, text: str | None, size: int, overlap: int, least: int) -> Iterator[tuple]:
        if text is None or not text.strip():
            return
        overlap = effective_overlap(size, overlap)
        kept = [c for c in (p.strip() for p in chunking.split_recursive(text, size, overlap)) if len(c) >= least]
        for index, (chunk, at) in enumerate(zip(kept, chunking.locate(text, kept, overlap))):
            yield index, chunk, len(chunk), at


class WindowChunks:
    """The windows of a text with at least `least` characters when stripped; `position` is where the window begins."""

    def eval(self, text: str | None, size: int, overlap: int, least: int) -> Iterator[tuple]:
        if text is None:
            return
        step, index = max(1, size - effective_overlap(size, overlap)), 0
        for k in range(max(0, -(-(len(text) - size) // step)) + 1):
            chunk = text[k * step : k * step + size].strip()
            if chunk and len(chunk) >= least:
                yield index, chunk, len(chunk), k * step
                index += 1


class PageAt:
    """The page that an offset of a document's joined pages lies on: the last one that begins at or before it."""

    def eval(self, pages: list | None, offset: int | None) -> Iterator[tuple]:
        found, at = None, 0
        for page in pages or ():
            if offset is not None and at <= max(0, offset):
                found = page["number"]
            at += len(page["text"] or "") + len(JOINER)
        yield (found,)


#: SQL name: class, columns.
TABLE_FUNCTIONS = {"recursive_chunks": (RecursiveChunks, CHUNKS), "window_chunks": (WindowChunks, CHUNKS), "page_at": (PageAt, PAGE)}
#: Plain SQL functions, which the optimizer puts in place of their calls.
SQL_FUNCTIONS = {
    "content_hash(content STRING)": ("STRING", "sha2(content, 256)"),
    "page_label(first INT, last INT)": (
        "STRING", "CASE WHEN first IS NULL THEN 'n/a' WHEN last IS NULL OR last = first THEN string(first) ELSE concat(first, '-', last) END"),
    "citation(source STRING, label STRING)": ("STRING", "CASE WHEN label = 'n/a' THEN source ELSE concat(source, ' (p. ', label, ')') END"),
}


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session's SQL. Table functions get Arrow batches of rows."""
    ship(spark)
    for name, (function, columns) in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, F.udtf(function, returnType=columns, useArrow=True))
    for head, (kind, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
