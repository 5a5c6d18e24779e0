"""The per-page cascade over extraction tiers of a paged document (PDF).

No PDF engine is part of the repository. An engine is a function that turns (doc, content) into
rows (doc, page, text); the cascade works on such rows, whatever made them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.functions.text import is_blank
from docweave.operators.skew import first_rows_per_key

# Names of the tiers in the order they are tried; pages named in a warning.
TIERS = ["pypdf", "pdfplumber", "pymupdf"]
SHOWN_PAGES = 12


def cascade(extracted: DataFrame) -> DataFrame:
    """(doc, page, text, extractor): per page the text of the first tier that found any.

    extracted: (doc, page, tier, text), tier from 1. Grouped per page, so a long document spreads.
    """
    usable = extracted.where(~is_blank(F.col("text")))
    best = usable.groupBy("doc", "page").agg(
        F.min_by(F.struct("text", "tier"), "tier").alias("_b")
    )
    name = F.get(F.array(*[F.lit(t) for t in TIERS]), F.col("_b.tier") - 1)
    return best.select("doc", "page", F.col("_b.text").alias("text"), F.coalesce(name, F.lit("unknown")).alias("extractor"))


def still_missing(totals: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc, page) of the expected pages 1..total that no tier could read: input of the next tier."""
    expected = totals.select("doc", F.explode(F.sequence(F.lit(1), F.col("total").cast("int"))).alias("page"))
    return expected.join(pages.select("doc", "page"), ["doc", "page"], "left_anti")


def missing_report(totals: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc, missing, total, warning) of documents with unread pages; the first ones are named."""
    missing = still_missing(totals, pages)
    counts = missing.groupBy("doc").agg(F.count("*").alias("missing"))
    named = (
        first_rows_per_key(missing, ["doc"], [F.col("page")], SHOWN_PAGES, "_n")
        .groupBy("doc")
        .agg(F.array_sort(F.collect_list("page")).alias("_pages"))
    )
    shown = F.concat(
        F.lit("["), F.array_join(F.transform("_pages", lambda p: p.cast("string")), ", "), F.lit("]"),
        F.when(F.col("missing") > SHOWN_PAGES, "...").otherwise(""),
    )
    warning = F.format_string(
        "%d/%d pages yielded no text (pages %s)", "missing", "total", shown
    )
    return (
        counts.join(named, "doc")
        .join(totals.select("doc", F.col("total").cast("bigint").alias("total")), "doc")
        .select("doc", "missing", "total", warning.alias("warning"))
    )


def to_documents(pages: DataFrame) -> DataFrame:
    """One row per document with its page array; a file's pages fit one row, as the file did."""
    page = F.struct(F.col("page").cast("int").alias("number"), "text", "extractor")
    return pages.groupBy("doc").agg(F.array_sort(F.collect_list(page)).alias("pages"))


def retry_missing(extracted: DataFrame, totals: DataFrame, engine, tier: int) -> DataFrame:
    """Runs the next engine on the missing pages only and adds its rows."""
    missing = still_missing(totals, cascade(extracted))
    return extracted.unionByName(engine(missing).select("doc", "page", F.lit(tier).alias("tier"), "text"))
