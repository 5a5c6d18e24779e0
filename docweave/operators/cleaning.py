"""Document-level columns, running-head removal and page cleaning.

A document is one row with `pages ARRAY<STRUCT<number, text, extractor>>`. A file is read as one
row, so every step here works inside the row and needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions import text as tx
from docweave.functions.ids import content_hash

MIN_PAGES = 5
THRESHOLD = 0.6
JOINER = "\n\n"


def readable(pages: Column) -> Column:
    return F.filter(pages, lambda p: ~tx.is_blank(p["text"]))


def document_text(pages: Column) -> Column:
    return F.array_join(F.transform(readable(pages), lambda p: p["text"]), JOINER)


def char_count(pages: Column) -> Column:
    return F.aggregate(pages, F.lit(0).cast("bigint"), lambda n, p: n + F.length(p["text"]))


def extractors_used(pages: Column) -> Column:
    return F.sort_array(F.array_distinct(F.transform(readable(pages), lambda p: p["extractor"])))


def profile(docs: DataFrame) -> DataFrame:
    pages = F.col("pages")
    return docs.withColumns(
        {
            "page_count": F.size(pages).cast("bigint"),
            "char_count": char_count(pages),
            "extractors": extractors_used(pages),
            "content_hash": content_hash(document_text(pages)),
        }
    )


def remove_running_heads(docs: DataFrame, min_pages: int = MIN_PAGES, threshold: float = THRESHOLD) -> DataFrame:
    """Drops lines that recur on most pages, and page-number lines in such documents.

    A key counts once per page. In the sorted list of all page keys a key occurs at least
    `cutoff` times exactly if some entry equals the one `cutoff - 1` places before it.
    Shorter documents have no running heads, so their lines get no keys.
    """
    n_pages = F.size("pages")
    keyed = docs.withColumn(
        "_pages",
        F.transform(
            F.when(n_pages >= min_pages, F.col("pages")),
            lambda p: F.struct(
                p["number"].alias("number"),
                p["extractor"].alias("extractor"),
                F.transform(
                    tx.lines(p["text"]), lambda s: F.struct(s.alias("line"), tx.line_key(s).alias("key"))
                ).alias("lines"),
            ),
        ),
    )
    per_page = F.transform(
        "_pages",
        lambda p: F.array_distinct(
            F.filter(F.transform(p["lines"], lambda s: s["key"]), lambda k: k.isNotNull())
        ),
    )
    sorted_keys = keyed.withColumn("_keys", F.sort_array(F.flatten(per_page))).withColumn(
        "_cutoff", F.greatest(F.lit(2), F.floor(n_pages * F.lit(float(threshold))).cast("int"))
    )
    repeated = F.array_distinct(
        F.filter("_keys", lambda k, i: k == F.get(F.col("_keys"), i - F.col("_cutoff") + 1))
    )
    found = sorted_keys.withColumn(
        "_heads", F.when(n_pages >= min_pages, repeated).otherwise(F.array().cast("array<string>"))
    )
    kept = F.transform(
        "_pages",
        lambda p: F.struct(
            p["number"].alias("number"),
            F.array_join(
                F.transform(
                    F.filter(
                        p["lines"],
                        lambda s: ~(
                            F.coalesce(F.array_contains("_heads", s["key"]), F.lit(False))
                            | tx.is_page_number(s["line"])
                        ),
                    ),
                    lambda s: s["line"],
                ),
                "\n",
            ).alias("text"),
            p["extractor"].alias("extractor"),
        ),
    )
    return found.withColumn("pages", F.when(F.size("_heads") > 0, kept).otherwise(F.col("pages"))).drop(
        "_pages", "_keys", "_cutoff", "_heads"
    )


def normalize_pages(docs: DataFrame) -> DataFrame:
    """Repairs the text of each page and drops pages left blank."""
    folded = docs.withColumn("_folded", tx.nfkc_each(F.transform("pages", lambda p: p["text"])))
    repaired = folded.withColumn(
        "pages",
        F.zip_with(
            "pages",
            "_folded",
            lambda p, text: F.struct(
                p["number"].alias("number"), tx.repair(text).alias("text"), p["extractor"].alias("extractor")
            ),
        ),
    )
    return repaired.withColumn("pages", readable(F.col("pages"))).drop("_folded")


def clean_pages(docs: DataFrame) -> DataFrame:
    return normalize_pages(remove_running_heads(docs))
