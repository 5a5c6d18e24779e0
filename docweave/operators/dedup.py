"""Duplicate files, duplicate contents, duplicate chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.operators.skew import with_key_facts
from docweave.session import written


def canonical_names(files: DataFrame, hash_column: str, name: str = "name") -> DataFrame:
    """(name, hash, canonical, is_duplicate): the shortest, then alphabetically first name of a
    group of equal hashes is kept. A file without a hash (unreadable) is its own group.

    Names and hashes are written once, so that the contents are read and hashed only once.
    """
    slim = written(files.select(name, hash_column), "hashes")
    keyed = slim.withColumn(
        "_group", F.coalesce(F.col(hash_column), F.concat(F.lit("unhashable:"), F.col(name)))
    )
    best = F.struct(F.length(name).alias("size"), F.col(name).alias("name"))
    found = with_key_facts(keyed, ["_group"], [name], {"_best": (F.min(best), F.min)})
    canonical = F.col("_best.name")
    return found.withColumns({"canonical": canonical, "is_duplicate": F.col(name) != canonical}).drop(
        "_group", "_best"
    )


def content_status(records: DataFrame) -> DataFrame:
    """(filename, content_hash, status, duplicate_of) of readable documents after comparison.

    Processing files one by one in any order and demoting twins ends with exactly the canonical
    name of every content as 'ok', which is the minimum per hash.
    """
    found = canonical_names(records, "content_hash", "filename")
    return found.withColumns(
        {
            "status": F.when(F.col("is_duplicate"), "duplicate").otherwise("ok"),
            "duplicate_of": F.when(F.col("is_duplicate"), F.col("canonical")),
        }
    ).drop("canonical", "is_duplicate")


def first_of_equal_chunks(chunks: Column) -> Column:
    """Keeps the first chunk of each text within one document; indexes keep their gaps.

    `chunks` must be a plain column: sorted by (text, index), a chunk is first if the one before
    it differs.
    """
    ordered = F.sort_array(
        F.transform(chunks, lambda c: F.struct(c["text"].alias("text"), c["index"].alias("index")))
    )
    before = F.concat(
        F.array(F.lit(None).cast("string")),
        F.transform(ordered, lambda c: c["text"]),
    )
    firsts = F.filter(
        F.zip_with(
            ordered,
            F.slice(before, 1, F.size(ordered)),
            lambda c, b: F.when(b.isNull() | (b != c["text"]), c["index"]),
        ),
        lambda i: i.isNotNull(),
    )
    # Indexes are consecutive before this step, so they are positions too.
    return F.transform(F.sort_array(firsts), lambda i: F.get(chunks, i))


def drop_repeated_chunks(docs: DataFrame) -> DataFrame:
    return docs.withColumn("chunks", first_of_equal_chunks(F.col("chunks")))
