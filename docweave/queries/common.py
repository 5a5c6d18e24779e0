"""Registry, table access and derived inputs shared by the registered queries.

Every derived input is a Spark expression over the given tables, with the same expression as SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.session import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str, *columns: str, heavy: bool = False) -> DataFrame:
    """A given table; `heavy` spreads a small one over all cores for costly work per row."""
    found = spark.read.parquet(f"{folder}/{name}.parquet")
    found = found.select(*columns) if columns else found
    return spread(found) if heavy else found


# SQL pieces. WS is what Python's strip() removes, as an RE2 class.
WS = r"[\t-\r\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def sql_repair(x: str) -> str:
    """The text repairs in RE2; look-around is replaced by two consuming passes."""
    x = rf"regexp_replace({x}, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g')"
    x = rf"regexp_replace({x}, '([a-z])-\s*\n\s*([a-z])', '\1\2', 'g')"
    for _ in range(2):
        x = rf"regexp_replace({x}, '(^|[^.!?:;)\]])\n([a-z(])', '\1 \2', 'g')"
    x = rf"regexp_replace({x}, '[ \t\x{{A0}}]{{2,}}', ' ', 'g')"
    x = rf"regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g')"
    x = rf"regexp_replace({x}, '[ \t\x{{A0}}]+(\n|$)', '\1', 'g')"
    return sql_strip(x)


def sql_line_key(line: str) -> str:
    bare = sql_strip(line)
    return (
        f"CASE WHEN length({bare}) BETWEEN 1 AND 120 "
        f"THEN regexp_replace(lower({bare}), '\\p{{Nd}}+', '#', 'g') END"
    )


PAGE_NUMBER_RE2 = r"(?i)^\s*(?:page\s+)?\d{1,4}(?:\s*(?:/|of)\s*\d{1,4})?\s*$"
LINES_PER_PAGE = 3


def paged_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as files of several pages: three lines each, with a running head and a page number."""
    docs = table(spark, folder, "documents", "doc_id", "text", "source", "lang", heavy=True)
    rows = F.split("text", "\n")
    total = F.ceil(F.size(rows) / LINES_PER_PAGE).cast("int")
    page = F.transform(
        F.sequence(F.lit(1), total),
        lambda i: F.struct(
            i.alias("number"),
            F.concat(
                F.lit("Collection "), F.col("source"), F.lit(" 2024 - p. "), i.cast("string"), F.lit("\n"),
                F.array_join(F.slice(F.col("_rows"), (i - 1) * LINES_PER_PAGE + 1, F.lit(LINES_PER_PAGE)), "\n"),
                F.lit("\nPage "), i.cast("string"), F.lit(" of "), total.cast("string"),
            ).alias("text"),
            F.lit("builtin").alias("extractor"),
        ),
    )
    return docs.withColumn("_rows", rows).select(
        "doc_id",
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"),
        "source",
        "lang",
        page.alias("pages"),
    )


PAGED_SQL = f"""
paged AS (
  SELECT doc_id, 'doc_' || doc_id || '.txt' AS filename, source, i AS number, total,
         'Collection ' || source || ' 2024 - p. ' || i || chr(10)
         || array_to_string(list_slice(rows, (i - 1) * {LINES_PER_PAGE} + 1, i * {LINES_PER_PAGE}), chr(10))
         || chr(10) || 'Page ' || i || ' of ' || total AS text
  FROM (SELECT doc_id, source, rows, total, unnest(generate_series(1, total)) AS i
        FROM (SELECT doc_id, source, string_split(text, chr(10)) AS rows,
                     CAST(ceil(len(string_split(text, chr(10))) / {LINES_PER_PAGE}.0) AS INT) AS total
              FROM documents))
)"""


def damaged(text):
    """A text with the defects of extracted pages: broken words, wrapped lines, odd spaces."""
    steps = [
        (r" (th|de|di)", "-\n $1"),
        (", ", ",\n"),
        (r"\. ", ".\u00a0 \t"),
        (r"ing ", "ing\u0007 \n\n\n\n"),
        (r" (a|la|un) ", "\n$1  "),
    ]
    for pattern, replacement in steps:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def sql_damaged(x: str) -> str:
    x = rf"regexp_replace({x}, ' (th|de|di)', '-' || chr(10) || ' \1', 'g')"
    x = rf"replace({x}, ', ', ',' || chr(10))"
    x = rf"replace({x}, '. ', '.' || chr(160) || ' ' || chr(9))"
    x = rf"replace({x}, 'ing ', 'ing' || chr(7) || ' ' || repeat(chr(10), 4))"
    return rf"regexp_replace({x}, ' (a|la|un) ', chr(10) || '\1  ', 'g')"
