"""Text repair as column expressions (Python string semantics on the JVM side)."""

from __future__ import annotations

from collections.abc import Callable
from unicodedata import normalize as normalize_form

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.functions.binding import let

# The patterns below decide results.
BLANK = r"[\s\x1C-\x1F]"  # used with (?U): what Python's strip() removes
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)  # the same, character by character
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
OTHER_LINE_END = r"[\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
HYPHEN_BREAK = r"(?U)([a-z])-\s*\n\s*([a-z])"
SOFT_WRAP = r"(?<![.!?:;\)\]])\n(?=[a-z(])"
SPACE_RUN = r"[ \t\x{A0}]{2,}"
NEWLINE_RUN = r"\n{3,}"
PAGE_NUMBER_LINE = r"(?iuU)^\s*(?:page\s+)?\d{1,4}(?:\s*(?:/|of)\s*\d{1,4})?\s*\z"
LONGEST_RUNNING_HEAD = 120

# Every character outside these ranges may change under NFKC.
MAY_CHANGE_UNDER_NFKC = r"[^\x00-\x7F\x{C0}-\x{FF}]"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def is_blank(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(rf"(?U)^{BLANK}*\z")


def words(text: Column) -> Column:
    """Whitespace-separated words; no words for a blank text."""
    return F.filter(F.split(text, rf"(?U){BLANK}+"), lambda w: w != "")


def lines(text: Column) -> Column:
    """Lines without their terminators; a final terminator opens no extra line."""
    return let(
        F.split(text, LINE_END),
        lambda parts: F.when(
            F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)
        ).otherwise(parts),
    )


def _folded(text: str | None) -> str | None:
    return text and normalize_form("NFKC", text)


@F.arrow_udf(T.StringType())
def _fold_text(values: pa.Array) -> pa.Array:
    return pa.array((_folded(t.as_py()) for t in values), pa.string())


@F.arrow_udf(T.ArrayType(T.StringType()))
def _fold_texts(values: pa.Array) -> pa.Array:
    rows = (row and [_folded(t) for t in row] for row in (v.as_py() for v in values))
    return pa.array(rows, pa.list_(pa.string()))


def nfkc(text: Column) -> Column:
    """Compatibility folding. Only texts that may change cross into the Python worker."""
    return F.coalesce(_fold_text(F.when(text.rlike(MAY_CHANGE_UNDER_NFKC), text)), text)


def nfkc_each(texts: Column) -> Column:
    """The same for an array of texts."""
    changing = F.exists(texts, lambda t: t.rlike(MAY_CHANGE_UNDER_NFKC))
    return F.coalesce(_fold_texts(F.when(changing, texts)), texts)


def _where(text: Column, needed: Callable[[Column], Column], change: Callable[[Column], Column]) -> Column:
    """change(text) where `needed`, a cheap test that holds for every text that would change; else the text."""
    return let(text, lambda t: F.when(needed(t), change(t)).otherwise(t))


def drop_control(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, "")


def join_hyphenated(text: Column) -> Column:
    return _where(text, lambda t: t.contains("-"), lambda t: F.regexp_replace(t, HYPHEN_BREAK, "$1$2"))


def join_wrapped(text: Column) -> Column:
    return F.regexp_replace(text, SOFT_WRAP, " ")


def collapse_spaces(text: Column) -> Column:
    paired = lambda t: t.contains("  ") | t.contains("\t") | t.contains("\xa0")
    return _where(text, paired, lambda t: F.regexp_replace(t, SPACE_RUN, " "))


def collapse_newlines(text: Column) -> Column:
    return _where(text, lambda t: t.contains("\n\n\n"), lambda t: F.regexp_replace(t, NEWLINE_RUN, "\n\n"))


def trim_lines(text: Column) -> Column:
    """Every line loses its trailing whitespace, the text its outer whitespace."""
    unified = _where(text, lambda t: t.rlike(OTHER_LINE_END), lambda t: F.regexp_replace(t, LINE_END, "\n"))
    return strip(F.regexp_replace(unified, r"(?U)[^\S\n]+(\n|\z)", "$1"))


def repair(folded: Column) -> Column:
    """All repairs after compatibility folding; their order decides the result."""
    for step in (drop_control, join_hyphenated, join_wrapped, collapse_spaces, collapse_newlines, trim_lines):
        folded = step(folded)
    return folded


def normalize(text: Column) -> Column:
    return repair(nfkc(F.coalesce(text, F.lit(""))))


def line_key(line: Column) -> Column:
    """Comparison form of a possible running head; null for blank and long lines."""
    return let(
        strip(line),
        lambda bare: F.when(
            F.length(bare).between(1, LONGEST_RUNNING_HEAD), F.regexp_replace(F.lower(bare), r"(?U)\d+", "#")
        ),
    )


def is_page_number(line: Column) -> Column:
    return line.rlike(PAGE_NUMBER_LINE)


def fixed3(number: Column) -> Column:
    """A number with three decimals, rounded from its exact binary value, ties to even.

    The JVM formatter rounds the shortest decimal form half up, which differs for ties. Whole part and
    fraction are formatted apart; both are exact. From 2**123 on, and for values that are not finite, the digits
    are the JVM's.
    """
    size = F.abs(number)
    whole = F.floor(size.cast("double"))
    large = float(2**60)
    high = F.when(size < float(2**53), 0.0).otherwise(F.floor(size / large))
    exact = F.when(size < float(2**53), size.cast("bigint").cast("decimal(38,0)")).otherwise(
        high.cast("bigint").cast("decimal(19,0)") * F.lit(str(2**60)).cast("decimal(19,0)")
        + (size - high * large).cast("bigint").cast("decimal(38,0)")
    )
    fraction = F.when(size < float(2**53), size - whole).otherwise(0.0)
    one = 2**61
    scaled = fraction * float(one)
    # The last bit records that something smaller was cut off.
    bits = scaled.cast("bigint") * 2 + (scaled > F.floor(scaled)).cast("int")
    thousandths = bits.cast("decimal(20,0)") * F.lit(1000).cast("decimal(4,0)")
    unit, half = (F.lit(str(v)).cast("decimal(20,0)") for v in (2 * one, one))
    rest = thousandths % unit
    units = ((thousandths - rest) / unit).cast("bigint")
    up = (rest > half) | ((rest == half) & (units % 2 == 1))
    units = units + up.cast("int")
    total = exact + F.floor(units / 1000).cast("decimal(1,0)")
    sign = F.when(number.cast("string").startswith("-"), "-").otherwise("")
    tail = F.lpad((units % 1000).cast("string"), 3, "0")
    return F.when(size < 2.0**123, F.concat(sign, total.cast("string"), F.lit("."), tail)).otherwise(number.cast("string"))
