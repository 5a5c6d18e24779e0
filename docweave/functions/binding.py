"""Naming an intermediate value inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once however often the body uses it.

    Inside lambdas there is no common-subexpression elimination, and nested repetition would
    grow an expression exponentially.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
