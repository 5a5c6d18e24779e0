"""State of the vector table, and the shape of the answering plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.operators import store

# The answering plan as a Mermaid chart.
CHART = """graph TD
  translate_in --> planner
  planner --> responder
  planner --> clarifier
  planner --> retriever
  clarifier --> translate_out
  clarifier --> retriever
  retriever --> grader
  grader --> retriever
  grader --> responder
  grader --> advisor
  responder --> translate_out
  advisor --> translate_out"""


def health(points: DataFrame) -> DataFrame:
    """status, points and vector dimension as one row; an empty table is degraded."""
    return store.stats(points).select(
        F.when(F.col("points") > 0, "healthy").otherwise("degraded").alias("status"), "points", "vectors_dim"
    )
