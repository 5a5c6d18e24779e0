"""Evaluation metrics over replayed samples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.text import is_blank, strip

# How much of an answer and its passages is kept.
ANSWER_CHARS = 1200
KEPT_CONTEXTS = 4
JUDGED_CONTEXTS = 2
JUDGED_CHARS = 400


def _strings(column: Column) -> Column:
    return F.coalesce(column, F.array().cast("array<string>"))


def detect_tool(steps: Column, blocked: Column) -> Column:
    """The tool a trace stands for."""
    trace = F.lower(F.array_join(_strings(steps), " "))
    searched = trace.contains("retrieval pass") | trace.contains("intent: research") | trace.contains("sources:")
    return (
        F.when(blocked | trace.contains("guardrails fired"), F.lit("guardrails"))
        .when(searched, F.lit("retrieve_documents"))
        .when(trace.contains("conversational"), F.lit("direct_answer"))
        .otherwise(F.lit("unknown"))
    )


def was_blocked(blocked: Column, steps: Column) -> Column:
    return F.coalesce(blocked, F.lit(False)) | F.exists(
        _strings(steps), lambda s: F.lower(s).contains("guardrails fired")
    )


def enrich(samples: DataFrame) -> DataFrame:
    """Adds actual_* columns from a replayed response.

    samples: (..., relevant_contexts, answer, sources ARRAY<STRUCT<content, citation>>, steps,
    blocked, error). A failed replay keeps the reference passages and no citations.
    """
    failed = F.col("error").isNotNull()
    first = F.slice(F.coalesce("sources", F.array().cast(samples.schema["sources"].dataType)), 1, KEPT_CONTEXTS)
    passages = F.filter(F.transform(first, lambda s: s["content"]), lambda c: F.coalesce(c, F.lit("")) != "")
    citations = F.transform(first, lambda s: F.coalesce(s["citation"], F.lit("")))
    tool = detect_tool(F.col("steps"), F.coalesce("blocked", F.lit(False)))
    return samples.withColumns(
        {
            "actual_response": F.when(failed, "").otherwise(
                F.left(F.coalesce("answer", F.lit("")), F.lit(ANSWER_CHARS))
            ),
            "actual_contexts": F.when(failed, _strings(F.col("relevant_contexts"))).otherwise(passages),
            "actual_tools_called": F.array(F.when(failed, F.lit("unknown")).otherwise(tool)),
            "actual_citations": F.when(~failed, citations),
        }
    )


def tool_correctness(called: Column, expected: Column) -> Column:
    """Jaccard overlap of two sets, 0 for two empty ones."""
    called, expected = _strings(called), _strings(expected)
    union = F.size(F.array_union(called, expected))
    return F.when(union > 0, F.round(F.size(F.array_intersect(called, expected)) / union, 3)).otherwise(0.0)


def retrieval_hit(source_doc: Column, citations: Column) -> Column:
    """1 if the expected document is cited, or if none is expected and none is cited."""
    expected = strip(F.coalesce(source_doc, F.lit("")))
    cited = F.array_join(_strings(citations), " ")
    none_expected = (expected == "") | (expected == "none")
    return (
        F.when(none_expected, is_blank(cited)).otherwise(F.lower(cited).contains(F.lower(expected))).cast("int")
    )


def judged(samples: DataFrame) -> DataFrame:
    """Answered samples with the passages a judge sees."""
    own = F.col("actual_contexts")
    raw = F.when(F.size(_strings(own)) > 0, own).otherwise(_strings(F.col("relevant_contexts")))
    return samples.where(~is_blank(F.col("actual_response"))).withColumn(
        "actual_contexts",
        F.transform(F.slice(raw, 1, JUDGED_CONTEXTS), lambda c: F.left(c, F.lit(JUDGED_CHARS))),
    )


def outcome(expected: Column, actual: Column) -> Column:
    """TP, TN, FP or FN; an unreachable service counts as not blocked."""
    actual = F.coalesce(actual, F.lit(False))
    return (
        F.when(expected & actual, F.lit("TP"))
        .when(~expected & ~actual, F.lit("TN"))
        .when(~expected & actual, F.lit("FP"))
        .otherwise(F.lit("FN"))
    )


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def summarise(results: DataFrame) -> DataFrame:
    """Counts, accuracy, precision, recall and F1 as one row, from a `result` column."""
    counts = results.agg(
        *[F.count_if(F.col("result") == name).alias(name) for name in ("TP", "TN", "FP", "FN")]
    )
    tp, tn, fp, fn = (F.col(c) for c in ("TP", "TN", "FP", "FN"))
    precision, recall = _share(tp, tp + fp), _share(tp, tp + fn)
    return counts.withColumns(
        {
            "total": tp + tn + fp + fn,
            "accuracy": F.round(_share(tp + tn, tp + tn + fp + fn), 3),
            "precision": F.round(precision, 3),
            "recall": F.round(recall, 3),
            "f1": F.round(_share(2 * precision * recall, precision + recall), 3),
        }
    )


def mistakes(results: DataFrame, *columns: str) -> DataFrame:
    """The wrongly blocked and wrongly passed inputs, as rows."""
    return results.where(F.col("result").isin("FP", "FN")).select("result", *columns)


def metric_mean(frame: DataFrame, metric: str) -> DataFrame:
    return frame.agg(F.avg(metric).alias("mean"), F.count(metric).alias("samples"))


def judge(samples: DataFrame, metrics: dict[str, Callable[[], Column]]) -> DataFrame:
    """Adds one score column per metric of judged samples.

    A metric is a function that gives a column (usually an Arrow UDF that asks a judge model). One
    that cannot be set up, such as for a missing model, leaves its column null and the others alone.
    """
    for name, metric in metrics.items():
        try:
            score = metric().cast("double")
        except Exception:
            score = F.lit(None).cast("double")
        samples = samples.withColumn(name, score)
    return samples
