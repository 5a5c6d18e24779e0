"""Model targets per request, outcomes of calls, cached replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions import rules

TRIES_PER_TARGET = 2


def error_class(message: Column) -> Column:
    return (
        F.when(rules.mentions(message, rules.GATEWAY_FATAL), F.lit("fatal"))
        .when(rules.mentions(message, rules.GATEWAY_RETRYABLE), F.lit("retryable"))
        .otherwise(F.lit("unknown"))
    )


def target_chain(keys: Column, tier: Column, feature: Column) -> Column:
    """Ordered array<struct<label, model, key>> of the targets a request may use.

    `keys` is struct(primary, fallback, other, dedicated); a blank key is no key. A dedicated key
    of the feature comes first, then both models on the primary and fallback keys (the fast tier
    tries the small model first), then the other provider.
    """

    def key(name: str) -> Column:
        return F.coalesce(keys[name], F.lit(""))

    def target(label: Column, model: Column, value: Column) -> Column:
        return F.struct(label.alias("label"), model.alias("model"), value.alias("key"))

    fallback = F.when(key("fallback") == key("primary"), F.lit("")).otherwise(key("fallback"))
    fast = tier == "fast"
    first, second = (
        F.when(fast, F.lit("fast")).otherwise(F.lit("quality")),
        F.when(fast, F.lit("quality")).otherwise(F.lit("fast")),
    )
    own_model = F.when(feature == "translate", F.lit("translate")).otherwise(first)
    ladder = [target(F.concat(F.lit("dedicated-"), feature), own_model, key("dedicated"))]
    for model in (first, second):
        ladder.append(target(F.concat(F.lit("primary/"), model), model, key("primary")))
        ladder.append(target(F.concat(F.lit("fallback/"), model), model, fallback))
    ladder.append(target(F.lit("other"), F.lit("other"), key("other")))
    return F.filter(F.array(*ladder), lambda t: t["key"] != "")


def answered_by(calls: DataFrame, request: str = "request_id") -> DataFrame:
    """One row per request: which target answered, after how many attempts.

    calls: (request, position, attempt, message); message is null for a usable answer, and is what
    each target would say to its first and second try. A target gets a second try only after a
    retryable error; the first answer in order wins. A request's calls are few (targets x 2), and
    are reduced before the shuffle.
    """
    # Whole numbers aggregate in a hash table: 0 answered, 1 worth a second try, 2 next target.
    failed = F.when(error_class(F.col("message")) == "retryable", 1).otherwise(2)
    outcome = F.when(F.col("message").isNull(), 0).otherwise(failed)
    per_target = (
        calls.where(F.col("attempt") <= TRIES_PER_TARGET)
        .select(request, "position", "attempt", outcome.alias("outcome"))
        .groupBy(request, "position")
        .agg(
            F.max(F.when(F.col("attempt") == 1, F.col("outcome"))).alias("first"),
            F.max(F.when(F.col("attempt") == 2, F.col("outcome"))).alias("second"),
        )
    )
    retried = F.col("first") == 1
    settled = per_target.withColumns(
        {
            "ok": (F.col("first") == 0) | (retried & F.coalesce(F.col("second") == 0, F.lit(False))),
            "tries": F.when(retried, 2).otherwise(1),
        }
    )
    found = settled.groupBy(request).agg(
        F.min(F.when(F.col("ok"), F.col("position"))).alias("position"),
        F.min("position").alias("_first"),
        F.map_from_entries(F.collect_list(F.struct("position", "tries"))).alias("_tries"),
    )
    used = F.map_filter("_tries", lambda p, n: F.col("position").isNull() | (p <= F.col("position")))
    return found.withColumns(
        {
            "attempts": F.aggregate(F.map_values(used), F.lit(0), lambda a, n: a + n),
            "fallback_used": F.coalesce(F.col("position") > F.col("_first"), F.lit(False)),
            "failed": F.col("position").isNull(),
        }
    ).drop("_first", "_tries")


def cache_report(lookups: DataFrame) -> DataFrame:
    """hits, misses and hit rate of response-cache lookups with a `hit` flag."""
    return lookups.agg(
        F.count_if(F.col("hit")).alias("hits"), F.count_if(~F.col("hit")).alias("misses")
    ).withColumn(
        "hit_rate",
        F.when(
            F.col("hits") + F.col("misses") > 0,
            F.round(F.col("hits") / (F.col("hits") + F.col("misses")), 3),
        ).otherwise(0.0),
    )
