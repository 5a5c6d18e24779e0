"""Quality classifier by importance resampling (operator 4).

Two generative models over hashed n-grams, one of the target text (labelled good and not toxic) and one of all
raw text, give every document the log of its importance: log p(target) - log p(raw). The best are drawn
without replacement by Gumbel top-k: a random Gumbel number is added and the k largest sums are kept. How many
documents are worth keeping is read off a part of the labelled rows that the model did not see.

A third model finds toxic text: per n-gram the log ratio of the labelled toxic texts that hold it to the others. The
largest one of a document counts, so one toxic word is as telling in a long text as in a short one. Documents above
a cut that is read off the same unseen rows are rejected before the draw.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.shared import Store, chunks, text_bytes
from docweave.llm.spans import LOWER, SPACE, Prefix, mix

BUCKET_BITS = 16
TOXIC_BITS = 20  # more, as a single n-gram that shares a bucket would reject its document
SAMPLE = 20_000  # labelled rows that the models are fitted on, at most
PRIOR = 5.0
TEMPERATURE = 1.0  # of the Gumbel numbers: 1 draws with probabilities in proportion to the importance
KIND = np.ones(256, np.uint8)  # 0 space, 1 letters and digits, 2 other signs
KIND[SPACE] = 0
KIND[[c for c in range(33, 127) if not chr(c).isalnum()]] = 2


def features(data: np.ndarray, ends: np.ndarray, bits: int = BUCKET_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Rows and buckets of all words, runs of signs, and pairs of neighbours."""
    data = LOWER[data]
    kind = KIND[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[ends] = True
    starts = np.flatnonzero((kind > 0) & ((kind != np.r_[np.uint8(0), kind[:-1]]) | cut[:-1]))
    stops = np.flatnonzero((kind > 0) & ((kind != np.r_[kind[1:], np.uint8(0)]) | cut[1:])) + 1
    row = np.searchsorted(ends, starts, side="right") - 1
    code = mix(Prefix(data).spans(starts, stops))
    pair = mix(code[:-1] * np.uint64(3) + code[1:], 5)
    same = row[1:] == row[:-1]
    both = np.r_[code, pair[same]] >> np.uint64(64 - bits)
    return np.r_[row, row[1:][same]], both.astype(np.int64)


def counted(docs: DataFrame) -> DataFrame:
    """model, bucket, n: n-gram counts of all `docs` ('raw') and of those with `good` set ('target')."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 << BUCKET_BITS), np.int64)
        for batch in batches:
            for part in chunks(batch, "text"):
                row, bucket = features(*text_bytes(part.column("text")))
                good = np.array(part.column("good").to_pylist(), bool)
                sums[0] += np.bincount(bucket, minlength=1 << BUCKET_BITS)
                sums[1] += np.bincount(bucket[good[row]], minlength=1 << BUCKET_BITS)
        model, bucket = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(model.astype(np.int32)), pa.array(bucket), pa.array(sums[model, bucket])], names=["model", "bucket", "n"]
        )

    parts = docs.select("text", "good").mapInArrow(count, "model int, bucket long, n long")
    return parts.groupBy("model", "bucket").agg(F.sum("n").alias("n"))


def importance(counts: DataFrame) -> np.ndarray:
    """Log ratio of the two models per bucket, drawn to 0 where few n-grams were seen."""
    sums = np.zeros((2, 1 << BUCKET_BITS))
    for r in counts.collect():  # 2 * 2**BUCKET_BITS rows at most
        sums[r["model"], r["bucket"]] = r["n"]
    raw, target = sums
    if not target.sum():
        return np.zeros(1 << BUCKET_BITS)
    expected = raw * (target.sum() / raw.sum())
    share = raw / raw.sum() * (target + PRIOR) / (expected + PRIOR)
    return np.log((target + PRIOR) / (expected + PRIOR) / share.sum())


def toxicity(docs: DataFrame) -> np.ndarray:
    """Log ratio per bucket of the texts with `toxic` set that hold it to the others, drawn to 0 where few do."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, (1 << TOXIC_BITS) + 1), np.int64)  # the last one counts the texts
        for batch in batches:
            for part in chunks(batch, "text"):
                row, bucket = features(*text_bytes(part.column("text")), TOXIC_BITS)
                toxic = np.array(part.column("toxic").to_pylist(), bool)
                once = np.unique(row << TOXIC_BITS | bucket)
                row, bucket = once >> TOXIC_BITS, once & ((1 << TOXIC_BITS) - 1)
                for model in (0, 1):
                    sums[model, :-1] += np.bincount(bucket[toxic[row] == model], minlength=1 << TOXIC_BITS)
                    sums[model, -1] += (toxic == model).sum()
        model, bucket = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(model.astype(np.int32)), pa.array(bucket), pa.array(sums[model, bucket])], names=["model", "bucket", "n"]
        )

    parts = docs.select("text", "toxic").mapInArrow(count, "model int, bucket long, n long")
    sums = np.zeros((2, (1 << TOXIC_BITS) + 1))
    found = parts.groupBy("model", "bucket").agg(F.sum("n").alias("n")).toArrow()  # 2 * 2**TOXIC_BITS rows and 2 at most
    sums[found.column("model").to_numpy(), found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    other, toxic = sums
    if not toxic[-1] or not other[-1]:
        return np.zeros(1 << TOXIC_BITS)
    return np.log((toxic[:-1] + PRIOR) / (other[:-1] * (toxic[-1] / other[-1]) + PRIOR))


def scored(docs: DataFrame, ratios: np.ndarray, worst: np.ndarray, name: str) -> DataFrame:
    """`docs` with the sum of the log ratios of their n-grams in column `name`, and the largest of `worst` in `_toxic`."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                row, wide = features(*text_bytes(part.column("text")), TOXIC_BITS)
                bucket = wide >> (TOXIC_BITS - BUCKET_BITS)
                total = np.bincount(row, weights=ratios[bucket], minlength=part.num_rows).astype(float)  # whole numbers if empty
                most, hit = np.zeros(part.num_rows), np.flatnonzero(worst[wide] > 0)
                np.maximum.at(most, row[hit], worst[wide[hit]])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(total), pa.array(most)], names=[*part.schema.names, name, "_toxic"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(score, f"{schema}, `{name}` double, _toxic double")


def gumbel(seed: int = 4) -> Column:
    """A Gumbel number that only depends on id and text."""
    chance = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text"), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(chance))


def kth_largest(rows: DataFrame, key: str, k: int) -> float:
    """The k-th largest value of `key`, by counting in ever narrower cells; at most 1024 counts per answer."""
    low, high = rows.agg(F.min(key), F.max(key)).first()
    while high > low:
        inside = rows.where(F.col(key).between(low, high))
        cell = F.least(F.lit(1023), F.floor((F.col(key) - low) / (high - low) * 1024)).cast("int")
        cells = inside.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high"))
        for r in sorted(cells.collect(), key=lambda r: -r["cell"]):
            if k <= r["n"]:
                break
            k -= r["n"]
        if k == 1 or (r["low"], r["high"]) == (low, high):
            return r["high"] if k == 1 else r["low"]
        low, high = r["low"], r["high"]
    return high


def classify(
    docs: DataFrame, labels: DataFrame, temperature: float = TEMPERATURE, sample: int = SAMPLE, name: str = "log_ratio", verdict: str = "kept"
) -> DataFrame:
    """The columns of `docs` with the log of each row's importance and whether it is drawn.

    Reads doc_id and text of `docs`; of `labels` doc_id, quality and toxic. Rows of quality 0 or toxic 1 are bad, others
    of quality 1 good; a null tells nothing. At most `sample` labelled rows, those with the smallest hashes, are used;
    four fifths fit the target and the toxic model and the others set the cut between good and bad and the one between
    toxic and not. Toxic documents are rejected; k is the number of the others above the first cut. A null or
    empty text has importance 1. Rows equal in id and text share their verdict. Without labels all rows
    are kept; an empty table gives none.
    """
    store = Store(docs.sparkSession, "quality")
    toxic = F.col("toxic") == 1
    good = F.when((F.col("quality") == 0) | toxic, False).when(F.col("quality") == 1, True)
    order = F.xxhash64(F.lit(4), "doc_id")
    known = labels.select(F.col("doc_id").alias("label_id"), good.alias("good"), toxic.alias("toxic"), order.alias("order"))
    known = known.where("label_id IS NOT NULL AND (good IS NOT NULL OR toxic IS NOT NULL)").orderBy("order", "label_id").limit(sample)
    known = store.put(known.dropDuplicates(["label_id"]).withColumn("fit", F.pmod("order", F.lit(5)) > 0).drop("order"), "labels")
    joined = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("label_id"), "left")
    marked = joined.select("doc_id", "text", F.coalesce(F.col("good") & F.col("fit"), F.lit(False)).alias("good"))
    ratios = importance(counted(marked))
    worst = toxicity(joined.where("fit AND toxic IS NOT NULL"))

    held = [F.when(~F.col("fit"), F.col(c)).alias(c) for c in ("good", "toxic")]
    scores = scored(joined.select("doc_id", "text", *held).withColumn("chance", gumbel()), ratios, worst, "score")
    scores = store.put(scores.select("score", (F.col("score") + temperature * F.col("chance")).alias("sum"), "good", "toxic", "_toxic"), "scores")
    judged = np.array([(r["score"], r["good"]) for r in scores.where("good IS NOT NULL").collect()], float).reshape(-1, 2)
    cut = best_cut(judged[:, 0], judged[:, 1] > 0)
    judged = np.array([(-r["_toxic"], not r["toxic"]) for r in scores.where("toxic IS NOT NULL").collect()], float).reshape(-1, 2)
    clean = -F.col("_toxic") >= F.lit(float(best_cut(judged[:, 0], judged[:, 1] > 0)))
    rest = scores.where(clean)
    k = rest.where(F.col("score") >= cut).count() if np.isfinite(cut) else rest.count()
    least = kth_largest(rest, "sum", k) if k else float("inf")
    done = scored(docs, ratios, worst, name)
    return done.withColumn(verdict, clean & (F.col(name) + temperature * gumbel() >= F.lit(least))).drop("_toxic")


def best_cut(score: np.ndarray, good: np.ndarray) -> float:
    """The score from which on rows count as good: the most rows on the right side, good ones counting double."""
    if good.all() or not good.any():
        return -np.inf
    order = np.argsort(score)
    score, good = score[order], good[order]
    right = np.r_[0, np.cumsum(~good / (~good).sum())] + 2 * (1 - np.r_[0, np.cumsum(good / good.sum())])
    best = int(np.argmax(right))
    return -np.inf if best == 0 else (score[best - 1] + score[min(best, len(score) - 1)]) / 2
