"""Language-model scores of documents (operator 1).

The model is a causal self-attention network over subword ids. Its direct path from one id to the next is set
from counts over all training text; attention, hidden layer and outputs learn the rest by gradient steps in
numpy. Learners train on their own share of the training windows, from a common start; their weights are averaged
after each round. All training windows are learned from, each in one round by one learner: more text means more
learners. Documents are scored in overlapping windows: each window
re-reads the last ids of the one before as context and scores only new ones, so every id counts once.

The score of a text is the network's log10 probability of all its ids and its end, by the chain rule. The base is a
smoothed unigram model over whole words; `mixed_score` interpolates both half and half, word by word. Counts of frequent
words come from a table of bounded size, those of rare ones by a join.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm import attention
from docweave.llm.attention import TOKENS, WINDOW
from docweave.llm.packing import byte_letters, tokenizer
from docweave.llm.shared import Store, chunks
from docweave.llm.spans import Prefix, mix, words

STRIDE = 26
END = TOKENS - 1
ROUNDS = 4
LEARNER_WINDOWS = 16_384
FREQUENT = 1 << 18
NETWORK = 0.5  # weight of the network against the base


def normal(text: str) -> str:
    """Letters A-Z as a-z, words apart by one space."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII letters and white space only
    return b" ".join([b"", *parts]).decode("utf-8", "surrogatepass")


def raw_ids(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, row_key, held_out, ids (16 bits each): the subword ids of every text."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = tokenizer(vocabulary)
        for batch in batches:
            for part in chunks(batch, "text"):
                ids = [ids_of(normal(t)).astype("<u2").tobytes() if t else b"" for t in part.column("text").to_pylist()]
                columns = [*(part.column(c) for c in ("doc_id", "row_key", "held_out")), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row_key", "held_out", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, row_key long, held_out boolean, ids binary"
    return docs.select("doc_id", "row_key", "held_out", "text").mapInArrow(encode, schema)


def unpacked(column) -> tuple[np.ndarray, np.ndarray]:
    """Raw ids of a binary column, one after the other, and where each row's end."""
    _, places, data = column.buffers()
    ends = np.frombuffer(places, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // 2
    if data is None or ends[-1] == ends[0]:
        return np.zeros(0, np.int64), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, "<u2")[ends[0] : ends[-1]].astype(np.int64), ends - ends[0]


class Ragged:
    """A list of numbers for each raw id, looked up for many ids at once."""

    def __init__(self, parts: list, kind):
        self.sizes = np.array([len(p) for p in parts], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.array([x for p in parts for x in p], kind)

    def places(self, ids: np.ndarray) -> np.ndarray:
        size = self.sizes[ids]
        nth = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return np.repeat(self.starts[ids], size) + nth


@functools.lru_cache(maxsize=2)
def spelling(vocabulary: str) -> Ragged:
    """The bytes of every raw id."""
    letters = byte_letters()
    with open(vocabulary, encoding="utf-8") as file:
        found = json.load(file)
    parts = [[] for _ in range(1 << 16)]
    for word, i in found["model"]["vocab"].items():
        parts[i] = [letters[c] for c in word]
    for entry in found["added_tokens"]:
        parts[entry["id"]] = list(entry["content"].encode())
    return Ragged(parts, np.uint8)


def decoded(raw: np.ndarray, ends: np.ndarray, vocabulary: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts that the ids stand for, and where each text ends."""
    spelled = spelling(vocabulary)
    return spelled.flat[spelled.places(raw)], np.r_[0, np.cumsum(spelled.sizes[raw])][ends]


class Subwords:
    """The most frequent raw ids as ids of their own; any other as its bytes. The last id ends a text."""

    def __init__(self, counts: np.ndarray, vocabulary: str):
        spelled = spelling(vocabulary)
        often = [int(i) for i in np.argsort(-counts, kind="stable") if counts[i] and spelled.sizes[i] > 1][: TOKENS - 257]
        own = {raw: 256 + n for n, raw in enumerate(often)}
        words = [spelled.flat[a : a + n].tolist() for a, n in zip(spelled.starts, spelled.sizes)]
        self.ids = Ragged([[own[i]] if i in own else word for i, word in enumerate(words)], np.int32)


def sequences(raw: np.ndarray, ends: np.ndarray, subwords: Subwords) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts as one array of ids, each between two END ids; where each begins; the places of all other ids."""
    at = subwords.ids.places(raw)
    size = np.r_[0, np.cumsum(subwords.ids.sizes[raw])][ends]
    begins = size[:-1] + 2 * np.arange(len(ends) - 1)
    out = np.full(len(at) + 2 * (len(ends) - 1), END, np.int32)
    inside = np.ones(len(out), bool)
    inside[begins] = False
    inside[begins + np.diff(size) + 1] = False
    out[inside] = subwords.ids.flat[at]
    return out, np.r_[begins, len(out)], np.flatnonzero(inside)


def windows(begins: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first place and end of text of the windows that cover all places but the last of every text."""
    size = np.diff(begins) - 1
    counts = 1 + np.maximum(0, -(-(size - WINDOW) // stride))
    row = np.repeat(np.arange(len(size)), counts)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    return row, begins[row] + nth * stride, begins[row + 1]


def cut(ids: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows of WINDOW + 1 ids, and which of the last WINDOW lie inside their text."""
    at = first[:, None] + np.arange(WINDOW + 1)
    inside = at < end[:, None]
    return ids[np.minimum(at, len(ids) - 1)], inside[:, 1:]


def pair_counts(ids: DataFrame, subwords: Subwords) -> np.ndarray:
    """How often each id follows each other one; TOKENS * TOKENS numbers whatever the input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(TOKENS * TOKENS, np.int64)
        for batch in batches:
            for part in chunks_of_rows(batch, 512):
                found, begins, _ = sequences(*unpacked(part.column("ids")), subwords)
                cell = found[:-1].astype(np.int64) * TOKENS + found[1:]
                cell = np.delete(cell, begins[1:-1] - 1)
                sums += np.bincount(cell, minlength=TOKENS * TOKENS)
        cell = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(sums[cell])], names=["cell", "n"])

    sums = ids.select("ids").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    pairs = np.zeros(TOKENS * TOKENS)
    pairs[sums.column("cell").to_numpy()] = sums.column("n").to_numpy()
    return pairs.reshape(TOKENS, TOKENS)


def chunks_of_rows(batch: pa.RecordBatch, n: int) -> Iterator[pa.RecordBatch]:
    return (batch.slice(at, n) for at in range(0, batch.num_rows, n))


def fit(ids: DataFrame, subwords: Subwords, counts, store: Store) -> dict[str, np.ndarray]:
    """Weights after ROUNDS rounds of learning on disjoint parts of the windows, averaged after each."""

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks_of_rows(batch, 512):
                found, begins, _ = sequences(*unpacked(part.column("ids")), subwords)
                row, first, end = windows(begins, WINDOW)
                spot = mix(mix(part.column("row_key").to_numpy().view(np.uint64)[row]) + (first - begins[row]).astype(np.uint64))
                spot = mix(spot, 3).view(np.int64)
                for at in range(0, len(row), 8192):
                    mine = slice(at, at + 8192)
                    ids_, inside = cut(found, first[mine], end[mine])
                    ids_[:, 1:][~inside] = TOKENS  # outside the text
                    rows = [x.tobytes() for x in ids_.astype("<u2")]
                    yield pa.RecordBatch.from_arrays([pa.array(spot[mine]), pa.array(rows, pa.binary())], names=["spot", "ids"])

    taken = store.put(ids.select("row_key", "ids").mapInArrow(every, "spot long, ids binary"), "windows")
    n = taken.count()
    learners = max(1, -(-n // (ROUNDS * LEARNER_WINDOWS)))
    weights = attention.flat(attention.fresh())
    spark = ids.sparkSession
    for turn in range(ROUNDS if n else 0):
        start = spark.sparkContext.broadcast(weights)

        def learn(rows: pa.Table) -> pa.Table:
            order = np.argsort(rows.column("spot").to_numpy())  # a random order, the same on every run
            held = np.frombuffer(b"".join(rows.column("ids").to_pylist()), "<u2").reshape(-1, WINDOW + 1)[order]
            held = held.astype(np.int64)
            wanted = held[:, 1:] < TOKENS
            held[held == TOKENS] = END
            found = attention.train(attention.shaped(start.value), counts.value, held, wanted)
            return pa.table({"learner": [rows.column("learner")[0].as_py()], "n": [len(held)], "w": [attention.flat(found).tobytes()]})

        def average(rows: pa.Table) -> pa.Table:
            n = rows.column("n").to_numpy()
            each = [np.frombuffer(x, np.float32) * np.float32(k / n.sum()) for x, k in zip(rows.column("w").to_pylist(), n)]
            return pa.table({"learner": [0], "n": [int(n.sum())], "w": [np.sum(each, axis=0).tobytes()]})

        mine = taken.where(F.pmod(F.shiftright("spot", 8), F.lit(ROUNDS)) == turn)
        mine = mine.withColumn("learner", F.pmod(F.xxhash64("spot"), F.lit(learners)))
        kind = "learner long, n long, w binary"
        found = mine.groupBy("learner").applyInArrow(learn, kind)
        found = store.put(found, f"learned{turn}")
        some = found.withColumn("learner", F.floor(F.sqrt("learner")))
        some = some.groupBy("learner").applyInArrow(average, kind)
        rows = some.withColumn("learner", F.lit(0).cast("long")).groupBy("learner").applyInArrow(average, kind).collect()
        weights = np.frombuffer(bytes(rows[0]["w"]), np.float32) if rows else weights
        store.drop(f"learned{turn}")
    return weights


def word_counts(ids: DataFrame, vocabulary: str) -> DataFrame:
    """code, n: how often each word (by the hash of its bytes) occurs in the texts of `ids`."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for part in chunks_of_rows(batch, 512):
                held.append(np.unique(word_codes(*unpacked(part.column("ids")), vocabulary)[0], return_counts=True))
                if len(held) == 16:
                    held = [merged(held)]
        code, n = merged(held)
        for at in range(0, len(code), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(code[at : at + 100_000].view(np.int64)), pa.array(n[at : at + 100_000])], names=["code", "n"])

    return ids.select("ids").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
    code = np.concatenate([np.zeros(0, np.uint64), *[c for c, _ in parts]])
    n = np.concatenate([np.zeros(0, np.int64), *[k for _, k in parts]])
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]][: len(code)])
    return (code[first], np.add.reduceat(n, first)) if len(code) else (code, n)


def word_codes(raw: np.ndarray, ends: np.ndarray, vocabulary: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and first byte of each word in the decoded texts."""
    data, ends = decoded(raw, ends, vocabulary)
    start, stop, row = words(data, ends)
    return mix(Prefix(data).spans(start, stop)), row, start


def blended(log: np.ndarray, base: np.ndarray) -> np.ndarray:
    """log10 of the mean of two probabilities, weighted by NETWORK, both given as log10."""
    sure, other = np.log10(NETWORK) + log, np.log10(1 - NETWORK) + base
    high = np.maximum(sure, other)
    return high + np.log10(1 + 10.0 ** (np.minimum(sure, other) - high))


def scores(docs: DataFrame, held_out: Column, vocabulary: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, mixed_score: one row for each of `docs`.

    Reads doc_id and text; `held_out` tells which rows are only scored (null: learned from). `score` is the network's
    log10 probability of the text with A-Z as a-z and words apart by one space, its end included; `mixed_score` blends it
    with the base word by word and is no probability of its own. A null text is empty: its end alone. Rows equal in id and text have equal scores.
    Without training text the network is untrained and the base knows no word. An empty table gives no rows.
    """
    spark = docs.sparkSession
    store = Store(spark, "scores")
    docs = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"), F.xxhash64("doc_id", "text").alias("row_key"))
    ids = store.put(raw_ids(docs, vocabulary), "ids")
    learned = ids.where("NOT held_out")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(1 << 16, np.int64)
        for batch in batches:
            sums += np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), "<u2"), minlength=1 << 16)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(sums)), pa.array(sums[sums > 0])], names=["id", "n"])

    single = learned.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    sums = np.zeros(1 << 16)
    sums[[r["id"] for r in single]] = [r["n"] for r in single]
    subwords = Subwords(sums, vocabulary)
    counts = spark.sparkContext.broadcast(attention.direct(pair_counts(learned, subwords)))
    weights = spark.sparkContext.broadcast(fit(learned, subwords, counts, store))

    vocabulary_counts = store.put(word_counts(learned, vocabulary), "words")
    texts = learned.count()
    total, kinds = vocabulary_counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total, kinds = int(total) + texts, int(kinds) + (texts > 0)
    # The cut is a power of two found from 64 sums, so that no task sorts the words of all others.
    size = F.floor(F.log2("n")).cast("int")
    held = {r["size"]: r["count"] for r in vocabulary_counts.groupBy(size.alias("size")).count().collect()}
    cut = min((b for b in range(64) if sum(n for k, n in held.items() if k >= b) <= FREQUENT), default=63)
    frequent = vocabulary_counts.where(size >= cut).toArrow()  # at most FREQUENT rows
    order = np.argsort(frequent.column("code").to_numpy().view(np.uint64))
    often = spark.sparkContext.broadcast(
        (frequent.column("code").to_numpy().view(np.uint64)[order], frequent.column("n").to_numpy()[order])
    )
    part_of = float(np.log10(total + 0.5 * (kinds + 1)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, (codes, times) = attention.shaped(weights.value), often.value
        for batch in batches:
            for part in chunks_of_rows(batch, 256):
                size = part.num_rows
                raw, ends = unpacked(part.column("ids"))
                found, begins, own = sequences(raw, ends, subwords)
                logs = network_logs(w, counts.value, found, begins)
                end_log = logs[begins[1:] - 1]
                code, row, start = word_codes(raw, ends, vocabulary)
                first = np.cumsum(spelling(vocabulary).sizes[raw]) - spelling(vocabulary).sizes[raw]
                word = np.searchsorted(start - 1, first, side="right") - 1  # the space before a word is its own
                word = np.repeat(word, subwords.ids.sizes[raw])
                word_log = np.bincount(word, weights=logs[own], minlength=len(code)).astype(float)
                at = np.minimum(np.searchsorted(codes, code), max(0, len(codes) - 1))
                hit = codes[at] == code if len(codes) else np.zeros(len(code), bool)
                n = times[at[hit]]
                sums = lambda rows, x: np.bincount(rows, weights=x, minlength=size).astype(float)
                worth, end_worth = np.log10(n + 0.5) - part_of, np.full(size, np.log10(texts + 0.5) - part_of)
                base = sums(row[hit], worth) + end_worth
                mixed = sums(row[hit], blended(word_log[hit], worth)) + blended(end_log, end_worth)
                edges = pa.array(np.r_[0, np.cumsum(np.bincount(row[~hit], minlength=size))].astype(np.int32))
                rare = [pa.ListArray.from_arrays(edges, pa.array(x)) for x in (code[~hit].view(np.int64), word_log[~hit])]
                columns = [part.column(c) for c in ("doc_id", "row_key", "held_out")]
                columns += [pa.array(np.bincount(row, minlength=size) + 1), pa.array(np.bincount(row[hit], minlength=size) + int(texts > 0))]
                columns += [*map(pa.array, (base, mixed, sums(row, word_log) + end_log)), *rare]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, row_key long, held_out boolean, n_tokens long, n_known long, base double, mixed double, "
        "network_score double, rare array<long>, logs array<double>"
    )
    names = [part.split()[0] for part in schema.split(", ")]
    rows = store.put(ids.mapInArrow(score, schema).withColumn("uid", F.monotonically_increasing_id()), "texts")
    store.drop("ids")
    rare = rows.select("uid", F.explode(F.arrays_zip("rare", "logs")).alias("word")).select("uid", "word.*")
    rare = rare.withColumnRenamed("rare", "code").join(vocabulary_counts, "code", "left")
    seen = F.coalesce("n", F.lit(0))
    worth, sure = F.log10(seen + 0.5) - F.lit(part_of), F.col("logs") + float(np.log10(NETWORK))
    other = worth + float(np.log10(1 - NETWORK))
    word = F.greatest(sure, other) + F.log10(1 + F.pow(F.lit(10.0), -F.abs(sure - other)))
    rest = rare.groupBy("uid").agg(
        F.sum(worth).alias("more"), F.sum((seen > 0).cast("long")).alias("known"), F.sum(word).alias("words")
    )
    zero = F.lit(0.0)
    return rows.drop("rare", "logs").join(rest, "uid", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", zero)).alias("base_score"),
        F.col("network_score").alias("score"),
        (F.col("mixed") + F.coalesce("words", zero)).alias("mixed_score"),
    )


def network_logs(w: dict, counts: dict, ids: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """log10 probability of every id after the first of its text, in overlapping windows; 0 for the first."""
    row, first, end = windows(begins, STRIDE)
    fresh = np.r_[True, row[1:] != row[:-1]]
    logs = np.zeros(len(ids))
    for at in range(0, len(row), 256):
        mine = slice(at, at + 256)
        held, wanted = cut(ids, first[mine], end[mine])
        wanted[:, : WINDOW - STRIDE] &= fresh[mine, None]
        found = attention.log_chances(w, counts, held[:, :-1], held[:, 1:], wanted)
        logs[(first[mine, None] + np.arange(1, WINDOW + 1))[wanted]] = found[wanted]
    return logs / np.log(10)
