"""Byte-level BPE encoding and decoding (operator 12).

Two tiers. A minimal perfect hash of the vocabulary finds in one numpy pass all pre-tokens of a chunk that are
tokens as they stand; the bytes under the found place are compared, so that nothing else is taken for one. Each
other pre-token starts as a linked list of its bytes, and a heap gives the pair of neighbours of lowest rank,
leftmost first, until no pair is a token.

Ranks and perfect hash are built once on the driver and sent to all tasks; their size is that of the vocabulary.
Texts stay where they are: no row is shuffled.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain
from operator import methodcaller

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame

from docweave.llm.scoring import Ragged
from docweave.llm.shared import chunks, text_bytes
from docweave.llm.spans import BASE, Prefix, mix

BUCKET_KEYS = 3
TRIES = 512
KNOWN, KNOWN_BYTES = 1 << 18, 64  # merged pre-tokens in each generation that a worker remembers, and the longest of them


def ranks_of(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 text and rank."""
    with open(path, "rb") as file:
        return {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, file)}


class PerfectHash:
    """Distinct 64-bit keys to 0..n-1 without gaps, by a displacement for each small bucket of keys.

    Large buckets are placed first, each by the first displacement that sends its keys to free places. The
    single keys left at the end take the free places directly (a negative displacement names the place).
    """

    def __init__(self, keys: np.ndarray):
        self.n = len(keys)
        self.shift = np.zeros(self.n // BUCKET_KEYS + 1, np.int64)
        bucket = (keys % np.uint64(len(self.shift))).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=len(self.shift))
        starts = np.cumsum(sizes) - sizes
        free = np.ones(self.n, bool)
        for b in np.argsort(-sizes, kind="stable"):
            mine = keys[order[starts[b] : starts[b] + sizes[b]]]
            if len(mine) < 2:
                break
            first = 1
            while True:
                place = self._place(mine[None, :], np.arange(first, first + TRIES)[:, None])
                held = np.sort(place, axis=1)
                good = free[place].all(1) & (held[:, 1:] != held[:, :-1]).all(1)
                if good.any():
                    at = int(np.argmax(good))
                    self.shift[b] = first + at
                    free[place[at]] = False
                    break
                first += TRIES
        self.shift[np.flatnonzero(sizes == 1)] = -1 - np.flatnonzero(free)

    def _place(self, keys: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return (mix(keys + shift.astype(np.uint64) * np.uint64(BASE), 12) % np.uint64(max(1, self.n))).astype(np.int64)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """A place for every key; one that was not built in gets any place."""
        shift = self.shift[(keys % np.uint64(len(self.shift))).astype(np.int64)]
        return np.where(shift < 0, -1 - shift, self._place(keys, shift))


class Vocabulary:
    """Tokens by rank, by bytes and by perfect hash; one for all texts."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.name = ranks, hashlib.sha256(repr(ranks).encode()).hexdigest()
        words, self.ids = list(ranks), np.array(list(ranks.values()), np.int32)
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.r_[0, np.cumsum([len(w) for w in words])].astype(np.int64)
        keys = mix(Prefix(data).spans(ends[:-1], ends[1:]))
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two tokens share a 64-bit hash")
        self.hash = PerfectHash(keys)
        at = np.empty(len(keys), np.int64)
        at[self.hash.places(keys)] = np.arange(len(keys))
        self.keys, self.ids = keys[at], self.ids[at]
        self.words = Ragged([list(words[i]) for i in at], np.uint8)

    def whole(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The id of each span of `data` that is a token, else -1."""
        keys = mix(Prefix(data).spans(start, end))
        place = self.hash.places(keys)
        maybe = np.flatnonzero((self.keys[place] == keys) & (self.words.sizes[place] == end - start))
        size = (end - start)[maybe]
        nth = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        same = data[np.repeat(start[maybe], size) + nth] == self.words.flat[self.words.places(place[maybe])]
        wrong = np.bincount(np.repeat(np.arange(len(maybe)), size), weights=~same, minlength=len(maybe)) > 0
        ids = np.full(len(start), -1, np.int32)
        ids[maybe[~wrong]] = self.ids[place[maybe[~wrong]]]
        return ids

    def merged(self, piece: bytes) -> tuple[int, ...]:
        """Ids of a pre-token that is no token: a heap of pairs over its linked bytes.

        A heap entry is one number made of rank, begin and end of a pair. `after[i]` is where the part that begins at i
        ends; a part that has gone into another ends at n, where no pair begins.
        """
        n, get, push, pop = len(piece), self.ranks.get, heapq.heappush, heapq.heappop
        bits = n.bit_length()
        mask = (1 << bits) - 1
        after, before = [*range(1, n + 1), 0], [*range(-1, n)]
        heap = [(r << bits | i) << bits | i + 2 for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            item = pop(heap)
            end, i = item & mask, item >> bits & mask
            middle = after[i]
            if after[middle] != end:
                continue  # one of its halves has gone into another pair
            after[middle], after[i], before[end] = n, end, i
            if end < n and (r := get(piece[i : after[end]])) is not None:
                push(heap, (r << bits | i) << bits | after[end])
            j = before[i]
            if j >= 0 and (r := get(piece[j:end])) is not None:
                push(heap, (r << bits | j) << bits | end)
        out, i, ranks = [], 0, self.ranks
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return tuple(out)


class Known:
    """Merged pre-tokens in two generations: a full one takes the place of the older, whose entries come back when met."""

    def __init__(self, vocabulary: Vocabulary):
        self.merged, self.new, self.old = vocabulary.merged, {}, {}

    def ids(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        new, out = self.new, []
        for piece in pieces:
            found = new.get(piece)
            if found is None:
                found = self.old.get(piece)
                if found is None:
                    found = self.merged(piece)
                if len(piece) <= KNOWN_BYTES:
                    if len(new) >= KNOWN:
                        self.old, self.new = new, {}
                        new = self.new
                    new[piece] = found
            out.append(found)
        return out


def encoded(vocabulary: Vocabulary, pattern, known: Known, column) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts of an Arrow column, one after the other, and where each text's end."""
    data, ends = text_bytes(column)
    end = methodcaller("end")
    cuts = [np.fromiter(map(end, pattern.finditer(t)), np.int64) if t else np.zeros(0, np.int64) for t in column.to_pylist()]
    heads = np.r_[np.flatnonzero((data & 0xC0) != 0x80), len(data)]  # where each code point begins
    base = np.searchsorted(heads, ends[:-1])
    counts = np.array([len(c) for c in cuts], np.int64)
    stop = heads[np.concatenate([np.zeros(0, np.int64), *cuts]) + np.repeat(base, counts)]
    covered = np.r_[0, stop][np.cumsum(counts)] if len(counts) else ends[1:]
    if (covered[counts > 0] != ends[1:][counts > 0]).any():
        raise ValueError("the pattern leaves a part of a text out")
    start = np.r_[0, stop[:-1]] if len(stop) else stop
    ids = vocabulary.whole(data, start, stop)
    missed = np.flatnonzero(ids < 0)
    blob = data.tobytes()
    found = known.ids([blob[a:b] for a, b in zip(start[missed].tolist(), stop[missed].tolist())])
    size = np.ones(len(ids), np.int64)
    size[missed] = np.fromiter(map(len, found), np.int64, len(found))
    flat = np.repeat(ids, size)
    flat[flat < 0] = np.fromiter(chain.from_iterable(found), np.int32, int(size[missed].sum()))
    return flat, np.r_[0, np.cumsum(size)][np.r_[0, np.cumsum(counts)]]


_known: dict[str, Known] = {}


def known_to(vocabulary: Vocabulary) -> Known:
    """What this worker process remembers of a vocabulary, from one task to the next."""
    if vocabulary.name not in _known:
        _known.clear()
        _known[vocabulary.name] = Known(vocabulary)
    return _known[vocabulary.name]


@functools.lru_cache(maxsize=2)
def vocabulary_of(path: str) -> Vocabulary:
    return Vocabulary(ranks_of(path))


def encode(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, ids (array<int>): one row for each of `docs`, in place.

    Reads doc_id and text, other columns are ignored. `ranks` is the path of a vocabulary file that holds all single
    bytes; `pattern` cuts a text into pre-tokens and has to cover every text. Special tokens are ordinary text. A null
    or empty text has no ids; repeated rows are encoded each; an empty table gives no rows. Texts of any length are
    encoded as a whole; equal ranks cannot occur, and of equal pairs the left one merges first.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary_of(ranks))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        matcher, known = regex.compile(pattern), known_to(sent.value)
        for batch in batches:
            for rows in chunks(batch, "text"):
                flat, ends = encoded(sent.value, matcher, known, rows.column("text"))
                ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), ids], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(rows: DataFrame, ranks: str) -> DataFrame:
    """doc_id, ids, decoded (binary): the bytes that the ids of each row stand for.

    Null or empty ids give empty bytes. An id outside the vocabulary stops the job, as nothing stands for it.
    """
    sent = rows.sparkSession.sparkContext.broadcast(ranks_of(ranks))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = [b""] * (max(sent.value.values(), default=-1) + 1)
        for word, rank in sent.value.items():
            words[rank] = word
        spelled = Ragged([list(w) for w in words], np.uint8)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                lists = part.column("ids")
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                if len(flat) and (flat.min() < 0 or flat.max() >= len(words) or not spelled.sizes[flat].all()):
                    raise ValueError("an id outside the vocabulary")
                sizes = np.array([0 if n is None else n for n in pa.compute.list_value_length(lists).to_pylist()], np.int64)
                spelt = spelled.flat[spelled.places(flat)] if len(flat) else np.zeros(0, np.uint8)
                ends = np.r_[0, np.cumsum(spelled.sizes[flat])][np.r_[0, np.cumsum(sizes)]]
                blob = spelt.tobytes()
                texts = [blob[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, pa.array(texts, pa.binary())], names=["doc_id", "ids", "decoded"])

    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded binary")
