"""Byte-level BPE, spelling variants and hard negatives against plain Python."""

import collections
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import functions as F

from compare import compare
from docweave.llm import bpe, rtree, variants
from docweave.llm.queries import ORACLES, QUERIES

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
FOLDER = "/root/testdata/sf0.001"


def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.ranks_of(RANKS), special_tokens={})


def test_perfect_hash():
    for n in (0, 1, 2, 7, 5000):
        keys = np.unique(np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64))
        assert sorted(bpe.PerfectHash(keys).places(keys).tolist()) == list(range(len(keys)))


def test_ids_are_the_library_s():
    pick, vocabulary = random.Random(6), bpe.Vocabulary(bpe.ranks_of(RANKS))
    letters = ["a", "e", "th", "ing", "'s", "'ll", " ", "  ", "\n", "\t", "1", "23", "é", "गाय", "中", "\U0001F600", "!", "...", "\x00", "\x1c", "\xa0", "<|endoftext|>"]
    texts = ["".join(pick.choices(letters, k=pick.randrange(60))) for _ in range(2000)]
    texts += ["a" * 3000, "ab" * 2000, "é" * 999, " " * 500, "zqxj" * 300 + "\n", None, ""]
    flat, ends = bpe.encoded(vocabulary, regex.compile(PATTERN), bpe.Known(vocabulary), pa.array(texts, pa.string()))
    model = library()
    for text, a, b in zip(texts, ends[:-1], ends[1:]):
        assert flat[a:b].tolist() == model.encode_ordinary(text or "")


def test_what_is_remembered_does_not_matter(monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN", 3)
    vocabulary, texts = bpe.Vocabulary(bpe.ranks_of(RANKS)), pa.array(["qwrtz plmok zuhbg qwrtz ijnuhb okmtfc " * 5])
    flat, _ = bpe.encoded(vocabulary, regex.compile(PATTERN), bpe.Known(vocabulary), texts)
    assert flat.tolist() == library().encode_ordinary(texts[0].as_py())


def test_encode_and_decode(spark, odd, none):
    model = library()
    rows = bpe.decode(bpe.encode(odd, RANKS, PATTERN), RANKS).collect()
    expected = [(r.doc_id, model.encode_ordinary(r.text or ""), (r.text or "").encode()) for r in odd.collect()]
    assert sorted(((r.doc_id, r.ids, bytes(r.decoded)) for r in rows), key=str) == sorted(expected, key=str)
    assert bpe.encode(none, RANKS, PATTERN).collect() == []
    bare = spark.createDataFrame([(1, None), (2, []), (3, [15496])], "doc_id long, ids array<int>")
    assert [bytes(r.decoded) for r in bpe.decode(bare, RANKS).orderBy("doc_id").collect()] == [b"", b"", b"Hello"]


def test_unknown_ids_stop(spark):
    rows = spark.createDataFrame([(1, [50256])], "doc_id long, ids array<int>")
    try:
        bpe.decode(rows, RANKS).collect()
    except Exception as error:
        assert "outside the vocabulary" in str(error)
    else:
        raise AssertionError("it was decoded")


def test_encoding_query(spark):
    import hashlib

    model = library()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    digest = lambda data: hashlib.sha256(data).hexdigest()
    for r in QUERIES["op12_bpe"](spark, FOLDER).collect():
        ids = model.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), digest(" ".join(map(str, ids)).encode()), digest(texts[r.doc_id].encode()))


def plain_variants(rows, shortest=7, least=2, times=10, spoil=31):
    counts, lower = collections.Counter(), str.maketrans(variants.UPPER, variants.LOWER)
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            code = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and code % spoil == 0:
                run = run[: code % len(run)] + run[code % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= shortest and n >= least}

    def one_edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and one_edit(w, v)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= times * words[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted(((w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()), key=str)


def test_variants(spark, odd, none):
    pick = random.Random(7)
    stems = ["letters", "letterss", "lettters", "aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "bananas", "banañas", "Ümlauts", "abababa", "bababab"]
    docs = []
    for i in range(300):
        words = [pick.choice(stems) if pick.random() < 0.8 else "".join(pick.choices("ab", k=pick.randrange(7, 9))) for _ in range(40)]
        words += ["letters"] * (i % 3 * 30)
        docs.append((i, pick.choice([" ", ", ", "1"]).join(words)))
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    frame = spark.createDataFrame([*docs, *rows], "doc_id long, text string").withColumn("word", F.lit(1)).withColumn("n", F.lit("x"))
    expected = plain_variants([*docs, *rows])
    assert any(r[1] for r in expected) and any(r[2] != (r[1] or r[0]) for r in expected)
    for limit in (10_000, 20, 1):
        found = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in variants.variants(frame, limit=limit).collect()]
        assert sorted(found, key=str) == expected
    assert variants.variants(none).collect() == [] and variants.variants(odd.where("doc_id = 3")).collect() == []


def test_composition_finds_each_pair_once():
    pick = random.Random(8)
    words = sorted({"".join(pick.choices("abc", k=pick.randrange(0, 6))) for _ in range(250)})
    found = [tuple(sorted(p)) for p in variants.Composed(variants.Acceptor(words)).pairs()]
    near = lambda a, b: (len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1) or (
        abs(len(a) - len(b)) == 1 and any(max(a, b, key=len)[:k] + max(a, b, key=len)[k + 1 :] == min(a, b, key=len) for k in range(6)))
    assert len(found) == len(set(found))
    assert set(found) == {(a, b) for a in words for b in words if a < b and near(a, b)}
    small = variants.Acceptor(["taps", "tops", "xaps", "xops"])
    assert len(small.final) == 5  # minimal: t and x, a and o share what follows


def test_long_words(spark):
    long = "".join(random.Random(9).choices("abcdefgh", k=20_000))
    docs = [(1, f"{long} {long} {long}x {long}x y{long[1:]} y{long[1:]}")]
    rows = {len(r.word) * 10 + (r.word[0] == "y"): r.n_near for r in variants.variants(spark.createDataFrame(docs, "doc_id long, text string"), spoil=1 << 40).collect()}
    assert rows == {200_000: 2, 200_010: 1, 200_001: 1}


def plain_negatives(rows, every=50, positives=5, negatives=3):
    rows = sorted({(i, l, tuple(v)) for i, l, v in rows})
    out = []
    for i, label, vector in rows:
        if i % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(vector, v)), j, l) for j, l, v in rows if j != i)
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            fit = [(n, t) for t, n, l in scored if l != label and 50 * -s <= 100 * -t <= 95 * -s][:negatives]
            out += [(i, p, rank + 1, n, -s, -t) for rank, (n, t) in enumerate(fit)]
    return sorted(out)


def test_hard_negatives(spark):
    random_ = np.random.default_rng(11)
    rows = [(i, int(random_.integers(0, 4)), random_.integers(-9, 12, 6).tolist()) for i in range(500)]
    rows += [(1000 + i, 1 + i % 2, [5, 4, 3, 2, 1, 0]) for i in range(150)] + [(1000, 1, [5, 4, 3, 2, 1, 0])] * 3  # copies and ties
    rows += [(3000 + 50 * i, 9, [7, 7, 7, 7, 7, i]) for i in range(2)] + [(3300, 8, [0] * 6), (3350, 8, [0] * 6), (4001, 7, [0] * 6)]
    bad = [(5000, None, [1] * 6), (5050, 1, None), (5100, 1, [None] + [1] * 5), (None, 1, [1] * 6), (5150, 1, [1])]
    kind = "vec_id long, label int, vector array<long>, entry int, slot string, shard int"
    frame = spark.createDataFrame([(*r, 1, "s", 2) for r in [*rows, *bad]], kind)
    expected = plain_negatives(rows)
    assert len(expected) > 50
    for options in ({}, {"shard_rows": 60, "block": 3}):
        found = rtree.hard_negatives(frame, F.col("vec_id") % 50 == 0, **options).collect()
        assert sorted(tuple(r) for r in found) == expected
        assert found[0].asDict().keys() == {"anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"}
    one = frame.where("label = 1")
    assert rtree.hard_negatives(one, F.col("vec_id") % 50 == 0).collect() == []
    assert rtree.hard_negatives(frame.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def test_rows_that_share_an_id(spark):
    rows = [(50, 1, [3, 0]), (50, 1, [2, 1]), (7, 1, [4, 0]), (8, 2, [2, 0]), (9, 2, [3, 3])]
    found = rtree.hard_negatives(spark.createDataFrame(rows, "vec_id long, label int, vector array<long>"), F.col("vec_id") == 50).collect()
    assert sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in found) == [
        (50, 7, 1, 8, 8, 4), (50, 7, 1, 9, 12, 9), (50, 7, 2, 8, 12, 6)]


def test_tree_prunes_and_keeps_ties():
    random_ = np.random.default_rng(12)
    centres = random_.integers(-300, 300, (40, 5))
    points = np.concatenate([c + random_.integers(-3, 4, (50, 5)) for c in centres])
    tree = rtree.Tree(points, np.zeros(len(points), np.int64), leaf=16, fanout=4)
    assert sorted(tree.order.tolist()) == list(range(len(points)))
    least, most = rtree.bounds(points[:1], tree.low, tree.high)
    for node in range(tree.leaves):
        score = tree.points[slice(*tree.below[node])] @ points[0]
        assert least[0, node] <= score.min() and score.max() <= most[0, node]
    opened = sum(most[0, : tree.leaves] >= np.sort(points @ points[0])[-5])
    assert opened < tree.leaves / 3


def test_queries_against_sql(spark):
    for name in ("op11_variants", "op13_negatives"):
        assert compare(spark, FOLDER, QUERIES[name], ORACLES[name]) is None
