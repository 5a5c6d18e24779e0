"""Language-model scores, the quality classifier and nearest neighbours."""

import collections
import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from docweave.llm import attention, forest, quality, scoring
from docweave.llm.queries import vocabulary


def test_gradients():
    random_ = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in attention.fresh().items()}
    for k in ("class", "member", "bias"):
        w[k] = random_.standard_normal(w[k].shape) * 0.3
    pairs = random_.poisson(0.01, (attention.TOKENS, attention.TOKENS)).astype(float)
    counts = {k: v.astype(float) for k, v in attention.direct(pairs).items()}
    ids = random_.integers(0, attention.TOKENS, (3, attention.WINDOW + 1))
    wanted = random_.random((3, attention.WINDOW)) < 0.8
    loss = lambda: -attention.log_chances(w, counts, ids[:, :-1], ids[:, 1:], wanted).sum() / wanted.sum()
    g, found = attention.gradients(w, counts, ids[:, :-1], ids[:, 1:], wanted)
    assert abs(found - loss()) < 1e-9
    for k in w:
        at = (ids[0, 1], 3) if k == "token" else tuple(random_.integers(0, s) for s in w[k].shape)
        kept, step = w[k][at], 1e-5
        w[k][at] = kept + step
        up = loss()
        w[k][at] = kept - step
        down = loss()
        w[k][at] = kept
        assert abs((up - down) / (2 * step) - g[k][at]) < 1e-6


def test_training_uses_its_arrays_again_and_is_adam():
    """Gradients go into the arrays given, whatever these hold; a pass of training follows Adam's formula with them."""
    random_ = np.random.default_rng(6)
    counts = attention.direct(random_.poisson(0.01, (attention.TOKENS, attention.TOKENS)))
    held = random_.integers(0, 500, (80, attention.WINDOW + 1))  # no member of the higher classes
    wanted = random_.random((80, attention.WINDOW)) < 0.8
    wanted[64:] = False  # a batch without any wanted token
    w = attention.fresh()
    kept = attention.flat(w).copy()
    mean, square = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    g = {k: np.full_like(v, np.nan) for k, v in w.items()}
    for t in range(3):
        part, use = held[t * 32 : (t + 1) * 32], wanted[t * 32 : (t + 1) * 32]
        found, loss = attention.gradients(w, counts, part[:, :-1], part[:, 1:], use, g)
        again, same = attention.gradients(w, counts, part[:, :-1], part[:, 1:], use)
        assert found is g and loss == same and all((g[k] == again[k]).all() for k in w)
        for k in w:
            mean[k] += 0.1 * (g[k] - mean[k])
            square[k] += 0.01 * (g[k] ** 2 - square[k])
            step = mean[k] / (1 - 0.9 ** (t + 1)) / (np.sqrt(square[k] / (1 - 0.99 ** (t + 1))) + 1e-8)
            w[k] = w[k] - np.float32(0.003 * (t + 1) / 20 * (1 - 0.3 * t)) * step
    learned = attention.train(attention.shaped(kept), counts, held, wanted)
    assert (kept == attention.flat(attention.fresh())).all()  # weights given stay as they are
    assert np.abs(attention.flat(learned) - attention.flat(w)).max() < 1e-5 < np.abs(attention.flat(learned) - kept).max()


def test_probabilities_sum_to_one():
    w = attention.fresh(3)
    counts = attention.direct(np.zeros((attention.TOKENS, attention.TOKENS)))
    ids = np.random.default_rng(1).integers(0, attention.TOKENS, (1, attention.WINDOW))
    wanted = np.zeros((1, attention.WINDOW), bool)
    wanted[0, -1] = True
    every = np.repeat(ids, attention.TOKENS, 0)
    nexts = every.copy()
    nexts[:, -1] = np.arange(attention.TOKENS)
    logs = attention.log_chances(w, counts, every, nexts, np.repeat(wanted, attention.TOKENS, 0)).sum(1)
    assert abs(np.exp(logs).sum() - 1) < 1e-3


def test_each_id_is_scored_once():
    for sizes in ([1], [2, 40], [33, 34, 100, 1]):
        begins = np.r_[0, np.cumsum([n + 1 for n in sizes])]
        row, first, end = scoring.windows(begins, scoring.STRIDE)
        fresh = np.r_[True, row[1:] != row[:-1]]
        times = np.zeros(begins[-1], int)
        for r, f, e, new in zip(row, first, end, fresh):
            skip = 0 if new else scoring.WINDOW - scoring.STRIDE
            times[f + 1 + skip : min(f + 1 + scoring.WINDOW, e)] += 1
        assert times.tolist() == [int(n not in begins) for n in range(begins[-1])]


def test_scores(spark, odd, none):
    pick = random.Random(1)
    words = ["the", "of", "and", "river", "stone", "walked", "Blue", "seven,"]
    docs = [(i, " ".join(pick.choices(words, [9, 7, 7, 3, 3, 2, 2, 1], k=pick.randrange(5, 60)))) for i in range(120)]
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    frame = spark.createDataFrame([*docs, *rows], "doc_id long, text string")
    found = scoring.scores(frame, F.col("doc_id") % 5 == 1, vocabulary()).collect()
    counts, held = collections.Counter(), []
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    for i, t in [*docs, *rows]:
        tokens = [*split(t), None]
        held.append((i, t, tokens))
        if i is None or i % 5 != 1:
            counts.update(tokens)
    total = sum(counts.values())
    expected = collections.Counter()
    for i, t, tokens in held:
        base = sum(math.log10((counts[x] + 0.5) / (total + 0.5 * (len(counts) + 1))) for x in tokens)
        expected[i, len(tokens), sum(counts[x] > 0 for x in tokens), round(base, 6)] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in found) == expected
    assert {r.train_tokens for r in found} == {total}
    assert all(math.isfinite(r.score) and r.score < 0 for r in found)
    assert all(r.mixed_score >= r.base_score + r.n_tokens * math.log10(0.5) - 1e-6 for r in found)
    out = [r for r in found if r.held_out and r.n_tokens > 4]
    assert sum(r.mixed_score for r in out) > sum(r.base_score for r in out)
    assert scoring.scores(none, F.lit(False), vocabulary()).collect() == []


def test_network_alone_beats_the_base(spark):
    pick = random.Random(2)
    words = ["one", "two", "three", "four", "five", "six", "seven", "eight"]
    docs = [(i, " ".join(words[(at + k) % 8] for k in range(pick.randrange(20, 60)))) for i in range(200) for at in [pick.randrange(8)]]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    out = scoring.scores(frame, F.col("doc_id") % 5 == 1, vocabulary()).where("held_out").collect()
    assert len(out) == 40 and all(r.score < 0 for r in out)
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_score_is_the_chain_rule_sum(spark):
    """The network's probabilities of one text, taken window by window with the learned weights, add up to its score."""
    docs = [(i, f"one two three four five {i % 3}") for i in range(60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r.doc_id: r for r in scoring.scores(frame, F.col("doc_id") % 5 == 1, vocabulary()).collect()}
    assert found[1].score == found[4].score != found[2].score  # equal texts
    longer = spark.createDataFrame([*docs, (100, "one two three four five 1 one two three four five 1")], "doc_id long, text string")
    both = {r.doc_id: r for r in scoring.scores(longer, F.col("doc_id") % 5 != 9, vocabulary()).collect()}
    assert both[100].score < both[1].score < 0 and both[100].n_tokens == 13


def test_equal_windows_score_equal_in_any_company():
    """Bit for bit, whatever the number of windows in a batch and the place of the window in it."""
    random = np.random.default_rng(4)
    weights = attention.fresh()
    for k in ("class", "member"):
        weights[k] = random.standard_normal(weights[k].shape).astype(np.float32)
    counts = attention.direct(random.integers(0, 3, (attention.TOKENS, attention.TOKENS)))
    one = random.integers(0, attention.TOKENS, attention.WINDOW + 1)
    found = set()
    for n in (1, 2, 3, 5, 17, 100, 255, 256):
        held = random.integers(0, attention.TOKENS, (n, attention.WINDOW + 1))
        wanted = random.random((n, attention.WINDOW)) < 0.8
        at = random.integers(n)
        held[at], wanted[at] = one, True
        found.add(attention.log_chances(weights, counts, held[:, :-1], held[:, 1:], wanted)[at].tobytes())
    assert len(found) == 1


def test_all_windows_are_learned_from(spark):
    ids = spark.range(9000).select(F.xxhash64("id").alias("row_key"), F.unhex(F.lit("05000600")).alias("ids"))
    long = spark.range(1).select(F.lit(1).cast("long").alias("row_key"), F.unhex(F.repeat(F.lit("0700"), F.lit(3199))).alias("ids"))
    seen = np.zeros(1 << 16)
    seen[5:8] = 1
    subwords = scoring.Subwords(seen, vocabulary())
    counts = spark.sparkContext.broadcast(attention.direct(np.zeros((attention.TOKENS, attention.TOKENS))))
    store = scoring.Store(spark, "test")
    per_id = int(subwords.ids.sizes[7])
    weights = scoring.fit(ids.union(long), subwords, counts, store)
    windows = store.get("windows")
    assert windows.count() == 9000 + -(-(3199 * per_id + 1) // attention.WINDOW)
    assert windows.select("spot").distinct().count() == windows.count()
    assert np.isfinite(weights).all() and (attention.shaped(weights)["class"] != 0).any()
    assert attention.WINDOW - scoring.STRIDE >= 6


def test_classifier(spark, odd, none):
    pick = random.Random(3)
    docs, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        text = " ".join(pick.choice(["tree", "lake", "walks", "under", "a", "the"]) + ("!!" if bad else "") for _ in range(pick.randrange(8, 60)))
        docs.append((i, text, "x"))
        if i % 2 == 0 or i % 3 == 0:
            labels.append((i, 0 if bad else 1, 0))
    frame = spark.createDataFrame(docs, "doc_id long, text string, extra string")
    known = spark.createDataFrame([*labels, (None, 1, None), (9999, None, 1)], "doc_id long, quality int, toxic int")
    rows = quality.classify(frame, known).collect()
    assert len(rows) == 400 and sum(r.kept == (r.doc_id % 5 > 0) for r in rows) >= 390
    assert quality.classify(frame, known.limit(0)).where("kept").count() == 400
    assert quality.classify(none, known).collect() == []
    found = quality.classify(odd, known)
    assert found.columns == [*odd.columns, "log_ratio", "kept"] and found.count() == odd.count()


def test_classifier_by_plain_python(spark):
    """Ratios from counts of words and neighbouring words; the drawn rows are those of the largest noisy ratios."""
    pick = random.Random(12)
    docs = [(i, " ".join(pick.choice(["tree", "lake", "walks"] + ["spam", "buy"] * (i % 3 == 0)) for _ in range(pick.randrange(0, 30)))) for i in range(200)]
    labels = [(i, int(i % 3 > 0), 0) for i in range(0, 200, 2)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = quality.classify(frame, known).select("*", quality.gumbel().alias("noise")).collect()
    fits = {r.doc_id: r.fit for r in known.select("doc_id", (F.pmod(F.xxhash64(F.lit(4), "doc_id"), F.lit(5)) > 0).alias("fit")).collect()}
    grams = lambda t: [(w,) for w in t.split()] + list(zip(t.split(), t.split()[1:]))
    raw = collections.Counter(g for _, t in docs for g in grams(t))
    target = collections.Counter(g for i, t in docs if i % 2 == 0 and i % 3 > 0 and fits[i] for g in grams(t))
    n_raw, n_target = sum(raw.values()), sum(target.values())
    expected = {g: n * n_target / n_raw for g, n in raw.items()}
    smooth = {g: (target[g] + quality.PRIOR) / (expected[g] + quality.PRIOR) for g in raw}
    norm = sum(raw[g] / n_raw * smooth[g] for g in raw)
    ratio = {i: sum(math.log(smooth[g] / norm) for g in grams(t)) for i, t in docs}
    assert len(rows) == 200 and all(abs(r.log_ratio - ratio[r.doc_id]) < 1e-6 for r in rows)
    held = [i for i, _, _ in labels if not fits[i]]
    cut = quality.best_cut(np.array([ratio[i] for i in held]), np.array([i % 3 > 0 for i in held]))
    k = sum(x >= cut for x in ratio.values())
    order = sorted(rows, key=lambda r: -(r.log_ratio + quality.TEMPERATURE * r.noise))
    assert {r.doc_id for r in rows if r.kept} == {r.doc_id for r in order[:k]} and 0 < k < 200


def test_kept_share_falls_with_the_ratio(spark):
    """Texts of a few words differ by few units: the draw takes more of the better ones, but not only those."""
    pick = random.Random(5)
    docs = [(i, " ".join(pick.choice(["oak", "elm", "ash"] if pick.random() < (0.35 if i % 2 else 0.65) else ["bad", "ill", "low"]) for _ in range(4))) for i in range(4000)]
    labels = [(i, i % 2 ^ 1, 0) for i in range(4000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    rows = sorted(quality.classify(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect(), key=lambda r: r.log_ratio)
    shares = [np.mean([r.kept for r in rows[k : k + 1000]]) for k in range(0, 4000, 1000)]
    assert shares == sorted(shares) and shares[0] < shares[3] and sum(0.02 < x < 0.98 for x in shares) >= 2


def test_toxic_documents_go(spark):
    pick = random.Random(4)
    docs, labels = [], []
    for i in range(600):
        words = [pick.choice(["tree", "lake", "walks", "under", "a", "the", "hill", "green"]) for _ in range(pick.choice([12, 40, 900]))]
        if i % 6 == 0:
            words[pick.randrange(len(words))] = pick.choice(["scumbag", "filth"])
        docs.append((i, " ".join(words)))
        if i % 4 < 2:
            labels.append((i, 1, int(i % 6 == 0)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    rows = quality.classify(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(rows) == 600 and not any(r.kept for r in rows if r.doc_id % 6 == 0)
    assert sum(r.kept for r in rows if r.doc_id % 6) >= 250
    assert sum(r.kept for r in rows) > 0


def test_kth_largest(spark):
    values = [0.5, 0.5, 0.5, 1.0, -3.0, 2.25, 2.25, 1e-9]
    rows = spark.createDataFrame([(v,) for v in values], "x double")
    assert [quality.kth_largest(rows, "x", k + 1) for k in range(8)] == sorted(values, reverse=True)


def test_nearest(spark):
    random_ = np.random.default_rng(5)
    points = [(i, random_.standard_normal(16).astype(float).tolist()) for i in range(700)]
    points += [(1000 + i, points[3][1]) for i in range(60)] + [(2000, points[3][1])]
    bad = [(3000, None), (3001, [0.0] * 16), (3002, [None] + [1.0] * 15), (3003, [float("nan")] * 16), (3004, [float("inf")] * 16), (3005, [1.0]), (None, [1.0] * 16)]
    frame = spark.createDataFrame([*points, *bad], "vec_id long, embedding array<double>")
    rows = forest.nearest(frame, frame.where("vec_id % 20 = 0"), shard_rows=150).collect()
    held = np.array([v for _, v in points])
    ids = np.array([i for i, _ in points])
    found = collections.defaultdict(list)
    for r in rows:
        found[r.query_id].append(r)
    assert set(found) == {int(i) for i in ids if i % 20 == 0}
    hits = 0
    for query, near in found.items():
        near = sorted(near, key=lambda r: r["rank"])
        assert [r["rank"] for r in near] == list(range(1, 21)) and query not in {r.vec_id for r in near}
        assert [(-r.score, r.vec_id) for r in near] == sorted((-r.score, r.vec_id) for r in near)
        score = held @ held[ids.tolist().index(query)]
        score[ids == query] = -np.inf
        best = np.lexsort((ids, -np.round(score, 9)))[:20]
        hits += len({r.vec_id for r in near} & set(ids[best].tolist()))
    assert hits / (20 * len(found)) >= 0.9
    copies = sorted(found[1000], key=lambda r: r["rank"])
    assert [r.vec_id for r in copies] == [3, *range(1001, 1020)]
    few = frame.where("vec_id < 5")
    assert forest.nearest(few, few.where("vec_id = 0")).count() == 4
    assert forest.nearest(frame.limit(0), frame.limit(0)).collect() == []
