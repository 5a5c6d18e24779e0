"""Operators on keys that hold a third of all rows, against plain Python."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from docweave.operators import chunking, dedup, embedding, history, search, skew, store
from docweave.operators.embedding import BUILTIN


def hot(n, seed=1):
    """(id, key): a third of the rows share one key."""
    pick = random.Random(seed)
    return [(i, "hot" if i % 3 == 0 else f"k{pick.randint(0, n // 4)}") for i in range(n)]


def test_key_facts_and_attach(spark):
    rows = hot(3000)
    frame = spark.createDataFrame(rows, "id bigint, key string")
    found = skew.with_key_facts(
        frame, ["key"], ["id"], {"least": (F.min("id"), F.min), "n": (F.count("*"), F.sum)}
    ).collect()
    groups = defaultdict(list)
    for i, key in rows:
        groups[key].append(i)
    assert len(found) == len(rows)
    assert all((r.least, r.n) == (min(groups[r.key]), len(groups[r.key])) for r in found)
    facts = spark.createDataFrame([(k, k.upper()) for k in groups if k != "k1"], "key string, big string")
    left = skew.attach(frame, facts, ["key"], ["id"], "left").collect()
    assert len(left) == len(rows)
    assert all(r.big == (None if r.key == "k1" else r.key.upper()) for r in left)


def test_keep_only_in_every_form(spark):
    rows = spark.createDataFrame([(i, f"k{i}") for i in range(60)], "id int, key string")
    for cut in (10, 30, 50):
        wanted = rows.where(f"id < {cut}").select("key")
        unwanted = rows.where(f"id >= {cut}").select("key")
        for limit in (5, 20, 100):
            kept = skew.keep_only(rows, wanted, unwanted, "key", limit).collect()
            assert sorted(r.id for r in kept) == list(range(cut))


def test_canonical_names(spark):
    rows = [(f"f{i}" + "x" * (i % 4), key) for i, key in hot(900)] + [("lost1", None), ("lost2", None)]
    found = dedup.canonical_names(spark.createDataFrame(rows, "name string, h string"), "h").collect()
    groups = defaultdict(list)
    for name, h in rows:
        groups[h or name].append(name)
    assert all(r.canonical == min(groups[r.h or r.name], key=lambda n: (len(n), n)) for r in found)


def test_content_status_does_not_depend_on_order(spark):
    """One by one in random order, demoting twins, ends with the minimum of each content."""
    rows = [(f"f{i}", key) for i, key in hot(60)]
    random.Random(5).shuffle(rows)
    status = {}
    for name, h in rows:
        twin = next((n for n, (s, k) in status.items() if s == "ok" and k == h), None)
        better = twin is None or (len(name), name) < (len(twin), twin)
        if twin and better:
            status[twin] = ("duplicate", h)
        status[name] = ("ok" if better else "duplicate", h)
    frame = spark.createDataFrame(rows, "filename string, content_hash string")
    assert {r.filename: r.status for r in dedup.content_status(frame).collect()} == {
        n: s for n, (s, _) in status.items()
    }


def test_running_sums_and_look_back_with_gaps(spark):
    pick = random.Random(9)
    turns = {"hot": sorted(pick.sample(range(40000), 700)), "small": [3, 9, 70000], "one": [5]}
    rows = [(k, t, f"{k}{t}") for k, ts in turns.items() for t in ts]
    frame = spark.createDataFrame(rows, "key string, turn bigint, text string")
    found = skew.last_rows_before(frame, ["key"], "turn", 6, F.col("text"), "before", width=32).collect()
    assert len(found) == len(rows)
    for r in found:
        at = turns[r.key].index(r.turn)
        assert r.before == [f"{r.key}{t}" for t in turns[r.key][max(0, at - 6) : at]]
    sums = skew.running_before(frame, ["key"], "turn", F.col("turn"), "total", 1000).collect()
    assert all(r.total == sum(t for t in turns[r.key] if t < r.turn) for r in sums)


def test_page_lookup_on_long_documents(spark):
    pick = random.Random(2)
    pages = [("long", n, pick.randint(0, 9000)) for n in range(1, 200)] + [("short", 4, 10)]
    frame = spark.createDataFrame(pages, "doc string, number bigint, n_chars bigint")
    index = chunking.page_index(frame, width=16)
    starts, at = {}, 0
    for doc, number, size in pages[:-1]:
        starts[number] = at
        at += size + 2
    assert {r.number: r.start_offset for r in index.where("doc = 'long'").collect()} == starts
    offsets = sorted(pick.sample(range(at), 500))
    wanted = spark.createDataFrame([("long", o) for o in offsets] + [("short", 0)], "doc string, offset bigint")
    found = {(r.doc, r.offset): r.number for r in chunking.page_lookup(index, wanted).collect()}
    assert found.pop(("short", 0)) == 4
    assert found == {("long", o): max(n for n, s in starts.items() if s <= o) for o in offsets}


def test_top_k_both_forms_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    vectors = rng.integers(-2, 3, size=(900, 6)).astype(float)  # many equal scores and some zero vectors
    asked = rng.integers(-2, 3, size=(7, 6)).astype(float)
    corpus = spark.createDataFrame(
        [(i, v.tolist(), f"s{i % 3}") for i, v in enumerate(vectors)], "id bigint, vector array<float>, source string"
    ).repartition(5)
    questions = spark.createDataFrame(
        [(q, v.tolist(), None if q % 2 else "s1") for q, v in enumerate(asked)],
        "qid int, vector array<double>, source_filter string",
    )

    def unit(m):
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, n, out=np.zeros_like(m), where=n > 0)

    scores = np.round(unit(asked) @ unit(vectors).T, 8)
    for floor in (0.0, 0.6):
        expected = []
        for q in range(len(asked)):
            usable = [
                (-scores[q, i], i)
                for i in range(len(vectors))
                if (q % 2 or i % 3 == 1) and (floor == 0 or scores[q, i] >= floor)
            ]
            expected += [(q, i, r, -s) for r, (s, i) in enumerate(sorted(usable)[:20], 1)]
        for sent in (10**6, 0):
            found = search.top_k(questions, corpus, 6, 20, floor, sent_values=sent).collect()
            assert sorted((r.qid, r.id, r["rank"], r.score) for r in found) == sorted(expected)


def test_best_k_of_blocks_equals_brute_force(monkeypatch):
    """Ties, zero and unsound vectors, floors and sources over many small blocks; few pairs are scored in double precision."""
    for name, value in (("BLOCK_QUESTIONS", 4), ("BLOCK_PAIRS", 3), ("HELD_IDS", 5)):
        monkeypatch.setattr(search, name, value)
    rng = np.random.default_rng(6)
    vectors, asked = (rng.integers(-1, 2, size=(n, 5)).astype(float) for n in (700, 30))
    vectors[11, 2] = np.nan
    norms = [np.linalg.norm(m, axis=1, keepdims=True) for m in (vectors, asked)]
    vectors, asked = (np.divide(m, n, out=np.zeros_like(m), where=n > 0) for m, n in zip((vectors, asked), norms))
    vectors[11] = np.nan
    of, allowed = [f"s{i % 3}" for i in range(700)], [None if q % 2 else "s1" for q in range(30)]
    scores = np.rint(asked @ vectors.T * search.SCALE)
    for floor in (0.0, 0.7):
        running = search._Running(asked, allowed, 9, floor)
        for at in range(0, 700, 50):
            running.add(vectors[at : at + 50], pa.array(range(at, at + 50)), of[at : at + 50])
        found = pa.Table.from_batches(running.rows(list(range(30)), pa.schema([("qid", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])))
        expected = []
        for q in range(30):
            usable = [i for i in range(700) if i != 11 and (q % 2 or i % 3 == 1) and (not floor or scores[q, i] >= floor * search.SCALE)]
            expected += [(q, i) for i in sorted(usable, key=lambda i: (-scores[q, i], i))[:9]]
        assert sorted(zip(found["qid"].to_pylist(), found["id"].to_pylist())) == sorted(expected)


def test_large_batch_is_searched_once(spark, monkeypatch):
    """The join of the payload reads the results of the search twice; the search itself is not in its plan."""
    monkeypatch.setattr(search, "SENT_ROWS", 0)
    corpus = spark.range(50).select("id", F.array(F.lit(1.0), F.col("id") % 7.0).alias("vector"), F.lit("x").alias("text"))
    asked = spark.range(5000).select(F.col("id").alias("qid"), F.array(F.lit(1.0), F.col("id") % 5.0).alias("vector"))
    found = search.search(asked, corpus, 2, 3, sent_values=0)
    assert found.count() == 15_000
    assert "InArrow" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_embedding_each_text_once(spark):
    rows = [(i, "hot text" if i % 3 == 0 else f"text {i % 50}") for i in range(400)]
    texts = spark.createDataFrame(rows, "id bigint, text string")
    cache = embedding.new_entries(texts.where("id % 3 = 0"), None, BUILTIN)
    assert cache.count() == 1
    fresh = embedding.new_entries(texts, cache, BUILTIN)
    assert fresh.count() == len({t for i, t in rows}) - 1
    done = embedding.embed_rows(texts, ["id"], BUILTIN, cache)
    expected = {r.text: r.v for r in texts.select("text", BUILTIN.embed("text").alias("v")).distinct().collect()}
    got = done.collect()
    assert len(got) == len(rows) and all(r.vector == expected[r.text] for r in got)


def test_dimension_drift_fails(spark):
    wrong = embedding.Backend("p", "m", 3, BUILTIN.embed)
    texts = spark.createDataFrame([(1, "a")], "id bigint, text string")
    try:
        embedding.embed_rows(texts, ["id"], wrong).collect()
    except Exception as error:
        assert "dimension drift" in str(error)
    else:
        raise AssertionError("no error")


def test_replace_sources(spark):
    old = spark.createDataFrame([(f"{s}:{i}", s, i) for s in ("a", "b", "c") for i in range(50)], "id string, source string, i int")
    new = spark.createDataFrame([("a:0", "a", 0)], "id string, source string, i int")
    touched = spark.createDataFrame([("a",), ("c",), ("new",)], "source string")
    rows = store.replace_sources(old, new, touched).collect()
    assert sorted((r.source, r.i) for r in rows) == [("a", 0)] + [("b", i) for i in range(50)]


def test_clarification_for_any_number_of_rounds(spark):
    from docweave.streaming.folds import Thread

    pick = random.Random(8)
    rows = [(c, t, pick.random() < 0.6, pick.random() < 0.5) for c in range(40) for t in sorted(pick.sample(range(60), 14))]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, symptom boolean, need_more boolean")
    for rounds, enabled in ((1, True), (3, True), (2, False)):
        found = history.clarification_state(turns, rounds, enabled).collect()
        expected = {}
        for c in range(40):
            thread = Thread(rounds, enabled)
            for conv, t, symptom, need in rows:
                if conv == c:
                    expected[c, t] = thread.turn(symptom, need)[1:]
        assert {(r.conv_id, r.turn): (r.awaiting, r.rounds) for r in found} == expected
