"""Near-duplicate documents, repeated strings and lines against brute force."""

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from docweave.llm import lines, sketching, spans, suffixes


def family(pick, n, words=60):
    base = [f"w{pick.randrange(3000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        base = list(base)
        for _ in range(pick.randrange(3)):
            base[pick.randrange(len(base))] = f"x{pick.randrange(9999)}"
        out.append(" ".join(base))
    return out


def shingle_set(text, n):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(found[k : k + n]) for k in range(len(found) - n + 1)} or ({tuple(found)} if found else set())


def brute(docs, threshold, n):
    sets = {i: shingle_set(t, n) for i, t in docs}
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= round(100 * threshold) * len(sets[a] | sets[b]):
                label[max(root(a), root(b))] = min(root(a), root(b))
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_near_groups(spark, monkeypatch):
    pick = random.Random(4)
    texts = [t for n in (40, 25, 3, 2, 1, 1) for t in family(pick, n)] + ["a b", "A  b", "a", "", None, " ", "a b c d e f g h i j"]
    docs = list(enumerate(pick.sample(texts, len(texts))))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for block, n, threshold in ((512, 3, 0.85), (8, 5, 0.8)):
        monkeypatch.setattr(sketching, "BLOCK", block)
        expected = brute(docs, threshold, n)
        rows = sketching.near_groups(frame, threshold, n).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == expected and len(rows) == len(docs)
        assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    kept = {r.doc_id for r in sketching.without_near_copies(frame).collect()}
    assert kept == {i for i, (_, c) in brute(docs, 0.8, 5).items() if c == i}


def test_near_groups_of_odd_rows(spark, odd, none):
    rows = sketching.near_groups(odd).collect()
    assert len(rows) == odd.count()
    found = {(r.doc_id, r.n_shingles > 0): (r.component_id, r.kept) for r in rows}
    assert found[5, True] == (1, False) and found[1, True] == (1, True) and found[9, True] == (8, False)
    assert found[2, False] == (2, True) and found[None, True] == (None, True)
    assert sketching.near_groups(none).collect() == []
    assert sketching.without_near_copies(odd).columns == odd.columns


def test_an_id_with_two_texts_links_by_both(spark):
    pick = random.Random(8)
    one, two = " ".join(f"a{pick.randrange(900)}" for _ in range(60)), " ".join(f"b{pick.randrange(900)}" for _ in range(60))
    rows = [(7, one), (7, two), (2, one + " tail"), (3, two + " tail"), (9, "nothing like it at all in here"), (4, one), (4, one)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = sketching.near_groups(frame).collect()
    assert len(found) == 7 and {(r.doc_id, r.component_id, r.kept) for r in found} == {(7, 2, False), (2, 2, True), (3, 2, False), (9, 9, True), (4, 2, False)}
    named = frame.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    assert {(r.doc_id, r.component_id) for r in sketching.near_groups(named).collect()} == {("d7", "d2"), ("d2", "d2"), ("d3", "d2"), ("d9", "d9"), ("d4", "d2")}
    assert sorted(r.doc_id for r in sketching.without_near_copies(named).collect()) == ["d2", "d9"]


def test_repeated_rows_leave_and_names_may_clash(spark):
    pick = random.Random(9)
    text = " ".join(f"a{pick.randrange(900)}" for _ in range(60))
    rows = [(1, text), (1, text), (1, text), (5, text + " x"), (6, "short one"), (6, "short one"), (6, "another"), (None, "short one"), (None, "short one"), (8, None), (8, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_maybe": F.lit(1), "_gone": F.lit("g"), "_row": F.lit(2.5)})
    rest = sketching.without_near_copies(frame)
    assert rest.columns == frame.columns
    assert sorted(((r.doc_id, r.text, r._maybe) for r in rest.collect()), key=str) == sorted(
        [(1, text, 1), (6, "another", 1), (6, "short one", 1), (None, "short one", 1), (None, "short one", 1), (8, None, 1)], key=str)


def test_registers_merge_and_estimate():
    random_ = np.random.default_rng(1)
    a, b = (random_.integers(0, 2**63, 4000).astype(np.uint64) for _ in range(2))
    both = np.r_[a, b]
    one, two, union = (sketching.registers(np.zeros(len(x), int), x)[0] for x in (a, np.r_[a[:3000], b[:1000]], np.r_[a, b[:1000]]))
    assert (np.maximum(one, two) == union).all() and len(both) == 8000
    found = sketching.similarity(*(np.array([x], float) for x in ((one > two).sum(), (one < two).sum(), 4000, 4000)))
    assert abs(found[0] - 0.6) < 0.2


def repeated(texts, length):
    """Covered bytes of every text, string by string."""
    places = {}
    for i, t in enumerate(texts):
        for k in range(len(t) - length + 1):
            places.setdefault(t[k : k + length], []).append((i, k))
    cover = [bytearray(len(t)) for t in texts]
    for found in places.values():
        if len(found) > 1:
            for i, k in found:
                cover[i][k : k + length] = b"\1" * length
    return cover


def test_repeats(spark, monkeypatch):
    pick = random.Random(6)
    common = "".join(pick.choice("abcdefgh") for _ in range(70))
    texts = ["".join(pick.choice("abcdé\n") for _ in range(pick.randrange(200))) for _ in range(30)]
    texts += [t[:10] + common[pick.randrange(9) : 45 + pick.randrange(25)] + t[10:] for t in texts]
    texts += ["ab" * 40, "z" * 90, "z" * 30, "z" * 19, "", texts[5], common + common]
    raw = [t.encode() for t in texts]
    expected = repeated(raw, 20)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for rows, piece in ((50_000, 8_000_000), (1, 8_000_000), (50_000, 64)):
        monkeypatch.setattr(suffixes, "PIECE", piece)
        for r in suffixes.without_repeats(frame, 20, rows).collect():
            cover = np.frombuffer(bytes(expected[r.doc_id]), np.uint8)
            assert bytes(r.kept) == bytes(np.frombuffer(raw[r.doc_id], np.uint8)[cover == 0])
            edges = np.flatnonzero(np.diff(np.r_[0, cover, 0].astype(int)))
            assert [(s["start"], s["end"]) for s in r.spans] == list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def test_repeats_of_odd_rows(spark, odd, none):
    rows = suffixes.without_repeats(odd, 20).collect()
    assert len(rows) == odd.count() and suffixes.without_repeats(none).collect() == []
    assert all(len(r.kept) + sum(s["end"] - s["start"] for s in r.spans) == r.n_bytes for r in rows)
    assert [len(r.kept) for r in rows if r.doc_id in (1, 5)] == [0, 0, 0]


def test_portions_are_whole_groups_of_bounded_bytes():
    sizes = [3, 1, 2, 9, 1, 1]
    gram = np.repeat(np.arange(6), sizes)
    table = pa.table({"gram": gram, "around": [b"x" * 10] * len(gram)})
    found = [t.column("gram").to_pylist() for t in suffixes.portions(table, "gram", "around", 40)]
    assert found == [[0, 0, 0, 1], [2, 2], [3] * 9, [4, 5]]
    assert [t.num_rows for t in suffixes.portions(table, "gram", "around", 1000)] == [17]


def test_hashes_and_comparisons_take_bounded_memory():
    """Prefix hashes are made in place, and neighbours are compared some at a time."""
    data = np.random.default_rng(1).integers(97, 99, 1 << 20).astype(np.uint8)
    spans.Prefix(data)  # the powers are made once
    at = np.arange(5000, dtype=np.int64)
    tracemalloc.start()
    try:
        one = spans.Prefix(data)
        assert tracemalloc.get_traced_memory()[1] < 18 * len(data)
        assert one.spans(at, at + 9).tolist() == one.spans(slice(0, 5000), slice(9, 5009)).tolist()
        tracemalloc.reset_peak()
        assert suffixes.agrees(data, at, at, np.full(5000, 400), np.full(5000, 400))
        assert tracemalloc.get_traced_memory()[1] < 20 * len(data)
    finally:
        tracemalloc.stop()


def test_sort_falls_back_to_bytes(monkeypatch):
    """With hashes that collide all the time, neighbours show it and the bytes decide."""
    monkeypatch.setattr(suffixes.Prefix, "spans", lambda self, a, b: np.zeros(len(np.atleast_1d(a)), np.uint64))
    data = np.frombuffer(b"bananaband", np.uint8)
    at = np.arange(10)
    order, shared = suffixes.ordered(data, at, 10 - at, np.zeros(10, int))
    assert [bytes(data[a:]) for a in order] == sorted(bytes(data[a:]) for a in at) and shared[0] == -1


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row = row, [i + 1]
        for j, y in enumerate(b):
            row.append(min(last[j] + (x != y), last[j + 1] + 1, row[j] + 1))
    return row[-1]


def edited(pick, text, n):
    out = list(text)
    for _ in range(n):
        k = pick.randrange(len(out) + 1)
        kind = pick.randrange(3)
        out[k : k + (kind > 0)] = [] if kind == 1 else [pick.choice("abcé")]
    return "".join(out)


def test_banded_distance_and_segments():
    pick = random.Random(2)
    left = ["".join(pick.choice("abé") for _ in range(pick.randrange(16))) for _ in range(1500)]
    right = [edited(pick, t, pick.randrange(5)) for t in left]
    for most in (0, 1, 2, 3):
        near = [distance(a, b) <= most for a, b in zip(left, right)]
        assert lines.within(left, right, most).tolist() == near
        for a, b, close in zip(left, right, near):
            if close and a != b and min(len(a), len(b)) > 2 * most + 2:
                row, key = lines.keys_of([a, b], most, 0.5)
                assert set(key[row == 0].tolist()) & set(key[row == 1].tolist())


def test_near_lines(spark, odd, none):
    pick = random.Random(9)
    stock = ["".join(pick.choice("abcdefgh ") for _ in range(30)).strip().ljust(24, "x") for _ in range(12)]
    stock += ["".join(pick.choice("abcdefghijklmno") for _ in range(n)) for n in (4, 8, 9, 10, 11, 12, 15, 18, 19, 20, 21, 23)]
    docs = []
    for i in range(80):
        held = [edited(pick, pick.choice(stock), pick.randrange(3)) if pick.random() < 0.8 else pick.choice(["", " ", "ab", "abc"]) for _ in range(5)]
        docs.append((i, "\n".join(held)))
    every = sorted({line for _, t in docs for line in t.split("\n")})
    label = {x: x for x in every}
    root = lambda x: x if label[x] == x else root(label[x])
    for a in every:
        for b in every:
            if a < b and a.strip() and b.strip() and distance(a, b) <= min(2, min(len(a), len(b)) // 10):
                label[root(b)] = root(a)
    seen, expected = set(), {}
    for i, t in docs:
        kept = []
        for line in t.split("\n"):
            if line.strip():
                if root(line) in seen:
                    continue
                seen.add(root(line))
            kept.append(line)
        expected[i] = "\n".join(kept)
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("place", F.lit(1))
    rows = lines.near_lines(frame).collect()
    assert {r.doc_id: r.text for r in rows} == expected and len(rows) == 80
    assert all(r.removed_lines == dict(docs)[r.doc_id].count("\n") - r.text.count("\n") or not r.text for r in rows)
    found = lines.near_lines(odd)
    assert found.columns == [*odd.columns, "removed_lines"] and found.count() == odd.count()
    texts = {r.doc_id: r.text for r in found.where("doc_id in (1, 2, 3, 4, 5, 9)").collect()}
    assert texts == {1: "the cat sat on the mat and ran", 2: None, 3: "", 4: " \n\t ", 5: "", 9: ""}
    assert lines.near_lines(none).collect() == []


def test_very_long_lines_and_clashing_names(spark):
    pick = random.Random(3)
    long = "".join(pick.choice("abcdefgh ") for _ in range(1_000_000))
    middle = long[:500_000] + "#" + long[500_001:]
    docs = [(1, "a\n" + long, 9), (2, middle + "\nb", 9), (3, long[:-3] + "\nc", 9), (4, "d", 9)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, removed_lines int")
    frame = frame.withColumns({"_lost": F.lit("l"), "_touched": F.lit(2), "_lost_key": F.lit(1.5), "_at": F.lit(7), "_word": F.lit(8)})
    found = lines.near_lines(frame)
    assert sorted(found.columns) == sorted(frame.columns)
    rows = {r.doc_id: r for r in found.collect()}
    assert [rows[i].removed_lines for i in (1, 2, 3, 4)] == [0, 1, 0, 0] and rows[2].text == "b"
    assert {(r._lost, r._touched, r._lost_key, r._at, r._word) for r in rows.values()} == {("l", 2, 1.5, 7, 8)}


def test_common_lines_are_spread(spark, monkeypatch):
    monkeypatch.setattr(lines, "HEAVY", 3)
    docs = [(i, f"the same common line of many documents\nown line {i * 7919} {i * 104729} {i}") for i in range(50)]
    rows = {r.doc_id: r for r in lines.near_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [rows[i].removed_lines for i in range(50)] == [0] + [1] * 49
