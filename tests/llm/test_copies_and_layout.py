"""Exact dedup, sharding, mixing and packing on odd rows and against plain Python."""

import collections
import zlib

import numpy as np
from pyspark.sql import functions as F

from docweave.llm import exact, mixing, packing, sharding
from docweave.llm.queries import vocabulary


def pairs(odd):
    return [(r.doc_id, r.text) for r in odd.collect()]


def test_exact(spark, odd, none):
    groups = collections.defaultdict(list)
    for i, text in pairs(odd):
        groups[text or ""].append(i)
    expected = sorted(
        ((i, max((x for x in ids if x is not None), default=None), len(ids)) for ids in groups.values() for i in ids), key=str
    )
    for options in ({}, {"bucket_keys": 1}, {"bucket_keys": 2, "key_of": lambda c: F.length(c) % 3}):
        rows = exact.exact_groups(odd, **options).collect()
        assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in rows), key=str) == expected
        assert all(r.kept == (r.doc_id == r.keep_id) for r in rows)
    assert exact.exact_groups(none).collect() == []


def test_exact_directory(spark):
    keys = spark.range(1000).select(F.xxhash64("id").alias("key"))
    slots, depth = exact.directory(keys, 16)
    rows = slots.collect()
    assert sorted(r.slot for r in rows) == list(range(1 << depth))  # every slot has a bucket
    held = keys.withColumn("slot", exact.prefix("key", depth)).join(slots, "slot").groupBy("bucket").count()
    assert held.agg(F.max("count"), F.sum("count")).first() == (max(r["count"] for r in held.collect()), 1000)
    assert max(r["count"] for r in held.collect()) <= 16


def test_shards(spark, odd, none):
    hot = spark.range(300).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot " * 20)).otherwise(F.concat(F.lit("text"), F.col("id"), F.repeat(F.lit("y"), (F.col("id") % 50).cast("int")))).alias("text"))
    hot = hot.withColumnRenamed("id", "doc_id")
    for docs in (odd, hot):
        rows = sharding.shards(docs).collect()
        texts = collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in pairs(docs))
        assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == texts
        for shard in range(8):
            assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    load = np.bincount([r.shard for r in rows], weights=[r.size for r in rows], minlength=8)
    assert load.max() - load.min() <= 200  # the hot text fills three shards, so it is spread
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    assert sharding.shards(none).collect() == []
    assert sharding.fill_levels([5, 0, 1], 6) == [0, 4, 2] or sum(sharding.fill_levels([5, 0, 1], 6)) == 6


def test_equal_texts_share_a_shard(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 60, F.repeat(F.lit("z"), (F.col("id") % 60).cast("int"))).alias("text"))
    rows = sharding.shards(docs).collect()
    load = np.bincount([r.shard for r in rows], weights=[r.size for r in rows], minlength=8)
    assert len({(r.text_crc32, r.shard) for r in rows}) == 60
    assert load.max() / load.min() < 1.25


def test_mix(spark, odd, none):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count() and all(r.taken == r.size * r.copies and r.taken <= 3 * r.size for r in rows)
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 9 + 1).cast("int")).alias("text"),
        F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 2 == 0, F.concat(F.lit("s"), F.col("id") % 30)).alias("source"),
    )
    sums = mixing.mix(docs).groupBy("source").agg(F.first("target").alias("target"), F.first("source_size").alias("size"), F.sum("taken").alias("taken")).collect()
    total = sum(r["size"] for r in sums)
    assert abs(sum(r.target for r in sums) - total) < 1e-6 * total
    assert all(abs(r.taken - r.target) <= 9 and r.target <= 3 * r["size"] + 1e-9 for r in sums)
    taken = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    repeated = collections.Counter(r.doc_id for r in mixing.mixture(docs).collect())
    assert repeated == collections.Counter({i: n for i, n in taken.items() if n})
    assert mixing.mix(none).collect() == [] and mixing.mixture(none).collect() == []
    assert mixing.mixture(odd).columns == odd.columns


def test_inclusion_follows_size(spark):
    """Certain beyond a size, in proportion below, and the expected words are the rest of the target."""
    sizes = [3] * 400 + [10] * 200 + [50] * 20 + [2000]
    docs = spark.createDataFrame([(i, "w " * n, "a") for i, n in enumerate(sizes)] + [(9000 + i, "w " * 400, "b") for i in range(20)], "doc_id long, text string, source string")
    rows = mixing.mix(docs, weights=(3, 7)).collect()
    target = next(r.target for r in rows if r.source == "a")
    rest, own = target, sorted(sizes, reverse=True)
    assert target < sum(sizes)
    certain = 0
    while (rest - sum(own[:certain])) / sum(s * s for s in own[certain:]) * own[certain] >= 1:
        certain += 1
    slope = (rest - sum(own[:certain])) / sum(s * s for s in own[certain:])
    got = {n: [r.copies for r in rows if r.source == "a" and r.size == n] for n in set(sizes)}
    assert certain == 21 and set(got[2000] + got[50]) == {1}
    for n in (3, 10):
        assert abs(np.mean(got[n]) - slope * n) < 4 * (slope * n * (1 - slope * n) / len(got[n])) ** 0.5 + 0.01
    assert abs(sum(r.taken for r in rows if r.source == "a") - target) <= 25


def test_repeated_rows_share_one_fate(spark):
    docs = spark.createDataFrame([(1, "a b c", "x")] * 500 + [(i, "d e f g", "x") for i in range(2, 900)] + [(None, None, "y"), (None, "h", "y")], "doc_id long, text string, source string")
    rows = mixing.mix(docs).collect()
    assert len(rows) == 1400 and len({r.copies for r in rows if r.doc_id == 1}) == 1
    assert {r.taken for r in rows if r.size == 0} == {0}


def test_packing_round_trip(spark, odd, none):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(vocabulary())
    rows = packing.pieces(odd, vocabulary(), length=64, with_ids=True).collect()
    expected = collections.Counter()
    for i, text in pairs(odd):
        ids = plain.encode(text or "", add_special_tokens=False).ids + [0]
        expected[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    found, sequences = collections.defaultdict(dict), collections.defaultdict(list)
    for r in rows:
        ids = np.frombuffer(bytes(r.ids), "<u4")
        assert len(ids) == r.length and zlib.crc32(bytes(r.ids)) == r.ids_crc32 and r.offset + r.length <= 64
        sequences[r.sequence_id].append((r.offset, r.length))
        found[r.sequence_id * 64 + r.offset - r.start, r.doc_id][r.start] = ids
    whole = collections.Counter()
    for (_, i), parts in found.items():
        ids = np.concatenate([parts[s] for s in sorted(parts)])
        whole[i, len(ids), zlib.crc32(ids.astype("<u4").tobytes())] += 1
    assert whole == expected
    for number, held in sequences.items():
        ends = sorted(held)
        assert all(a + n == b for (a, n), (b, _) in zip(ends, ends[1:])) and ends[0][0] == 0
        assert number == max(sequences) or sum(n for _, n in held) == 64
    assert sorted(sequences) == list(range(len(sequences)))
    assert packing.pieces(none, vocabulary()).collect() == []
