"""Committed versions, and ingestion into them."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from docweave.functions import vectors as vx
from docweave.operators import embedding
from docweave.plans import ingest
from docweave.plans.sinks import Versioned
from docweave.sources.versions import BUCKET, Conflict, Tables


def rows(spark, *pairs):
    return spark.createDataFrame([*pairs], "k string, n int")


def content(frame):
    return sorted(((r.k, r.n) for r in frame.collect()), key=str)


def bucket_of(tables, *keys):
    frame = rows(tables.spark, *((k, 0) for k in keys))
    return {r.k: r[BUCKET] for r in frame.select("k", tables.bucket("k")).collect()}


def test_a_change_touches_its_buckets_only(spark):
    tables = Tables(spark, f"{tempfile.mkdtemp()}/t", 8)
    assert tables.latest() == 0 and tables.read("a") is None
    first = tables.change()
    first.overwrite("a", rows(spark, *((f"k{i}", i) for i in range(40)), (None, -1), (None, -2)), "k")
    assert tables.latest() == 0  # nothing is visible yet
    assert first.commit("all") == 1
    pinned, before = tables.read("a"), tables.state()["tables"]["a"]["files"]

    second = tables.change()
    second.replace("a", rows(spark, ("k3", 300), ("k3", 301)), rows(spark, ("k4", 0)), "k", ["n"])
    assert second.commit() == 2
    after, moved = tables.state()["tables"]["a"]["files"], set(map(str, bucket_of(tables, "k3", "k4").values()))
    assert {b for b in before if before[b] != after[b]} == moved
    expected = [(f"k{i}", i) for i in range(40) if i not in (3, 4)] + [("k3", 300), ("k3", 301), (None, -1), (None, -2)]
    assert content(tables.read("a")) == sorted(expected, key=str)
    assert content(pinned) == content(tables.read("a", 1)) and len(content(pinned)) == 42
    assert content(tables.read("a", keys=["k3", "k7", "nobody"])) == [("k3", 300), ("k3", 301), ("k7", 7)]
    read = tables.read("a", keys=["k7"]).inputFiles()
    assert all(f"{BUCKET}={bucket_of(tables, 'k7')['k7']}/" in f for f in read)

    third = tables.change()
    third.replace("a", rows(spark, (None, 5)), rows(spark, (None, 0)), "k", ["n"])
    third.commit()
    assert [x for x in content(tables.read("a")) if x[0] is None] == [(None, 5)]
    assert [(r.version, r.note, r.changed["a"]) for r in tables.history().orderBy("version").collect()][0] == (1, "all", len(before))
    assert tables.at(0) == 0 and tables.at(4e9) == 3


def test_a_table_keeps_its_buckets_and_key(spark):
    folder = f"{tempfile.mkdtemp()}/t"
    first = Tables(spark, folder, 8)
    first.replace_in("a", rows(spark, *((f"k{i}", i) for i in range(30))), rows(spark), "k", ["n"])
    other = Tables(spark, folder, 3)
    other.replace_in("a", rows(spark, ("k5", 500)), rows(spark, ("k6", 0)), "k", ["n"])
    assert dict(content(first.read("a"))) == {f"k{i}": i for i in range(30) if i != 6} | {"k5": 500}
    assert content(other.read("a", keys=["k5", "k6", "k9"])) == [("k5", 500), ("k9", 9)]
    with pytest.raises(ValueError):
        other.change().replace("a", rows(spark, ("k5", 1)), rows(spark), "n", ["k"])


def test_columns_added_later_are_null_before(spark):
    tables = Tables(spark, f"{tempfile.mkdtemp()}/t", 4)
    change = tables.change()
    change.overwrite("a", rows(spark, ("x", 1), ("y", 2), ("z", 3)), "k")
    change.commit()
    change = tables.change()
    change.replace("a", rows(spark, ("x", 9)).withColumn("more", F.lit("m")), rows(spark), "k", ["n"])
    change.commit()
    assert sorted((r.k, r.n, r.more) for r in tables.read("a").collect()) == [("x", 9, "m"), ("y", 2, None), ("z", 3, None)]


def test_a_dead_writer_leaves_the_old_version(spark, monkeypatch):
    folder = f"{tempfile.mkdtemp()}/t"
    tables = Tables(spark, folder, 4)
    change = tables.change()
    change.overwrite("a", rows(spark, ("x", 1)), "k")
    change.overwrite("b", rows(spark, ("x", 10)), "k")
    change.commit()

    change = tables.change()
    change.replace("a", rows(spark, ("x", 2)), rows(spark), "k", ["n"])
    monkeypatch.setattr(Tables, "_write", lambda *a: (_ for _ in ()).throw(OSError("executor lost")))
    with pytest.raises(OSError):
        change.replace("b", rows(spark, ("x", 20)), rows(spark), "k", ["n"])
    monkeypatch.undo()
    again = Tables(spark, folder, 4)
    assert again.latest() == 1 and content(again.read("a")) == [("x", 1)] and content(again.read("b")) == [("x", 10)]
    assert len(os.listdir(f"{folder}/data")) == 3
    assert again.expire(grace_seconds=3600) == 0 and again.expire(grace_seconds=-5) == 1  # the data of no version
    assert len(os.listdir(f"{folder}/data")) == 2 and content(again.read("a")) == [("x", 1)]


def test_two_writers(spark):
    tables = Tables(spark, f"{tempfile.mkdtemp()}/t", 16)
    change = tables.change()
    names = [f"k{i}" for i in range(20)]
    change.overwrite("a", rows(spark, *((k, 0) for k in names)), "k")
    change.commit()
    places = bucket_of(tables, *names)
    one = names[0]
    other = next(k for k in names if places[k] != places[one])
    left, right, late = tables.change(), tables.change(), tables.change()
    left.replace("a", rows(spark, (one, 1)), rows(spark), "k", ["n"])
    right.replace("a", rows(spark, (other, 2)), rows(spark), "k", ["n"])
    late.replace("a", rows(spark, (one, 3)), rows(spark), "k", ["n"])
    assert (left.commit(), right.commit()) == (2, 3)
    with pytest.raises(Conflict):
        late.commit()
    assert dict(content(tables.read("a"))) == {k: 0 for k in names} | {one: 1, other: 2}
    assert not [n for n in os.listdir(f"{tables.root}/log") if n.startswith(".") and not n.endswith(".crc")]  # no draft is left


def test_expired_versions_go(spark):
    tables = Tables(spark, f"{tempfile.mkdtemp()}/t", 2)
    for n in range(5):
        tables.replace_in("a", rows(spark, ("x", n), ("y", n)), rows(spark), "k", ["n"])
    assert tables.expire(keep=2, grace_seconds=-5) > 0
    assert tables.versions() == [4, 5] and content(tables.read("a", 4)) == [("x", 3), ("y", 3)]
    assert tables.change().commit() == 6 and content(tables.read("a")) == [("x", 4), ("y", 4)]


LONG = "The tick carries a parasite of cattle. It causes fever in the herd. " * 8


def corpus(spark, **texts):
    found = [(name.replace("_", "."), bytearray(text.encode())) for name, text in texts.items()]
    return spark.createDataFrame(found, "filename string, content binary")


def failing(word):
    """A backend without a vector for texts that hold `word`, and with too short a one for those that hold 'short'."""
    def embed(text):
        good = vx.embed(text)
        return F.when(text.contains(word), F.lit(None)).when(text.contains("short"), F.slice(good, 1, 3)).otherwise(good)

    return embedding.Backend(vx.PROVIDER, vx.MODEL, vx.DIM, embed)


def test_versioned_ingestion(spark):
    sink = Versioned(spark, f"{tempfile.mkdtemp()}/store")
    files = {f"f{i}_txt": f"{LONG} number {i}." for i in range(12)}
    code, state = ingest.run_into(sink, corpus(spark, **files, copy_txt=files["f1_txt"]), cache="vectors")
    assert code == ingest.OK and {r.status for r in state.collect()} == {"ok", "duplicate"}
    first = sink.tables.latest()
    before = sink.tables.state()["tables"]
    vectors = sink.tables.read("vectors").count()
    assert vectors == sink.points().select("text").distinct().count()

    # One changed file, one whose vector fails, one that cannot be read; the others are left alone.
    changed = files | {"f3_txt": LONG.replace("tick", "fly") * 2, "f4_txt": LONG + " poison", "f5_txt": " ", "f6_txt": LONG + " short"}
    code, state = ingest.run_into(sink, corpus(spark, **changed), backend=failing("poison"), cache="vectors")
    found = {r.filename: r for r in state.collect()}
    assert code == ingest.SOME_FAILED and len(found) == 13
    assert {n for n, r in found.items() if r.status == "failed"} == {"f4.txt", "f5.txt", "f6.txt"}
    assert "no usable vector for 1 of 1" in found["f4.txt"].error and found["f4.txt"].points == 0
    texts = {r.source: r.texts for r in sink.points().groupBy("source").agg(F.concat_ws("", F.sort_array(F.collect_list("text"))).alias("texts")).collect()}
    assert set(texts) == {f"f{i}.txt" for i in range(12)}
    assert "fly" in texts["f3.txt"] and "number 4" in texts["f4.txt"] and "number 5" in texts["f5.txt"]
    assert sink.points().where("vector IS NULL OR size(vector) <> 256").count() == 0 or vx.DIM != 256
    assert sink.tables.read("vectors").count() == vectors + len({r.text for r in sink.points().where("source = 'f3.txt'").collect()})

    # Only the bucket of the one file with new points was written.
    after = sink.tables.state()["tables"]
    assert len({b for b in after["points"]["files"] if after["points"]["files"][b] != before["points"]["files"].get(b)}) == 1
    assert sink.points(first).where("text LIKE '%fly%'").count() == 0
    again = ingest.run_into(sink, corpus(spark, **files | {"f3_txt": changed["f3_txt"]}))[1]
    assert {r.filename: r.ingested_at for r in again.collect()}["f7.txt"] == found["f7.txt"].ingested_at


def test_a_run_that_dies_at_its_end_changes_nothing(spark, monkeypatch):
    sink = Versioned(spark, f"{tempfile.mkdtemp()}/store")
    ingest.run_into(sink, corpus(spark, a_txt=LONG))
    version, points, state = sink.tables.latest(), sorted(sink.points().collect()), sink.tables.read("state").collect()
    monkeypatch.setattr(Tables, "_publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        ingest.run_into(sink, corpus(spark, a_txt=LONG[:400], b_txt=LONG.upper()))
    monkeypatch.undo()
    assert sink.tables.latest() == version and sorted(sink.points().collect()) == points and sink.tables.read("state").collect() == state
    code, state = ingest.run_into(sink, corpus(spark, a_txt=LONG[:400], b_txt=LONG.upper()))
    assert code == ingest.OK and sink.points().where("source = 'b.txt'").count() > 0


def test_other_dimension_and_wipe(spark):
    sink = Versioned(spark, f"{tempfile.mkdtemp()}/store")
    ingest.run_into(sink, corpus(spark, a_txt=LONG, b_txt=LONG.upper()))
    small = embedding.Backend("p", "m", 3, lambda t: F.slice(vx.embed(t), 1, 3))
    assert ingest.run_into(sink, corpus(spark, c_txt=LONG + "c"), backend=small)[0] == ingest.UNUSABLE
    code, state = ingest.run_into(sink, corpus(spark, c_txt=LONG + "c"), ingest.Modes(wipe=True), backend=small)
    assert code == ingest.OK and [r.filename for r in state.collect()] == ["c.txt"]
    assert {r.source for r in sink.points().collect()} == {"c.txt"} and {r.source for r in sink.points(1).collect()} == {"a.txt", "b.txt"}
    assert ingest.run_into(sink, corpus(spark, z_txt=LONG), ingest.Modes(dry_run=True), backend=small)[0] == ingest.OK
    assert {r.source for r in sink.points().collect()} == {"c.txt"}


def test_a_new_copy_with_a_shorter_name_is_one_record(spark):
    sink = Versioned(spark, f"{tempfile.mkdtemp()}/store")
    ingest.run_into(sink, corpus(spark, long_name_txt=LONG))
    state = ingest.run_into(sink, corpus(spark, long_name_txt=LONG, a_txt=LONG))[1]
    assert sorted((r.filename, r.status, r.duplicate_of) for r in state.collect()) == [("a.txt", "ok", None), ("long.name.txt", "duplicate", "a.txt")]
    assert {r.source for r in sink.points().collect()} == {"a.txt"}


def test_warnings_reach_the_state(spark):
    sink = Versioned(spark, f"{tempfile.mkdtemp()}/store")

    def pdf(rows):
        page = F.array(F.struct(F.lit(1).alias("number"), F.lit(LONG).alias("text"), F.lit("own").alias("extractor")))
        return rows.withColumns({"pages": page, "error": F.lit(None).cast("string"), "warnings": F.array(F.lit("1/2 pages yielded no text (pages [2])"))})

    state = ingest.run_into(sink, corpus(spark, a_pdf="%PDF", b_txt=LONG.upper()), pdf=pdf)[1]
    assert {r.filename: r.warnings for r in state.collect()} == {"a.pdf": ["1/2 pages yielded no text (pages [2])"], "b.txt": []}
