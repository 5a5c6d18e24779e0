"""Table functions in SQL, mergeable sketches, the cube of the state, and one order over all rows."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from docweave.functions import tables
from docweave.operators import chunking, cleaning, manifest, sketches
from docweave.operators.ordering import Ordered
from docweave.plans import ingest
from docweave.plans.sinks import Versioned
from docweave.queries.common import paged_documents

FOLDER = "/root/testdata/sf0.001"


def test_ingestion_in_sql_equals_the_job_s_chunks(spark):
    tables.register(spark)
    docs = cleaning.clean_pages(paged_documents(spark, FOLDER)).withColumn("full", F.array_join(F.transform("pages", lambda p: p["text"]), "\n\n"))
    chunked = chunking.chunk_documents(docs.drop("full"), 1400, 200, 120)
    recursive = [r.filename for r in chunked.where("strategy = 'recursive'").select("filename").collect()]
    assert len(recursive) > 100
    wanted = chunking.explode_chunks(chunked.where("strategy = 'recursive'"), "filename")
    columns = ["filename", "chunk_index", "text", "char_count", "page_start", "page_end", "page_label"]
    found = spark.sql(
        """
        SELECT d.filename, c.chunk_index, c.text, c.char_count, a.number AS page_start, b.number AS page_end, page_label(a.number, b.number) AS page_label
        FROM {docs} d, LATERAL recursive_chunks(d.full, 1400, 200, 120) c, LATERAL page_at(d.pages, c.position) a,
             LATERAL page_at(d.pages, c.position + c.char_count - 1) b
        WHERE c.position >= 0""",
        docs=docs.where(F.col("filename").isin(recursive)),
    )
    assert sorted(map(tuple, found.select(*columns).collect()), key=str) == sorted(map(tuple, wanted.where("page_start IS NOT NULL").select(*columns).collect()), key=str)


def test_table_functions_on_odd_texts(spark):
    tables.register(spark)
    rows = spark.createDataFrame([(1, None), (2, ""), (3, " \n "), (4, "abc"), (5, "x" * 25)], "id int, t string")
    windows = spark.sql("SELECT id, c.* FROM {rows}, LATERAL window_chunks(t, 10, 2, 1) c ORDER BY id, chunk_index", rows=rows).collect()
    assert [(r.id, r.chunk_index, r.char_count, r.position) for r in windows] == [(4, 0, 3, 0), (5, 0, 10, 0), (5, 1, 10, 8), (5, 2, 9, 16)]
    kept = spark.sql("SELECT id FROM {rows}, LATERAL recursive_chunks(t, 10, 10, 4) c", rows=rows).collect()
    assert {r.id for r in kept} == {5}
    pages = "array(named_struct('number', 3, 'text', 'abc'), named_struct('number', 7, 'text', 'de'))"
    at = lambda offset: spark.sql(f"SELECT p.number FROM VALUES (1) v(x), LATERAL page_at({pages}, {offset}) p").first().number
    assert [at(x) for x in ("-4", "0", "4", "5", "99", "CAST(NULL AS INT)")] == [3, 3, 3, 7, 7, None]
    assert spark.sql("SELECT citation('a.txt', page_label(2, 4)) AS c, page_label(NULL, 3) AS n, content_hash('') AS h").first()[:2] == ("a.txt (p. 2-4)", "n/a")


def chunks(spark, n, kinds, seed):
    pick = random.Random(seed)
    return spark.createDataFrame([(f"s{i % 7}", "w" * pick.randrange(1, 400) + str(pick.randrange(kinds))) for i in range(n)], "source string, text string")


def test_merged_sketches_are_as_good_as_one(spark):
    a, b = chunks(spark, 6000, 3000, 1), chunks(spark, 4000, 3000, 2)
    parts = sketches.of_sources(a).unionByName(sketches.of_sources(b))
    every = a.unionByName(b)
    merged = sketches.overview(sketches.merged(parts), (0.1, 0.5, 0.9)).first()
    whole = sketches.overview(sketches.merged(sketches.of_sources(every.withColumn("source", F.lit("all")))), (0.1, 0.5, 0.9)).first()
    exact = every.select("text").distinct().count()
    lengths = sorted(len(r.text) for r in every.collect())
    for told in (merged, whole):
        assert told.n == 10_000 and abs(told.distinct_texts - exact) <= sketches.DISTINCT_BOUND * exact
        for rank, value in zip((0.1, 0.5, 0.9), told.length_quantiles):
            share = lambda test: sum(map(test, lengths)) / len(lengths)
            assert share(lambda x: x < value) <= rank + sketches.RANK_BOUND and share(lambda x: x <= value) >= rank - sketches.RANK_BOUND
    assert {r.source for r in sketches.overview(sketches.merged(parts, "source")).collect()} == {f"s{i}" for i in range(7)}
    nulls = spark.createDataFrame([("s", None), ("s", None)], "source string, text string")
    row = sketches.overview(sketches.merged(sketches.of_sources(nulls))).first()
    assert (row.n, row.distinct_texts, row.length_quantiles) == (2, 0, None)


def test_sketches_follow_the_table(spark):
    text = lambda i: f"Item {i}. " + "The herd of cattle grazes by the river in the morning. " * 5
    corpus = lambda names: spark.createDataFrame([(f"f{i}.txt", bytearray(text(t).encode())) for i, t in names], "filename string, content binary")
    sink = Versioned(spark, f"{tempfile.mkdtemp()}/store", 8)
    assert sink.overview() is None
    ingest.run_into(sink, corpus([(i, i) for i in range(20)]))
    assert (sink.overview().first().n, sink.overview().first().distinct_texts) == (20, 20)
    ingest.run_into(sink, corpus([(0, 0), (1, 101), (2, 2)]))
    points = sink.points()
    told = sink.overview().first()
    assert (told.n, told.distinct_texts) == (points.count(), points.select("text").distinct().count()) == (20, 20)
    assert sink.overview(1).first().n == 20 and sink.tables.read("sketches").count() == 20


def test_cube_of_the_state(spark):
    rows = [("ok", "text", "recursive", 2, 2), ("ok", "text", None, 1, 0), ("failed", "html", None, 0, 0), (None, "html", "window", 3, 3)]
    state = spark.createDataFrame(rows, "status string, loader string, strategy string, chunks int, points int")
    found = manifest.summary_sets(state, ["status", "loader", "strategy"])
    held = {(r.status, r.loader, r.strategy, r.level): (r.files, r.chunks, r.points) for r in found.collect()}
    assert held[None, None, None, 7] == (4, 6, 5) and held[None, None, None, 3] == (1, 3, 3)  # the null status is not the total
    assert held["ok", None, None, 3] == (2, 3, 2) and held["ok", "text", None, 0] == (1, 1, 0) and held[None, "html", None, 5] == (2, 3, 3)
    assert manifest.summary_sets(state.limit(0), ["status"]).where("level = 0").count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 97])
def test_one_order_over_all_rows(spark, n):
    pick = random.Random(n)
    rows = [(i, pick.randrange(10), f"v{i}") for i in range(n)]
    frame = spark.createDataFrame(rows, "id int, k int, v string")
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    placed = Ordered(frame, [F.desc("k"), "id"], parts=13)
    ids = [r[0] for r in order]
    assert sorted((r.position, r.id) for r in placed.positions().collect()) == [(i + 1, x) for i, x in enumerate(ids)]
    for parts in (1, 4, 7, 200):
        size, more = divmod(n, parts)
        sizes = [size + (i < more) for i in range(parts)]
        expected = dict(zip(ids, [t + 1 for t, s in enumerate(sizes) for _ in range(s)]))
        assert {r.id: r.tile for r in placed.tiles(parts).collect()} == expected
    near = placed.neighbours({"b": ("v", -1), "c": ("v", 5), "d": ("id", -30)})
    at = lambda i: order[i] if 0 <= i < n else (None, None, None)
    assert {r.id: (r.b, r.c, r.d) for r in near.collect()} == {x: (at(i - 1)[2], at(i + 5)[2], at(i - 30)[0]) for i, x in enumerate(ids)}
    plan = near._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan
