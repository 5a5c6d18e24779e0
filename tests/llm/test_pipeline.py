"""The pipeline: each stage works on all that the one before it kept."""

import collections

import corpus_pipeline
from docweave.llm import lines, mixing, packing, quality, sketching
from docweave.llm.queries import ORACLES, QUERIES, vocabulary

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "mixing", "packing"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, now = docs.columns, docs
    kept = []
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, FOLDER).cache()
        kept.append(now)
    good, fresh, unique, mixed, packed = kept
    assert all(d.columns == columns for d in kept[:-1])
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    ids = lambda d: collections.Counter(r.doc_id for r in d.collect())
    assert ids(good) == ids(quality.classify(docs, labels).where("kept"))
    assert {(r.doc_id, r.text) for r in fresh.collect()} == {(r.doc_id, r.text) for r in lines.near_lines(good).collect()}
    assert ids(unique) == ids(sketching.near_groups(fresh).where("kept"))
    assert ids(mixed) == collections.Counter({r.doc_id: r.copies for r in mixing.mix(unique).collect() if r.copies})
    digest = lambda d: collections.Counter((r.doc_id, r.doc_tokens) for r in d.where("start = 0").collect())
    assert digest(packed) == digest(packing.pieces(mixed, vocabulary()))
    assert {r.n_chars == len(r.text) for r in fresh.collect()} == {True}
    whole = corpus_pipeline.run(spark, FOLDER)
    assert digest(whole) == digest(packed) and whole.columns == packed.columns


def test_queries_have_rows(spark):
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) == 13
    from compare import compare

    for name in ORACLES:
        assert compare(spark, FOLDER, QUERIES[name], ORACLES[name]) is None
