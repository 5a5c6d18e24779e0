"""The replies that are read hold the whole texts that they are made of."""

from pyspark.sql import functions as F

from docweave.queries import QUERIES, dialogue

FOLDER = "/root/testdata/sf0.001"


def raw_replies(spark, monkeypatch, reader, query):
    held, read = [], getattr(dialogue.parsing, reader)
    monkeypatch.setattr(dialogue.parsing, reader, lambda raw, *more: held.append(raw) or read(raw, *more))
    QUERIES[query](spark, FOLDER)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    return docs.select("doc_id", "text", held[0].alias("raw")).collect()


def letters(text):
    return "".join(c for c in text.lower() if c.isascii() and c.isalpha())


def test_planner(spark, monkeypatch):
    rows = raw_replies(spark, monkeypatch, "planner_reply", "i95_96_planner_replies")
    assert any("\n" in r.text for r in rows)
    assert all(r.raw.endswith(r.text.partition("\n")[2]) for r in rows)


def test_grader(spark, monkeypatch):
    rows = raw_replies(spark, monkeypatch, "grader_reply", "i97_98_grader_replies")
    some = [r for r in rows if r.doc_id % 4 in (1, 2)]
    assert any(len(r.text.split()) > 50 for r in some)
    assert all(letters(r.text) in letters(r.raw) for r in some)


def test_clarifier(spark, monkeypatch):
    rows = raw_replies(spark, monkeypatch, "clarifier_reply", "i99_100_clarifier_replies")
    assert any(r.text.count("\n") > 8 for r in rows)
    assert all(r.text.strip().split("\n")[-1].strip() in r.raw for r in rows if r.doc_id and not r.text.strip().split("\n")[-1].strip()[:1] in "-•*0123456789")
