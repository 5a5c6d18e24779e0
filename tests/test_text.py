import random
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from docweave.functions import parsing, vectors
from docweave.functions import text as tx


def random_texts(n, seed=7):
    pick = random.Random(seed)
    parts = ["a", "b-", "\n", "\n\n", " ", "  ", "\t", ".", ")", "(", "X", "é", "ﬁ", " ", " ", "\x07",
             "\r\n", "\r", "\x85", " ", "\x1c", "1", "　", "Ａ", "-\n", "ab\n(c"]
    return ["".join(pick.choice(parts) for _ in range(pick.randint(0, 25))) for _ in range(n)]


def column(spark, texts, *columns):
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return frame.select("i", "t", *columns).orderBy("i").collect()


def test_repair_is_its_plain_patterns(spark):
    """The tests that spare a text a pattern never spare one that the pattern changes."""
    texts = [t.replace("b", "-") if i % 3 else t.replace("X", "\n\n\n\xa0 \u2028\x0b") for i, t in enumerate(random_texts(800, 11))]
    trim = tx.strip(F.regexp_replace(F.regexp_replace("t", tx.LINE_END, "\n"), r"(?U)[^\S\n]+(\n|\z)", "$1"))
    pairs = [
        (tx.join_hyphenated, F.regexp_replace("t", tx.HYPHEN_BREAK, "$1$2")), (tx.collapse_spaces, F.regexp_replace("t", tx.SPACE_RUN, " ")),
        (tx.collapse_newlines, F.regexp_replace("t", tx.NEWLINE_RUN, "\n\n")), (tx.trim_lines, trim),
    ]
    columns = [F.struct(f(F.col("t")).alias("got"), plain.alias("wanted")).alias(f"c{i}") for i, (f, plain) in enumerate(pairs)]
    rows = column(spark, [*texts, None], *columns)
    for i in range(len(pairs)):
        assert all(r[f"c{i}"].got == r[f"c{i}"].wanted for r in rows)
        assert any(r[f"c{i}"].got != r.t for r in rows if r.t)


def test_embedding_is_its_plain_formula():
    texts = [*random_texts(300, 5), None, "", "One one TWO größe"]
    found = np.array(vectors._counted(pa.array(texts)))
    for text, got in zip(texts, found):
        words = re.findall(r"[^\W_]+", (text or "").lower())
        wanted = np.bincount([vectors._bucket(w) for w in words], minlength=vectors.DIM).astype(float) if words else np.zeros(vectors.DIM)
        assert (got == wanted / (np.sqrt((wanted * wanted).sum(keepdims=True)) or 1)).all()


def test_repair_examples(spark):
    cases = {
        "treat-\nment": "treatment",
        "treat- \n  ment": "treatment",
        "Treat-\nMENT": "Treat-\nMENT",
        "a line\nwrapped (here\n(and there": "a line wrapped (here (and there",
        "ends.\nnext": "ends.\nnext",
        "list:\nitem": "list:\nitem",
        "one\nTwo": "one\nTwo",
        "wide \t  gaps\u00a0\u00a0here": "wide gaps here",
        "A\n\n\n\nB": "A\n\nB",
        "bell\x07 and\x00 null": "bell and null",
        "ﬁne Ａ": "fine A",
        "trailing   \nNext  ": "trailing\nNext",
        " \n\t ": "",
        "": "",
    }
    rows = column(spark, list(cases), tx.normalize(F.col("t")).alias("r"))
    assert {r.t: r.r for r in rows} == cases


def test_repair_properties(spark):
    texts = random_texts(600)
    rows = column(spark, texts, tx.normalize(F.col("t")).alias("r"), tx.normalize(tx.normalize(F.col("t"))).alias("twice"))
    for r in rows:
        assert not re.search(r"[\x00-\x08\x0b\x0c\x0e-\x1b\x7f]", r.r)
        assert r.r == r.r.strip() and not re.search(r"[ \t]\n", r.r)
        letters = lambda t: [c for c in unicodedata.normalize("NFKC", t) if c.isalnum()]
        assert letters(r.r) == letters(r.t)  # nothing but space, signs and control characters goes
        assert letters(r.twice) == letters(r.r)


def test_strip_and_lines_equal_python(spark):
    rows = column(spark, random_texts(400, 3), tx.strip(F.col("t")).alias("s"), tx.lines(F.col("t")).alias("l"),
                  tx.words(F.col("t")).alias("w"), tx.is_blank(F.col("t")).alias("b"))
    for r in rows:
        assert r.s == r.t.strip()
        assert r.l == (r.t.splitlines())
        assert r.w == r.t.split()
        assert r.b == (not r.t.strip())


def test_folding_an_array_equals_folding_each(spark):
    texts = random_texts(50, 5)
    frame = spark.createDataFrame([(texts,), (["plain"],), ([],)], "t array<string>")
    rows = [r.f for r in frame.select(tx.nfkc_each(F.col("t")).alias("f")).collect()]
    assert rows == [[unicodedata.normalize("NFKC", t) for t in texts], ["plain"], []]


def test_page_number_lines(spark):
    yes = ["4", " Page 4 of 11 ", "page 12", "3/9", "PAGE 1 / 2"]
    no = ["12345", "page", "4 of", "Section 4", "p. 4"]
    rows = column(spark, yes + no, tx.is_page_number(F.col("t")).alias("p"))
    assert [r.p for r in rows] == [True] * len(yes) + [False] * len(no)


def test_three_decimals_as_python_formats(spark):
    values = [k / n for n in range(1, 130) for k in range(n + 1)] + [-0.25, -0.0625, 0.0005, 1e-9, -0.0, -1e-9]
    values += [s * m * 10.0**e for s in (1, -1) for m in (1, 4.2, 8.6, 9.9995, 1.0625) for e in range(-12, 13)]
    values += [2.0**53 + 1, 2.0**60, 2.0**80 + 2.0**40, 1.5 * 2.0**100, 999.9995, 3.9996]
    frame = spark.createDataFrame([(float(v),) for v in values], "x double")
    assert all(r.f == f"{r.x:.3f}" for r in frame.select("x", tx.fixed3(F.col("x")).alias("f")).collect())


def test_planner_reply(spark):
    cases = {
        "INTENT: Symptom\nQUERY: \"cattle AND (weak)\"": ("symptom", "cattle weak"),
        "QUERY: only": ("research", "only"),
        "INTENT: RESEARCH\nQUERY: none": ("research", "back"),
        "INTENT: conversational\nQUERY: NONE": ("conversational", "NONE"),
        "INTENT: research\nQUERY: ()": ("research", "()"),
        "": ("research", "back"),
    }
    rows = column(spark, list(cases), parsing.planner_reply(F.col("t"), F.lit("back")).alias("p"))
    assert [(r.p.intent, r.p.query) for r in rows] == list(cases.values())


def test_grader_reply(spark):
    cases = {
        "VERDICT: NO\nQUERY: tick borne disease, can be improved to x": (False, "tick borne disease"),
        "verdict: yes\nverdict: no because\nquery: \"a b": (False, "a b"),
        "VERDICT: NO\nQUERY: single": (False, "back"),
        "VERDICT: NO\nQUERY: none needed": (False, ""),
        "VERDICT: NO\nQUERY:\nQUERY: second one": (False, "second one"),
        "no verdict": (True, ""),
        "VERDICT: NO\nQUERY: it's one two": (False, "back"),
    }
    rows = column(spark, list(cases), parsing.grader_reply(F.col("t"), F.lit("back")).alias("p"))
    assert [(r.p.sufficient, r.p.query) for r in rows] == list(cases.values())


def test_clarifier_and_care_replies(spark):
    raw = "NEED_MORE: yes\n- a?\n* b?\n• NONE\n1. c?\n2) d?\n-e?"
    told = column(spark, [raw, "NEED_MORE: YES", "- a?"], parsing.clarifier_reply(F.col("t"), 4).alias("p"))
    assert [(r.p.need_more, r.p.questions) for r in told] == [
        (True, ["a?", "b?", "c?", "d?"]), (False, []), (False, ["a?"])]
    levels = column(spark, ["x\nCARE_LEVEL: **vet_now**", "x\ncare_level: `info`\ny", "CARE_LEVEL: odd\nx", "x", ""],
                    parsing.care_level(F.col("t")).alias("p"))
    assert [(r.p.answer, r.p.level) for r in levels] == [
        ("x", "vet_now"), ("x\ny", "info"), ("x", "vet_soon"), ("x", "vet_soon"), ("", "vet_soon")]


def test_batches_of_long_texts_are_bounded(spark):
    """Python workers get texts in batches bounded by bytes; a limit that is given stays."""
    from docweave import session

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    texts = spark.range(3000).coalesce(1).select(F.repeat(F.lit("long text "), F.lit(1000)).alias("text"))
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    session.ship(spark)
    assert texts.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0] <= 8 << 20  # 30 MB in all
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1000000")
    session.ship(spark)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "1000000"
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    session.ship(spark)


def test_vectors_of_many_texts(spark):
    """Texts counted slice by slice give the vectors that each gives alone."""
    texts = [None if i % 97 == 0 else "" if i % 89 == 0 else f"word {i % 50} and {i}" for i in range(2500)]
    found = vectors.embed.func(pa.array(texts, pa.string()))
    assert len(found) == 2500
    for i in (0, 89, 1023, 1024, 2048, 2499):
        assert found[i].as_py() == vectors.embed.func(pa.array([texts[i]], pa.string()))[0].as_py()
