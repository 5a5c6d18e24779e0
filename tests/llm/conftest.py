import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, size int, group string, vertex int, place int"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in all columns, empty and very long texts, repeated rows and ids, and columns that operators use themselves."""
    long = " ".join(f"word{i % 977} and{i % 31}" for i in range(30_000))
    texts = [
        (1, "the cat sat on the mat and ran"), (2, None), (3, ""), (4, " \n\t "), (5, "the cat sat on the mat and ran"),
        (5, "the cat sat on the mat and ran"), (None, "no id here"), (None, None), (7, long), (8, "x"), (9, "x"),
        (10, "Ünïcode wörds\nsecond line <|endoftext|> end"), (11, "a\x00b  c d"),
    ]
    rows = [(i, t, None, None if n % 3 == 0 else f"s{n % 3}", None if t is None else len(t), "k", n, "g", 1, None) for n, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
