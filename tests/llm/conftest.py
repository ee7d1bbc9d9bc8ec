import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rep long, `__spans` string"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, columns whose names the operators use themselves."""
    rnd = random.Random(5)
    long_ = " ".join(f"w{rnd.randint(0, 10**6)}" for _ in range(300))
    texts = [
        (1, "a" * 1000), (2, "a" * 399), (3, None), (4, ""), (5, "ab" * 700), (6, long_), (7, "x " + long_ + " y"), (7, "x " + long_ + " y"), (7, "x " + long_ + " y"),
        (None, long_[100:1500]), (None, None), (8, "é" * 300 + long_[500:1100]), (9, "the quick brown fox jumps over a lazy dog " * 40), (10, long_[:450] + "Z" + long_[450:900]),
        (11, " ".join(["k"] * 80)), (12, long_[700:1099]), (13, long_[700:1100]), (14, "  two  spaces\n\n\tand ▁ marks <|endoftext|> it's 'tis "), (15, "12 34 !!"), (16, "one two three"), (17, "One TWO three"), (18, " \n\t "),
    ]
    rows = [(d, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else "s", None, 5, "x") for i, (d, t) in enumerate(texts)]
    rows.append((20, " ".join(f"v{i % 977}" for i in range(60_000)), "en", "s", 1, 5, "x"))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def id_(d):
    return -1 if d is None or d != d else int(d)


def rows(df):
    """Rows as tuples, a null doc_id as -1."""
    return sorted((id_(r[0]), *r[1:]) for r in df.collect())


def texts(df):
    return [(id_(r[0]), r[1]) for r in df.select("doc_id", "text").collect()]
