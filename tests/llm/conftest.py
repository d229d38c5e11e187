import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, size string, n int, tie int, bucket int, label int, shard int, d int, seed long, part int, rank int"
CLASH = (1, "x", 2, 3, 4, 5, 6, 7, 8, 9, 10)


def frame(spark, rows):
    """documents with extra columns whose names the operators use inside; rows: (doc_id, text[, source])."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), *CLASH) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def passage(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Null and empty texts, null ids, repeated rows and ids, blanks, copies, a long text, non-ASCII."""
    rng = random.Random(1)
    base = passage(rng, 60)
    return [
        (1, None, "a"), (2, "", "a"), (3, " \t\n\x0b ", None), (4, "one", "b"), (5, "one two three", None), (None, base, "a"), (None, None, None),
        (7, base, "a"), (8, base, "b"), (8, base, "b"), (9, base + " tail", "b"), (9, "other text of nine", "b"), (10, passage(rng, 20000), "c"),
        (11, "É à ß Ünï 日本 " * 20, "c"), (12, "the " * 300, "c"), (13, base.upper(), "c"), (14, "x" * 5000, "c"), (15, base.replace("w1", "v1", 1), "d"),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return frame(spark, odd_rows).persist()


@pytest.fixture(scope="session")
def none(spark):
    return frame(spark, [(1, "x")]).limit(0)
