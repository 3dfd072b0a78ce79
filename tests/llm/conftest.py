import random

import pytest

SCHEMA = "doc_id long, text string, node string, hits int, `row` int, label int"


def words(rng, n, vocabulary=400):
    return [f"{rng.choice('abcdefgh')}{rng.randrange(vocabulary)}" for _ in range(n)]


def odd_texts():
    """Nulls, empty and blank texts, marks only, other scripts, very long texts, repeated rows."""
    rng = random.Random(11)
    long = " ".join(words(rng, 30_000))
    return [
        (1, None), (2, ""), (3, "   \n\t "), (4, "!!! ... ***"), (5, "one"), (6, "日本語のテキスト 😀 é é ß İ Σας"), (7, long), (7, long), (8, long + " tail"),
        (None, "a null id with some words in it"), (9, "x" * 20_000), (10, "The the THE the " * 50), (11, "\0 nul \x1c unit   separator"), (12, "<|endoftext|>it's <b>bold</b> &amp; 12,000.50"), (13, "The the THE the " * 50),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with extra columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, "n", 1, 2, 3) for i, t in odd_texts()], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
