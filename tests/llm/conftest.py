import random

import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "h string, bin long, kept boolean, score double, shard int, size long, part int, component_id long, row string")


def make(spark, rows):
    """documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame(
        [(i, t, lang, s, None if t is None else len(t), "x", 1, True, 0.5, 3, 7, 0, 9, "r") for i, t, lang, s in rows], SCHEMA)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def messy_rows():
    """Nulls in every column, empty, blank and long texts, ties, repeated rows."""
    rng = random.Random(5)
    base = prose(rng, 60)
    near = base.replace(base.split()[30], "other", 1)
    return [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, near, "en", "b"), (4, prose(rng, 60), "de", None),
        (5, None, "en", "b"), (6, "", None, "c"), (7, " \t\n ", "fr", "c"), (8, "Word", "en", "a"), (9, "word", "en", "a"),
        (10, prose(rng, 30_000, 5000), "es", "d"), (11, base.upper(), "en", "a"), (12, base.replace(" ", "\n  "), "en", "b"),
        (13, "é ñ 3,5 km", "es", "a"), (13, "é ñ 3,5 km", "es", "a"), (None, "no id here at all", "en", "a"),
        (None, None, None, None), (14, "  x", "en", "b"), (15, "<|im_start|> <\\|", "en", "b"),
    ]


@pytest.fixture(scope="session")
def messy(spark, messy_rows):
    return make(spark, messy_rows)


@pytest.fixture(scope="session")
def empty(spark):
    return make(spark, [])
