import random

import pytest

WORDS = [a + b for a in ("ta", "re", "mi", "so", "lu", "ka") for b in ("na", "ti", "vo", "re", "mo", "s")]
CLASHING = "key string, row string, h long, node long, block string, component string, score double, id string, part int, marks string"


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with nulls, empty and blank texts, repeated rows, one long text and columns with clashing names."""
    rng = random.Random(5)
    long_text = sentence(rng, 4000)
    rows = [
        (1, sentence(rng, 60)), (2, None), (3, ""), (4, "  \n\t "), (5, long_text), (6, long_text), (7, "one two"), (7, "one two"), (None, sentence(rng, 50)),
        (8, "!!! ??? ..."), (9, "é ü ñ"), (10, "One Two"), (None, None)]
    extra = ["x", "y", 1, 2, "b", "c", 0.5, "i", 3, "m"]
    full = [(i, t, "en", "s", len(t or ""), *extra) for i, t in rows]
    return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 0, 1), (6, 1, 0), (None, 1, 1), (7, None, None), (1, 0, 1)], "doc_id long, quality int, toxic int")
