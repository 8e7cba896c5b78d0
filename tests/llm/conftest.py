import random

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, n=9):
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon".split()) + str(rng.randrange(40)) for _ in range(n)).capitalize() + "."


def body(rng, n=12):
    return " ".join(sentence(rng) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and blank texts, a very long text, repeated rows, one id with two texts."""
    rng = random.Random(4)
    base = body(rng)
    rows = [
        (1, base, "en", "a", 5), (1, base, "en", "a", 5), (2, base, "en", None, 5), (3, None, "en", "a", None), (4, "", None, "b", 0), (5, " \n\t ", "en", "b", 4),
        (None, body(rng), "en", "a", 1), (None, None, None, None, None), (6, body(rng, 4000), "en", "c", 9), (7, "one two", "en", "a", 7), (7, "three", "en", "a", 5),
        (8, base.replace("alpha", "beta", 1), "en", "b", 1), (9, "\u0000 ퟿ 😀 ß ﬁ   x", "de", "b", 1), (10, "!!! ??? ...", "en", "b", 1),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(spark, odd):
    """Extra columns with names that operators use for their own results."""
    for c in ("node", "key", "component", "component_id", "rk", "size", "mix", "position", "score", "predicted", "kept", "n_words", "pii", "h", "good", "n_removed", "word", "target", "lang_pred", "one", "at", "first", "rank"):
        odd = odd.withColumn(c, F.lit("x"))
    return odd
