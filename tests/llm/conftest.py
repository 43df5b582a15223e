import random

import pytest

TEXT_CASES = [
    None, "", " ", "one", "Plain text, with marks.\nAnd a second line.", "É ü 中文 😀 don't 123abc  x\t\ty\n\n",
    "a" * 3000, "word " * 2000, "\n" * 500, "<|endoftext|> is text",
]


@pytest.fixture(scope="session")
def cases():
    """Texts with nulls, empties, long ones and repeated rows."""
    return [(i, t) for i, t in enumerate(TEXT_CASES)] + [(4, TEXT_CASES[4]), (None, "no id"), (None, None)]


@pytest.fixture(scope="session")
def case_docs(spark, cases):
    """The cases with further columns whose names clash with result columns."""
    return spark.createDataFrame([(i, t, "z", 7) for i, t in cases],
                                 "doc_id long, text string, n_tokens string, score int")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


@pytest.fixture
def rng():
    return random.Random(11)
