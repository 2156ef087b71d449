import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join(rng.choice(["the", "of", "and", "was", "to"]) if rng.random() < 0.4 else "".join(rng.choice("abcdeghilmnorst") for _ in range(rng.randint(3, 9))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and long texts, exact copies, repeated rows."""
    rng = random.Random(3)
    base = [words(rng, rng.randint(1, 200)) for _ in range(40)]
    rows = [(i, t, "en", f"s{i % 4}", len(t)) for i, t in enumerate(base)]
    rows += [(100 + i, base[0], "en", None, 0) for i in range(30)]
    rows += [(200, None, None, None, None), (201, "", "en", "s1", 0), (202, " \t\r\n\x0b\x0c ", "en", "s1", 0), (None, "no id here", None, "s2", 1)]
    rows += [(203, words(rng, 9000), "en", "s0", 1), (204, "é ü 中文 \U0001f600 x", "de", "s3", 1), (205, base[1].replace(" ", "\n "), "en", "s3", 1)]
    rows += [(1, base[1], "en", "s1", 1), (1, base[1], "en", "s1", 1)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
