import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(400)]


def sentence(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def edge_rows() -> list[tuple]:
    """Nulls, empty and very long texts, copies, near copies, chains, repeated rows."""
    base = sentence(1, 60).split()
    near = [list(base) for _ in range(4)]
    for i, n in enumerate(near):
        for k in range(i + 1):
            n[7 * k + 3] = f"x{i}-{k}"
    rows = [
        (1, " ".join(base), "en", "a", 1), (2, " ".join(base).upper(), "en", "b", 1), *[(3 + i, " ".join(n), "en", "a", 1) for i, n in enumerate(near)],
        (10, None, None, None, None), (11, "", "en", "a", 0), (12, " \n\t ", "en", None, 3), (13, "one two", "en", "b", 7), (14, "ONE two", "en", "b", 7),
        (15, "one two three", "de", "b", 1), (None, " ".join(base), "en", "a", 1), (None, None, None, None, None),
        (16, sentence(2, 30_000), "en", "c", 1), (17, "x" * 50_000, "en", "c", 1), (18, "ÀÉ ß 漢字 🙂 é " * 20, "fr", "é", 1),
        (19, sentence(3, 80), "en", "a", 1), (19, sentence(3, 80), "en", "a", 1), (20, "same " * 200, "en", "a", 1),
    ]
    return rows + [(100 + i, sentence(100 + i, 20 + i), "en", "abc"[i % 3], 1) for i in range(40)]


@pytest.fixture(scope="session")
def edge_docs(spark):
    from pyspark.sql import functions as F

    # extra columns whose names the operators use themselves
    extra = {c: F.lit(i) for i, c in enumerate(("hits", "items", "n_words", "size", "score", "copies", "id", "key", "y", "label", "block", "own_0", "held_out"))}
    return spark.createDataFrame(edge_rows(), DOCS).repartition(3).withColumns(extra)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
