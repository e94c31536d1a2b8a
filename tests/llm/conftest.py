import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, count long, start string, _h int"

_RNG = random.Random(11)
_WORD = lambda: "".join(_RNG.choice(["la", "zy", "fo", "ri", "ten", "du", "ma", "so"]) for _ in range(_RNG.randint(1, 3)))
PROSE = "\n".join(" ".join(_WORD() for _ in range(14)) + "." for _ in range(12))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, ties and repeated rows, extra columns with clashing names."""
    rows = [
        (1, PROSE, "en", "a", None, 5, "x", 1),
        (1, PROSE, "en", "a", None, 5, "x", 1),
        (2, None, None, None, None, None, None, None),
        (3, "", "en", "b", 0, 1, "y", 2),
        (4, " \t\n\x0b\x0c\r ", "en", "b", 7, 1, "y", 2),
        (None, PROSE + " tail", "en", None, 3, 1, "y", 2),
        (None, None, None, None, None, None, None, None),
        (5, "word", "en", "c", 4, 1, "y", 2),
        (6, " ".join(f"w{i % 977}x{i}" for i in range(30000)), "en", "c", 4, 1, "y", 2),
        (7, "x" * 50000, "en", "c", 4, 1, "y", 2),
        (8, PROSE.replace("lazy", "sleepy", 1) + " more", "en", "a", 4, 1, "y", 2),
        (9, "é ü ß 𝒳y\u0085z " * 20, "fr", "", 4, 1, "y", 2),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)
