import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, pos int, h1 string, size string, before int"


def prose(seed: int, n: int) -> str:
    """n made-up words in lines of ten, the same for the same seed."""
    import random

    rng = random.Random(seed)
    made = ["".join(rng.choice(("ba", "ko", "ri", "tu", "se", "na")) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    return "\n".join(" ".join(made[k : k + 10]) for k in range(0, n, 10))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows and near copies."""
    base = prose(1, 120)
    near = base.replace("\n", " ").split(" ")
    near[60] = "changed"
    rows = [
        (1, base, "en", "a"),
        (2, base, "en", "a"),
        (2, base, "en", "a"),
        (3, " ".join(near), "en", "b"),
        (4, None, "en", "b"),
        (5, "", None, None),
        (6, " \t\n\x0b ", "de", "b"),
        (7, "four words are here", "de", None),
        (8, "Four  WORDS are\there", "de", "ü"),
        (9, "Ärger ÄRGER straße " * 9, "de", "ü"),
        (10, prose(2, 30000), "en", "a"),
        (11, "shared line of text\n" + prose(3, 60), "en", "a"),
        (12, prose(4, 60) + "\n  SHARED line of text \nshared line of text", "en", "b"),
        (13, "shared line of text", None, "b"),
        (14, "short\nshort\nshort", "en", "c"),
        (15, prose(5, 40) + " \x1c \xa0 end", "fr", "c"),
    ]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """The rows with columns whose names the operators use themselves."""
    rows = [(*r, len(r[1] or ""), 7, "x", "y", 3) for r in odd_rows]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def null_ids(spark):
    rows = [(None, "shared line of text and more", "en", "a"), (3, "shared line of text and more", "en", "a"), (None, None, None, None)]
    return spark.createDataFrame([(*r, 0, 0, "x", "y", 0) for r in rows], SCHEMA)
