import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, `order` int, text_sha256 string, h1 string, size string, node string, __row string"


def docs(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, source). The other columns clash with names that operators use within."""
    whole = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), "x", 1, "y", "z", "big", "n", "r") for r in rows]
    return spark.createDataFrame(whole, DOCS)


@pytest.fixture
def make(spark):
    return lambda rows: docs(spark, rows)


@pytest.fixture
def odd():
    """Nulls, empty and blank texts, a very long text, repeated rows, ids that repeat with another text, no id."""
    rng = random.Random(9)
    prose = [" ".join(rng.choice(["river", "stone", "Over", "cloud,", "seven", "the", "und", "paix", "Übung", "x1"]) for _ in range(n)) for n in (60, 80, 100, 400)]
    long = "\n".join(" ".join(str(rng.randint(0, 10**6)) for _ in range(12)) for _ in range(4000))
    return [(1, prose[0], "a"), (2, prose[0], "b"), (2, prose[0], "b"), (3, None, "a"), (4, "", None), (5, " \t\n ", None), (6, long, "c"), (7, prose[1] + "\n" + prose[2], "a"), (8, prose[2] + "\n" + prose[1], "a"), (None, prose[3], None), (None, prose[0], "d"), (9, prose[3] + " end", "c"), (9, "other text for the same id", "c")]
