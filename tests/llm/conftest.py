import random

import pytest

WORDS = "alpha beta gamma delta eins zwei drei uno dos tres foo bar baz qux lorem ipsum dolor".split()


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, ties, near copies, a clashing extra column."""
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(300)) for _ in range(n))
    base = text(80)
    near = base.split()
    near[40] = "changed"
    rows = [
        (1, base, "en", "a", 1, 7), (2, " ".join(near), "en", "a", 1, 7), (3, base, "de", "b", 1, 7), (4, base, "de", None, 1, 7),
        (5, None, "en", "a", None, 7), (6, "", None, "b", 0, 7), (7, "one two three", "en", "b", 1, 7), (8, "one two three", "en", "c", 1, 7),
        (9, text(3000), "fr", "c", 1, None), (10, "x" * 200_000, "fr", "c", 1, 7), (11, "mail me: jo@example.com or 10.0.0.1\n\n+1 (555) 010-9999", "en", "c", 1, 7),
        (None, text(60), None, None, None, None), (12, text(60), "es", "c", 1, 7), (12, text(60), "es", "c", 1, 7), (13, " \n\t ", "es", "c", 1, 7),
        (14, "same same same\n" * 40, "es", "d", 1, 7), (14, "same same same\n" * 40, "es", "d", 1, 7),
    ]
    rows += [(100 + k, text(rng.randrange(1, 200)), rng.choice(["en", "de"]), rng.choice("abc"), 1, 7) for k in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept int").repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
