"""Fixtures of the training-data operators: documents with every odd case."""

import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, extra columns with clashing names."""
    long = " ".join(f"w{i % 977} x{i % 31}." for i in range(15_000))
    base = " ".join(f"common{i}" for i in range(60))
    rows = [
        (1, "The house and the garden of the neighbour were sold. " * 3, "en", "a", 1), (2, None, "en", "a", None), (3, "", None, None, 0),
        (4, " \n\t ", "de", "b", 4), (5, long, "en", "a", 5), (6, long, "en", "b", 6), (7, base, "en", "a", 7), (8, base + " tail", None, "a", 8),
        (9, "1234 5678 !!", "fr", None, 9), (10, "Der Hund und die Katze. Das Haus.\n\nDer Garten", "de", "b", 10),
        (11, "short one two", "en", "b", 11), (12, "short one two", "en", "b", 11), (13, "Ä ÖÜ ß é \U0001f600", "de", None, 3),
        (20, "repeated row " + base, "en", "a", 5), (20, "repeated row " + base, "en", "a", 5), (21, "one id", "en", "a", 1),
        (21, "one id, another text " + base, "en", "a", 1), (None, "no id " + base, "en", "a", 3), (None, None, None, None, None),
        (-5, "a" * 3000, "es", "c", 3000), (30, "GNU General Public License, then cc by and MIT license", "en", "c", 1),
    ]
    extra = [(*r, f"x{i}", i, None) for i, r in enumerate(rows)]
    schema = ("doc_id long, text string, lang string, source string, n_chars long, tokens string, Text_Hash long, n_words string")
    return spark.createDataFrame(extra, schema)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
