"""Small fixtures: every operator meets nulls, empty and long texts, ties and clashing names."""

import hashlib
import re

import pytest

PASSAGE = " ".join(f"word{i}" for i in range(60))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with nulls in any column, repeats, long texts and clashing column names."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog again and again", "en", "b", 1, "x"),
        (2, "the QUICK brown fox jumps over the lazy dog again and again", "en", "b", 1, "x"),
        (3, None, "fr", None, None, None),
        (4, "", None, "a", 0, "y"),
        (5, "   \t\n ", "fr", "a", 5, None),
        (6, PASSAGE, "en", "a", 1, "z"),
        (7, "intro words " + PASSAGE + " tail", "en", "a", 1, "z"),
        (7, "intro words " + PASSAGE + " tail", "en", "a", 1, "z"),
        (None, "an id that is null", "de", "c", 3, "q"),
        (9, "Éclair À la carte", "fr", "c", 3, "q"),
        (10, "long " * 30000 + "end", "en", "a", 150003, "q"),
        (11, "one", None, None, 3, "q"),
    ]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, digest string")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")


def lowered(text):
    return re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")


def sha256(text):
    return hashlib.sha256(text.encode()).hexdigest()
