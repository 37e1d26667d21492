"""Odd rows that several tests share."""

from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, score double, fp string, part int, _features int"
COMMON = ["the", "of", "and", "to", "in", "is", "it", "that", "was", "for"]


def prose(seed: int, words: int) -> str:
    draw = random.Random(seed)
    made = ["".join(draw.choice(["ba", "ri", "to", "lun", "ges", "mar", "ki"]) for _ in range(draw.randint(1, 4))) for _ in range(words)]
    return " ".join(w if draw.random() < 0.6 else draw.choice(COMMON) for w in made)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and long texts, signs only, repeated rows and ids, equal texts under several ids."""
    one, two = prose(1, 120), prose(2, 80)
    rows = [
        (1, one, "en", "a"),
        (2, one, "en", "a"),
        (3, two, "en", None),
        (3, two, "en", None),
        (4, None, "en", "b"),
        (5, "", None, "b"),
        (6, "   \n\t ", "en", "b"),
        (7, "!!! ... 12 34 ???", "en", "a"),
        (None, prose(3, 40), "en", "a"),
        (None, None, None, None),
        (8, prose(4, 30_000), "en", "a"),
        (9, "x" * 50_000, "en", "a"),
        (10, one + " and", "en", "c"),
        (-11, "Ünïcode 😀 éàç ñ the of and", "de", "c"),
        (12, "one two", "en", "c"),
    ]
    return [(*r, 0.5, "fp", 1, 2) for r in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
