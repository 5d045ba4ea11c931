"""Small tables for the corpus operators: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


@pytest.fixture(scope="session")
def texts() -> dict[int, str | None]:
    rows: dict[int, str | None] = {i: prose(i, 30 + i) for i in range(40)}
    rows |= {100: None, 101: "", 102: "   \n\t ", 103: "one", 104: "Ünïcödé 中文 \U0001f600 text's", 105: prose(5, 35), 106: prose(5, 35), 107: prose(7, 20_000), 108: "a" * 5_000, 109: rows[3]}
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts with columns whose names the operators use inside, and one row twice."""
    rows = [(i, t, "en" if i % 2 else None, f"src{i % 3}", len(t or ""), "x", 1) for i, t in texts.items()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, shard int")


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
