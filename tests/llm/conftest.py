from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, fp long, _row string, _doc string, n_words string, spans string, bad int, label string"


def prose(rng: random.Random, n: int) -> str:
    words = ["river", "stone", "Lamp", "garden", "window", "café", "naïve", "table", "forest", "paper", "evening", "harbour", "signal", "winter", "bridge", "copper", "meadow", "thunder", "velvet", "orchard"]
    return " ".join(rng.choice(words) + str(rng.randrange(40)) * (rng.random() < 0.5) for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows() -> list[tuple]:
    """Nulls, empty, blank and long texts, ties and repeated rows."""
    rng = random.Random(5)
    long = prose(rng, 30_000)
    body = prose(rng, 120)
    texts = [None, "", "  \n\t ", "one", "one two", "One TWO", "a\nb\n\na\n", "#*$ %&| <>", long, body, body, body + " more", body.upper(), "é" * 50, "  x", "x\x0by\x0cz"]
    rows = [(i, t, [None, "en", "de"][i % 3], [None, "a", "b", ""][i % 4], len(t) if t is not None and i % 5 else None) for i, t in enumerate(texts)]
    rows += [rows[9], rows[9], (None, None, None, None, None), (None, "only a text here", "en", "a", 3), (7, "#*$ %&| <>", "de", None, 11), (-4, body, "en", "b", 1)]
    return [(*r, 1, 2, 3, "r", "d", "w", "s", 4, "l") for r in rows]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
