from __future__ import annotations

import random

import corpus_pipeline
import pytest

from posespark.llm import near_copies

from . import brute
from .conftest import prose


def _groups(rows: list[tuple[int, str | None]]) -> list[int]:
    """The ids that are kept where all pairs of shingle sets are compared."""
    roots = brute.near_roots([t for _, t in rows])
    return [rows[i][0] for i in range(len(rows)) if roots[i] == i]


def _edited(rng: random.Random, text: str, n: int) -> str:
    words = text.split(" ")
    for i in rng.sample(range(len(words)), n):
        words[i] += "x"
    return " ".join(words)


@pytest.fixture(scope="module")
def rows():
    """Copies with few and many edits, a large group, a chain, a passage shared by many, short and empty texts."""
    rng = random.Random(4)
    bodies = [prose(rng, rng.randrange(60, 300)) for _ in range(12)]
    texts = [*bodies, *[_edited(rng, b, k) for b in bodies for k in (1, 2, 4, 6, 9)]]
    large, passage = prose(rng, 200), prose(rng, 60)
    texts += [_edited(rng, large, rng.randrange(1, 6)) for _ in range(60)]
    texts += [passage + " " + prose(rng, rng.randrange(5, 80)) for _ in range(40)]
    chain = prose(rng, 120)
    for _ in range(8):
        texts.append(chain := _edited(rng, chain, 2))
    texts += [None, "", " ", "one two", "One  two", "one two three", prose(rng, 5), bodies[0].upper(), bodies[1]]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("sample", [0, 20_000])
def test_against_all_pairs(spark, rows, sample, monkeypatch):
    monkeypatch.setattr(near_copies, "SAMPLE", sample)
    monkeypatch.setattr(near_copies, "SPREAD", 3)
    monkeypatch.setattr(near_copies, "HELD", 20)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(r["doc_id"] for r in near_copies.drop_near_copies(docs).collect()) == _groups(rows)


def test_stage_of_the_pipeline(spark, sf_dir, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, sf_dir).collect()) == _groups(rows)
