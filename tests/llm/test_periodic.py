"""Periodic runs against a search of all places and periods."""

from __future__ import annotations

import random
import zlib
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from posespark.llm import periodic


def plain_runs(words: list) -> list[tuple[int, int, int]]:
    """All maximal stretches by trying each period at each place."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(6, 4 * q) and not any(q % d == 0 and all(words[k] == words[k + d] for k in range(i, i + length - d)) for d in range(1, q)):
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(doc_id: int | None, text: str | None) -> list[bytes]:
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def plain_report(doc_id: int | None, text: str | None) -> tuple:
    words = planted(doc_id, text)
    runs = plain_runs(words)
    best = sorted(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))[0] if runs else None
    dropped = {k for s, n, q in runs for k in range(s + q, s + n)}
    kept = b" ".join(w for k, w in enumerate(words) if k not in dropped)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (doc_id, len(runs), *(best or (None, None, None)), best[1] * 1000 // best[2] if best else None, sha256(listed.encode()).hexdigest(), sha256(kept).hexdigest())


def of_many(documents: list[list[int]]) -> list[list[tuple[int, int, int]]]:
    out: list[list] = [[] for _ in documents]
    for d, s, n, q in periodic.runs_of(np.array([w for x in documents for w in x], np.int64), np.array([len(x) for x in documents], np.int64)).tolist():
        out[d].append((s, n, q))
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in out]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), min_size=1, max_size=5))
def test_random_words_of_few_kinds(documents):
    assert of_many(documents) == [plain_runs(x) for x in documents]


def test_periodic_words():
    rng = random.Random(8)
    documents = []
    for _ in range(300):
        words: list[int] = []
        for _ in range(rng.randrange(1, 4)):
            root = [rng.randrange(3) for _ in range(rng.randrange(1, 7))]
            words += [rng.randrange(4) for _ in range(rng.randrange(4))] + (root * 9)[: rng.randrange(1, 9 * len(root))]
        documents.append(words * rng.choice([1, 1, 5]))
    assert of_many(documents) == [plain_runs(x) for x in documents]


@pytest.mark.parametrize("words", [[0] * 3000, list(range(2000, 0, -1)), list(range(2000)), [0, *range(1500, 0, -1)], [1, 2] * 1000 + [1, 1] * 30])
def test_rising_falling_and_equal_words(words):
    got = of_many([words, [], words])
    assert got[0] == got[2] and got[1] == []
    if words[0] == 0 and len(set(words)) == 1:
        assert got[0] == [(0, 3000, 1)]
    elif len(set(words)) > 2:
        assert got[0] == []


def test_next_smaller_beyond_the_rounds_of_jumps():
    rank = np.array([0, *range(400, 0, -1), 500, 3, 2])
    end = np.full(len(rank), len(rank))
    want = [next((j for j in range(i + 1, len(rank)) if rank[j] < rank[i]), len(rank)) for i in range(len(rank))]
    assert periodic.next_smaller(rank, end).tolist() == want


def test_edge_rows(edge_docs, no_docs, edge_rows):
    texts = [(r[0], r[1] if len(r[1] or "") < 5000 else None) for r in edge_rows]
    docs = edge_docs.sparkSession.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, periodic.report_runs(periodic.with_planted_repeats(docs)).collect()), key=repr)
    assert got == sorted((plain_report(*t) for t in texts), key=repr)
    assert periodic.report_runs(periodic.with_planted_repeats(edge_docs)).count() == len(edge_rows)
    assert periodic.find_runs(edge_docs).columns == [*edge_docs.columns, "runs"] and periodic.find_runs(no_docs).count() == 0
    assert periodic.collapse_runs(edge_docs).columns == edge_docs.columns
    assert periodic.report_runs(no_docs).count() == 0


def test_documents_with_planted_repeats(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["a", "b", "c\n", "dé\t"]) for _ in range(rng.choice([0, 1, 2, 7, 40, 90])))) for i in range(300)]
    got = sorted(map(tuple, periodic.report_runs(periodic.with_planted_repeats(spark.createDataFrame(rows, "doc_id long, text string"))).collect()))
    assert [repr(g) for g in got] == [repr(plain_report(*r)) for r in sorted(rows)]
    assert sum(g[1] > 0 for g in got) > 10


def test_collapsed_text(spark):
    docs = spark.createDataFrame([(1, "x\ty " + "again and " * 5 + "end"), (2, "two  words\n"), (3, None)], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in periodic.collapse_runs(docs).collect()} == {1: "x y again and end", 2: "two  words\n", 3: None}
    assert [tuple(x) for x in periodic.find_runs(docs).filter("doc_id = 1").first()["runs"]] == [(2, 10, 2)]


def test_documents_in_several_arrays(monkeypatch):
    texts = [b"a b " * 4, None, b"c " * 9, b"d e f", b"", b"g " * 30]
    whole = list(periodic._documents(texts))
    monkeypatch.setattr(periodic, "TOGETHER", 5)
    assert list(periodic._documents(texts)) == whole and [len(r) for _, r in whole] == [1, 0, 1, 0, 0, 1]
