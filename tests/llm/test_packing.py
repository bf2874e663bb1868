"""Packing: round trip to the tokenizer's ids, no overlap, and few sequences."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from posespark.llm import packing

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
ENCODER = packing.Encoder(None)


def ids_of(text: str | None) -> list[int]:
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 0]


def own_ids(text: str, encoder: packing.Encoder = ENCODER) -> list[int]:
    return np.frombuffer(next(encoder.ids(pa.array([text]))), "<u4").tolist()


def expected(rows: list[tuple], capacity: int) -> Counter:
    out = Counter()
    for doc_id, text in rows:
        ids = ids_of(text)
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[start : start + capacity], "<u4")
            out[doc_id, piece, start, len(part), zlib.crc32(part.tobytes())] += 1
    return out


def check(rows: list, docs: list[tuple], capacity: int) -> int:
    """Every piece once, sequences gapless and within capacity; the number of sequences."""
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == expected(docs, capacity)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


@pytest.mark.parametrize("capacity", [16, 2048])
def test_edge_rows(edge_docs, no_docs, edge_rows, capacity):
    rows = packing.pack(edge_docs, capacity).collect()
    n = check(rows, [(r[0], r[1]) for r in edge_rows], capacity)
    assert n <= -(-sum(r["length"] for r in rows) // capacity) + 1
    assert packing.pack(no_docs, capacity).count() == 0


def test_levels_of_blocks(spark):
    """Small blocks: several levels pool the emptiest bins, and the count comes near the least that is possible."""
    rng = random.Random(3)
    docs = [(i, " ".join(["a"] * rng.choice([1, 2, 5, 9, 14, 22, 30, 45, 200]))) for i in range(1500)]
    rows = packing.pack(spark.createDataFrame(docs, "doc_id long, text string").repartition(6), 64, block=64).collect()
    assert check(rows, docs, 64) <= -(-sum(r["length"] for r in rows) // 64) + 1


def test_the_same_rows_again(spark):
    docs = spark.createDataFrame([(i, "river stone " * (i % 40)) for i in range(300)], "doc_id long, text string").repartition(3)
    first, second = (Counter(map(tuple, packing.pack(docs, 64, block=50).collect())) for _ in range(2))
    assert first == second


def test_more_than_best_fit():
    """Where best fit by falling size wastes a bin, the islands find the packing that has none to spare."""
    rng = np.random.default_rng(2)
    sizes = []
    for _ in range(40):  # triples that fill a bin
        a, b = sorted(rng.integers(20, 60, 2))
        sizes += [a, b, 128 - a - b]
    island = packing.Island(np.array(sizes, "<u2"), 128, rng)
    seeds = island.seeds(packing.POPULATION)
    start = island.cost(seeds[0])
    population, cost = island.epoch(seeds, 300)
    assert start[0] > 40 and cost < start and (island.rooms(population[0]) >= 0).all()


def test_children_are_whole_solutions():
    rng = np.random.default_rng(4)
    island = packing.Island(rng.integers(1, 100, 200).astype("<u2"), 128, rng)
    a, b = island.seeds(2)
    for _ in range(50):
        a, b = b, island.child(a, b)
        assert len(b) == 200 and b.min() == 0 and (island.rooms(b) >= 0).all() and (np.bincount(b) > 0).all()


def test_islands_exchange_their_best(spark):
    sizes = np.random.default_rng(1).integers(30, 90, 60).astype("<u2").tobytes()
    blocks = spark.createDataFrame([(0, bytearray(sizes)), (1, bytearray(sizes))], "block long, sizes binary")
    best = {r["block"]: np.frombuffer(r["best"], "<u2") for r in packing.evolve(blocks, 128).collect()}
    assert set(best) == {0, 1} and all(len(b) == 60 for b in best.values())


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \t\n\x0b\x0c ́'sS<|>")), max_size=60))
def test_word_by_word_equals_whole_text(text):
    assert own_ids(text) == ids_of(text)[:-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(min_codepoint=0x41, max_codepoint=0x260), st.sampled_from("aeßİıǅſŉ'.,!?")), min_size=1, max_size=12), max_size=6))
def test_latin_words_equal_whole_text(words):
    assert own_ids(" ".join(words)) == ids_of(" ".join(words))[:-1]


def test_every_letter_of_the_direct_way():
    assert len(ENCODER.letters) > 400 and ord("é") in ENCODER.letters and ord("İ") not in ENCODER.letters
    for c in map(chr, ENCODER.letters):
        for text in (c, f"a{c}b{c}", f"{c}{c}.", f"{c}'s"):
            assert own_ids(text) == ids_of(text)[:-1]


def test_special_tokens_and_forgotten_words(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 3)
    encoder = packing.Encoder(None)
    texts = ["one two", "", "two three! four,", "x" * 100 + " one", "日本 語 one"] * 2
    assert [np.frombuffer(ids, "<u4").tolist() for ids in encoder.ids(pa.array([*texts, None]))] == [ids_of(t)[:-1] for t in [*texts, None]]
    for text in ["a <|endoftext|>b  x<|startoftext|>", "one two three four five", "one two six " * 3, "w" * 500 + " one", "", "one two"]:
        assert own_ids(text, encoder) == ids_of(text)[:-1]
