from __future__ import annotations

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from posespark.llm import simhash

from . import brute
from .conftest import prose


@settings(max_examples=60, deadline=None)
@given(st.one_of(st.none(), st.text(max_size=80), st.lists(st.sampled_from(["a", "B", "é", "\t", " ", "\n", "\x0b"]), max_size=60).map("".join)))
def test_fingerprint_of_any_text(text):
    assert simhash.fingerprint(None if text is None else text.encode()) == brute.fingerprint(text)


def _near(rng: random.Random) -> list[int]:
    """Random prints, some within few bits of others, a chain, and a crowd around one."""
    prints = [rng.getrandbits(64) for _ in range(40)]
    for p in prints[:20]:
        for n in (1, 2, 3, 4):
            for b in rng.sample(range(64), n):
                p ^= 1 << b
            prints.append(p)
    crowd = rng.getrandbits(64)
    prints += [crowd ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(a)] + [crowd]
    chain = rng.getrandbits(64)
    for k in range(0, 20, 2):
        prints.append(chain := chain ^ (3 << k))
    return prints


def test_components_of_prints(spark, monkeypatch):
    prints = _near(random.Random(3))
    want = brute.components(prints)
    for limit in (0, 4, simhash.BUCKET_LIMIT):
        monkeypatch.setattr(simhash, "BUCKET_LIMIT", limit)
        signed = [p - (1 << 64) if p >> 63 else p for p in prints]
        roots = {r["fp"]: r["root"] for r in simhash._roots(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()}
        got = [roots.get(p, p) for p in signed]
        groups = lambda labels: {frozenset(i for i, x in enumerate(labels) if x == y) for y in labels}
        assert groups(got) == groups(want), limit


def test_documents_against_all_pairs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: r["doc_id"])
    prints = [brute.fingerprint(r["text"]) for r in rows]
    want = {rows[i]["doc_id"]: (f"{prints[i]:016x}", rows[c]["doc_id"]) for i, c in enumerate(brute.components(prints))}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert got == want
    kept = sorted(r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect())
    assert kept == sorted({c for _, c in want.values()})


def test_a_large_group_of_copies(spark):
    rng = random.Random(8)
    body, other = prose(rng, 300), prose(rng, 300)
    rows = [(i, body + (f" end{i}" if i % 2 else "")) for i in range(60)] + [(100, other)]
    out = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    prints = [brute.fingerprint(t) for _, t in rows]
    assert out == {rows[i][0]: rows[c][0] for i, c in enumerate(brute.components(prints))}
