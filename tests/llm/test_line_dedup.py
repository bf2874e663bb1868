from __future__ import annotations

import random
from collections import defaultdict

import pytest

from posespark.llm import line_dedup


def _brute(rows, min_sites):
    sites = defaultdict(set)
    strip = lambda s: s.strip(" \t\n\r\x0b\x0c")
    for _, source, text in rows:
        for line in (text or "").split("\n"):
            sites[strip(line)].add(source)
    bad = {k for k, s in sites.items() if k and len(s) >= min_sites}
    out = []
    for doc, _, text in rows:
        lines = [] if text is None else text.split("\n")
        kept = [x for x in lines if strip(x) not in bad]
        out.append((doc is None, doc or 0, len(lines), len(lines) - len(kept), None if text is None else "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("heavy", [3, 1000])
def test_against_brute_force(spark, monkeypatch, heavy):
    """Lines on 1 to 14 sites (7 to 9 among them), one that makes up a third of all lines, repeats and nulls."""
    monkeypatch.setattr(line_dedup, "HEAVY", heavy)
    rng = random.Random(1)
    rows = []
    for i in range(150):
        site = rng.choice([None, *[f"s{k}" for k in range(14)]])
        lines = [f"  spread {k}\t" for k in range(1, 15) if site is None or int(site[1:]) < k] + ["everywhere"] * 8 + ["own " + str(rng.randrange(30)), ""]
        rows.append((i if i % 9 else None, site, "\n".join(rng.sample(lines, rng.randrange(len(lines) + 1)))))
    rows += [(200, "s1", None), (201, None, ""), (202, "s2", "everywhere"), (202, "s2", "everywhere"), (202, "s3", "spread 14\nx")]
    docs = spark.createDataFrame([(*r, 1, "n") for r in rows], "doc_id long, source string, text string, h1 int, bad string").repartition(3)
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_lines"], r["n_removed"], r["text"]) for r in line_dedup.remove_boilerplate(docs).collect()), key=repr)
    assert got == _brute(rows, line_dedup.MIN_SITES)
    assert sum(r[3] for r in got) > 50


def test_near_threshold_is_exact_with_a_coarse_sketch(spark):
    rows = [(i, f"s{i}", f"wide\n{'near' if i < 40 else 'far'}\n{'just' if i < 39 else 'not'}") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    keys = line_dedup.line_keys(docs)
    bad = line_dedup.line_spread(keys, min_sites=40, lg_k=4, near=3.0).filter("boilerplate")
    lines = {line_dedup._line_hashes(x): x for x in ("wide", "near", "far", "just", "not")}
    assert {lines[(r["h1"], r["h2"])] for r in bad.collect()} == {"wide", "near", "far", "not"}
