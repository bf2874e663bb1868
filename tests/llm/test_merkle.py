"""The Merkle manifest against a tree built in plain Python, its SQL, and changed rows."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from posespark.llm import merkle


def h(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row) -> str:
    shown = (str(v) if v is not None else None for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], row["text"]))
    return h(*["-" if v is None else f"{len(v.encode())}:{v}" for v in shown])


def tree(nodes: list[str], arity: int) -> tuple[str, list[list[tuple[str, str]]]]:
    """The top and each node's steps, left and right siblings."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            first = p - p % arity
            steps[i].append(("".join(nodes[first:p]), "".join(nodes[p + 1 : first + arity])))
            at[i] = p // arity
        nodes = [h(*nodes[k : k + arity]) for k in range(0, len(nodes), arity)]
    return nodes[0], steps


def plain(rows: list[dict], arity: int = 2) -> Counter:
    groups = defaultdict(list)
    for r in rows:
        groups[r["lang"]].append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    built, subroots = {}, []
    for g in order:
        built[g] = sorted(groups[g], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        top, steps = tree([leaf(r) for r in built[g]], arity)
        subroots.append((top, steps))
    root, upper = tree([top for top, _ in subroots], arity)
    out = Counter()
    for g, (top, steps), above in zip(order, subroots, upper, strict=True):
        for r, own in zip(built[g], steps, strict=True):
            changed = dict(r)
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and r["n_chars"] is not None:
                changed["n_chars"] += 1
            at = leaf(changed)
            for left, right in own + above:
                at = h(left, at, right)
            out[r["doc_id"], leaf(r), top, root, h(*[a + b for a, b in own + above]), at, at == root] += 1
    return out


def got(docs, arity: int = 2) -> Counter:
    return Counter(tuple(r) for r in merkle.verify(docs, merkle.tampered(), arity=arity).collect())


@pytest.mark.parametrize("arity", [2, 3])
def test_edge_rows_equal_a_plain_tree(edge_docs, arity):
    rows = [r.asDict() for r in edge_docs.collect()]
    assert got(edge_docs, arity) == plain(rows, arity)


def test_several_rounds_equal_a_plain_tree(spark, monkeypatch):
    """Blocks of four nodes: seven rounds up, and trees that end in different rounds."""
    monkeypatch.setattr(merkle, "BLOCK", 4)
    rows = [(i * 37 % 1009, f"text {i}", "en" if i % 3 else (None if i % 2 else f"l{i % 40}"), "s", i) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    assert got(docs) == plain([r.asDict() for r in docs.collect()])


@pytest.mark.parametrize("n", [1, 2, 1024, 1025, 3001])
def test_sizes_about_a_block(spark, n):
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("en").alias("lang"), F.lit(None).cast("string").alias("source"), F.col("id").alias("n_chars"))
    assert got(docs) == plain([r.asDict() for r in docs.collect()])


def test_no_rows(no_docs):
    assert merkle.verify(no_docs, merkle.tampered()).count() == 0
    assert merkle.manifest(no_docs).columns == ["doc_id", "leaf", "subroot", "root", "place", "proof"]


def test_proofs_hold_for_their_row_only(edge_docs):
    rows = merkle.manifest(edge_docs).withColumn("own", merkle.fold(F.col("leaf"), F.col("proof")) == F.col("root"))
    rows = rows.withColumn("other", merkle.fold(F.sha2(F.lit("other"), 256), F.col("proof")) == F.col("root"))
    assert {(r["own"], r["other"]) for r in rows.collect()} == {(True, False)}


def test_halves_of_a_frontier_merge_in_any_order():
    digests = [bytes([i]) * 32 for i in range(11)]
    whole = merkle.Frontier(11, 2, 16)
    for i, d in enumerate(digests):
        whole.leaf(i, d, (i,))
    for split in range(12):
        left, right = merkle.Frontier(11, 2, 16), merkle.Frontier(11, 2, 16)
        for i in range(10, -1, -1):
            (left if i < split else right).leaf(i, digests[i], (i,))
        assert right.merge(left).rows() == whole.rows()
