from __future__ import annotations

import random
import uuid
from collections import Counter

import corpus_pipeline
import pytest

from posespark.llm.common import read

from . import brute
from .conftest import prose


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    docs = [tuple(r) for r in read(spark, sf_dir, "documents").select("doc_id", "text", "source").collect()]
    items = [tuple(r) for r in read(spark, sf_dir, "benchmark").select("item_id", "text").collect()]
    return docs, items


def test_run_against_brute_force(spark, sf_dir, tables):
    """The near-copy stage is to link texts by a share of four fifths of their five-word shingles."""
    docs, items = tables
    rows = sorted(d for d in docs if brute.kept(d[1]))
    roots = brute.near_roots([d[1] for d in rows])
    rows = [d for i, d in enumerate(rows) if roots[i] == i]
    rows = [d for d in rows if not brute.contamination(d[1], items)[1]]
    want = {d[0]: c for d, c in zip(rows, brute.copies(rows), strict=True) if c}
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter(r["doc_id"] for r in out) == want
    counts = Counter(r["shard"] for r in out)
    assert max(counts.values()) - min(counts.get(k, 0) for k in range(40)) <= 1
    assert all(sorted(r["slot"] for r in out if r["shard"] == k) == list(range(n)) for k, n in counts.items())


def test_stages_return_the_columns_of_documents(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "simhash_dedup", "decontamination", "mixing", "sharding"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns


def test_empty_table(spark, sf_dir, tmp_path):
    read(spark, sf_dir, "documents").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    read(spark, sf_dir, "benchmark").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_edge_rows(spark, edge_docs, edge_rows, tmp_path):
    """Nulls, empty and long texts, repeated rows and clashing columns through all stages."""
    rng = random.Random(8)
    fresh = [prose(rng, 90) for _ in range(6)]
    rows = edge_rows + [(500 + i, t, None if i % 2 else "en", [None, "a"][i % 2], None, *edge_rows[0][5:]) for i, t in enumerate(fresh)] * 2
    spark.createDataFrame(rows, edge_docs.schema).write.parquet(f"{tmp_path}/documents.parquet")
    items = [("b1", " ".join(fresh[0].split()[:12])), (None, None), ("b2", "")]
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    good = [r for r in rows if brute.kept(r[1])]
    assert {r["doc_id"] for r in out} <= {r[0] for r in good} - {500}
    assert {501, 502, 503, 504, 505} & {r["doc_id"] for r in out}
    counts = Counter(r["shard"] for r in out)
    assert max(counts.values()) == 1 and len(out) < 40


def test_a_broken_run_goes_on(spark, sf_dir, monkeypatch):
    calls = []

    def stage(name, fail=False):
        def work(spark, docs, sf_dir):
            calls.append(name)
            if fail and calls.count(name) == 1:
                raise RuntimeError(name)
            return docs.withColumn("doc_id", docs["doc_id"] + 1)
        return name, work

    monkeypatch.setattr(corpus_pipeline, "STAGES", [stage("a"), stage("b"), stage("c", fail=True), stage("d")])
    name = uuid.uuid4().hex
    with pytest.raises(RuntimeError):
        corpus_pipeline.run(spark, sf_dir, name)
    out = corpus_pipeline.run(spark, sf_dir, name)
    docs = read(spark, sf_dir, "documents")
    assert calls == ["a", "b", "c", "c", "d"] and out.agg({"doc_id": "sum"}).first()[0] == docs.selectExpr("sum(doc_id + 4)").first()[0]
