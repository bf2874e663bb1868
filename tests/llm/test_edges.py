"""Each operator over nulls, empty and long texts, ties, repeats, clashing columns, and no rows at all."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from posespark.llm import compression_quality, decontamination, licenses, line_dedup, mixing, quality_rules, secrets, sharding, simhash

from . import brute

ITEMS = [("b1", "one two"), ("b2", None), ("b3", ""), (None, "only a text here"), ("b1", "one two")]


def _bench(docs):
    return docs.sparkSession.createDataFrame(ITEMS, "item_id string, text string")


def _quality(docs):
    spark = docs.sparkSession
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(12)] + [(3, None, 1), (None, 1, 0), (4, 7, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    return compression_quality.score_documents(docs, compression_quality.fit(docs, labels))


PER_DOCUMENT = {
    "sharding": lambda d: sharding.shard_documents(d, 4, "rows"),
    "sharding_bytes": lambda d: sharding.shard_documents(d, 4, "bytes"),
    "simhash": simhash.near_duplicates,
    "lines": lambda d: line_dedup.remove_boilerplate(d, min_sites=2),
    "contamination": lambda d: decontamination.contamination(d, _bench(d)),
    "ledger": quality_rules.verdicts,
    "licenses": licenses.scan,
    "quality": _quality,
    "mixing": mixing.mix_sizes,
}


@pytest.mark.parametrize("name", PER_DOCUMENT)
def test_a_row_for_each_document(name, edge_docs, no_docs, edge_rows):
    ids = Counter(r["doc_id"] for r in PER_DOCUMENT[name](edge_docs).select("doc_id").collect())
    assert ids == Counter(r[0] for r in edge_rows)
    assert PER_DOCUMENT[name](no_docs).count() == 0


SAME_COLUMNS = {
    "simhash": simhash.drop_near_duplicates,
    "contamination": lambda d: decontamination.drop_contaminated(d, _bench(d)),
    "spans": lambda d: decontamination.remove_spans(d, _bench(d)),
    "ledger": quality_rules.keep_documents,
    "mixing": mixing.mix_documents,
}


@pytest.mark.parametrize("name", SAME_COLUMNS)
def test_filters_keep_rows_as_they_are(name, edge_docs, no_docs, edge_rows):
    out = SAME_COLUMNS[name](edge_docs)
    assert out.columns == edge_docs.columns
    rows = {tuple(r) for r in out.collect()}
    if name != "spans":
        assert rows <= set(edge_rows)
    assert SAME_COLUMNS[name](no_docs).count() == 0


def test_edge_results(edge_docs, edge_rows):
    prints = {r["doc_id"]: r for r in simhash.near_duplicates(edge_docs).filter("doc_id between 0 and 2").collect()}
    assert all(r["fingerprint"] == "0" * 16 and r["component_id"] == 0 for r in prints.values())
    assert all(r["n_words"] == 0 and not r["kept"] for r in quality_rules.verdicts(edge_docs).filter("doc_id between 0 and 2").collect())
    assert all(r["score"] == r["score"] and 0 <= r["score"] <= 1 for r in _quality(edge_docs).collect())
    assert all(r["digest"] is None for r in licenses.scan(edge_docs).filter("doc_id between 0 and 2").collect())
    hit = {r["doc_id"]: r for r in decontamination.contamination(edge_docs, _bench(edge_docs)).collect()}
    assert hit[4]["n_hit"] == 2 and hit[5]["contaminated"] and not hit[0]["contaminated"] and hit[None] is not None


def test_secrets_of_edge_rows(edge_docs, no_docs):
    plain = edge_docs.select("doc_id", "text", "source", F.lit("x").alias("candidate"), F.lit(1).alias("score"), F.lit(0).alias("length"))
    key = "token = 9f14a7029c8514dfe98aba92898d323168e199da"
    rows = [(None, key, None, "x", 1, 0), (50, key, "a", "x", 1, 0), (50, key, "a", "x", 1, 0)]
    out = secrets.scan(plain.unionByName(plain.sparkSession.createDataFrame(rows, plain.schema))).filter("is_secret").collect()
    assert Counter(r["doc_id"] for r in out) == {None: 1, 50: 2}
    assert secrets.scan(no_docs).count() == 0


def test_words_of_the_mix(edge_docs, edge_rows):
    got = Counter((r["doc_id"], r["size"]) for r in mixing.mix_sizes(edge_docs).collect())
    assert got == Counter((r[0], len(brute.WORD.findall(r[1] or ""))) for r in edge_rows)
