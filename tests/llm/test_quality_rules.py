from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st

from posespark.llm import quality_rules

from . import brute

PIECES = ["a", "Bb", "é", "ñandú", "#", "$%", " ", " ", "\n", "\n\n", "\t", "\x0b", "same words here ", " ", "7"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=80).map("".join))
def test_measures(text):
    assert dict(zip(quality_rules.MEASURES, quality_rules.measure(text.encode()), strict=True)) == brute.measures(text)


def test_verdicts_and_policies(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = quality_rules.verdicts(docs).collect()
    assert all(r["kept"] == brute.kept(texts[r["doc_id"]]) for r in rows)
    base = {r["doc_id"] for r in quality_rules.verdicts(docs, "base-1").filter("kept").collect()}
    assert base == {r["doc_id"] for r in rows if not r["base_failed"]}
    assert {r["doc_id"] for r in quality_rules.keep_documents(docs).collect()} == {r["doc_id"] for r in rows if r["kept"]}


def test_ablations_from_the_stored_bits(spark, sf_dir):
    entries = quality_rules.ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")).cache()
    rows = entries.collect()
    for a in quality_rules.ablations(entries).collect():
        mask, bit = quality_rules.POLICIES[a["policy"]], quality_rules.BIT[a["rule"]]
        assert a["n_fail"] == sum(r["fail_bits"] & bit != 0 for r in rows)
        assert a["n_alone"] == sum(r["fail_bits"] & mask == bit for r in rows)


def test_clean_documents_stay(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").select("doc_id")
    assert quality_rules.verdicts(docs).filter("not base_failed").join(good, "doc_id").filter("not kept").count() == 0
