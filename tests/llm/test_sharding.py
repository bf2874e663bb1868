from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from posespark.llm import sharding


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (4, 2), (1, 5)])
def test_curve_visits_each_cell_by_single_steps(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
    index = sharding.hilbert_index(cells, bits)
    assert sorted(index.tolist()) == list(range(len(cells)))
    path = cells[np.argsort(index)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_laws(spark, sf_dir, law):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    out = sharding.shard_documents(docs, 8, law).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(texts)
    slots, sizes = defaultdict(list), Counter()
    for r in out:
        assert r["size"] == len(texts[r["doc_id"]].encode()) + 16
        assert r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode())
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    if law == "rows":
        counts = [len(slots[k]) for k in range(8)]
        assert max(counts) - min(counts) <= 1
    else:
        assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r["size"] for r in out)
    order = sorted(out, key=lambda r: (r["shard"], r["slot"]))
    assert [r["curve_index"] for r in order] == sorted(r["curve_index"] for r in out)


def _brute(rows, n_shards, bits=5):
    """doc_id: (cells, shard, slot) of rows (doc_id, text, source, lang, n_chars), all at once."""
    cells = []
    for k in (2, 3, 4):
        values = sorted(r[k] for r in rows if r[k] is not None)
        points = [values[-(-i * len(values) // (1 << bits)) - 1] for i in range(1, 1 << bits)] if values else []
        cells.append([(1 << bits) - 1 if r[k] is None else sum(p <= r[k] for p in points) for r in rows])
    index = sharding.hilbert_index(np.array(cells).T.reshape(-1, 3), bits).tolist()
    order = sorted(range(len(rows)), key=lambda i: (index[i], rows[i][0]))
    out = {}
    for at, i in enumerate(order):
        shard = at * n_shards // len(rows)
        out[rows[i][0]] = (shard, at - -(-shard * len(rows) // n_shards), index[i])
    return out


def test_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang", "n_chars")
    rows = [tuple(r) for r in docs.collect()]
    rows = [(r[0], r[1], None if r[0] % 11 == 0 else r[2], r[3], None if r[0] % 7 == 0 else r[4]) for r in rows]
    changed = spark.createDataFrame(rows, docs.schema)
    want = _brute(rows, 7)
    for parts in (1, 5):
        out = sharding.shard_documents(changed.repartition(parts), 7, "rows").collect()
        assert {r["doc_id"]: (r["shard"], r["slot"], r["curve_index"]) for r in out} == want


def test_shards_hold_few_values(spark):
    """All dimensions narrow: languages and the spread of lengths within a shard of 25 documents, against all."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = sharding.shard_documents(docs, 40, "rows", carry=("lang", "source", "n_chars")).toPandas()
    assert out.groupby("shard").lang.nunique().mean() < 2.6
    assert out.groupby("shard").source.nunique().mean() < 0.55 * out.source.nunique()
    spread = lambda x: x.quantile(0.9) / x.quantile(0.1)
    assert out.groupby("shard").n_chars.apply(spread).median() < 0.5 * spread(out.n_chars)


def test_files_hold_narrow_ranges(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = str(tmp_path / "runs")
    sharding.write_files(docs, path, n_files=16)
    back = spark.read.parquet(path)
    assert back.count() == docs.count() and back.columns == docs.columns
    kinds = back.selectExpr("input_file_name() f", "source").groupBy("f").agg({"source": "approx_count_distinct"}).collect()
    total = docs.select("source").distinct().count()
    assert np.mean([r[1] for r in kinds]) < 0.7 * total


def test_unknown_law(no_docs):
    with pytest.raises(ValueError):
        sharding.shard_documents(no_docs, 4, "weight")
