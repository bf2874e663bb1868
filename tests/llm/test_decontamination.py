from __future__ import annotations

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from posespark.llm import decontamination
from posespark.llm.fmindex import FMIndex, occurrences

from . import brute


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=60), st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=4), min_size=1, max_size=8))
def test_index_finds_every_occurrence(symbols, phrases):
    symbols = np.array([*symbols, 0], dtype=np.int64)
    table = np.zeros((len(phrases), 4), dtype=np.int64)
    for row, p in zip(table, phrases, strict=True):
        row[4 - len(p) :] = p
    which, at = occurrences(FMIndex(symbols, 4, rate=3), table, np.array([len(p) for p in phrases]))
    got = sorted(zip(which.tolist(), at.tolist(), strict=True))
    want = [(k, i) for k, p in enumerate(phrases) for i in range(len(symbols) - len(p) + 1) if symbols[i : i + len(p)].tolist() == p]
    assert got == sorted(want)


def _fixture(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(7)] + ["Été"]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(words) for _ in range(n))
    items = [(f"i{k}", text(n)) for k, n in enumerate([1, 3, 9, 10, 11, 14, 14, 30])] + [("i8", None), ("i9", " - "), ("i4", text(12))]
    docs = [(k, text(rng.randrange(0, 60))) for k in range(40)]
    docs += [(100, f"{text(5)} {items[7][1]} {text(5)}"), (101, items[4][1].upper()), (102, None), (103, f"{items[5][1]}! {items[6][1]}"), (104, f"{items[7][1]} {items[7][1]}"), (105, f"x {items[2][1]}\n{items[3][1]}")]
    items = [x for x in items if x[0] not in ("i0", "i1")]
    return docs, items, spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id string, text string")


def test_against_brute_force(spark):
    docs, items, df, bench = _fixture(spark)
    want = {}
    for k, text in docs:
        n, hit, found = brute.contamination(text, items)
        want[k] = (n, hit, len(found), decontamination.digest(found), hit > 0)
    assert sum(w[4] for w in want.values()) > 3
    got = {r[0]: tuple(r[1:6]) for r in decontamination.contamination(df, bench).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()}
    assert got == want
    kept = {r["doc_id"] for r in decontamination.drop_contaminated(df, bench).collect()}
    assert kept == {k for k, w in want.items() if not w[4]}


def test_small_shards_and_blocks_change_nothing(spark):
    _, _, df, bench = _fixture(spark)
    rows = lambda d: sorted((r["doc_id"], r["n_words"], r["spans"], sorted(r["items"])) for r in d.collect())
    whole = rows(decontamination.find_spans(df, bench))
    assert whole == rows(decontamination.find_spans(df, bench, shard_words=50, block_bytes=100))


def test_removed_spans(spark):
    _, items, df, bench = _fixture(spark)
    out = {r["doc_id"]: r["text"] for r in decontamination.remove_spans(df, bench).collect()}
    assert out[104].strip() == "" and out[102] is None and len(out) == df.count()
    assert brute.contamination(out[100], items)[1] == 0


def test_sql_on_the_fixture(spark):
    """The SQL says the same of null texts, items without words or id, short items and repeated rows."""
    import duckdb

    docs, items, df, bench = _fixture(spark)
    docs, items = [*docs, docs[-1], (None, docs[-2][1])], [*items, (None, items[2][1])]
    con = duckdb.connect()
    for name, key, rows in (("documents", "doc_id BIGINT", docs), ("benchmark", "item_id VARCHAR", items)):
        con.execute(f"CREATE TABLE {name} ({key}, text VARCHAR)")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?)", rows)
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans")
    want = con.execute(f"SELECT {', '.join(names)} FROM ({decontamination.ORACLE_SQL})").fetchall()
    found = decontamination.contamination(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    ).select(*names).collect()
    got = [(*r[:6], ",".join(f"{s['start']}-{s['end']}" for s in r["spans"])) for r in found]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and sum(r[5] for r in got) > 5
