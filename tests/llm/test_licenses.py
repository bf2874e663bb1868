from __future__ import annotations

import pytest

from posespark.llm import licenses
from posespark.llm.license_texts import KNOWN


@pytest.mark.parametrize("name", KNOWN)
def test_spelling_case_and_layout_do_not_matter(name):
    text = KNOWN[name]
    changed = "Copyright (c) 2019 Somebody Else\n" + "  ".join(text.upper().replace("LICENSE", "LICENCE").splitlines(keepends=True)).replace(",", " ,") + "\nAll rights reserved."
    assert licenses.digest(changed.encode()) == licenses.digest(text.encode())
    assert licenses.digest((text + " unless it rains").encode()) != licenses.digest(text.encode())


def test_whole_texts_only(spark):
    name, text = next(iter(KNOWN.items()))
    rows = [(1, text, 0, "x"), (2, "intro " + text, 0, "x"), (3, None, 0, "x"), (4, "Copyright 2020 A", 0, "x"), (1, text, 0, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest int, license_id string")
    out = sorted((r["doc_id"], r["license_id"], r["n_canonical_words"] > 0) for r in licenses.scan(docs).collect())
    assert out == [(1, name, True), (1, name, True), (2, None, True), (3, None, False), (4, None, False)]


def test_a_table_of_digests(spark):
    known = spark.createDataFrame([(licenses.digest(b"my terms"), "b"), (licenses.digest(b"My, terms!"), "a"), (None, "c")], "license_digest string, license_id string")
    docs = spark.createDataFrame([(1, "MY terms."), (2, "")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["license_id"]) for r in licenses.scan(docs, known).collect()) == [(1, "a"), (2, None)]


@pytest.mark.parametrize("line", ["(c) 2021 Jane Doe", "Copyright Jane Doe 2021", "Copyright The Foo Authors", "Portions Copyright 2019 X", "Copyright © 2020, 2021 A. Person <a@b.c>", "Copyright [year] [name]", "© 2024 Foo"])
def test_copyright_lines(line):
    text = KNOWN["BSD-3-Clause"]
    assert licenses.digest(f"{line}\n{text}".encode()) == licenses.digest(text.encode())


@pytest.mark.parametrize("name", KNOWN)
def test_sentences_are_no_copyright_lines(name):
    """Wherever a licence is wrapped, its own words about copyright stay."""
    words = licenses.canonical(KNOWN[name].encode()).decode().split()
    for k, w in enumerate(words):
        if w == "copyright":
            wrapped = " ".join(words[:k]) + "\n" + " ".join(words[k:])
            assert licenses.digest(wrapped.encode()) == licenses.digest(" ".join(words).encode())


def test_whole_licences_meet_the_sql(spark, tmp_path):
    """A table that holds whole licences, licences in other text, and none, against the registered query's SQL."""
    import duckdb

    from posespark.llm.queries import op8_license_scan

    texts = [*KNOWN.values(), *[f"Copyright 2020 A B\n{t.upper()}" for t in KNOWN.values()], *[f"before\n\n{t}\nafter it" for t in KNOWN.values()]]
    texts += [KNOWN["MIT"] + KNOWN["ISC"], "some words", "", None, "Copyright The Foo Authors", "(c) 2020 x", "Copyright notice and more words", "non-infringement licence", "Licensed under CC BY-NC 4.0. Released under the MIT License."]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    cursor = con.execute(licenses.ORACLE_SQL)
    names = [d[0] for d in cursor.description]
    want = sorted((dict(zip(names, r, strict=True)) for r in cursor.fetchall()), key=lambda r: r["doc_id"])
    got = sorted((r.asDict() for r in op8_license_scan(spark, str(tmp_path)).collect()), key=lambda r: r["doc_id"])
    assert got == want and sum(r["license_id"] is not None for r in got) >= 2 * len(KNOWN) and got[-1]["inside"] == "CC-BY-NC-4.0,MIT"
