from __future__ import annotations

import random
from pathlib import Path

import pytest

from posespark.llm import licenses
from posespark.llm.license_texts import FULL, KNOWN

from .conftest import prose


def test_licences_inside_other_text(spark):
    rng = random.Random(2)
    head, tail = prose(rng, 80), prose(rng, 40)
    n = len(licenses.canonical(head.encode()).split())
    size = {k: len(licenses.canonical(t.encode()).split()) for k, t in KNOWN.items()}
    texts = [
        head + "\nLicensed under CC BY-NC 4.0.", head + " " + KNOWN["MIT:notice"] + " " + tail, head + "\n\nCopyright (c) 2020 A\n" + KNOWN["MIT"].upper(),
        head + "\n" + KNOWN["ISC"] + KNOWN["Zlib"], head, None, "", KNOWN["GPL-3.0:notice"].replace("license", "licence"), "Licensed under CC BY-NC",
    ]
    docs = spark.createDataFrame([*enumerate(texts), (4, texts[1])], "doc_id long, text string")
    got = sorted((r["doc_id"], r["license_id"], r["start"], r["end"]) for r in licenses.find(docs).collect())
    notice = ("MIT:notice", n, n + size["MIT:notice"])
    assert got == [
        (0, "CC-BY-NC-4.0:notice", n, n + 7), (1, *notice), (2, "MIT", n, n + size["MIT"]), (3, "ISC", n, n + size["ISC"]),
        (3, "Zlib", n + size["ISC"], n + size["ISC"] + size["Zlib"]), (4, *notice), (7, "GPL-3.0:notice", 0, size["GPL-3.0:notice"]),
    ]
    assert licenses.find(docs.limit(0)).count() == 0


@pytest.mark.parametrize("name, file", [("Apache-2.0", "Apache-2.0"), ("GPL-3.0", "GPL-3"), ("MPL-2.0", "MPL-2.0")])
def test_long_licences(spark, name, file):
    path = Path("/usr/share/common-licenses") / file
    if not path.exists():
        pytest.skip("no such text here")
    docs = spark.createDataFrame([(1, "a header\n" + path.read_text())], "doc_id long, text string")
    assert [(r["license_id"], r["start"], r["end"]) for r in licenses.find(docs).collect()] == [(name, 2, 2 + FULL[name][0])]


FILES = {"Apache-2.0": "Apache-2.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0"}


def test_whole_long_licences_have_their_name(spark, tmp_path):
    """Texts that are one of the five long licences as a whole, re-wrapped and in capitals too, by the query and by its SQL."""
    import duckdb

    from posespark.llm.queries import op8_license_scan

    texts = {n: Path("/usr/share/common-licenses") / f for n, f in FILES.items()}
    if not all(p.exists() for p in texts.values()):
        pytest.skip("no such texts here")
    rows = []
    for name, path in texts.items():
        text = path.read_text()
        rows += [(name, text), (name, "Copyright (c) 2020 Some One\n" + text.upper()), (None, text + "\nand more terms"), (None, text[:400])]
    spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r.asDict() for r in op8_license_scan(spark, str(tmp_path)).collect()}
    assert [got[i]["license_id"] for i in range(len(rows))] == [n for n, _ in rows]
    assert all(got[i]["inside"].split(",")[0] == list(FILES)[i // 4] for i in range(len(rows)) if i % 4 < 3)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    cursor = con.execute(licenses.ORACLE_SQL)
    names = [d[0] for d in cursor.description]
    for r in (dict(zip(names, r, strict=True)) for r in cursor.fetchall()):
        assert {k: v for k, v in got[r["doc_id"]].items() if k != "inside"} == {k: v for k, v in r.items() if k != "inside"}
        assert r["license_id"] is None or r["inside"] == got[r["doc_id"]]["inside"]


def test_first_words_are_those_of_the_texts():
    firsts = licenses.first_runs()
    assert len(firsts) == len({d for _, _, d in licenses.known_runs().values()})


def test_a_licence_without_known_first_words(spark):
    known = licenses.known_runs({"own": "these are my own terms and conditions of all use"}, {})
    docs = spark.createDataFrame([(1, "see: These are my own terms and conditions of all use. Yes")], "doc_id long, text string")
    assert [(r["license_id"], r["start"], r["end"]) for r in licenses.find(docs, known).collect()] == [("own", 1, 11)]


def test_lines_of_the_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = docs.filter("text rlike '(?s)(Licensed under CC BY-NC 4.0|Released under the MIT License|Licensed under the Apache License, Version 2.0|licensed under the GNU General Public License, version 3)[.]'")
    assert 0 < want.count() == licenses.find(docs).select("doc_id").distinct().count()
