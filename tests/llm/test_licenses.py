import os

import duckdb
import pytest

from tracelake.llm import license_texts, licenses, queries

ROWS = [
    (1, license_texts.MIT),
    (2, "Copyright (c) 2024 Someone\nAll Rights Reserved.\n\n" + license_texts.MIT.upper().replace("\n", "\r\n   ")),
    (3, "Some prose.\nReleased under the MIT License."),
    (4, "Some prose.\nReleased under the MIT License but not really."),
    (5, None),
    (6, "© 2020 A\nCopyright B"),
    (7, "Intro\n\n" + license_texts.BSD_3.replace("contributors", "Contributors")),
    (8, "this work is LICENCED under the GNU General Public Licence, version 3.0"),
    (None, "SPDX-License-Identifier: Apache-2.0"),
    (9, ""),
    (9, ""),
    (10, "x" * 100_000 + "\n" + "Licensed under CC BY-NC 4.0."),
]


def test_scan(spark):
    docs = spark.createDataFrame([(*r, "l", "d") for r in ROWS], "doc_id long, text string, license string, digest string")
    rows = licenses.scan(docs).collect()
    assert len(rows) == len(ROWS)
    by = {r["doc_id"]: r for r in rows}
    assert {k: by[k]["license"] for k in (1, 2, 3, 4, 5, 6)} == {1: "MIT", 2: "MIT", 3: None, 4: None, 5: None, 6: None}
    assert {k: by[k]["licenses"] for k in by} == {
        1: "MIT", 2: "MIT", 3: "MIT", 4: "", 5: "", 6: "", 7: "BSD-3-Clause", 8: "GPL-3.0", None: "Apache-2.0", 9: "", 10: "CC-BY-NC-4.0"
    }
    assert by[1]["text_digest"] == by[2]["text_digest"]


def test_texts_of_several_blocks_are_found_in_longer_documents(spark):
    docs = [(1, license_texts.BSD_3), (2, "Intro\n\n" + license_texts.APACHE_HEADER.replace("\n\n", "\n")),
            (3, f"# Title\n\nCopyright (c) 1999 X\n\n{license_texts.MIT}\n\nMore prose.\n\n{license_texts.ZLIB}\n\nThe end."),
            (4, license_texts.MIT[:-30]), (5, "\n\n".join(["word"] * 3000) + "\n\n" + license_texts.BSL_1)]
    by = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert by[1]["license"] == "BSD-3-Clause" and by[2]["licenses"] == "Apache-2.0" and by[2]["license"] is None
    assert {i: by[i]["licenses"] for i in (3, 4, 5)} == {3: "MIT,Zlib", 4: "", 5: "BSL-1.0"}


def test_texts_of_ones_own_are_found(spark):
    texts = {"WTF": ["Do what you want to."], "two": ["First part\n\nis of, two blocks"], "none": ["...", ""]}
    docs = [(1, "Prose here\n\ndo what YOU want to\n\nmore"), (2, "x\n\nfirst part\n\nIs of two\nblocks\n\ny"), (3, "first part"), (4, ""), (5, "Do what you want to."), (6, None)]
    by = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string"), texts).collect()}
    assert {i: by[i]["licenses"] for i in by} == {1: "WTF", 2: "two", 3: "", 4: "", 5: "WTF", 6: ""}
    assert by[5]["license"] == "WTF"
    nothing = licenses.scan(spark.createDataFrame(docs, "doc_id long, text string"), {})
    assert {r["licenses"] for r in nothing.collect()} == {""}


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="the published texts are not there")
def test_long_texts_are_found_whole_and_within(spark):
    docs = []
    for i, name in enumerate(["Apache-2.0", "GPL-3", "LGPL-2.1", "MPL-2.0", "CC0-1.0"]):
        with open(f"/usr/share/common-licenses/{name}", encoding="utf-8") as f:
            text = f.read()
        docs += [(2 * i, text), (2 * i + 1, "Before.\n\n" + text.upper() + "\n\nAfter.")]
    by = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    ids = ["Apache-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0", "CC0-1.0"]
    assert [by[2 * i]["license"] for i in range(5)] == ids
    assert all(ids[i] in by[2 * i + 1]["licenses"].split(",") for i in range(5))


def test_empty_table(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_every_known_text_has_a_stem(spark):
    stems = licenses.Known(spark).stems
    assert len(stems) < 20
    frame = spark.createDataFrame([(t,) for several in license_texts.KNOWN.values() for t in several], "text string")
    for r in frame.select(licenses.joined(licenses.canonical(frame["text"])).alias("form")).collect():
        assert any(s in r["form"] for s in stems)


def test_query_equals_its_sql_on_planted_texts(spark, tmp_path):
    docs = [(i, t) for i, t in ROWS[:9] if i is not None]
    docs += [(20, f"Intro\n\n{license_texts.MIT}\n\nx"), (21, f"MIT License\n\n{license_texts.MIT}\n\n{license_texts.MIT}"), (22, license_texts.BSL_1.replace("\n\n", "\n \n\n\n"))]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(f"SELECT doc_id, text_digest, license, n_matches, licenses FROM ({queries.ORACLE_SQL['op8_license_scan']}) ORDER BY doc_id").fetchall()
    got = queries.op8_license_scan(spark, str(tmp_path)).select("doc_id", "text_digest", "license", "n_matches", "licenses").orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == want
