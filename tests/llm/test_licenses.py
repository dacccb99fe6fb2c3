import re

from tests.llm.helpers import same
from termloom.llm import licenses as lic
from termloom.llm.queries import LICENSE_BASE_SQL, license_base, op4_license_scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places = [(i, label) for phrase, label in lic.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


CASES = [
    None, "", "!!", "MIT License", "mit-license mit license MIT\tLICENSE", "permit license", "the apache license license", "gnu General Public LICENSE, mit license",
    "é mit ßlicense mit license é", "summit licensee", "general public license " * 500, "x" * 100_000, "mit mit license license",
]


def test_base_equals_brute_force():
    for text in CASES:
        assert lic.scan(text)[:5] == brute(text), text


def test_shunting_yard():
    assert lic.evaluate("MIT") == ({"mit"}, True)
    assert lic.evaluate("MIT OR GPL-2.0-only AND Apache-2.0") == ({"mit", "gpl", "apache"}, True)
    assert lic.evaluate("(MIT OR GPL-2.0-only) AND GPL-3.0+") == ({"mit", "gpl"}, False)
    assert lic.evaluate("GPL-2.0-only WITH Classpath-exception-2.0 or mit") == ({"gpl", "mit"}, True)
    assert lic.evaluate("mit and") == ({"mit"}, True)
    assert lic.evaluate("((mit)") == ({"mit"}, True)
    assert lic.evaluate("mit */ int x") == ({"mit"}, True)
    assert lic.evaluate("and mit") is None and lic.evaluate("") is None and lic.evaluate(")") is None and lic.evaluate("(") is None
    assert lic.evaluate("LicenseRef-Own-1") == ({"spdx:licenseref-own-1"}, False)


def test_method_adds_labels():
    n, base, first, last, base_labels, labels, free, score = lic.scan("// SPDX-License-Identifier: BSD-3-Clause OR GPL-2.0\nReleased under the MIT License.")
    assert (base, base_labels, labels, free) == (1, "mit", "bsd,gpl,mit", True) and 0.9 < score <= 1
    assert lic.scan("Licensed under CC BY-NC 4.0.")[5] == "cc-by,cc-by-nc"
    assert lic.scan("nothing here")[5:] == ("", None, 0.0)


def test_query_on_all_rows(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op4_license_scan(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    assert all((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(docs[r.doc_id]) for r in got)


def test_base_equals_sql(spark):
    assert same(spark, license_base, LICENSE_BASE_SQL) == 200


def test_clashing_columns_and_empty_table(spark):
    rows = spark.createDataFrame([(1, None, "old", 5), (2, "mit license", "old", 6)], "doc_id long, text string, labels string, n_words int")
    got = lic.scan_licenses(rows)
    assert sorted((r.doc_id, r.labels, r.n_words) for r in got.collect()) == [(1, "", 0), (2, "mit", 2)]
    assert lic.scan_licenses(rows.limit(0)).count() == 0
