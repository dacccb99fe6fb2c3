import hashlib

from pyspark.sql import functions as F

from tests.llm.helpers import same
from termloom.llm import exact_dedup as ed
from termloom.llm.queries import OP3_SQL, op3_exact_dedup

SCHEMA = "doc_id long, text string, keep_id string"


def test_query_equals_sql(spark):
    assert same(spark, op3_exact_dedup, OP3_SQL) == 200


def test_nulls_ties_and_repeats(spark):
    rows = [(1, None), (2, ""), (3, "Abc É"), (4, "aBC É"), (5, "abc é"), (6, "x" * 200_000), (7, "X" * 200_000), (8, "one"), (8, "one"), (None, "two"), (9, "Two")]
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in ed.exact_dedup(spark.createDataFrame([(*r, "old") for r in rows], SCHEMA)).collect()}
    assert got == {
        (1, 2, 2, False), (2, 2, 2, True), (3, 4, 2, False), (4, 4, 2, True), (5, 5, 1, True), (6, 7, 2, False), (7, 7, 2, True), (8, 8, 2, True), (None, 9, 2, False), (9, 9, 2, True),
    }


def test_empty_table(spark):
    assert ed.exact_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_equal_digests_of_different_texts_are_told_apart(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "aa"), (2, "ab"), (3, "aa"), (4, "b"), (5, "ab")], "doc_id long, text string")
    real = F.sha2
    monkeypatch.setattr(F, "sha2", lambda c, n: real(F.substring(c, 1, 1), n))
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in ed.exact_dedup(rows).collect()}
    assert got == {(1, 3, 2, False), (3, 3, 2, True), (2, 5, 2, False), (5, 5, 2, True), (4, 4, 1, True)}


def test_ids_beyond_the_broadcast_limit_and_drop_copies(spark, monkeypatch):
    monkeypatch.setattr(ed, "IDS_BROADCAST", 0)
    rows = spark.createDataFrame([(i, f"text {i % 7}", "s") for i in range(50)] + [(99, "solo", "s")], "doc_id long, text string, source string")
    left = ed.drop_copies(rows)
    assert left.columns == rows.columns
    assert sorted(r.doc_id for r in left.collect()) == [43, 44, 45, 46, 47, 48, 49, 99]


def test_digest_is_of_the_normalised_text(spark):
    got = ed.exact_dedup(spark.createDataFrame([(1, "ÀBC")], "doc_id long, text string")).first()
    assert bytes(got.digest) == hashlib.sha256("Àbc".encode()).digest()


def test_plan_has_no_python(spark):
    plan = op3_exact_dedup(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
