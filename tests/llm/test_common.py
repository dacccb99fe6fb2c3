from pyspark.sql import functions as F

from termloom.llm import common


def test_bounded_sample_is_the_smallest_hashes(spark):
    rows = spark.range(50_000).select(F.col("id"), (F.col("id") % 3).alias("label"))
    want = {r.id for r in rows.orderBy(F.xxhash64(F.lit(5), "id"), "id").limit(1000).collect()}
    assert {r.id for r in common.bounded_sample(rows, "id", 1000, 5, "label").collect()} == want
    assert common.bounded_sample(rows.limit(10), "id", 1000, 5).count() == 10
    assert common.bounded_sample(rows.limit(0), "id", 1000, 5).count() == 0


def test_ascii_lower_and_words(spark):
    rows = spark.createDataFrame([("ABC É\x85x",), (None,), ("ABC",)], "t string")
    assert [r[0] for r in rows.select(common.ascii_lower(F.col("t"))).collect()] == ["abc É\x85x", "", "abc"]
    assert [r[0] for r in rows.select(common.n_words(F.col("t"))).collect()] == [2, 0, 1]


def test_repeated_ids_dont_shrink_the_sample(spark):
    rows = spark.range(30_000).union(spark.range(300_000).select(F.lit(7).cast("long")))
    got = common.bounded_sample(rows, "id", 20_000, 5).collect()
    order = rows.orderBy(F.xxhash64(F.lit(5), "id"), "id").limit(20_000).collect()
    assert len(got) == 20_000 and sorted(r.id for r in got) == sorted(r.id for r in order)
