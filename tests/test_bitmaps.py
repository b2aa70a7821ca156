"""Distinct counts by bitmaps against count_distinct."""

from pyspark.sql import functions as F

from roamlens.operators import bitmaps as M, tree as R
from tests.conftest import sessions


def test_numbers_have_no_gaps_and_keep_homes_together(spark):
    s = spark.range(70_000).selectExpr("concat('d', id % 40000) AS mac_address", "CAST(id % 40000 % 7 AS INT) AS space_id")
    s = s.unionByName(spark.createDataFrame([(None, 1), ("lost", None)], "mac_address STRING, space_id INT"))
    numbers = M.dense_numbers(s, blocks=5)
    got = numbers.agg(F.count("*"), F.count_distinct("mac_address"), F.min("number"), F.max("number"), F.count_distinct("number")).first()
    assert tuple(got) == (40_001, 40_001, 0, 40_000, 40_001)
    homes = numbers.join(s.groupBy("mac_address").agg(F.min("space_id").alias("home")), "mac_address")
    ranges = sorted(tuple(r) for r in homes.where("home IS NOT NULL").groupBy("home").agg(F.min("number"), F.max("number")).collect())
    assert all(a[2] < b[1] for a, b in zip(ranges, ranges[1:]))
    by = M.distinct_by(s.where("space_id IS NOT NULL"), ["space_id"], numbers)
    want = s.where("space_id IS NOT NULL").groupBy("space_id").agg(F.count_distinct("mac_address").alias("n"))
    assert by.exceptAll(want).count() == 0 and want.exceptAll(by).count() == 0


def test_rollup_counts_a_device_in_two_rooms_once(spark):
    tree = spark.createDataFrame([(1, None), (2, 1), (3, 1)], "space_id INT, parent_space_id INT")
    s = sessions(spark, [("a", 2, "01:00", "01:10"), ("a", 3, "01:20", "02:30"), ("b", 3, "01:00", "01:10"), ("b", 1, "04:00", "04:00")])
    got = M.distinct_rollup_bitmaps(s, tree, 3600)
    want = R.distinct_rollup(s, tree, 3600)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 5
