"""Seek paging and batch votes."""

import pytest
from pyspark.sql import functions as F

from roamlens.operators.paging import Pages
from roamlens.operators.votes import lf_batch


def test_pages_open_only_their_ranges(spark, tmp_path):
    df = spark.range(5000).selectExpr("CASE WHEN id % 50 = 0 THEN NULL ELSE CAST(pmod(xxhash64(id), 300) AS INT) END AS k", "id").repartition(7)
    want = [tuple(r) for r in df.orderBy("k", "id").collect()]
    pages = Pages.write(df, ["k", "id"], str(tmp_path / "p"), parts=12)
    assert len(pages) == 5000 and len(pages.counts) > 6
    for n, offset in ((10, 0), (100, 95), (500, 2400), (7, 4996), (5, 5000), (5, 9000), (0, 3)):
        got = pages.page(n, offset)
        assert [tuple(r) for r in got.collect()] == want[offset : offset + n]
    files = pages.page(20, 3000).inputFiles()
    assert 1 <= len({f.split("range=")[1].split("/")[0] for f in files}) <= 2
    for at in (150, 2222, 4990):
        assert [tuple(r) for r in Pages(spark, pages.path).after(list(want[at]), 30).collect()] == want[at + 1 : at + 31]
    with pytest.raises(ValueError):
        pages.page(501)


def test_pages_of_an_empty_table(spark, tmp_path):
    pages = Pages.write(spark.range(0), ["id"], str(tmp_path / "p"), parts=3)
    assert len(pages) == 0 and pages.page(5).collect() == [] and pages.after([3], 5).collect() == []


def test_failing_batches_are_halved_to_the_bad_rows(spark):
    calls = spark.sparkContext.accumulator(0)

    def rule(rows):
        calls.add(1)
        if (rows.x % 100 == 7).any():
            raise ValueError("refused")
        return [5 if x % 3 == 0 else (None if x % 3 == 1 else 8) for x in rows.x]

    lf = lf_batch("third", rule, ["x"], (5, 6))
    got = {r.x: r.v for r in spark.range(1000).coalesce(1).select(F.col("id").alias("x")).select("x", lf.vote.alias("v")).collect()}
    assert got == {x: (5 if x % 3 == 0 and x % 100 != 7 else -1) for x in range(1000)}
    assert calls.value < 10 * 2 * 12

    short = lf_batch("short", lambda rows: [1] * min(len(rows), 3), ["x"], (1,))
    rows = spark.range(9).select(F.col("id").alias("x")).coalesce(1).select(short.vote.alias("v")).collect()
    assert {r.v for r in rows} == {1}


def test_refused_rows_cost_about_a_call_each(spark):
    calls = spark.sparkContext.accumulator(0)

    def rule(rows):
        calls.add(1)
        if (rows.x > 89).any():
            raise ValueError("refused")
        return rows.x % 3

    lf = lf_batch("third", rule, ["y", "x"], (0, 1))
    df = spark.range(6000).selectExpr("id * 7919 % 6000 AS y", "CASE WHEN id % 50 = 3 THEN NULL ELSE id * 37 % 100 END AS x").coalesce(1)
    got = df.select("y", "x", lf.vote.alias("v")).collect()
    assert len(got) == 6000
    assert all(r.v == (r.x % 3 if r.x is not None and r.x <= 89 and r.x % 3 < 2 else -1) for r in got)
    refused = sum(r.x is not None and r.x > 89 for r in got)
    assert calls.value < 2.5 * refused


def test_trials_go_on_from_batch_to_batch(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    try:
        test_refused_rows_cost_about_a_call_each(spark)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
