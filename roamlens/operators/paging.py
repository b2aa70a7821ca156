"""Pages of a large ordered table by seeking.

The table is written once in ranges of its order, each sorted, with a small index
of the ranges: how many rows, first and last key. A page then opens only the
ranges it lies in, however far into the table it is; nothing is sorted but these.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from roamlens.operators.scope import MAX_PAGE


class Pages:
    """An ordered table written by :meth:`write`, opened at ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        rows = spark.read.parquet(f"{path}/index").orderBy("range").collect()  # one row a range
        self.keys, self.schema = list(rows[0]["keys"]), StructType.fromJson(json.loads(rows[0]["schema"]))
        self.ranges = [r["range"] for r in rows if r["range"] is not None]
        self.counts = [r["n"] for r in rows if r["range"] is not None]
        self.last = [tuple(r["last"]) for r in rows if r["range"] is not None]
        self.starts = [0, *accumulate(self.counts)]

    @classmethod
    def write(cls, df: DataFrame, keys: list[str], path: str, parts: int | None = None) -> Pages:
        """Sort ``df`` by ``keys`` (ascending, nulls first) into ranges under ``path``.

        ``parts`` is the number of ranges; rows equal in all keys stay in one.
        """
        on = [F.col(k) for k in keys]
        ranged = df.repartitionByRange(parts, *on) if parts else df.repartitionByRange(*on)
        ranged.withColumn("range", F.spark_partition_id()).sortWithinPartitions("range", *on).write.partitionBy("range").parquet(f"{path}/rows")
        spark = df.sparkSession
        stored = spark.read.schema(StructType([*df.schema.fields, StructField("range", IntegerType())])).parquet(f"{path}/rows")
        index = stored.groupBy("range").agg(F.count("*").alias("n"), F.max(F.struct(*on)).alias("last"))
        header = stored.limit(0).groupBy().agg(F.max("range").alias("range"), F.count("*").alias("n"), F.max(F.struct(*on)).alias("last"))
        index.unionByName(header).withColumns(
            {"keys": F.array(*[F.lit(k) for k in keys]), "schema": F.lit(df.schema.json())}
        ).coalesce(1).write.parquet(f"{path}/index")
        return cls(spark, path)

    def __len__(self) -> int:
        return self.starts[-1]

    def _read(self, first: int, last: int) -> DataFrame:
        paths = [f"{self.path}/rows/range={r}" for r in self.ranges[first:last]]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def page(self, n: int, offset: int = 0, cap: int = MAX_PAGE) -> DataFrame:
        """Rows offset … offset + n - 1 of the order."""
        if n > cap:
            raise ValueError(f"a page has at most {cap} rows, {n} asked for")
        first = max(bisect_right(self.starts, offset) - 1, 0)
        last = first
        while last < len(self.counts) and self.starts[last] < offset + n:
            last += 1
        rows = self._read(first, last) if n > 0 else self._read(0, 0)
        return rows.orderBy(*self.keys).offset(offset - self.starts[min(first, len(self.counts))]).limit(n)

    def after(self, key: list, n: int, cap: int = MAX_PAGE) -> DataFrame:
        """The first n rows behind a key (none of its values null): the next page of one who has the last row."""
        if n > cap:
            raise ValueError(f"a page has at most {cap} rows, {n} asked for")
        ordered = lambda t: tuple((x is not None, x) for x in t)
        first = 0
        while first < len(self.last) and ordered(self.last[first]) <= ordered(key):
            first += 1
        behind = F.struct(*[F.col(k) for k in self.keys]) > F.struct(*[F.lit(v).alias(k) for k, v in zip(self.keys, key)])
        last, found = first, 0
        while last < len(self.counts) and found < n:
            # the first range counts only with what lies behind the key
            found += self._read(first, first + 1).where(behind).count() if last == first else self.counts[last]
            last += 1
        return self._read(first, last).where(behind).orderBy(*self.keys).limit(n)
