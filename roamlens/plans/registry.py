"""All registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from roamlens.operators.grains import metrics_bundle
from roamlens.plans import (
    block_queries, label_queries, lf_catalog, metric_queries, model_queries, occupancy_queries, oracle_metrics,
)
from roamlens.sources import driver_tables as T


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics, _, _ = lf_catalog._rules(1, lf_catalog.DOCUMENTED)
    return metrics_bundle(T.sessions(spark, sf_dir), metrics, None, T.dims(spark, sf_dir))


def queries() -> dict:
    return metric_queries.QUERIES | block_queries.QUERIES | occupancy_queries.QUERIES | label_queries.QUERIES | model_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    sql = oracle_metrics.METRIC_SQL | block_queries.SQL | occupancy_queries.SQL | label_queries.SQL | model_queries.SQL
    return {k: oracle_metrics.with_fixture(v) for k, v in sql.items()}
