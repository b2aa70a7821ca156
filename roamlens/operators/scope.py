"""Entity sets, scoping, bound SQL, paging and name search."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, functions as F

from roamlens.session import sized_broadcast

KEY = "mac_address"
MAX_PAGE = 500


def entity_index(df: DataFrame, key: str = KEY) -> DataFrame:
    """The set of unique keys of a table."""
    if key not in df.columns:
        raise ValueError(f"key column '{key}' not in {df.columns}")
    return df.select(key).distinct()


def scope_to(df: DataFrame, entities: DataFrame | None, key: str = KEY) -> DataFrame:
    """Keep the rows of the given entities; None keeps everything.

    A left semi join. The entity side is broadcast only when it is counted to
    be small; otherwise both sides meet by shuffle.
    """
    if entities is None:
        return df
    return df.join(sized_broadcast(entities.select(key).distinct()), key, "left_semi")


def bind_query(
    sql: str,
    entities: DataFrame,
    tables: dict[str, DataFrame] | None = None,
    params: dict | None = None,
    key: str = KEY,
) -> DataFrame:
    """Run a SQL template holding ``:index_values`` and ``{{param}}``.

    ``IN (:index_values)`` becomes a subquery over a temp view of the entity
    set, so no key list goes through the driver; ``{{param}}`` becomes a named
    parameter, so values are bound and never spliced in as text.
    """
    spark = entities.sparkSession
    view = f"entities_{uuid.uuid4().hex}"
    entities.select(key).createOrReplaceTempView(view)
    for name, df in (tables or {}).items():
        df.createOrReplaceTempView(name)
    sql = sql.replace(":index_values", f"SELECT {key} FROM {view}")
    sql = re.sub(r"\{\{\s*(\w+)\s*\}\}", r":\1", sql)
    return spark.sql(sql, args=params or {})


def preview(df: DataFrame, order_by, n: int = 100, offset: int = 0, cap: int = MAX_PAGE) -> DataFrame:
    """One page in an explicit order; a page longer than ``cap`` is an error."""
    if n > cap:
        raise ValueError(f"a page has at most {cap} rows, {n} asked for")
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    return df.orderBy(*keys).offset(offset).limit(n)


def find_spaces(space: DataFrame, pattern: str | None = None, skip: int = 0, limit: int | None = None) -> DataFrame:
    """Spaces whose name contains ``pattern``, ignoring case, by name; all of
    them unless ``limit`` is given."""
    if pattern:
        space = space.where(F.col("space_name").ilike(f"%{pattern}%"))
    found = space.orderBy("space_name", "space_id").offset(skip)
    return found if limit is None else found.limit(limit)
