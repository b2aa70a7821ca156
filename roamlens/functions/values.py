"""Ratios, conditional counts, interval overlap, AP-name tests, JSON filters."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from roamlens.functions.times import col, span_us

LABEL_FILTER_TYPE = T.StructType(
    [
        T.StructField(
            "labels",
            T.MapType(
                T.StringType(),
                T.StructType([T.StructField("min_confidence", T.DoubleType())]),
            ),
        )
    ]
)


def ratio(num: Column | str, den: Column | str) -> Column:
    """num / den as DOUBLE, NULL when the denominator is 0."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def or_zero(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(0))


def count_where(p: Column) -> Column:
    return F.count_if(p)


def sum_where(p: Column, value: Column | str) -> Column:
    """Sum of ``value`` over rows where ``p`` holds, 0 when there is none."""
    return F.sum(F.when(p, col(value)).otherwise(F.lit(0)))


def distinct_where(p: Column, value: Column | str) -> Column:
    return F.count_distinct(F.when(p, col(value)))


def overlaps(a_start, a_end, b_start, b_end, inclusive: bool = False) -> Column:
    a_start, a_end, b_start, b_end = map(col, (a_start, a_end, b_start, b_end))
    if inclusive:
        return (a_start <= b_end) & (b_start <= a_end)
    return (a_start < b_end) & (b_start < a_end)


def overlap_us(a_start, a_end, b_start, b_end) -> Column:
    return span_us(
        F.greatest(col(a_start), col(b_start)), F.least(col(a_end), col(b_end))
    )


def ap_contains(ap: Column | str, text: str) -> Column:
    return col(ap).contains(text)


def ap_building(ap: Column | str) -> Column:
    """First dash-separated part of an AP name without its last character."""
    head = F.substring_index(col(ap), "-", 1)
    return F.substring(head, F.lit(1), F.length(head) - F.lit(1))


def parse_label_filter(doc: Column | str) -> Column:
    """{"labels": {"<class>": {"min_confidence": x}}} as a typed struct."""
    return F.from_json(col(doc), LABEL_FILTER_TYPE)
