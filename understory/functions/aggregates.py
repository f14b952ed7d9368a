"""Aggregates with the null rules the inventory summaries use."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def count_true(condition: Column) -> Column:
    """Rows where ``condition`` is true; null counts as not true."""
    return F.count_if(condition)


def zero_sum(value: Column) -> Column:
    """Sum that skips nulls and is zero, not null, when nothing is left."""
    return F.coalesce(F.sum(value), F.lit(0).cast("double"))


def strict_sum(value: Column) -> Column:
    """Sum that is null as soon as one value is null."""
    return F.when(F.count(value) == F.count(F.lit(1)), F.sum(value))


def mean(value: Column) -> Column:
    """Mean over the non-null values."""
    return F.avg(value)
