"""Joins whose null keys match each other, as grouping treats them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from understory.sources.shared import cut_lineage

# Key columns packed into one struct. Inside a struct, null equals null, and a
# table grouped by the struct is already partitioned for a join on it.
PACKED = "_key"

# A key with more than this part of all counted rows is hot; there are fewer hot keys than this.
HOT_KEYS = 2000
# Pieces that all rows together would be split into; a hot key gets its share of them.
PIECES = 8 * HOT_KEYS


def pack(keys: Sequence[str]) -> Column:
    return F.struct(*keys).alias(PACKED)


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Equi join on ``on`` in which null keys match; keeps the left keys.

    A left side that was grouped by :func:`pack` and still carries the packed
    key is not shuffled again. No broadcast is asked for: the right side may
    grow with the data. Spark still picks one where the size it measures allows
    it, and splits skewed sort-merge partitions at run time.
    """
    if PACKED not in left.columns:
        left = left.select("*", pack(on))
    semi = how in ("left_semi", "left_anti")
    columns = [pack(on)] if semi else [pack(on), *[c for c in right.columns if c not in on]]
    return left.join(right.select(*columns), PACKED, how).drop(PACKED)


def join_by_frequency(
    rows: DataFrame, table: DataFrame, on: Sequence[str], count: Column, spread: Column, how: str = "left",
) -> DataFrame:
    """Join ``rows`` to ``table``, which has each key once, by how often keys occur; null keys match.

    ``count`` is a key's number of rows, a column of ``table``. Keys with more than one in HOT_KEYS
    of the counted rows are hot. They number less than HOT_KEYS whatever the data, so they are
    broadcast, each with a number of pieces in proportion to its count. Their rows are dealt over
    those pieces by ``spread`` in the shuffle that all other rows need. ``how`` is left or inner.
    """
    carried = [c for c in table.columns if c not in on]
    counted = table.select(*on, F.struct(*carried).alias("_row"), count.cast("double").alias("_count"))
    total = counted.agg(F.sum("_count").alias("_count")).scalar()
    hot = F.col("_count") * HOT_KEYS > total
    pieces = F.ceil(F.col("_count") * PIECES / total).cast("int")
    few = counted.where(hot).select(*on, F.col("_row").alias("_hot"), pieces.alias("_pieces"))
    met = null_safe_join(rows, F.broadcast(few), on).withColumn("_salt", salt(F.col("_pieces"), spread))
    most = counted.where(~hot).select(*on, F.lit(0).alias("_salt"), F.col("_row").alias("_cold"))
    joined = null_safe_join(met, most, [*on, "_salt"]).withColumn("_row", F.coalesce("_hot", "_cold"))
    joined = joined if how == "left" else joined.where(F.col("_row").isNotNull())
    return joined.select(*rows.columns, *[F.col(f"_row.{c}").alias(c) for c in carried])


def salt(pieces: Column, spread: Column) -> Column:
    """0 for keys that are not hot; for others one of ``pieces`` numbers from 1."""
    return F.when(pieces.isNull(), 0).otherwise(F.lit(1) + F.pmod(F.xxhash64(spread), pieces)).cast("int")


def join_group_statistics(
    rows: DataFrame, statistics: DataFrame, by: Sequence[str], value: str,
    closed: Mapping[str, Sequence[str]] | None, count: Column,
) -> DataFrame:
    """Give each value the statistics of its group; ``_n`` counts equal values.

    Where ``closed`` lists the values of every group column, groups of other values
    than those and null are dropped, so there are no more groups than combinations:
    the statistics, one row per group, are broadcast and the rows stay where they
    are. Otherwise equal values of a group are counted first, so copies collapse
    before the shuffle, and a large group is spread by value over pieces in proportion
    to ``count``, the rows of a group, a column of ``statistics``, which are stored for it.
    """
    if closed is not None:
        if set(closed) != set(by):
            raise ValueError("every group column needs its closed domain")
        for name, levels in closed.items():
            statistics = statistics.where(F.col(name).isNull() | F.col(name).isin(*levels))
        return null_safe_join(rows.withColumn("_n", F.lit(1).cast("long")), F.broadcast(statistics), by, "inner")
    counted = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    return join_by_frequency(counted, cut_lineage(statistics), by, count, F.col(value), "inner")
