"""Joins that know the size of one side, or how often its keys occur."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_IDS = 1_000_000  # 8 MB; larger sets are joined by a shuffle
HOT_KEYS = 2000  # a key with more than this part of all counted rows is hot, so there are fewer hot keys than this


def _by_ids(rows: DataFrame, ids: DataFrame, how: str, doc_id: str) -> DataFrame:
    """``ids`` is a stored frame of one long column without nulls or repeats; its size is looked up first."""
    ids = ids.select(F.col(ids.columns[0]).alias(doc_id))
    small = ids.count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if small else ids, doc_id, how).select(*rows.columns)


def without_ids(rows: DataFrame, ids: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Rows whose id is not among ``ids``; rows without an id stay."""
    return _by_ids(rows, ids, "left_anti", doc_id)


def with_ids(rows: DataFrame, ids: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Rows whose id is among ``ids``."""
    return _by_ids(rows, ids, "left_semi", doc_id)


def join_by_frequency(rows: DataFrame, table: DataFrame, key: str, count: str) -> DataFrame:
    """Inner join of ``rows`` to ``table``, a stored frame that has each key once and its number of rows.

    Keys that hold more than one in HOT_KEYS of the counted rows number less than
    HOT_KEYS, however large the data: they are broadcast, and their rows are not
    moved. All others are joined by a shuffle, in which no key is large. Where all
    keys are of one kind there is one join only: a broadcast takes the driver some MB,
    empty or not.
    """
    total, fewest, most = table.agg(F.sum(count), F.min(count), F.max(count)).first()
    if not total or most * HOT_KEYS <= total:
        return rows.join(table.drop(count), key)
    hot = F.broadcast(table.where(F.col(count) * HOT_KEYS > total).drop(count))
    if fewest * HOT_KEYS > total:
        return rows.join(hot, key)
    rest = table.where(F.col(count) * HOT_KEYS <= total).drop(count)
    cold = rows.join(hot.select(key), key, "left_anti").join(rest, key)
    return rows.join(hot, key).unionByName(cold)
