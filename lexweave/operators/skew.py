"""Joins whose keys may be hot: a key that holds more than its share of all rows is joined without moving them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds over one in SHARE of all rows, so there are fewer than SHARE hot keys in any table.
SHARE = 1000


def hot_join(left: DataFrame, right: DataFrame, key: str, count: str) -> DataFrame:
    """Inner join of ``left`` with ``right``, which has one row for each key and in ``count`` its rows in ``left``.

    Hot keys' rows of ``right`` are broadcast, fewer than ``SHARE`` of them whatever the tables' sizes; the
    other keys meet by an exchange. ``count`` is not in the result. Null keys join nothing.
    """
    total = right.agg(F.sum(count).alias("n")).first()["n"] or 0
    hot = F.broadcast(right.where(F.col(count) * SHARE > total).drop(count))
    rest = left.join(hot.select(key), key, "left_anti").join(right.where(F.col(count) * SHARE <= total).drop(count), key)
    return left.join(hot, key).select(rest.columns).unionByName(rest)
