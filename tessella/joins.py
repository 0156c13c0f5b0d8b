"""Joins that stay safe when one key holds a large part of the rows."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

#: A side is broadcast only if it has at most this many rows.
BROADCAST_ROWS = 20_000
#: Keys of more rows than HOT_ROWS are hot, of those at most the HOT_KEYS largest; any other key has less than a thousandth of the rows.
HOT_ROWS = 50_000
HOT_KEYS = 1_000


def hot_keys(df: DataFrame, keys: list[str]) -> list[Row]:
    """The hot keys of ``df``, at most HOT_KEYS; null keys aren't counted."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > HOT_ROWS)
    top = counts.where(reduce(and_, [F.col(k).isNotNull() for k in keys])).orderBy(F.desc("__n"), *keys).limit(HOT_KEYS).select(*keys)
    return top.collect()


def split_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", rows: int | None = None) -> DataFrame:
    """Join a table to one in which ``keys`` are unique, where neither is small.

    Rows with a hot key meet the few entries of hot keys by broadcast, all
    others by a shuffle in which no key is hot. Null keys match nothing and
    stay out of the shuffle. ``how`` is inner or left. Who knows the number of
    rows of ``big`` gives it: too few for a hot key need no search for one.
    """
    known = big.where(reduce(and_, [F.col(k).isNotNull() for k in keys]))
    hot = [] if rows is not None and rows <= HOT_ROWS else hot_keys(big.select(*keys), keys)
    if not hot:
        out = known.join(small, keys, how)
    else:
        few = F.broadcast(big.sparkSession.createDataFrame(hot, big.select(*keys).schema))
        out = known.join(few, keys, "left_anti").join(small, keys, how)
        out = out.unionByName(known.join(few, keys, "left_semi").join(F.broadcast(small.join(few, keys, "left_semi")), keys, how))
    if how == "inner":
        return out
    return out.unionByName(big.where(reduce(or_, [F.col(k).isNull() for k in keys])), allowMissingColumns=True)


def lookup_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "left", rows: int | None = None) -> DataFrame:
    """Join ``big`` to a lookup table with unique ``keys``.

    The lookup side is counted first, no further than BROADCAST_ROWS rows, up
    to which it is broadcast; beyond, ``split_join`` sets hot keys apart. Null
    keys match nothing.
    """
    n = small.limit(BROADCAST_ROWS + 1).count() if rows is None else rows
    if n <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), keys, how)
    return split_join(big, small, keys, how)
