"""Lookup join that stays balanced when a few keys hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_KEYS = 1000
BROADCAST_ROWS = 100_000


def lookup_join(
    rows: DataFrame, table: DataFrame, key: list[str], how: str = "inner", table_rows: int | None = None
) -> DataFrame:
    """Join ``rows`` (inner or left) with a ``table`` that is unique on ``key``.

    A table counted to be small is broadcast. Otherwise the HOT_KEYS most frequent keys of
    ``rows`` meet their table entries by broadcast, which is at most HOT_KEYS entries
    whatever the data size. Every other key holds less than 1/HOT_KEYS of the rows, so the
    shuffle join of the rest is even. No row is dropped.
    """
    if table_rows is not None and table_rows <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), key, how)
    frequent = (
        rows.groupBy(*key)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter("_n > 1")
        .orderBy(F.desc("_n"), *key)
        .limit(HOT_KEYS)
        .select(*key)
    )
    hot = rows.join(F.broadcast(frequent.join(table, key, how)), key)
    rest = rows.join(F.broadcast(frequent), key, "left_anti").join(table, key, how)
    return hot.unionByName(rest)
