"""Joins whose behaviour does not depend on how often a key occurs."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

BROADCAST_ROWS = 1_000_000  # a looked-up table is broadcast only up to this many rows

ROWS_SETTING = "spark.tempolog.rowsPerTask"
ROWS_PER_TASK = 500_000     # rows of an exchange that one task sorts or joins, where their number is known


def spread(df: DataFrame, rows: int, keys: Iterable[str]) -> DataFrame:
    """Rows dealt by ``keys`` over enough tasks for ``rows`` of them, if the session's shuffle partitions are too few.

    Only for keys none of which has many rows, as the rows of a key stay together.
    """
    conf = df.sparkSession.conf
    tasks = math.ceil(rows / int(conf.get(ROWS_SETTING, str(ROWS_PER_TASK))))
    return df if tasks <= int(conf.get("spark.sql.shuffle.partitions")) else df.repartition(tasks, *keys)


def match_all(left: DataFrame, right: DataFrame, keys: Iterable[str], how: str, broadcast: bool = False) -> DataFrame:
    """Equi-join on ``keys`` with null equal to null, keeping the left key columns."""
    keys = list(keys)
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    condition = F.lit(True)
    for i, k in enumerate(keys):
        same = F.col(k).eqNullSafe(F.col(f"_right_{k}"))
        condition = same if i == 0 else condition & same
    joined = left.join(F.broadcast(renamed) if broadcast else renamed, condition, how)
    return joined.drop(*[f"_right_{k}" for k in keys])


def broadcast_hot(df: DataFrame, hot: DataFrame, keys: Iterable[str]) -> tuple[DataFrame, DataFrame]:
    """Split rows into those whose key is not in ``hot`` and those whose key is (hot lists are short by construction)."""
    keys = list(keys)
    return match_all(df, hot, keys, "left_anti", broadcast=True), match_all(df, hot, keys, "left_semi", broadcast=True)


def lookup(rows: DataFrame, table: DataFrame, on: Iterable[str]) -> DataFrame:
    """Left join of a large row set to a table with one row per key.

    The table should be stored (a read or a checkpoint), as its rows are counted first. A short table is
    broadcast. A long one is broadcast only for the keys that are frequent in ``rows`` or null; the other
    rows go through an ordinary shuffled join.
    """
    from tempolog.plans.timeline import group_sizes, hot_limit

    on = list(on)
    if table.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), on, "left")
    total, _, largest, counts = group_sizes(rows, on)
    limit = hot_limit(rows, total)
    if largest <= limit:
        return spread(rows, total, on).join(spread(table, total, on), on, "left")
    hot = counts.filter(F.col("_rows") > limit).drop("_rows")
    cold_rows, hot_rows = broadcast_hot(rows, hot, on)
    hot_table = match_all(table, hot, on, "left_semi", broadcast=True)
    return cold_rows.join(table, on, "left").unionByName(hot_rows.join(F.broadcast(hot_table), on, "left"))
