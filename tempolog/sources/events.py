"""From any activity table to the columns the operators work on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tempolog.functions.scalars import log_gap, micros, seconds


def as_events(
    df: DataFrame,
    uid: str,
    ts: str,
    op: str,
    tie: Sequence[str] = (),
    session: str | Column | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Project a table to ``uid, ts_us, tie..., op`` (and ``session_id``) with integer microseconds.

    ``tie`` names the columns that make the order inside a user unique; they keep their names, as do ``keep``.
    """
    columns = {
        "uid": F.col(uid).cast("string"),
        "ts_us": micros(df, ts),
        "op": F.col(op).cast("string"),
    }
    if session is not None:
        columns["session_id"] = (F.col(session) if isinstance(session, str) else session).cast("string")
    plain = [c for c in dict.fromkeys([*tie, *keep])]
    return df.select(*[c.alias(n) for n, c in columns.items()], *plain)


# Contract columns that the operators carry along but do not read.
CARRIED = ("method", "path", "referer", "user_agent", "ip")


def from_contract(df: DataFrame, tie: Sequence[str] = ()) -> DataFrame:
    """The same projection for a table that already has the nine contract columns; the others are carried along."""
    return as_events(df, "uid", "timestamp_utc", "op_category", tie=tie, session="session_id", keep=CARRIED)


def to_stage(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Back to the columns of a stage table (sessioned or deltified), in its order."""
    computed = {
        "timestamp_utc": F.timestamp_micros("ts_us"), "op_category": F.col("op"),
        "delta_t_seconds": seconds("gap_us"), "log_delta_t": log_gap("gap_us"),
    }
    return rows.select(*[computed.get(c, F.col(c)).alias(c) for c in columns])
