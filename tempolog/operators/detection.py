"""Detectors: predicates over a table of events that find what the injectors put in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tempolog.plans.joins import lookup
from tempolog.plans.timeline import Timeline, timeline
from tempolog.schema import CLIP, PROTECTED_OPS


def is_protected(op: str | Column, protected: Sequence[str] = PROTECTED_OPS) -> Column:
    op = F.col(op) if isinstance(op, str) else op
    return F.upper(F.trim(op)).isin([p.strip().upper() for p in protected])


def detect_order(pairs: DataFrame, allowed: DataFrame) -> DataFrame:
    """Next-event pairs ``prev_op -> op`` that are not in the stored table ``allowed(prev_op, op)``."""
    known = allowed.select("prev_op", "op").distinct().withColumn("_allowed", F.lit(True))
    return lookup(pairs, known, ["prev_op", "op"]).filter("_allowed is null").drop("_allowed")


def detect_unauth(line: Timeline, auth: Sequence[str] = ("AUTH",), protected: Sequence[str] = PROTECTED_OPS) -> DataFrame:
    """Protected operations with no earlier authentication in the same session."""
    signed_in = F.when(is_protected("op", auth), 1)
    line = line.running("max", "_signed_in", signed_in, inclusive=False)
    return line.rows.filter(is_protected("op", protected) & F.col("_signed_in").isNull()).drop("_signed_in")


def session_owners(events: DataFrame, tie: Sequence[str]) -> DataFrame:
    """``session_id, owner``: the user seen first with each session id."""
    return events.groupBy("session_id").agg(F.min_by("uid", F.struct("ts_us", *tie)).alias("owner"))


def detect_token_replay(events: DataFrame, tie: Sequence[str]) -> DataFrame:
    """Events whose session id belongs to somebody else. A session id may be as frequent as it likes."""
    line = timeline(events, ["session_id"], ["ts_us", *tie])
    owned = line.attach(session_owners(events, tie)).rows
    return owned.filter(F.col("uid") != F.col("owner"))


def detect_time(scored: DataFrame) -> DataFrame:
    """Scored events whose wait is beyond the clip bound or beyond its operation's threshold."""
    return scored.filter((F.abs("z") >= CLIP) | (F.col("flag_dt") == 1))
