"""Evenly spaced series from scored events, and control metrics over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tempolog.functions.scalars import seconds
from tempolog.plans.quantiles import quantiles
from tempolog.plans.timeline import timeline


def as_signals(scored: DataFrame, series: str) -> DataFrame:
    """``series, ts_us, ref, y, y_base`` from a scored table."""
    return scored.select(
        F.col(series).alias("series"), "ts_us", F.col("S").alias("ref"), F.col("s_time").alias("y"),
        F.col("flag_dt").cast("double").alias("y_base"))


def resample_linear(signals: DataFrame, columns: Sequence[str] = ("ref", "y", "y_base")) -> DataFrame:
    """Resample each series on the grid ``k * median gap``, k below its number of samples, by linear interpolation.

    Times count from the first sample. Each sample also provides the grid point of its own number, so no grid
    is generated from nothing; samples and grid points are then put in one order and every grid point looks at
    the nearest sample on either side. Times are in half microseconds, which makes a median of two gaps whole.
    """
    line = timeline(signals, ["series"], ["ts_us"]).previous(_before="ts_us").position("_n")
    line = line.map(_gap=F.col("ts_us") - F.col("_before"))
    rows = line.rows
    steps = quantiles(rows.select("series", "_gap"), "_gap", {"step": 0.5}, by=["series"], largest=line.largest)
    starts = rows.groupBy("series").agg(F.min("ts_us").alias("_t0"))
    per_series = starts.join(steps.drop("n"), "series", "left")
    placed = line.attach(per_series).rows.select(
        "series", (F.col("_n") - 1).alias("k"), ((F.col("ts_us") - F.col("_t0")) * 2).alias("_at"),
        F.coalesce(F.rint(F.col("step") * 2).cast("bigint"), F.lit(0)).alias("_step"), *columns)

    sample = F.struct(F.col("_at").alias("t"), *columns)
    nothing = F.when(F.lit(False), sample)
    # At equal times the sample comes first, so that the grid point finds it as its left neighbour.
    kinds = F.array(
        F.struct(F.col("_at"), F.lit(0).alias("_side"), F.lit(-1).cast("bigint").alias("k"), sample.alias("_s")),
        F.struct((F.col("k") * F.col("_step")).alias("_at"), F.lit(1).alias("_side"), F.col("k"), nothing.alias("_s")))
    points = placed.select("series", F.explode(kinds).alias("p")).select("series", "p.*")
    left = timeline(points, ["series"], ["_at", "_side", "k"], largest=2 * line.largest).running("last", "_left", "_s")
    # The next sample is the previous one in the reversed order.
    right = left.map(_back=-F.col("_at"), _side_back=-F.col("_side"), _k_back=-F.col("k"))
    right = right.backwards("_back", "_side_back", "_k_back").running("last", "_right", "_s")
    both = right.rows.filter("_side = 1")

    l, r = F.col("_left"), F.coalesce("_right", "_left")
    ratio = F.when(r["t"] > l["t"], (F.col("_at") - l["t"]) / (r["t"] - l["t"])).otherwise(F.lit(0.0))
    out = [(l[c] + ratio * (r[c] - l[c])).alias(c) for c in columns]
    return both.select("series", F.col("k").cast("bigint").alias("k"), (F.col("_at") / F.lit(2e6)).alias("t"), *out)


def control_errors(series: DataFrame, y: str = "y") -> DataFrame:
    """``series, iae, ise, itae``: absolute, squared and time-weighted absolute error over time (first step 0)."""
    line = timeline(series, ["series"], ["t"]).previous(_before="t")
    dt = F.coalesce(F.col("t") - F.col("_before"), F.lit(0.0))
    e = F.col("ref") - F.col(y)
    return line.rows.groupBy("series").agg(
        F.sum(F.abs(e) * dt).alias("iae"), F.sum(e * e * dt).alias("ise"), F.sum(F.col("t") * F.abs(e) * dt).alias("itae"))


def step_response(series: DataFrame, y: str = "y") -> DataFrame:
    """``series, rise_time, settling_time, overshoot_pct, steady_state_error``; null where a level is never reached.

    Settled means every later sample is within two percent of the final reference: that is the sample after the
    last one outside, or the first sample if none is outside.
    """
    line = timeline(series, ["series"], ["t"]).following(_after="t")
    ends = line.rows.groupBy("series").agg(F.max_by("ref", "t").alias("ref_ss"), F.max_by(y, "t").alias("y_ss"))
    rows = line.attach(ends).rows
    value, ref = F.col(y), F.col("ref_ss")
    outside = F.abs(value - ref) > F.lit(0.02) * F.abs(ref)
    found = rows.groupBy("series", "ref_ss", "y_ss").agg(
        F.min(F.when(value >= F.lit(0.1) * ref, F.col("t"))).alias("t10"),
        F.min(F.when(value >= F.lit(0.9) * ref, F.col("t"))).alias("t90"),
        F.min("t").alias("t0"), F.max(value).alias("peak"),
        F.count(F.when(outside, 1)).alias("n_outside"),
        F.max_by(F.struct(F.col("_after").alias("t")), F.when(outside, F.col("t"))).alias("last_outside"))
    return found.select(
        "series",
        (F.col("t90") - F.col("t10")).alias("rise_time"),
        F.when(F.col("n_outside") == 0, F.col("t0")).otherwise(F.col("last_outside.t")).alias("settling_time"),
        F.when(ref != 0, F.greatest(F.lit(0.0), (F.col("peak") - ref) / ref * 100)).alias("overshoot_pct"),
        (ref - F.col("y_ss")).alias("steady_state_error"))
