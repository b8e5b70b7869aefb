"""Robust features of the gaps: statistics over all rows and per user, z, rolling quartiles, burst ratio."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tempolog.functions.scalars import clip, log_gap, quartile_us, robust_score, seconds
from tempolog.plans.quantiles import quantiles
from tempolog.plans.timeline import Timeline
from tempolog.schema import (
    FIT_EPSILON, GAP_EPSILON, HISTORY, MAD_SCALE, MIN_USER_ROWS, SCALE_FLOOR)

TINY = 1e-12


def _median_mad(rows: DataFrame, value: str, at_most: int | None) -> DataFrame:
    """One row ``n, median, mad``. The median is fetched first, so that it is computed once."""
    n, median = quantiles(rows, value, {"median": 0.5}, largest=at_most).first()
    if median is None:
        return rows.sparkSession.createDataFrame([], "n bigint, median double, mad double")
    deviations = rows.select(F.abs(F.col(value) - F.lit(median)).alias("d"))
    mad = quantiles(deviations, "d", {"mad": 0.5}, largest=at_most).first().mad
    return rows.sparkSession.createDataFrame([(n, median, mad)], "n bigint, median double, mad double")


def global_robust_stats(line: Timeline) -> DataFrame:
    """One row ``n, median, mad`` of ln(gap + eps) over every row, with a floor for a MAD of zero."""
    stats = _median_mad(line.rows.select(log_gap("gap_us").alias("x")), "x", line.total)
    return stats.withColumn("mad", F.when(F.abs("mad") <= TINY, F.lit(1e-9)).otherwise(F.col("mad")))


def user_robust_stats(line: Timeline, overall: DataFrame) -> DataFrame:
    """``uid, n, median, mad, is_fallback`` for every user; short histories and a zero MAD use the global figures."""
    rows = line.rows.select("uid", log_gap("gap_us").alias("x"))
    medians = quantiles(rows, "x", {"m": 0.5}, by=["uid"], largest=line.largest)
    centred = line.map(x=log_gap("gap_us")).attach(medians.select("uid", "m")).rows
    mads = quantiles(centred.select("uid", F.abs(F.col("x") - F.col("m")).alias("d")), "d", {"d": 0.5}, by=["uid"],
                     largest=line.largest)
    g = overall.select(F.struct("median", "mad").alias("g")).scalar()
    few = F.col("n") < MIN_USER_ROWS
    return (
        medians.join(mads.drop("n"), "uid").withColumn("g", g)
        .select(
            "uid", "n",
            F.when(few, F.col("g.median")).otherwise(F.col("m")).alias("median"),
            F.when(few | (F.abs("d") <= TINY), F.col("g.mad")).otherwise(F.col("d")).alias("mad"),
            few.alias("is_fallback"),
        )
    )


def feature_stats(line: Timeline) -> DataFrame:
    """The per-user statistics of a timeline with gaps, which are written once for the five passes this takes."""
    narrow = line.store("uid", "gap_us")
    return user_robust_stats(narrow, global_robust_stats(narrow))


def fallback_users(stats: DataFrame) -> DataFrame:
    return stats.filter("is_fallback").select("uid", "n")


def with_robust_z(line: Timeline, stats: DataFrame) -> Timeline:
    """Add ``robust_z`` (0 where the gap is 0) and ``robust_z_clipped``."""
    line = line.attach(stats.select("uid", "median", "mad"))
    z = F.when(F.col("gap_us") == 0, F.lit(0.0)).otherwise(robust_score(log_gap("gap_us"), "median", "mad"))
    return line.map(robust_z=z).map(robust_z_clipped=clip("robust_z")).drop("median", "mad")


def with_rolling(line: Timeline) -> Timeline:
    """Add the quartiles of the user's previous gaps and the burst ratio previous/current gap."""
    line = line.history("_past", "gap_us", HISTORY)
    none = F.size("_past") == 0
    before = F.when(none, F.col("gap_us")).otherwise(F.element_at("_past", -1))
    return line.map(
        prev_q25_seconds=F.when(none, seconds("gap_us")).otherwise(quartile_us("_past", 1)),
        prev_q75_seconds=F.when(none, seconds("gap_us")).otherwise(quartile_us("_past", 3)),
        burst_ratio=(seconds(before) + F.lit(GAP_EPSILON)) / (seconds("gap_us") + F.lit(GAP_EPSILON)),
    ).drop("_past")


def deltify(line: Timeline) -> Timeline:
    """All features of a timeline of users that has gaps."""
    stats = feature_stats(line)
    return with_robust_z(with_rolling(line), stats)


# --- the model's own z ----------------------------------------------------------------------------------------

def raw_scale_stats(line: Timeline) -> DataFrame:
    """One row ``median_seconds, mad_seconds, scale`` of the raw gap in seconds over every row."""
    stats = _median_mad(line.store("gap_us").rows.select(seconds("gap_us").alias("x")), "x", line.total)
    scale = F.lit(MAD_SCALE) * F.col("mad")
    return stats.select(
        F.col("median").alias("median_seconds"), F.col("mad").alias("mad_seconds"),
        F.when(scale <= 0, F.lit(1.0)).otherwise(scale).alias("scale"))


def with_model_z(line: Timeline, stats: DataFrame) -> Timeline:
    """Add ``z``, the clipped robust score of the raw session gap, as the scoring model sees it."""
    s = stats.select(F.struct("median_seconds", "scale").alias("s")).scalar()
    z = (seconds("gap_us") - F.col("_s.median_seconds")) / F.greatest(F.col("_s.scale"), F.lit(SCALE_FLOOR))
    return line.map(_s=s).map(z=clip(z)).drop("_s")


def fit_log(gap_seconds: Column) -> Column:
    return F.ln(gap_seconds + F.lit(FIT_EPSILON))
