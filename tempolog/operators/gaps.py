"""Gaps between events, the choice of a session threshold, and sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tempolog.functions.scalars import log_gap, seconds
from tempolog.plans.quantiles import quantiles
from tempolog.plans.timeline import Timeline, timeline
from tempolog.session import durable
from tempolog.schema import (
    DEFAULT_THRESHOLD_SECONDS, GAP_EPSILON, MAX_BINS, MIN_BINS, OTSU_MAX_RATIO)


def user_timeline(events: DataFrame, tie: Sequence[str]) -> Timeline:
    return timeline(events, ["uid"], ["ts_us", *tie])


def session_timeline(events: DataFrame, tie: Sequence[str]) -> Timeline:
    """For tables that bring their own sessions. Sliced by user, since a session never has more rows than its user."""
    return user_timeline(events, tie).within("uid", "session_id")


def with_user_gap(line: Timeline) -> Timeline:
    """Add ``gap_us`` to the user's previous event, 0 on the user's first event, and ``is_first``."""
    line = line.previous(_before="ts_us")
    gap = F.coalesce(F.greatest(F.col("ts_us") - F.col("_before"), F.lit(0)), F.lit(0)).cast("bigint")
    return line.map(gap_us=gap, is_first=F.col("_before").isNull()).drop("_before")


def with_session_gap(line: Timeline) -> Timeline:
    """Add ``gap_us`` inside ``(uid, session_id)``, 0 on the session's first event."""
    return with_user_gap(line.within("uid", "session_id"))


def positive_gaps(line: Timeline) -> DataFrame:
    return line.rows.filter("gap_us > 0").select("gap_us")


# --- histogram and Otsu -------------------------------------------------------------------------------------

def gap_statistics(gaps: DataFrame, at_most: int | None = None) -> DataFrame:
    """One row: count, range and quartiles of ln(gap + eps), the Freedman-Diaconis width and the number of bins.

    ``at_most`` is an upper bound of the number of gaps, if known.
    """
    logs = gaps.select(log_gap("gap_us").alias("x"))
    stats = quantiles(logs, "x", {"min_log": 0.0, "q25": 0.25, "q75": 0.75, "max_log": 1.0}, largest=at_most)
    span = F.col("max_log") - F.col("min_log")
    scale = F.greatest(F.abs("max_log"), F.abs("min_log"))
    constant = span <= F.greatest(F.lit(1e-12) * scale, F.lit(1e-12))
    fd = F.lit(2.0) * (F.col("q75") - F.col("q25")) / F.pow(F.col("n").cast("double"), F.lit(1.0 / 3.0))
    width = F.when(fd > 0, fd).otherwise(span / 64)
    bins = F.least(F.lit(MAX_BINS), F.greatest(F.lit(MIN_BINS), F.ceil(span / F.col("fd_width")).cast("int")))
    return (
        stats.filter("n > 0")
        .withColumn("fd_width", F.when(~constant, width))
        .withColumn("bin_count", F.when(constant, F.lit(1)).otherwise(bins))
        .withColumn("bin_width", span / F.col("bin_count"))
    )


def gap_histogram(gaps: DataFrame, stats: DataFrame) -> DataFrame:
    """``bin, lo, hi, n`` with every bin present (at most 256 rows). The one row of statistics is fetched first."""
    spark, s = gaps.sparkSession, stats.first()
    if s is None:
        return spark.createDataFrame([], "bin int, lo double, hi double, n bigint")
    last = F.lit(s.bin_count - 1)
    x = F.col("x")
    inside = F.greatest(F.lit(0), F.least(last, F.floor((x - s.min_log) / F.lit(s.bin_width or 1.0)).cast("int")))
    place = last if s.bin_count == 1 else F.when(x >= s.max_log, last).otherwise(inside)
    counts = gaps.select(log_gap("gap_us").alias("x")).groupBy(place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    bins = spark.range(s.bin_count).select(F.col("id").cast("int").alias("bin"))
    edge = lambda k: F.lit(s.min_log) + k * F.lit(s.bin_width)
    return bins.join(F.broadcast(counts), "bin", "left").select(
        "bin", edge(F.col("bin")).alias("lo"), edge(F.col("bin") + 1).alias("hi"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def otsu_threshold(histogram: DataFrame) -> DataFrame:
    """One row: best bin, threshold in seconds, within/total variance ratio.

    Works on bin numbers and integer counts: the split and the ratio do not change under the affine map to bin
    centres, and bins of equal score (a run of empty bins) tie exactly, so that the first one wins.
    """
    so_far = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)   # at most 256 rows
    everything = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    k = F.col("bin").cast("bigint")
    sums = histogram.select(
        "bin", "lo", "hi",
        F.sum("n").over(so_far).alias("w"),
        F.sum(F.col("n") * k).over(so_far).alias("m"),
        F.sum("n").over(everything).alias("total"),
        F.sum(F.col("n") * k).over(everything).alias("m_total"),
        F.sum(F.col("n") * k * k).over(everything).alias("k2_total"),
    )
    d = lambda name: F.col(name).cast("double")
    between = F.when(
        (F.col("w") > 0) & (F.col("w") < F.col("total")),
        F.pow(d("m_total") * d("w") - d("total") * d("m"), F.lit(2.0)) / (d("w") * (d("total") - d("w"))),
    ).otherwise(F.lit(0.0))
    spread = d("total") * d("k2_total") - d("m_total") * d("m_total")
    best = sums.withColumn("between", between).agg(
        F.max_by(F.struct("bin", "lo", "hi", "between", spread.alias("spread")),
                 F.struct(F.col("between"), -F.col("bin"))).alias("b"))
    ratio = F.when(F.col("b.spread") == 0, F.lit(1.0)).otherwise(1 - F.col("b.between") / F.col("b.spread"))
    return best.filter("b is not null").select(
        F.col("b.bin").alias("bin"),
        F.exp((F.col("b.lo") + F.col("b.hi")) / 2).alias("threshold_seconds"),
        ratio.alias("ratio"),
    )


# --- session-count curve and elbow ----------------------------------------------------------------------------

def session_curve(positive: DataFrame, users: int) -> DataFrame:
    """``gap_us, sessions``: how many sessions there would be with each distinct gap as threshold.

    One user has 1 + (number of larger gaps) sessions, so the curve is a running count over the distinct gaps.
    The reference point is gap + epsilon, hence gaps at most a millisecond longer do not count as larger; the
    shifted points are merged into the sorted gaps, which keeps this one running sum.
    """
    epsilon_us = int(GAP_EPSILON * 1e6)
    gaps = durable(positive.groupBy("gap_us").agg(F.count(F.lit(1)).alias("m")))
    points = gaps.select(F.col("gap_us").alias("at"), F.lit(0).alias("side"), "m", F.lit(None).cast("bigint").alias("asked"))
    asked = gaps.select((F.col("gap_us") + epsilon_us).alias("at"), F.lit(1).alias("side"),
                        F.lit(0).cast("bigint").alias("m"), F.col("gap_us").alias("asked"))
    merged = timeline(points.unionByName(asked), [], ["at", "side"]).running("sum", "upto", "m")
    every = gaps.agg(F.sum("m")).first()[0] or 0
    return merged.rows.filter("asked is not null").select(
        F.col("asked").alias("gap_us"), (F.lit(users + every) - F.col("upto")).cast("bigint").alias("sessions"))


def elbow_threshold(curve: DataFrame) -> DataFrame:
    """One row ``threshold_seconds``: the point of the normalised curve farthest from its chord, smallest gap first."""
    x = log_gap("gap_us")
    ends = curve.agg(F.struct(
        F.count(F.lit(1)).alias("n"), F.min(x).alias("x_lo"), F.max(x).alias("x_hi"), F.avg(x).alias("x_mean"),
        F.min("sessions").alias("y_lo"), F.max("sessions").alias("y_hi"),
        F.min_by("sessions", "gap_us").alias("y_first"), F.max_by("sessions", "gap_us").alias("y_last")).alias("e"))
    scaled = curve.withColumn("e", ends.scalar())
    y_range = F.col("e.y_hi") - F.col("e.y_lo")
    nx = (x - F.col("e.x_lo")) / (F.col("e.x_hi") - F.col("e.x_lo"))
    ny = (F.col("sessions") - F.col("e.y_lo")) / y_range
    y0 = (F.col("e.y_first") - F.col("e.y_lo")) / y_range
    slope = (F.col("e.y_last") - F.col("e.y_first")) / y_range
    distance = F.when((F.col("e.n") > 1) & (y_range > 0),
                      F.abs((ny - y0) - slope * nx) / F.sqrt(1 + slope * slope)).otherwise(F.lit(0.0))
    picked = scaled.select("gap_us", "e", distance.alias("d")).agg(
        F.max_by(F.struct("gap_us", "e"), F.struct(F.col("d"), -F.col("gap_us"))).alias("p"))
    flat = (F.col("p.e.n") > 1) & (F.col("p.e.y_hi") == F.col("p.e.y_lo"))
    return picked.filter("p is not null").select(
        F.when(flat, F.exp(F.col("p.e.x_mean"))).otherwise(F.exp(log_gap(F.col("p.gap_us")))).alias("threshold_seconds"))


def select_threshold(line: Timeline) -> DataFrame:
    """One row ``threshold_seconds, method, ratio``: Otsu if it separates the gaps well, else the elbow, else an hour.

    The gaps are written once as a single column: quartiles, histogram and elbow each read them again. The elbow
    needs a sort of all distinct gaps, so it is planned only when the histogram asks for it.
    """
    gaps = durable(positive_gaps(line))
    spark = line.rows.sparkSession
    otsu = otsu_threshold(gap_histogram(gaps, gap_statistics(gaps, line.total))).first()
    if otsu is None:
        row = (DEFAULT_THRESHOLD_SECONDS, "elbow", 1.0)
    elif otsu.ratio < OTSU_MAX_RATIO:
        row = (otsu.threshold_seconds, "otsu", otsu.ratio)
    else:
        row = (elbow_threshold(durable(session_curve(gaps, line.groups))).first()[0], "elbow", otsu.ratio)
    return spark.createDataFrame([row], "threshold_seconds double, method string, ratio double")


# --- sessions -------------------------------------------------------------------------------------------------

def assign_sessions(line: Timeline, threshold_seconds: float) -> Timeline:
    """Number the sessions of each user: a new one starts where the gap exceeds the threshold.

    Adds ``session_no`` and ``session_id`` (``uid-0001``); the result can be used as a timeline of users or,
    with ``within``, of sessions.
    """
    starts = F.when(F.col("is_first") | (seconds("gap_us") > F.lit(float(threshold_seconds))), 1).otherwise(0).cast("bigint")
    line = line.running("sum", "session_no", starts)
    return line.map(session_id=F.printf(F.lit("%s-%04d"), F.col("uid"), F.col("session_no")))


def auto_sessions(events: DataFrame, tie: Sequence[str], threshold_seconds: float | None = None) -> Timeline:
    """Sessions of a table of events, with the threshold chosen from the table itself unless given.

    To choose it, the events with their gaps are written once: what it took to make the events (parsing, say), and the
    sort by user, are not repeated for the threshold, the statistics of features and the sessions.
    """
    line = with_user_gap(user_timeline(events, tie))
    if threshold_seconds is None:
        line = line.store()
        threshold_seconds = select_threshold(line).first().threshold_seconds
    return assign_sessions(line, threshold_seconds)


def with_elapsed(line: Timeline) -> Timeline:
    """Add ``elapsed_seconds`` since the session's first event, the running sum of a session timeline's gaps."""
    line = line.within("uid", "session_id").running("sum", "_elapsed", "gap_us")
    return line.map(elapsed_seconds=seconds("_elapsed")).drop("_elapsed")


def session_rollup(sessions: DataFrame) -> DataFrame:
    """One row per session: number of events, first and last time, span in seconds."""
    return sessions.groupBy("uid", "session_id").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.min("ts_us").alias("start_us"),
        F.max("ts_us").alias("end_us"),
    ).withColumn("span_seconds", seconds(F.col("end_us") - F.col("start_us")))
