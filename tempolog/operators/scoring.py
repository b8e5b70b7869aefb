"""Score every event: how unexpected was the operation, how unexpected was the wait."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from tempolog.operators.behavior import transition_counts
from tempolog.plans.joins import lookup
from tempolog.plans.quantiles import quantiles
from tempolog.plans.timeline import Timeline
from tempolog.session import durable


@dataclass(frozen=True)
class Predictor:
    """Tables that say what to expect after an operation.

    ``pairs``: ``prev_op, op, n`` observed transitions; ``sources``: ``prev_op, total, z_hat, best_op``;
    ``size``: number of operations; ``first_op``: the first of them, predicted where nothing is known.
    Both tables are stored, so that scores, thresholds and flags all see the same numbers.
    """

    pairs: DataFrame
    sources: DataFrame
    size: int
    first_op: str


def fit_predictor(pairs: DataFrame, vocab: DataFrame) -> Predictor:
    """From next-event pairs with ``prev_op, op, z``: transition counts, the mean next z and the likeliest next operation."""
    seen = pairs.groupBy("prev_op", "op").agg(F.count(F.lit(1)).alias("n"), F.sum("z").alias("z_sum"))
    seen = durable(seen)
    sources = durable(seen.groupBy("prev_op").agg(
        F.sum("n").alias("total"),
        (F.sum("z_sum") / F.sum("n")).alias("z_hat"),
        F.min_by("op", F.struct(-F.col("n"), F.col("op"))).alias("best_op"),
    ))
    known = vocab.agg(F.count(F.lit(1)), F.min("op")).first()
    return Predictor(seen.select("prev_op", "op", "n"), sources, known[0], known[1])


def with_prediction(rows: DataFrame, model: Predictor) -> DataFrame:
    """Add ``p`` (probability of what happened), ``z_hat`` and ``best_op`` to rows with ``prev_op`` and ``op``.

    Pairs and operations never seen in training get the smoothed default.
    """
    alpha = 1.0 / model.size
    rows = lookup(lookup(rows, model.pairs, ["prev_op", "op"]), model.sources, ["prev_op"])
    known = F.coalesce("total", F.lit(0))
    return rows.withColumns({
        "p": (F.coalesce("n", F.lit(0)) + F.lit(alpha)) / (known + 1),
        "z_hat": F.coalesce("z_hat", F.lit(0.0)),
        "best_op": F.coalesce("best_op", F.lit(model.first_op)),
    }).drop("n", "total")


def residuals(predicted: DataFrame) -> DataFrame:
    return predicted.withColumn("residual", F.abs(F.col("z_hat") - F.col("z")))


def category_thresholds(scored: DataFrame, vocab: DataFrame, alpha: float = 0.05, residual: str = "residual") -> DataFrame:
    """``op, tau_lo, tau_hi``: residual quantiles alpha and 1-alpha per operation, null where there are none."""
    if not 0.0 <= alpha <= 0.5:
        raise ValueError("a tail share lies in 0 to 0.5")
    found = quantiles(scored, residual, {"tau_lo": alpha, "tau_hi": 1.0 - alpha}, by=["op"])
    return vocab.select("op").join(found.drop("n"), "op", "left").select("op", "tau_lo", "tau_hi")


def score(
    rows: DataFrame, thresholds: DataFrame | None, w_cls: float = 0.5, w_time: float = 0.5
) -> DataFrame:
    """Scores and flags for rows with ``prev_op, op, z, p, z_hat, best_op``, from whichever predictor they came.

    Rows without a ``prev_op`` (first events) score 0. ``thresholds`` is a stored table; without it (or without
    an entry for the operation) ``flag_dt`` is 0.
    """
    if w_cls < 0 or w_time < 0:
        raise ValueError("weights must not be negative")
    if thresholds is None:
        rows = rows.withColumn("tau_hi", F.lit(None).cast("double"))
    else:
        rows = lookup(rows, thresholds.select("op", "tau_hi"), ["op"])
    follows = F.col("prev_op").isNotNull()
    or_zero = lambda c: F.when(follows, c).otherwise(F.lit(0.0))
    rows = rows.withColumns({
        "z_hat": or_zero(F.col("z_hat")),
        "s_cls": or_zero(1 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("p")))),
        "s_time": or_zero(F.abs(F.col("z_hat") - F.col("z"))),
    })
    return rows.withColumns({
        "S": F.lit(float(w_cls)) * F.col("s_cls") + F.lit(float(w_time)) * F.col("s_time"),
        "flag_cls": F.when(follows & (F.col("best_op") != F.col("op")), 1).otherwise(0),
        "flag_dt": F.when(follows & F.col("tau_hi").isNotNull() & (F.col("s_time") > F.col("tau_hi")), 1).otherwise(0),
    }).drop("tau_hi")


def score_events(line: Timeline, model: Predictor, thresholds: DataFrame | None, w_cls: float = 0.5, w_time: float = 0.5) -> DataFrame:
    """The scored table of a timeline of sessions that has ``z``."""
    line = line.previous(prev_op="op")
    return score(with_prediction(line.rows, model), thresholds, w_cls, w_time)


def scored_table(scored: DataFrame) -> DataFrame:
    """The eleven columns handed to the next stage."""
    return scored.select(
        F.timestamp_micros("ts_us").alias("timestamp_utc"), "uid", "session_id", F.col("op").alias("op_category"),
        "z", "z_hat", "s_cls", "s_time", "S", "flag_cls", "flag_dt")


def top_anomalies(scored: DataFrame, k: int, tie: list[str]) -> DataFrame:
    """The k highest combined scores."""
    return scored.orderBy(F.col("S").desc(), *tie).limit(k)


def top_anomalies_per_user(scored: DataFrame, k: int, tie: list[str]) -> DataFrame:
    """The k highest scores of every user, with their ``place``. Spark keeps only k rows per user and task before the shuffle."""
    place = F.row_number().over(Window.partitionBy("uid").orderBy(F.col("S").desc(), *tie))
    return scored.withColumn("place", place).filter(F.col("place") <= k)
