"""The behaviour model: first operations, transitions, waiting times; and the tables a sequence model trains on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tempolog.functions.scalars import seconds
from tempolog.plans.joins import lookup
from tempolog.plans.timeline import Timeline, timeline
from tempolog.operators.features import fit_log
from tempolog.schema import FIT_EPSILON
from tempolog.session import durable

def vocabulary(events: DataFrame) -> DataFrame:
    """``op, idx``: the distinct operations numbered in sorted order, however many they are."""
    numbered = timeline(durable(events.select("op").distinct()), [], ["op"]).position("_pos").rows
    return numbered.select("op", (F.col("_pos") - 1).cast("int").alias("idx"))


def encode(events: DataFrame, vocab: DataFrame) -> DataFrame:
    """Add ``op_index`` (null for operations outside the vocabulary)."""
    return lookup(events, durable(vocab.withColumnRenamed("idx", "op_index")), ["op"])


def decode(indices: DataFrame, vocab: DataFrame) -> DataFrame:
    """The inverse of :func:`encode`: add ``op`` from ``op_index``."""
    return lookup(indices, durable(vocab.withColumnRenamed("idx", "op_index")), ["op_index"])


def _ops_array(vocab: DataFrame) -> Column:
    return vocab.agg(F.array_sort(F.collect_list("op")).alias("ops")).scalar()


def initial_distribution(events: DataFrame, tie: Sequence[str], vocab: DataFrame, session=("uid", "session_id")) -> DataFrame:
    """``op, n, p``: how many sessions start with each operation, and the smoothed share (alpha = 1/vocabulary)."""
    firsts = events.groupBy(*session).agg(F.min_by("op", F.struct("ts_us", *tie)).alias("op"))
    counts = vocab.select("op").join(firsts.groupBy("op").agg(F.count(F.lit(1)).alias("n")), "op", "left")
    counts = counts.select("op", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    t = counts.agg(F.struct(F.sum("n").alias("total"), F.count(F.lit(1)).alias("c")).alias("t"))
    return counts.withColumn("t", t.scalar()).select(
        "op", "n", ((F.col("n") + 1 / F.col("t.c")) / (F.col("t.total") + 1)).alias("p"))


def next_event_pairs(line: Timeline, carry: Sequence[str] = ()) -> DataFrame:
    """Each event with what came before it in its session (``prev_op`` and ``prev_<column>``); first events drop out."""
    line = line.previous(prev_op="op", **{f"prev_{c}": c for c in carry})
    return line.rows.filter("prev_op is not null")


def transition_counts(pairs: DataFrame) -> DataFrame:
    """``src, dst, n`` for the pairs that occur."""
    return pairs.groupBy(F.col("prev_op").alias("src"), F.col("op").alias("dst")).agg(F.count(F.lit(1)).alias("n"))


def transition_matrix(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """``src, dst, n, p`` for every pair of operations, smoothed with alpha = 1/vocabulary and normalised per source."""
    ops = _ops_array(vocab)
    dense = vocab.select(F.col("op").alias("src"), F.explode(ops).alias("dst"))
    filled = dense.join(counts, ["src", "dst"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))
    row = Window.partitionBy("src")  # one row per operation
    p = (F.col("n") + 1 / F.count(F.lit(1)).over(row)) / (F.sum("n").over(row) + 1)
    return filled.select("src", "dst", "n", p.alias("p"))


def sparse_transitions(counts: DataFrame, vocab: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The model of :func:`transition_matrix` in proportion to the pairs that occur, however many operations there are.

    ``src, dst, n, p`` for the pairs seen, and one row ``src, total, unseen, p`` per operation: how often it was left, to how
    many operations never, and the probability of each of those.
    """
    counts = durable(counts.select("src", "dst", "n"))
    left = counts.groupBy("src").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("seen"))
    alpha = 1.0 / max(1, size := vocab.count())
    rows = vocab.select(F.col("op").alias("src")).join(left, "src", "left").select(
        "src", F.coalesce("total", F.lit(0)).cast("bigint").alias("total"),
        (F.lit(size) - F.coalesce("seen", F.lit(0))).cast("bigint").alias("unseen"))
    rows = durable(rows.withColumn("p", F.lit(alpha) / (F.col("total") + 1)))
    pairs = lookup(counts, rows.select("src", "total"), ["src"])
    return pairs.select("src", "dst", "n", ((F.col("n") + F.lit(alpha)) / (F.col("total") + 1)).alias("p")), rows


def lognormal_params(events: DataFrame, gap_seconds: Column | None = None) -> DataFrame:
    """``op, n, mu, sigma`` of ln(gap + eps) over the positive gaps; sigma is the population deviation."""
    gap = seconds("gap_us") if gap_seconds is None else gap_seconds
    logs = events.select("op", gap.alias("g")).filter("g > 0").select("op", fit_log(F.col("g")).alias("x"))
    return logs.groupBy("op").agg(
        F.count("x").alias("n"), F.avg("x").alias("mu"), F.stddev_pop("x").alias("sigma"))


def with_sigma_floor(params: DataFrame) -> DataFrame:
    """Sigma as the generator of waits needs it: never zero."""
    return params.withColumn("sigma", F.when(F.col("sigma") > 0, F.col("sigma")).otherwise(F.lit(FIT_EPSILON)))


def model_summary(events: DataFrame, session=("uid", "session_id")) -> DataFrame:
    """One row: sorted operations, events, sessions, first time."""
    per_session = events.groupBy(*session).agg(
        F.count(F.lit(1)).alias("n"), F.min("ts_us").alias("t"), F.collect_set("op").alias("ops"))
    ops = per_session.select(F.explode("ops").alias("op")).distinct().agg(
        F.array_join(F.array_sort(F.collect_list("op")), ",").alias("c"))
    return per_session.agg(
        F.sum("n").alias("n_events"), F.count(F.lit(1)).alias("n_sessions"), F.min("t").alias("first_us"),
    ).withColumn("categories", ops.scalar())


def check_model(initial: DataFrame, matrix: DataFrame, timing: DataFrame, tolerance: float = 1e-9, rest: DataFrame | None = None) -> DataFrame:
    """``rule, item, value`` for every way the model tables fail to describe a distribution.

    With ``rest`` (``src, unseen, p``) the matrix is the sparse form: pairs it does not list have the ``p`` of their source.
    """
    off = lambda total: F.abs(total - 1) > F.greatest(F.lit(tolerance), F.lit(tolerance) * F.greatest(F.abs(total), F.lit(1.0)))
    bad_p = lambda p: F.col(p).isNull() | F.isnan(p) | (F.col(p) < 0) | (F.col(p) > 1)
    states = initial.select(F.col("op").alias("src"))
    found = []

    def report(rows: DataFrame, rule: str, item, value) -> None:
        found.append(rows.select(F.lit(rule).alias("rule"), item.cast("string").alias("item"), value.cast("double").alias("value")))

    report(initial.filter(bad_p("p")), "initial_not_probability", F.col("op"), F.col("p"))
    report(initial.agg(F.sum("p").alias("total")).filter(off(F.col("total"))), "initial_sum", F.lit("*"), F.col("total"))
    report(matrix.filter(bad_p("p")), "transition_not_probability", F.concat_ws("->", "src", "dst"), F.col("p"))
    rows = matrix.groupBy("src").agg(F.sum("p").alias("total"), F.countDistinct("dst").alias("width"))
    sources = matrix.select("src")
    if rest is not None:
        report(rest.filter((F.col("unseen") > 0) & bad_p("p")), "transition_not_probability", F.concat_ws("->", "src", F.lit("*")), F.col("p"))
        sources = sources.union(rest.select("src"))
        rows = rest.select("src", "unseen", "p").join(rows, "src", "full").select(
            "src", (F.coalesce("total", F.lit(0.0)) + F.coalesce(F.when(F.col("unseen") > 0, F.col("unseen") * F.col("p")), F.lit(0.0))).alias("total"),
            (F.coalesce("width", F.lit(0)) + F.coalesce("unseen", F.lit(0))).alias("width"))
    report(rows.filter(off(F.col("total"))), "transition_row_sum", F.col("src"), F.col("total"))
    size = initial.agg(F.count(F.lit(1)).alias("c")).scalar()
    report(rows.filter(F.col("width") != size), "transition_row_incomplete", F.col("src"), F.col("width"))
    report(states.join(rows, "src", "left_anti"), "transition_row_missing", F.col("src"), F.lit(None))
    report(sources.join(states, "src", "left_anti").distinct(), "transition_unknown_state", F.col("src"), F.lit(None))
    report(matrix.select(F.col("dst").alias("src")).join(states, "src", "left_anti").distinct(),
           "transition_unknown_target", F.col("src"), F.lit(None))
    report(timing.filter(~(F.col("sigma") > 0) | F.isnan("sigma") | F.col("sigma").isNull() | (F.col("sigma") == float("inf"))),
           "sigma_not_positive", F.col("op"), F.col("sigma"))
    report(timing.filter(F.col("mu").isNull() | F.isnan("mu") | (F.abs("mu") == float("inf"))), "mu_not_finite", F.col("op"), F.col("mu"))
    report(states.join(timing.select(F.col("op").alias("src")), "src", "left_anti"), "timing_missing", F.col("src"), F.lit(None))
    report(timing.select(F.col("op").alias("src")).join(states, "src", "left_anti"), "timing_unknown_state", F.col("src"), F.lit(None))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


# --- sequences and folds --------------------------------------------------------------------------------------

def session_sequences(line: Timeline, vocab: DataFrame, piece: int = 100_000) -> DataFrame:
    """One row per session with aligned arrays of times, operation numbers, gaps and z.

    An array lives in one row, so a session with more than ``piece`` events is laid out as several rows
    numbered by ``part``, each with at most that many events; ``part = 0`` is the whole of any ordinary session.
    """
    line = line.position("_pos")
    rows = encode(line.rows, vocab).withColumn("part", F.floor((F.col("_pos") - 1) / piece).cast("int"))
    item = F.struct("_pos", "ts_us", "op_index", seconds("gap_us").alias("delta_seconds"), "z")
    packed = rows.groupBy("uid", "session_id", "part").agg(F.array_sort(F.collect_list(item)).alias("e"))
    return packed.select(
        "uid", "session_id", "part", F.size("e").alias("length"),
        F.col("e.ts_us").alias("timestamps_us"), F.col("e.op_index").alias("op_indices"),
        F.col("e.delta_seconds").alias("delta_seconds"), F.col("e.z").alias("z_clipped"),
    )


def group_kfold(events: DataFrame, n_splits: int, level: str = "session") -> DataFrame:
    """``uid[, session_id], fold``: groups in sorted order, dealt out in turn, so no group is in two folds."""
    if n_splits < 2:
        raise ValueError("cross-validation needs two folds or more")
    if level not in ("session", "user"):
        raise ValueError(f"level is session or user, not {level}")
    keys = ["uid", "session_id"] if level == "session" else ["uid"]
    groups = timeline(durable(events.select(*keys).distinct()), [], keys)
    if groups.total < n_splits:
        raise ValueError("some folds would have no group")
    return groups.position("_pos").rows.select(*keys, F.pmod(F.col("_pos") - 1, F.lit(n_splits)).cast("int").alias("fold"))
