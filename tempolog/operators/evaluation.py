"""How good are predictions and scores: F1, losses, ROC-AUC, average precision, detection delay."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tempolog.functions.scalars import seconds
from tempolog.operators.scoring import Predictor
from tempolog.plans.joins import lookup, spread
from tempolog.plans.timeline import timeline
from tempolog.session import durable


def micro_f1(predicted: DataFrame) -> DataFrame:
    """One row ``n, f1`` from rows with ``op`` and ``best_op``. With one label per row, micro F1 is accuracy."""
    return predicted.agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("op") == F.col("best_op")).cast("int")).alias("f1"))


def loss_summary(predicted: DataFrame, lambda_time: float = 1.0, delta: float = 1.0) -> DataFrame:
    """One row: mean -ln p, mean smooth-L1 of the z residual (quadratic below delta), and their weighted total."""
    r = F.abs(F.col("z_hat") - F.col("z"))
    smooth = F.when(r < delta, r * r / (2 * delta)).otherwise(r - delta / 2)
    means = predicted.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(-F.ln(F.least(F.lit(1.0), F.greatest(F.lit(1e-9), F.col("p"))))).alias("ce"),
        F.avg(smooth).alias("huber"))
    return means.withColumn("total", F.col("ce") + F.lit(float(lambda_time)) * F.col("huber"))


def tally(rows: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """``by..., score, n, n_pos``: rows and positives per distinct score. All ranking metrics start here.

    Stored, as each metric counts it and then sorts it, in a direction of its own.
    """
    return durable(rows.groupBy(*by, F.col(score).cast("double").alias("score")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("bigint")).alias("n_pos")))


def roc_auc(tallied: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve from ranks, ties at their mean rank; null with only one kind of label.

    Rank sums are kept as integers (twice the rank), so the order of addition cannot change them.
    """
    ranked = timeline(tallied, by, ["score"]).running("sum", "before", "n", inclusive=False).rows
    whole = lambda c: c.cast("decimal(19,0)")
    twice = whole(F.col("n_pos")) * whole(2 * F.col("before") + F.col("n") + 1)
    sums = ranked.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum("n_pos").alias("n_pos"), F.sum(twice).alias("twice_ranks"))
    pos, neg = whole(F.col("n_pos")), whole(F.col("n") - F.col("n_pos"))
    over = (F.col("twice_ranks") - pos * (pos + 1)).cast("double")
    auc = F.when((F.col("n_pos") > 0) & (F.col("n_pos") < F.col("n")), over / (2 * (pos * neg).cast("double")))
    return sums.select(*by, "n", "n_pos", auc.alias("roc_auc"))


def average_precision(tallied: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Area under the precision-recall steps, highest score first; equal scores are one step. Null without positives."""
    down = timeline(tallied.withColumn("down", -F.col("score")), by, ["down"])
    steps = down.running("sum", "seen", "n").running("sum", "hits", "n_pos").rows
    sums = steps.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum("n_pos").alias("n_pos"),
        F.sum(F.col("hits") / F.col("seen") * F.col("n_pos")).alias("area"))
    return sums.select(*by, "n", "n_pos", F.when(F.col("n_pos") > 0, F.col("area") / F.col("n_pos")).alias("average_precision"))


def one_vs_rest(model: Predictor, vocab: DataFrame, pairs: DataFrame) -> DataFrame:
    """``cls, score, n, n_pos``: for each operation, the tally of its predicted probability against "it happened".

    The predictor knows one probability per (previous operation, operation), so rows are counted per pair first
    and the classes are spread over those few counts, not over the rows.
    """
    alpha = 1.0 / model.size
    counted = pairs.groupBy("prev_op", "op").agg(F.count(F.lit(1)).alias("m"))
    per_source = counted.groupBy("prev_op").agg(F.sum("m").alias("rows"))
    ops = vocab.agg(F.collect_list("op").alias("ops")).scalar()
    grid = per_source.select("prev_op", "rows", F.explode(ops).alias("op"))
    grid = (grid.join(counted, ["prev_op", "op"], "left")
            .join(model.pairs, ["prev_op", "op"], "left")
            .join(model.sources.select("prev_op", "total"), "prev_op", "left"))
    p = (F.coalesce("n", F.lit(0)) + F.lit(alpha)) / (F.coalesce("total", F.lit(0)) + 1)
    return durable(grid.groupBy(F.col("op").alias("cls"), p.alias("score")).agg(
        F.sum("rows").alias("n"), F.sum(F.coalesce("m", F.lit(0))).cast("bigint").alias("n_pos")))


def one_vs_rest_sparse(model: Predictor, pairs: DataFrame) -> DataFrame:
    """``cls, n, n_pos, roc_auc, average_precision`` for the operations that happened, as by :func:`one_vs_rest`, without its grid.

    All operations that are unseen after a source share the default of that source. So the rows of all sources, at their
    defaults, are one distribution for every class; a class only moves the rows of the sources it was seen after from
    there to its own scores. Work grows with the pairs seen.
    """
    alpha = F.lit(1.0 / model.size)
    counted = durable(pairs.groupBy("prev_op", "op").agg(F.count(F.lit(1)).alias("m")))
    totals = model.sources.select("prev_op", "total")
    sources = counted.groupBy("prev_op").agg(F.sum("m").alias("rows")).join(totals, "prev_op", "left")
    sources = durable(sources.select("prev_op", "rows", (F.coalesce("total", F.lit(0)) + 1).alias("weight")).withColumn("default", alpha / F.col("weight")))
    every = sources.agg(F.sum("rows")).first()[0] or 0
    pair = ["prev_op", "op"]
    size = model.pairs.count() + counted.count()
    # Stored, as the look-up counts its rows first.
    both = durable(spread(model.pairs, size, pair).join(spread(counted, size, pair), pair, "full"))
    seen = lookup(both, sources, ["prev_op"]).where("rows is not null")
    moves = seen.select(F.col("op").alias("cls"), F.explode(F.array(
        F.struct(((F.coalesce("n", F.lit(0)) + alpha) / F.col("weight")).alias("score"), F.col("rows").alias("n"), F.coalesce("m", F.lit(0)).alias("n_pos")),
        F.struct(F.col("default").alias("score"), (-F.col("rows")).alias("n"), F.lit(0).cast("bigint").alias("n_pos")))).alias("e"))
    moves = spread(moves.select("cls", "e.score", "e.n", "e.n_pos"), 2 * size, ["cls", "score"])
    own = durable(moves.groupBy("cls", "score").agg(F.sum("n").alias("n"), F.sum("n_pos").alias("n_pos")))
    shared = sources.select(F.col("default").alias("score"), "rows").union(own.select("score", F.lit(0).cast("bigint")).distinct())
    shared = timeline(durable(shared.groupBy("score").agg(F.sum("rows").alias("there"))), [], ["score"]).running("sum", "below", "there", inclusive=False)
    placed = timeline(own, ["cls"], ["score"]).running("sum", "n_before", "n", inclusive=False).running("sum", "pos_before", "n_pos", inclusive=False).rows
    placed = lookup(placed.where("n_pos > 0"), durable(shared.rows), ["score"])
    before = F.col("n_before") + F.col("below")
    whole = lambda c: c.cast("decimal(19,0)")
    twice = whole(F.col("n_pos")) * whole(2 * before + F.col("n") + F.col("there") + 1)
    totals = own.groupBy("cls").agg(F.sum("n_pos").alias("all_pos")).where("all_pos > 0")
    sums = placed.join(totals, "cls").groupBy("cls").agg(
        F.max("all_pos").alias("n_pos"), F.sum(twice).alias("twice_ranks"),
        F.sum((F.col("all_pos") - F.col("pos_before")) / (F.lit(every) - before) * F.col("n_pos")).alias("area"))
    pos, neg = whole(F.col("n_pos")), whole(F.lit(every) - F.col("n_pos"))
    auc = F.when(F.col("n_pos") < every, (F.col("twice_ranks") - pos * (pos + 1)).cast("double") / (2 * (pos * neg).cast("double")))
    return sums.select("cls", F.lit(every).cast("bigint").alias("n"), "n_pos", auc.alias("roc_auc"), (F.col("area") / F.col("n_pos")).alias("average_precision"))


def explode_classes(rows: DataFrame, probabilities: str, label: str) -> DataFrame:
    """The same tally for an outside predictor that gives a map operation -> probability per row."""
    spread = rows.select(F.explode(probabilities).alias("cls", "score"), F.col(label).alias("_label"))
    return tally(spread.withColumn("hit", F.col("cls") == F.col("_label")), "score", "hit", by=["cls"])


def macro_over_classes(tallied: DataFrame) -> DataFrame:
    """One row: ROC-AUC and average precision, averaged over the classes where each is defined."""
    roc = roc_auc(tallied, ["cls"]).select("cls", "roc_auc")
    ap = average_precision(tallied, ["cls"]).select("cls", "average_precision")
    return roc.join(ap, "cls").agg(
        F.count("roc_auc").alias("n_classes"), F.avg("roc_auc").alias("roc_auc"), F.avg("average_precision").alias("pr_auc"))


def detection_delay(scored: DataFrame) -> DataFrame:
    """One row ``n_sessions, delay_seconds``: mean time from session start to the first flag, or its whole span.

    Sessions with one event do not count. Elapsed time is time since the first event, so this is one aggregate.
    """
    flagged = F.col("prev_op").isNotNull() & ((F.col("flag_cls") == 1) | (F.col("flag_dt") == 1))
    per_session = scored.groupBy("uid", "session_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts_us").alias("start"), F.max("ts_us").alias("end"),
        F.min(F.when(flagged, F.col("ts_us"))).alias("hit"))
    wait = F.coalesce("hit", "end") - F.col("start")
    # Whole microseconds as a decimal: the sum is exact and independent of the order of addition.
    sums = per_session.filter("n >= 2").agg(
        F.count(F.lit(1)).alias("n_sessions"), F.sum(wait.cast("decimal(20,0)")).cast("double").alias("us"))
    return sums.select("n_sessions", F.coalesce(seconds("us") / F.col("n_sessions"), F.lit(0.0)).alias("delay_seconds"))


def label_from_audit(scored: DataFrame, audit: DataFrame, index: str) -> DataFrame:
    """Add ``label`` 1 to rows that the audit names (as the record itself or as its swap partner)."""
    named = audit.select(F.explode(F.array("record_index", "swap_with")).alias(index)).filter(F.col(index).isNotNull())
    named = named.distinct().withColumn("label", F.lit(1))
    return scored.join(named, index, "left").withColumn("label", F.coalesce("label", F.lit(0)))


def evaluation_report(predicted: DataFrame, scored: DataFrame, per_class: DataFrame) -> DataFrame:
    """One row with the four headline numbers of a predictor."""
    delay = detection_delay(scored).select("delay_seconds").scalar()
    f1 = micro_f1(predicted).select("f1").scalar()
    return macro_over_classes(per_class).select(
        f1.alias("f1"), "pr_auc", "roc_auc", delay.alias("detection_delay"))
