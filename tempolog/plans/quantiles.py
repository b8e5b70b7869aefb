"""Exact linear-interpolation quantiles, per group or over everything, in bounded memory.

Spark's ``percentile`` is exact but keeps every distinct value of a group in one task. It is used for groups
of ordinary size. For larger groups each wanted position is bracketed twice with ``approx_percentile`` (whose
rank error is bounded), and only the distinct values inside the final bracket are counted one by one.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tempolog.plans.joins import broadcast_hot, match_all
from tempolog.plans.timeline import group_sizes, hot_limit, rows_per_window
from tempolog.session import durable

STEPS = 2000                # bracket grid; rank error of the sketch is a tenth of a step
ACCURACY = 10 * STEPS


def quantiles(
    df: DataFrame, value: str, qs: dict[str, float], by: Sequence[str] = (), largest: int | None = None
) -> DataFrame:
    """One row per group: the group columns, ``n`` (non-null values) and one column per entry of ``qs``.

    ``largest`` is an upper bound of the rows of a group, if the caller knows one; it saves the counting job.
    """
    values = df.select(*by, F.col(value).cast("double").alias("_v")).filter("_v is not null")
    # One tally of the values serves every inner quantile; the ends need none.
    inner = sorted({q for q in qs.values() if 0 < q < 1})
    ends = {0: F.min("_v"), 1: F.max("_v")}

    def plain(rows: DataFrame) -> DataFrame:
        found = rows.groupBy(*by).agg(
            F.count("_v").alias("n"), *[F.percentile("_v", inner).alias("_inner")] if inner else [],
            *[end.alias(f"_end{q}") for q, end in ends.items() if q in qs.values()])
        return found.select(*by, "n", *[
            (F.col("_inner")[inner.index(q)] if q in inner else F.col(f"_end{int(q)}")).alias(name) for name, q in qs.items()])

    if largest is not None and largest <= rows_per_window(df):
        return plain(values)
    total, _, largest, counts = group_sizes(values, by)
    limit = hot_limit(df, total)
    if largest <= limit:
        return plain(values)
    # The values of large groups are read once per narrowing step, so they are written out first: a value and its
    # group per row, instead of whatever it took to compute them.
    if not by:
        return _bracketed(durable(values), qs, by)
    hot = durable(counts.filter(F.col("_rows") > limit).drop("_rows"))
    cold_rows, hot_rows = broadcast_hot(values, hot, by)
    return plain(cold_rows).unionByName(_bracketed(durable(hot_rows), qs, by))


def _bracketed(values: DataFrame, qs: dict[str, float], by: Sequence[str]) -> DataFrame:
    # The grid 0, 1/STEPS, ..., 1 as one small constant expression.
    points = F.split(F.lit(",".join(str(i / STEPS) for i in range(STEPS + 1))), ",").cast("array<double>")
    wanted = F.explode(F.array(*[F.struct(F.lit(n).alias("q_name"), F.lit(float(q)).alias("q")) for n, q in qs.items()]))
    group = [*by, "q_name", "rank", "n"]

    def narrow(rows: DataFrame) -> DataFrame:
        """Rows carry lo and hi of their bracket; returns a tighter bracket around the same rank."""
        inside = F.when(F.col("_v") >= F.col("lo"), F.col("_v"))
        found = rows.groupBy(*group).agg(
            F.count(F.when(F.col("_v") < F.col("lo"), 1)).alias("below"),
            F.count(inside).alias("inside"),
            F.percentile_approx(inside, points, ACCURACY).alias("grid"),
        )
        def step(position, rounded):  # number of the grid point at an order statistic counted from the lowest value
            return rounded((position - F.col("below")) / F.col("inside") * STEPS).cast("int")

        first = step(F.floor("rank"), F.floor) - 1
        last = step(F.ceil("rank") + 1, F.ceil) + 1
        return found.select(
            *group,
            F.element_at("grid", F.greatest(first, F.lit(0)) + 1).alias("lo"),
            F.element_at("grid", F.least(last, F.lit(STEPS)) + 1).alias("hi"),
        )

    def against(brackets: DataFrame) -> DataFrame:
        if by:  # few groups are ever bracketed, so this side is short
            rows = match_all(values, brackets, by, "inner", broadcast=True)
        else:   # one bracket per wanted quantile
            every = brackets.agg(F.collect_list(F.struct(*brackets.columns)).alias("all"))
            rows = values.withColumn("_b", F.explode(every.scalar())).select("_v", "_b.*")
        return rows.filter(F.col("_v") <= F.col("hi"))

    sizes = durable(values.groupBy(*by).agg(F.count("_v").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")))
    start = sizes.select("*", wanted.alias("_q")).select(
        *by, "_q.q_name", (F.col("_q.q") * (F.col("n") - 1)).alias("rank"), "n", "lo", "hi")
    first = narrow(against(start))
    second = narrow(against(first))

    inside = F.when(F.col("_v") >= F.col("lo"), F.col("_v")).alias("_v")  # null stands for everything below the bracket
    tallied = against(second).groupBy(*group, inside).agg(F.count(F.lit(1)).alias("m"))
    upto = F.sum("m").over(Window.partitionBy(*group).orderBy(F.col("_v").asc_nulls_first()))
    picked = tallied.withColumn("upto", upto).groupBy(*group).agg(
        F.min(F.when(F.col("upto") > F.floor("rank"), F.col("_v"))).alias("a"),
        F.min(F.when(F.col("upto") > F.ceil("rank"), F.col("_v"))).alias("b"),
    )
    share = F.col("rank") - F.floor("rank")
    value = F.col("a") + (F.col("b") - F.col("a")) * share
    return picked.groupBy(*by, "n").agg(
        *[F.max(F.when(F.col("q_name") == name, value)).alias(name) for name in qs])
