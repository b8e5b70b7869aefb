"""Rows that one task sorts or joins stay bounded when the session has few shuffle partitions."""

import pytest
from pyspark.sql import functions as F

from tempolog.operators import behavior, evaluation, scoring
from tempolog.plans import joins
from tempolog.plans.timeline import timeline


@pytest.fixture
def few_rows(spark):
    spark.conf.set(joins.ROWS_SETTING, "50")
    yield 50
    spark.conf.unset(joins.ROWS_SETTING)


def chain(spark):
    step = F.col("id").cast("bigint")
    return spark.range(600).select((step % 5).alias("uid"), (step * 7 % 97).cast("string").alias("prev_op"), (step * 11 % 89).cast("string").alias("op"),
                                   F.lit(0.0).alias("z"))


def test_timelines_and_lookups_are_dealt_over_enough_tasks(spark, few_rows, monkeypatch):
    rows = chain(spark).withColumn("n", F.monotonically_increasing_id())
    assert timeline(rows, ["prev_op"], ["n"]).plain.rdd.getNumPartitions() == 12
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 10)
    table = rows.groupBy("prev_op").agg(F.max("n").alias("last"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = joins.lookup(rows, table, ["prev_op"])
        assert found.rdd.getNumPartitions() == 12 and found.where("last is null").count() == 0 and found.count() == 600
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_sparse_ranking_is_the_same_in_many_tasks(spark, monkeypatch):
    pairs = chain(spark)
    vocab = behavior.vocabulary(pairs)
    def ranking():
        model = scoring.fit_predictor(pairs.where("uid < 3"), vocab)
        return sorted(map(tuple, evaluation.one_vs_rest_sparse(model, pairs.where("uid >= 3")).collect()))
    want = ranking()
    spark.conf.set(joins.ROWS_SETTING, "20")
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 5)
    try:
        got = ranking()
    finally:
        spark.conf.unset(joins.ROWS_SETTING)
    assert len(got) == len(want) > 50
    for a, b in zip(got, want):
        assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], rel=1e-12)
