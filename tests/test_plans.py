"""The building blocks: the same numbers with and without slices, and as a plain loop would give."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempolog.operators import behavior
from tempolog.plans import joins
from tempolog.plans.quantiles import quantiles
from tempolog.plans.timeline import timeline
from tempolog.session import durable, scratch


@pytest.fixture(scope="module")
def data():
    rnd = random.Random(3)
    rows = []
    for i in range(120):
        key = rnd.choice(["hot", "hot", "a", "b", None])  # one key with a large share, and nulls
        rows.append((key, rnd.randrange(60), i, rnd.choice([None, *range(10)]), rnd.choice([0.5, 1.0, 2.0])))
    return rows


def frame(spark, data):
    return spark.createDataFrame(data, "k string, t bigint, i bigint, v bigint, f double")


def expected(data, keyed=True):
    groups = {}
    for r in sorted(data, key=lambda r: (r[1], r[2])):
        groups.setdefault(r[0] if keyed else 0, []).append(r)
    out = {}
    for rows in groups.values():
        for n, r in enumerate(rows):
            before = rows[:n]
            product = float(np.prod([b[4] for b in before])) if before else 1.0
            seen = [b[3] for b in before + [r] if b[3] is not None]
            out[r[2]] = (
                before[-1][3] if before else None,
                rows[n + 1][3] if n + 1 < len(rows) else None,
                n + 1,
                sum(b[3] or 0 for b in before),
                product,
                seen[-1] if seen else None,
                max((b[3] for b in before if b[3] is not None), default=None),
                [b[1] for b in before][-5:],
            )
    return out


@pytest.mark.parametrize("keys", [["k"], []])
def test_ordered_columns(spark, data, windows, keys):
    line = timeline(frame(spark, data), keys, ["t", "i"])
    assert (line.cut is not None) == (windows == "cut")
    line = line.scan(
        **line.neighbours(F.lag, {"prev": "v"}), **line.neighbours(F.lead, {"next": "v"}),
        before=line.fold("sum", F.coalesce("v", F.lit(0)), inclusive=False), prod=line.fold("product", "f", inclusive=False),
        latest=line.fold("last", "v"), top=line.fold("max", "v", inclusive=False))
    line = line.position("pos").history("past", "t", 5)
    got = {r.i: (r.prev, r.next, r.pos, r.before, r["prod"], r.latest, r.top, r.past) for r in line.rows.collect()}
    assert got == expected(data, keyed=bool(keys))


def test_backwards(spark, data, windows):
    line = timeline(frame(spark, data), ["k"], ["t", "i"]).map(t_=-F.col("t"), i_=-F.col("i")).backwards("t_", "i_").position("back")
    sizes = {}
    for r in data:
        sizes[r[0]] = sizes.get(r[0], 0) + 1
    forward = expected(data)
    assert all(r.back == sizes[r.k] + 1 - forward[r.i][2] for r in line.rows.collect())


def test_finer_key_keeps_slices(spark, data, windows):
    df = frame(spark, data).withColumn("s", F.col("i") % 3)
    line = timeline(df, ["k"], ["t", "i"]).within("k", "s").position("pos").previous(before="i")
    rows = line.rows.collect()
    groups = {}
    for r in sorted(rows, key=lambda r: (r.t, r.i)):
        group = groups.setdefault((r.k, r.s), [None])
        assert (r.pos, r.before) == (len(group), group[-1])
        group.append(r.i)


def test_attach_reaches_cut_keys(spark, data, windows):
    table = spark.createDataFrame([("hot", 1), ("a", 2), ("b", 3)], "k string, x int")
    rows = timeline(frame(spark, data), ["k"], ["t", "i"]).attach(table).rows.collect()
    assert len(rows) == len(data)
    assert {r.k: r.x for r in rows} == {"hot": 1, "a": 2, "b": 3, None: None}


@pytest.mark.parametrize("by", [[], ["k"]])
def test_quantiles_are_exact(spark, data, windows, by):
    qs = {"q0": 0.0, "q37": 0.37, "q50": 0.5, "q95": 0.95, "q1": 1.0}
    got = {(r.k if by else None): r for r in quantiles(frame(spark, data), "v", qs, by=by).collect()}
    groups = {}
    for r in data:
        if r[3] is not None:
            groups.setdefault(r[0] if by else None, []).append(r[3])
    assert set(got) == set(groups)
    for key, values in groups.items():
        assert got[key].n == len(values)
        for name, q in qs.items():
            assert got[key][name] == pytest.approx(np.quantile(values, q), abs=1e-12)


def test_quantiles_of_many_equal_values(spark, tiny_windows):
    df = spark.range(500).select(F.when(F.col("id") < 450, 7.0).otherwise(F.col("id") * 1.0).alias("v"))
    row = quantiles(df, "v", {"low": 0.1, "mid": 0.5, "high": 0.95}).first()
    values = [7.0] * 450 + [float(i) for i in range(450, 500)]
    assert (row.low, row.mid, row.high) == tuple(pytest.approx(np.quantile(values, q)) for q in (0.1, 0.5, 0.95))


def test_numpy_linear_quantile(spark):
    df = spark.createDataFrame([(v,) for v in (0.1, 2.5, 3.7, 5.9, 7.2)], "v double")
    assert quantiles(df, "v", {"q": 0.37}).first().q == pytest.approx(3.076)


@pytest.mark.parametrize("short", [True, False])
def test_lookup(spark, data, tiny_windows, monkeypatch, short):
    if not short:
        monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    table = spark.createDataFrame([("hot", 1), ("a", 2)], "k string, x int")
    rows = joins.lookup(frame(spark, data), table, ["k"]).collect()
    assert len(rows) == len(data)
    assert {r.k: r.x for r in rows} == {"hot": 1, "a": 2, "b": None, None: None}


def test_null_keys_attach_to_nothing_at_any_size(spark, windows):
    rows = spark.createDataFrame([(None if i % 2 else "a", i) for i in range(10)], "k string, i long")
    table = spark.createDataFrame([("a", 1), (None, 2)], "k string, v long")
    got = timeline(rows, ["k"], ["i"]).attach(table).rows.collect()
    assert sorted((r.i, r.v) for r in got) == [(i, None if i % 2 else 1) for i in range(10)]


def test_a_vocabulary_has_no_limit(spark):
    events = spark.range(12_000).select(F.format_string("op%05d", "id").alias("op"))
    vocab = behavior.vocabulary(events)
    got = behavior.encode(events, vocab)
    assert got.filter("op_index = cast(substring(op, 3) as int)").count() == 12_000
    assert behavior.decode(got.select("op_index"), vocab).filter("op is not null").count() == 12_000


def test_scratch_tables_are_removed(spark):
    with scratch(spark) as folder:
        assert durable(spark.range(5)).count() == 5 and len(os.listdir(folder.removeprefix("file:"))) == 1
    assert not os.path.exists(folder.removeprefix("file:"))
    assert durable(spark.range(3)).count() == 3
