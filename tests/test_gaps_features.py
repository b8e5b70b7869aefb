import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import column, events
from tempolog.operators import features, gaps
from tempolog.schema import GAP_EPSILON


def timeline_of(spark, rows):
    return gaps.with_user_gap(gaps.user_timeline(events(spark, rows), ["idx"]))


def by_times(times, uid="user-a"):
    return [(uid, "", t, "x") for t in times]


BIMODAL = by_times([30 * i for i in range(6)] + [7350 + 600 * i for i in range(6)])


def test_bimodal_gaps_choose_otsu(spark):
    line = timeline_of(spark, BIMODAL)
    choice = gaps.select_threshold(line).first()
    assert choice.method == "otsu" and choice.threshold_seconds > 30 and choice.ratio < 0.9
    sessions = column(gaps.assign_sessions(line, choice.threshold_seconds).rows, "session_id")
    assert len(set(sessions[:6])) == 1 and sessions[6] != sessions[0]


def test_histogram_has_at_least_32_bins_and_all_gaps(spark):
    line = timeline_of(spark, BIMODAL)
    positive = gaps.positive_gaps(line)
    bins = gaps.gap_histogram(positive, gaps.gap_statistics(positive)).collect()
    assert 32 <= len(bins) <= 256 and sum(b.n for b in bins) == 11
    assert [b.bin for b in sorted(bins, key=lambda b: b.lo)] == list(range(len(bins)))


def test_equal_gaps_fall_back_to_elbow(spark, windows):
    choice = gaps.select_threshold(timeline_of(spark, by_times([600 * i for i in range(6)], "user-b"))).first()
    assert choice.method == "elbow" and choice.threshold_seconds == pytest.approx(600, rel=1e-4)


def test_no_gaps_gives_an_hour(spark):
    choice = gaps.select_threshold(timeline_of(spark, [("a", "", 0, "x"), ("b", "", 5, "x")])).first()
    assert (choice.method, choice.threshold_seconds, choice.ratio) == ("elbow", 3600.0, 1.0)


def test_otsu_against_direct_variances(spark):
    rnd = np.random.default_rng(1)
    counts = rnd.integers(0, 20, 40)
    counts[15:20] = 0
    rows = [(i, float(i), float(i + 1), int(n)) for i, n in enumerate(counts)]
    got = gaps.otsu_threshold(spark.createDataFrame(rows, "bin int, lo double, hi double, n bigint")).first()
    c, p = np.arange(40) + 0.5, counts / counts.sum()
    between = [(p[:i + 1].sum() * p[i + 1:].sum()) * (np.average(c[:i + 1], weights=p[:i + 1]) - np.average(c[i + 1:], weights=p[i + 1:])) ** 2
               if 0 < p[:i + 1].sum() < 1 else 0 for i in range(39)]
    total = np.average((c - np.average(c, weights=p)) ** 2, weights=p)
    assert got.bin == int(np.argmax(np.round(between, 10)))
    assert got.ratio == pytest.approx(1 - max(between) / total)
    assert got.threshold_seconds == pytest.approx(math.exp(got.bin + 0.5))


def test_session_curve_counts_larger_gaps(spark, windows):
    rows = by_times([0, 1, 3, 6, 16], "a") + by_times([0, 2, 2.0005], "b")
    curve = {r.gap_us / 1e6: r.sessions for r in gaps.session_curve(gaps.positive_gaps(timeline_of(spark, rows)), 2).collect()}
    every = [1, 2, 3, 10, 2, 0.0005]
    assert curve == {g: 2 + sum(o > g + GAP_EPSILON for o in every) for g in set(every)}


def test_sessions_split_only_above_the_threshold(spark, windows):
    rows = by_times([0, 10, 20, 30.000001, 31, 60], "u")
    line = gaps.assign_sessions(timeline_of(spark, rows), 10.0)
    assert column(line.rows, "session_id") == ["u-0001"] * 3 + ["u-0002"] * 2 + ["u-0003"]
    roll = {r.session_id: (r.n_events, r.span_seconds) for r in gaps.session_rollup(line.rows).collect()}
    assert roll["u-0001"] == (3, 20.0) and roll["u-0002"][0] == 2


def test_session_numbers_beyond_four_digits(spark):
    df = spark.range(1).select(F.printf(F.lit("%s-%04d"), F.lit("u"), F.lit(12345)).alias("s"))
    assert df.first().s == "u-12345"


TWO_USERS = by_times([0, 45, 10845, 10870], "user-1") + by_times([60, 105], "user-2")


def test_two_users(spark):
    line = timeline_of(spark, TWO_USERS)
    choice = gaps.select_threshold(line).first()
    assert choice.method == "otsu"
    ids = column(gaps.assign_sessions(line, choice.threshold_seconds).rows, "session_id")
    assert ids[0] == ids[1] != ids[2] == ids[3] and ids[4] == ids[5]
    stats = features.user_robust_stats(line, features.global_robust_stats(line))
    assert sorted(r.uid for r in features.fallback_users(stats).collect()) == ["user-1", "user-2"]


def robust_reference(gaps_by_user):
    logs = {u: [math.log(g + GAP_EPSILON) for g in gs] for u, gs in gaps_by_user.items()}
    every = [x for xs in logs.values() for x in xs]
    spread = lambda xs: (np.median(xs), np.median(np.abs(np.array(xs) - np.median(xs))))
    out = {}
    for u, xs in logs.items():
        med, mad = spread(xs if len(xs) >= 5 else every)
        if abs(mad) <= 1e-12:
            mad = spread(every)[1] or 1e-9
        out[u] = [0.0 if g == 0 else (x - med) / (1.4826 * mad) for g, x in zip(gaps_by_user[u], xs)]
    return out


def test_robust_z_user_and_fallback(spark, windows):
    times = {"user-a": [0, 1, 3, 7, 15, 31], "user-b": [0, 0.5, 1.0, 1.5]}
    rows = [(u, "", t, "x") for u, ts in times.items() for t in ts]
    line = timeline_of(spark, rows)
    got = features.deltify(line).rows.collect()
    want = robust_reference({u: [0, *np.diff(ts)] for u, ts in times.items()})
    for u in times:
        mine = [r.robust_z for r in sorted(got, key=lambda r: r.idx) if r.uid == u]
        assert mine == pytest.approx(want[u], abs=1e-9)


def test_clip(spark):
    line = timeline_of(spark, by_times(np.cumsum([0, 0.01, 0.01, 0.01, 0.01, 5000]).tolist()))
    rows = features.with_robust_z(line, features.user_robust_stats(line, features.global_robust_stats(line))).rows
    assert column(rows, "robust_z")[-1] > 5 and column(rows, "robust_z_clipped")[-1] == 5.0


def test_rolling_quartiles_and_burst(spark, windows):
    deltas = [0, 3, 1, 4, 1.5, 9, 2, 6]
    line = timeline_of(spark, by_times(np.cumsum(deltas).tolist()))
    rows = features.with_rolling(line).rows
    for q, name in ((0.25, "prev_q25_seconds"), (0.75, "prev_q75_seconds")):
        want = [np.quantile(deltas[max(0, i - 5):i], q) if i else deltas[0] for i in range(len(deltas))]
        assert column(rows, name) == pytest.approx(want)
    want = [((deltas[i - 1] if i else deltas[0]) + 1e-3) / (deltas[i] + 1e-3) for i in range(len(deltas))]
    assert column(rows, "burst_ratio") == pytest.approx(want)


def test_model_scale(spark):
    rows = [("u1", "s1", 0, "cat_a"), ("u1", "s1", 30, "cat_b"), ("u1", "s1", 150, "cat_a"),
            ("u2", "s2", 0, "cat_c"), ("u2", "s2", 600, "cat_c")]
    line = gaps.with_session_gap(gaps.session_timeline(events(spark, rows), ["idx"]))
    stats = features.raw_scale_stats(line)
    row = stats.first()
    assert (row.median_seconds, row.mad_seconds, row.scale) == (30.0, 30.0, pytest.approx(1.4826 * 30))
    assert all(abs(z) <= 5 for z in column(features.with_model_z(line, stats).rows, "z"))
