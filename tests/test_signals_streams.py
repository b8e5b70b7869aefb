import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import SECOND
from tempolog.operators import features, gaps, signals
from tempolog.session import durable
from tempolog.streaming import flows


def series(spark, times, ref, y=None, base=None):
    rows = [("s", round(t * SECOND), float(r), float(v), float(b)) for t, r, v, b in zip(times, ref, y or ref, base or ref)]
    return spark.createDataFrame(rows, "series string, ts_us bigint, ref double, y double, y_base double")


def test_resample(spark, windows):
    df = series(spark, [0, 1, 1.9, 3.1], [0, 1, 1.9, 3.1], [0.5, 1.5, 2.4, 3.6], [0, 0, 1, 1])
    got = signals.resample_linear(df).orderBy("k").collect()
    assert [r.t for r in got] == [0, 1, 2, 3]
    assert [r.ref for r in got] == pytest.approx([0, 1, 2, 3])
    assert [r.y for r in got] == pytest.approx([0.5, 1.5, 2.5, 3.5]) and [r.y_base for r in got] == [0, 0, 1, 1]


def test_resample_against_numpy(spark, windows):
    rnd = np.random.default_rng(4)
    times = np.cumsum(rnd.integers(1, 9, 15)).astype(float)
    values = rnd.normal(size=15).tolist()
    got = signals.resample_linear(series(spark, times, values)).orderBy("k").collect()
    grid = np.arange(15) * np.median(np.diff(times))
    assert [r.t for r in got] == pytest.approx(grid)
    assert [r.ref for r in got] == pytest.approx(np.interp(grid, times - times[0], values))


def test_single_sample_is_unchanged(spark):
    got = signals.resample_linear(series(spark, [7], [3])).collect()
    assert [(r.k, r.t, r.ref) for r in got] == [(0, 0.0, 3.0)]


def metrics(t, ref, y):
    dt, e = np.diff(t, prepend=t[0]), ref - y
    ref_ss = ref[-1]
    up = lambda level: next((t[i] for i in range(len(t)) if y[i] >= level * ref_ss), None)
    within = np.abs(y - ref_ss) <= 0.02 * abs(ref_ss)
    settle = next((t[k] for k in range(len(t)) if within[k:].all()), None)
    rise = None if up(0.1) is None or up(0.9) is None else up(0.9) - up(0.1)
    over = None if ref_ss == 0 else max(0, (y.max() - ref_ss) / ref_ss * 100)
    return (np.abs(e) @ dt, e**2 @ dt, (t * np.abs(e)) @ dt), (rise, settle, over, ref_ss - y[-1])


@pytest.mark.parametrize("shape", ["settles", "never", "zero"])
def test_control_metrics(spark, shape):
    t = np.arange(0, 10.05, 0.05)
    y = 1 - np.exp(-1.2 * t) + 0.05 * np.exp(-0.4 * t) * np.sin(1.5 * t)
    ref = {"settles": np.ones_like(t), "never": np.full_like(t, 5.0), "zero": np.zeros_like(t)}[shape]
    df = spark.createDataFrame([("s", float(a), float(b), float(c)) for a, b, c in zip(t, ref, y)], "series string, t double, ref double, y double")
    errors, step = metrics(t, ref, y)
    got = signals.control_errors(df).first()
    assert (got.iae, got.ise, got.itae) == pytest.approx(errors)
    got = signals.step_response(df).first()
    for mine, want in zip((got.rise_time, got.settling_time, got.overshoot_pct, got.steady_state_error), step):
        assert mine is None if want is None else mine == pytest.approx(want)


SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string"


def event_files(spark, folder, parts=(0, 1, 2)):
    """Three files, each later than the one before if read in order, so that state has to live across triggers."""
    rnd = np.random.default_rng(8)
    at, rows = 0, []
    for i in range(90):
        at += int(rnd.integers(1, 900))
        rows.append((i, at, int(rnd.integers(0, 4)), str(rnd.choice(["view", "click", "buy"]))))
    for part in parts:
        df = spark.createDataFrame(rows[part * 30:part * 30 + 30], "event_id bigint, s bigint, user_id bigint, event_type string")
        df = df.select("event_id", F.timestamp_seconds("s").alias("ts"), "user_id", "event_type")
        df.coalesce(1).write.mode("append").parquet(folder)
    return spark.read.schema(SCHEMA).parquet(folder)


def as_line(batch):
    ev = batch.select("event_id", F.col("user_id").cast("string").alias("uid"), F.unix_micros("ts").alias("ts_us"), F.col("event_type").alias("op"))
    return gaps.with_user_gap(gaps.user_timeline(ev, ["event_id"]))


def test_closed_sessions_equal_batch(spark, tmp_path):
    folder = str(tmp_path / "events")
    batch = event_files(spark, folder)
    roll = gaps.session_rollup(gaps.assign_sessions(as_line(batch), 1500).rows)
    horizon = batch.agg(F.max(F.unix_micros("ts"))).first()[0] - 3600 * SECOND
    closed = {(r.uid, r.n_events, r.start_us, r.end_us) for r in roll.collect() if r.end_us + 1500 * SECOND <= horizon}
    live = flows.sessions_to_table(spark, batch.schema, folder, 1500, files_per_trigger=1)
    assert closed and {(r.uid, r.n_events, r.start_us, r.end_us) for r in live.collect()} == closed


def check_live(spark, batch, folder, stream, **settings):
    """Features and transitions of the stream against batch; the second table finds its stream at the end already."""
    line = as_line(batch)
    stats = durable(features.user_robust_stats(line, features.global_robust_stats(line)))
    want = {r.event_id: r for r in features.with_robust_z(features.with_rolling(line), stats).rows.collect()}
    got = flows.features_so_far(spark, batch.schema, folder, stats, folder=stream, files_per_trigger=1, **settings).collect()
    assert sorted(r.event_id for r in got) == sorted(want)
    for r in got:
        w = want[r.event_id]
        assert (r.gap_us, r.prev_q25_seconds, r.prev_q75_seconds) == (w.gap_us, w.prev_q25_seconds, w.prev_q75_seconds)
        assert r.robust_z == pytest.approx(w.robust_z_clipped) and r.burst_ratio == pytest.approx(w.burst_ratio)
    pairs = line.previous(src="op").rows.filter("src is not null").groupBy("src", F.col("op").alias("dst")).count()
    counts = flows.transitions_so_far(spark, batch.schema, folder, folder=stream, files_per_trigger=1, **settings)
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, pairs.collect()))
    return spark.read.parquet(f"{stream}/table")


@pytest.mark.parametrize("parts", [(0, 1, 2), (2, 1, 0), (1, 2, 0)])
def test_live_features_do_not_depend_on_the_order_of_files(spark, tmp_path, parts):
    folder = str(tmp_path / "events")
    batch = event_files(spark, folder, parts)
    let_go = check_live(spark, batch, folder, str(tmp_path / "stream"))
    assert let_go.where("prev_op is not null").count() > 0


def test_live_features_of_a_frequent_user_in_shuffled_files(spark, tmp_path, windows):
    rnd, folder = np.random.default_rng(5), str(tmp_path / "events")
    rows = [(i, int(t), None if rnd.random() < 0.05 else 1 if rnd.random() < 0.6 else int(rnd.integers(2, 6)), str(rnd.choice(["view", "click"])))
            for i, t in enumerate(np.sort(rnd.integers(0, 40_000, 300)))]
    late = rnd.integers(0, 3000, 300)  # mostly less than the delay of 2000 seconds
    order = np.argsort([r[1] + late[r[0]] for r in rows])
    for piece in np.array_split(order, 4):
        df = spark.createDataFrame([rows[i] for i in piece], "event_id bigint, s bigint, user_id bigint, event_type string")
        df.select("event_id", F.timestamp_seconds("s").alias("ts"), "user_id", "event_type").coalesce(1).write.mode("append").parquet(folder)
    check_live(spark, spark.read.schema(SCHEMA).parquet(folder), folder, str(tmp_path / "stream"), delay="2000 seconds")


def test_state_of_silent_users_is_given_up_and_nothing_lost(spark, tmp_path):
    folder, stream = str(tmp_path / "events"), str(tmp_path / "stream")
    day = 86_400
    rows = [(d * 10 + k, (d + 1) * day + k * 60, 1 if d % 8 == 0 else 100 + d, "view" if k % 2 else "click") for d in range(9) for k in range(1 + d % 3 * 3)]
    rows.append((999, 12 * day, 200, "view"))
    for lot in ([r for r in rows if r[1] < 4 * day], [r for r in rows if 4 * day <= r[1] < 7 * day], [r for r in rows if r[1] >= 7 * day]):
        df = spark.createDataFrame(lot, "event_id bigint, s bigint, user_id bigint, event_type string")
        df.select("event_id", F.timestamp_seconds("s").alias("ts"), "user_id", "event_type").coalesce(1).write.mode("append").parquet(folder)
    let_go = check_live(spark, spark.read.schema(SCHEMA).parquet(folder), folder, stream, idle=day // 2)
    lives = {r.uid: r.n for r in let_go.groupBy("uid").agg(F.countDistinct("since_us").alias("n")).collect()}
    assert lives["1"] > 1  # came back after the state was cleared
    kept = [r.key.uid for r in spark.read.format("statestore").option("stateVarName", "recent").load(f"{stream}/checkpoint").collect()]
    assert len(kept) <= 1 and len(lives) >= 5


@pytest.mark.parametrize("parts", [(0, 1, 2), (2, 1, 0), (1, 2, 0)])
def test_sessions_so_far_do_not_depend_on_the_order_of_files(spark, tmp_path, parts):
    folder = str(tmp_path / "events")
    batch = event_files(spark, folder, parts)
    ev = batch.select("event_id", F.col("user_id").cast("string").alias("uid"), F.unix_micros("ts").alias("ts_us"), F.col("event_type").alias("op"))
    line = gaps.with_user_gap(gaps.user_timeline(ev, ["event_id"]))
    want = {(r.uid, r.n_events, r.start_us, r.end_us) for r in gaps.session_rollup(gaps.assign_sessions(line, 1500).rows).collect()}
    got = flows.sessions_so_far(spark, batch.schema, folder, 1500, files_per_trigger=1).collect()
    assert len(got) == len(want) and {(r.uid, r.n_events, r.start_us, r.end_us) for r in got} == want
    assert {r.is_final for r in got} == {True, False}
