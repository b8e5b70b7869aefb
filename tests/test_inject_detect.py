import random

import pytest
from pyspark.sql import functions as F

from helpers import SECOND, column, events
from tempolog.functions.scalars import draw
from tempolog.operators import behavior, detection, evaluation, gaps, injection
from tempolog.operators.injection import Rule, Rules


def session_line(spark, rows):
    return gaps.session_timeline(events(spark, rows), ["idx"])


THREE = [("u", "s", 0, "login"), ("u", "s", 10, "click"), ("u", "s", 20, "logout")]


@pytest.mark.parametrize("mode,times", [("local", [0, 5, 15]), ("propagate", [0, 5, 10])])
def test_time_rules(spark, mode, times):
    line = injection.inject_time(session_line(spark, THREE), [Rule(1.0, op="login", mode=mode, scale=0.5)], 1, "idx")
    assert [t / SECOND for t in column(line.rows, "new_ts_us")] == times
    hit = column(line.rows, "time_hits")[0][0]
    assert (hit.seconds_before, hit.seconds_after) == (10.0, 5.0)


def random_events(n=60):
    rnd = random.Random(11)
    clock, rows = {}, []
    for _ in range(n):
        u = rnd.choice(["a", "a", "b", "c"])
        s = f"{u}-{rnd.choice([1, 2])}"
        clock[s] = clock.get(s, 0) + rnd.randrange(1, 50)
        rows.append((u, s, clock[s], rnd.choice(["AUTH", "READ", "UPDATE"])))
    return rows


def draws(spark, n, kind, number, seed):
    ids = spark.range(n).select("id", draw(seed, kind, number, "id").alias("u"))
    return {r.id: r.u for r in ids.collect()}


def by_session(rows):
    groups = {}
    for i, (u, s, t, o) in enumerate(rows):
        groups.setdefault((u, s), []).append((t, i, o))
    return [sorted(g) for g in groups.values()]


def test_time_rules_against_a_loop(spark, windows):
    rows = random_events()
    rules = [Rule(0.3, mode="propagate", scale=1.5), Rule(0.4, op="READ", delta=-7.0), Rule(0.2, mode="propagate", delta=3.0, scale=0.5)]
    u = [draws(spark, len(rows), "time", n, 5) for n in range(3)]
    want = {}
    for group in by_session(rows):
        now, mul, add = group[0][0] * SECOND, 1.0, 0.0
        for n, (t, i, op) in enumerate(group):
            want[i] = now
            value = (group[n + 1][0] - t if n + 1 < len(group) else 0) * mul + add
            for r, draws_r in zip(rules, u):
                if (r.op in (None, op)) and draws_r[i] <= r.p:
                    value = value * (1 if r.scale is None else r.scale) + (r.delta or 0)
                    if r.mode == "propagate":
                        mul, add = mul * (1 if r.scale is None else r.scale), add + (r.delta or 0)
            now += round(max(value, 0) * 1e6)
    line = injection.inject_time(session_line(spark, rows), rules, 5, "idx")
    assert column(line.rows, "new_ts_us") == [want[i] for i in range(len(rows))]


def test_swaps_against_a_loop(spark, windows):
    rows = random_events()
    u = draws(spark, len(rows), "order", 0, 5)
    want = {i: r[3] for i, r in enumerate(rows)}
    pairs = set()
    for group in by_session(rows):
        n = 0
        while n < len(group) - 1:
            i, j = group[n][1], group[n + 1][1]
            if want[i] == "READ" and u[i] <= 0.7:
                want[i], want[j] = want[j], want[i]
                pairs.add((i, j))
                n += 2
            else:
                n += 1
    line = injection.inject_order(session_line(spark, rows), Rule(0.7, op="READ"), 0, 5, "idx")
    assert column(line.rows, "op") == [want[i] for i in range(len(rows))]
    assert {(r.idx, r.swap["with"]) for r in line.rows.collect() if r.swap} == pairs and pairs


def test_swap_and_its_audit(spark):
    rules = Rules(time=[Rule(1.0, op="login", scale=2.0)], order=[Rule(1.0, op="login")])
    rows = [("u", "s", 0, "login"), ("u", "s", 10, "confirm")]
    out = injection.inject(session_line(spark, rows), rules, 9, "idx")
    assert column(out, "op") == ["confirm", "login"]
    audit = {r.type: r for r in injection.audit_table(out, rules, 9, "idx").collect()}
    assert audit["order"].constraint == "login->confirm" and audit["order"].swap_with == 1
    assert audit["time"].op == "confirm"  # the operation after the swap
    assert audit["time"].reason == "wait of 10.000 s became 20.000 s (times 2.0; this wait only)"
    assert audit["time"].params == '{"scale":2.0}'


def test_unauth(spark):
    rows = [("u", "s", 0, "AUTH"), ("u", "s", 5, "UPDATE")]
    out = injection.inject(session_line(spark, rows), Rules(unauth=[Rule(1.0)]), 3, "idx")
    assert column(out, "session_id") == ["s", "s-unauth-3-1"]
    entry = injection.audit_table(out, Rules(unauth=[Rule(1.0)]), 3, "idx").first()
    assert (entry.type, entry.session_original, entry.session_mutated, entry.auth_required) == ("unauth", "s", "s-unauth-3-1", True)


def test_replay_exchanges_two_owners(spark):
    rows = [("user-1", "sess-1", 0, "READ"), ("user-2", "sess-2", 0, "READ")]
    rules = Rules(token_replay=[Rule(1.0)])
    out = injection.inject(session_line(spark, rows), rules, 3, "idx")
    assert column(out, "session_id") == ["sess-2", "sess-1"]
    assert {(r.uid, r.token_owner_uid) for r in injection.audit_table(out, rules, 3, "idx").collect()} == {("user-1", "user-2"), ("user-2", "user-1")}
    found = detection.detect_token_replay(
        spark.createDataFrame([(0, "user-1", "x", 0), (1, "user-2", "x", 5), (2, "user-1", "x", 9)], "idx bigint, uid string, session_id string, ts_us bigint"), ["idx"])
    assert [(r.idx, r.owner) for r in found.collect()] == [(1, "user-1")]


def test_replay_reaches_every_foreign_session_and_no_other(spark):
    # u0 presents a session owned by u1: it must draw neither its own sessions nor that one.
    sessions = [(f"s{i}", f"u{i // 2}") for i in range(8)]
    rows = spark.range(400).select(
        F.col("id").alias("idx"), F.lit("u0").alias("uid"), F.when(F.col("id") % 2 == 0, "s2").otherwise("s0").alias("session_id"),
        F.lit("READ").alias("op"), F.lit(False).alias("unauth")).withColumn("session_before", F.col("session_id"))
    owners = spark.createDataFrame(sessions, "session_id string, owner string")
    out = injection.inject_token_replay(rows, owners, [Rule(1.0)], 1, "idx").collect()
    assert {r.session_id for r in out if r.session_before == "s2"} == {"s3", "s4", "s5", "s6", "s7"}
    assert {r.session_id for r in out if r.session_before == "s0"} == {"s2", "s3", "s4", "s5", "s6", "s7"}
    assert all(dict(sessions)[r.session_id] == r.replay_owner for r in out)


def test_nothing_to_replay(spark):
    out = injection.inject(session_line(spark, THREE), Rules(token_replay=[Rule(1.0)]), 3, "idx")
    assert column(out, "session_id") == ["s"] * 3 and not any(column(out, "replay"))


def test_no_rules_no_change(spark):
    out = injection.inject(session_line(spark, THREE), Rules(), 3, "idx")
    assert injection.audit_table(out, Rules(), 3, "idx").count() == 0
    same = injection.changed_events(out)
    assert column(same, "ts_us") == [0, 10 * SECOND, 20 * SECOND] and column(same, "op") == [r[3] for r in THREE]


def test_detectors_find_what_was_injected(spark):
    rows = [("u", "s", 0, "AUTH"), ("u", "s", 5, "READ"), ("u", "s", 9, "UPDATE"), ("v", "t", 1, "UPDATE"), ("v", "t", 2, "AUTH")]
    line = session_line(spark, rows)
    assert [r.idx for r in detection.detect_unauth(line).collect()] == [3]
    allowed = spark.createDataFrame([("AUTH", "READ"), ("READ", "UPDATE")], "prev_op string, op string")
    assert [(r.prev_op, r.op) for r in detection.detect_order(behavior.next_event_pairs(line), allowed).collect()] == [("UPDATE", "AUTH")]
    rules = Rules(unauth=[Rule(1.0)])
    out = injection.inject(line, rules, 1, "idx")
    dirty = gaps.session_timeline(injection.changed_events(out).select("idx", "uid", "session_id", "ts_us", "op"), ["idx"])
    assert {r.idx for r in detection.detect_unauth(dirty).collect()} == {2, 3}
    labelled = evaluation.label_from_audit(line.rows, injection.audit_table(out, rules, 1, "idx"), "idx")
    assert column(labelled, "label") == [0, 0, 1, 1, 0]


def test_same_result_under_any_partitioning(spark):
    rows, rules = random_events(), Rules(time=[Rule(0.5, mode="propagate", scale=1.5)], order=[Rule(0.5)], unauth=[Rule(0.5)], token_replay=[Rule(0.5)])
    results = []
    for parts, shuffle in (("1", 1), ("16", 7)):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        df = events(spark, rows).repartition(shuffle)
        out = injection.inject(gaps.session_timeline(df, ["idx"]), rules, 2, "idx")
        results.append([tuple(r) for r in out.select("idx", "new_ts_us", "op", "session_id").orderBy("idx").collect()])
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1]
