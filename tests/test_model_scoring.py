import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import column, events
from tempolog.operators import behavior, evaluation, features, gaps, scoring
from tempolog.session import durable

MARKOV = [("u", "s1", t, op) for t, op in ((0, "AUTH"), (1, "READ"), (2, "READ"), (3, "UPDATE"))]
MARKOV += [("v", "s2", t, op) for t, op in ((0, "AUTH"), (1, "READ"))]


def session_line(spark, rows):
    return gaps.session_timeline(events(spark, rows), ["idx"])


def test_markov_model(spark, windows):
    line = session_line(spark, MARKOV)
    vocab = behavior.vocabulary(line.rows)
    pi = {r.op: r.p for r in behavior.initial_distribution(line.rows, ["idx"], vocab).collect()}
    assert pi == pytest.approx({"AUTH": 7 / 9, "READ": 1 / 9, "UPDATE": 1 / 9})
    counts = behavior.transition_counts(behavior.next_event_pairs(line))
    a = {(r.src, r.dst): r.p for r in behavior.transition_matrix(counts, vocab).collect()}
    assert a["AUTH", "READ"] == pytest.approx(7 / 9) and a["AUTH", "AUTH"] == pytest.approx(1 / 9)
    assert a["READ", "READ"] == a["READ", "UPDATE"] == pytest.approx(4 / 9)
    assert all(a["UPDATE", d] == pytest.approx(1 / 3) for d in ("AUTH", "READ", "UPDATE"))  # never left
    summary = behavior.model_summary(line.rows).first()
    assert (summary.categories, summary.n_events, summary.n_sessions) == ("AUTH,READ,UPDATE", 6, 2)


def test_lognormal(spark):
    rows = spark.createDataFrame(
        [("AUTH", 2.0), ("READ", 1.0), ("READ", 4.0), ("UPDATE", 3.0), ("AUTH", 5.0), ("READ", 2.0), ("READ", 0.0)], "op string, d double")
    got = {r.op: r for r in behavior.lognormal_params(rows, F.col("d")).collect()}
    assert got["AUTH"].mu == pytest.approx(1.1512925465) and got["AUTH"].sigma == pytest.approx(0.4581453659)
    assert got["UPDATE"].mu == pytest.approx(1.0986122887) and got["UPDATE"].sigma == 0
    assert got["READ"].n == 3  # a wait of zero is not part of the timing model
    floor = {r.op: r.sigma for r in behavior.with_sigma_floor(behavior.lognormal_params(rows, F.col("d"))).collect()}
    assert floor["UPDATE"] == 1e-9


def model_tables(spark, p_last=0.5):
    initial = spark.createDataFrame([("a", 0.2), ("b", 0.3), ("c", p_last)], "op string, p double")
    matrix = spark.createDataFrame([(s, d, 0, p) for s in "abc" for d, p in zip("abc", (0.5, 0.25, 0.25))], "src string, dst string, n bigint, p double")
    timing = spark.createDataFrame([(s, 1, 0.1, 0.5) for s in "abc"], "op string, n bigint, mu double, sigma double")
    return initial, matrix, timing


def test_model_checks(spark):
    initial, matrix, timing = model_tables(spark)
    assert behavior.check_model(initial, matrix, timing).count() == 0
    assert [r.rule for r in behavior.check_model(model_tables(spark, 0.4)[0], matrix, timing).collect()] == ["initial_sum"]
    bad = matrix.withColumn("p", F.when(F.col("src") == "b", F.col("p") * 2).otherwise(F.col("p")))
    assert {(r.rule, r.item) for r in behavior.check_model(initial, bad, timing).collect()} == {("transition_row_sum", "b")}
    gone = {r.rule for r in behavior.check_model(initial, matrix.filter("src <> 'c'"), timing.filter("op <> 'a'")).collect()}
    assert gone == {"transition_row_missing", "timing_missing"}


SEQUENCES = [("u1", "s1", 0, "cat_a"), ("u1", "s1", 30, "cat_b"), ("u1", "s1", 150, "cat_a"), ("u2", "s2", 0, "cat_c"), ("u2", "s2", 600, "cat_c")]


def test_sequences_and_vocabulary(spark):
    line = gaps.with_session_gap(session_line(spark, SEQUENCES))
    line = features.with_model_z(line, features.raw_scale_stats(line))
    vocab = behavior.vocabulary(line.rows)
    assert {r.op: r.idx for r in vocab.collect()} == {"cat_a": 0, "cat_b": 1, "cat_c": 2}
    got = {r.session_id: r for r in behavior.session_sequences(line, vocab).collect()}
    assert got["s1"].op_indices == [0, 1, 0] and got["s1"].delta_seconds == [0, 30, 120] and got["s2"].length == 2
    parts = behavior.session_sequences(line, vocab, piece=2).filter("session_id = 's1'").orderBy("part").collect()
    assert [p.op_indices for p in parts] == [[0, 1], [0]]
    back = behavior.decode(behavior.encode(line.rows, vocab).drop("op"), vocab)
    assert column(back, "op") == [r[3] for r in SEQUENCES]


@pytest.mark.parametrize("level", ["session", "user"])
def test_folds_do_not_share_groups(spark, windows, level):
    rows = events(spark, [(f"u{i % 4}", f"s{i}", i, "x") for i in range(9)])
    folds = behavior.group_kfold(rows, 3, level).collect()
    assert len(folds) == (9 if level == "session" else 4) and {f.fold for f in folds} == {0, 1, 2}
    keys = sorted(folds, key=lambda f: tuple(f)[:-1])
    assert [f.fold for f in keys] == [i % 3 for i in range(len(keys))]
    with pytest.raises(ValueError):
        behavior.group_kfold(rows, 20, level)


def test_category_thresholds(spark):
    rows = [("cat_a", v) for v in (0.1, 0.2, 0.3, 0.4)] + [("cat_b", 1.0), ("cat_b", 1.5)]
    scored = spark.createDataFrame(rows, "op string, residual double")
    vocab = spark.createDataFrame([("cat_a", 0), ("cat_b", 1), ("cat_c", 2)], "op string, idx int")
    got = {r.op: (r.tau_lo, r.tau_hi) for r in scoring.category_thresholds(scored, vocab, alpha=0.25).collect()}
    assert got["cat_a"] == pytest.approx((0.175, 0.325)) and got["cat_b"] == pytest.approx((1.125, 1.375)) and got["cat_c"] == (None, None)
    with pytest.raises(ValueError):
        scoring.category_thresholds(scored, vocab, alpha=0.6)


LOGIN = [("u", "s", 0, "login"), ("u", "s", 5, "click"), ("u", "s", 15, "logout")]


def test_scores_with_an_outside_predictor(spark):
    line = gaps.with_session_gap(session_line(spark, LOGIN))
    line = features.with_model_z(line, features.raw_scale_stats(line)).previous(prev_op="op")
    rows = line.rows.withColumns({"p": F.lit(1 / 3), "z_hat": F.lit(0.0), "best_op": F.lit("click")})
    thresholds = spark.createDataFrame([("login", 0.25), ("click", 0.25), ("logout", 0.5)], "op string, tau_hi double")
    out = scoring.score(rows, thresholds)
    assert column(out, "z") == pytest.approx([-0.67448975, 0, 0.67448975], abs=2e-6)
    assert column(out, "s_cls") == pytest.approx([0, 2 / 3, 2 / 3])
    assert column(out, "S") == pytest.approx([0, 1 / 3, 0.5 * (2 / 3 + 0.67448975)], abs=2e-6)
    assert column(out, "flag_cls") == [0, 0, 1] and column(out, "flag_dt") == [0, 0, 1]
    assert column(scoring.score(rows, None), "flag_dt") == [0, 0, 0]
    assert scoring.scored_table(out).columns[0] == "timestamp_utc"
    with pytest.raises(ValueError):
        scoring.score(rows, None, w_cls=-1)


def test_predictor_defaults_for_the_unseen(spark):
    line = gaps.with_session_gap(session_line(spark, MARKOV))
    line = features.with_model_z(line, features.raw_scale_stats(line))
    vocab = behavior.vocabulary(line.rows)
    model = scoring.fit_predictor(behavior.next_event_pairs(line), vocab)
    asked = spark.createDataFrame([(0, "AUTH", "READ", 0.0), (1, "AUTH", "UPDATE", 0.0), (2, "UPDATE", "READ", 0.0)], "idx int, prev_op string, op string, z double")
    out = scoring.with_prediction(asked, model)
    assert column(out, "p") == pytest.approx([7 / 9, 1 / 9, 1 / 3]) and column(out, "best_op") == ["READ", "READ", "AUTH"]


def auc_by_pairs(labels, scores):
    pos = [s for s, l in zip(scores, labels) if l]
    neg = [s for s, l in zip(scores, labels) if not l]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def ap_by_steps(labels, scores):
    area = seen = hits = 0
    for s in sorted(set(scores), reverse=True):
        here = [l for l, v in zip(labels, scores) if v == s]
        seen, hits = seen + len(here), hits + sum(here)
        area += hits / seen * sum(here)
    return area / sum(labels)


def test_ranking_metrics(spark, windows):
    rnd = np.random.default_rng(0)
    labels, scores = rnd.integers(0, 2, 60).tolist(), (rnd.integers(0, 12, 60) / 4).tolist()
    df = spark.createDataFrame(list(zip(labels, scores)), "label int, s double")
    tallied = evaluation.tally(df, "s", "label")
    assert evaluation.roc_auc(tallied).first().roc_auc == pytest.approx(auc_by_pairs(labels, scores))
    assert evaluation.average_precision(tallied).first().average_precision == pytest.approx(ap_by_steps(labels, scores))
    one = evaluation.tally(df.filter("label = 1"), "s", "label")
    assert evaluation.roc_auc(one).first().roc_auc is None
    none = evaluation.tally(df.filter("label = 0"), "s", "label")
    assert evaluation.average_precision(none).first().average_precision is None


def test_macro_from_probability_maps(spark):
    rows = [("a", {"a": 0.6, "b": 0.4}), ("b", {"a": 0.5, "b": 0.5}), ("b", {"a": 0.1, "b": 0.9}), ("a", {"a": 0.3, "b": 0.7})]
    tallied = evaluation.explode_classes(spark.createDataFrame(rows, "y string, p map<string,double>"), "p", "y")
    got = evaluation.macro_over_classes(tallied).first()
    labels = {c: [int(y == c) for y, _ in rows] for c in "ab"}
    scores = {c: [p[c] for _, p in rows] for c in "ab"}
    assert got.roc_auc == pytest.approx(np.mean([auc_by_pairs(labels[c], scores[c]) for c in "ab"]))
    assert got.pr_auc == pytest.approx(np.mean([ap_by_steps(labels[c], scores[c]) for c in "ab"]))


def test_losses_and_f1(spark):
    rows = spark.createDataFrame([("a", "a", 0.5, 0.0, 0.4), ("a", "b", 1e-12, 0.0, 3.0)], "op string, best_op string, p double, z_hat double, z double")
    got = evaluation.loss_summary(rows, lambda_time=2.0).first()
    assert got.ce == pytest.approx((-math.log(0.5) - math.log(1e-9)) / 2)
    assert got.huber == pytest.approx((0.08 + 2.5) / 2) and got.total == pytest.approx(got.ce + 2 * got.huber)
    assert evaluation.micro_f1(rows).first().f1 == 0.5


def test_detection_delay(spark):
    rows = [("u", "hit", 0, None, 0, 0), ("u", "hit", 10, "x", 0, 0), ("u", "hit", 25, "x", 0, 1), ("u", "hit", 99, "x", 1, 0),
            ("u", "quiet", 0, None, 0, 0), ("u", "quiet", 40, "x", 0, 0), ("u", "single", 5, None, 0, 0)]
    df = spark.createDataFrame([(u, s, t * 1_000_000, p, c, d) for u, s, t, p, c, d in rows],
                               "uid string, session_id string, ts_us bigint, prev_op string, flag_cls int, flag_dt int")
    got = evaluation.detection_delay(df).first()
    assert got.n_sessions == 2 and got.delay_seconds == pytest.approx((25 + 40) / 2)
    assert evaluation.detection_delay(df.filter("session_id = 'single'")).first().delay_seconds == 0.0


def test_sparse_model_equals_dense(spark):
    rnd = np.random.default_rng(6)
    rows = [(str(a), str(b), 0.0) for a, b in rnd.integers(0, 9, (120, 2)) if a != 8]
    pairs = spark.createDataFrame(rows, "prev_op string, op string, z double")
    vocab = spark.createDataFrame([(str(i),) for i in range(12)], "op string")
    counts = behavior.transition_counts(pairs)
    dense = {(r.src, r.dst): r.p for r in behavior.transition_matrix(counts, vocab).collect()}
    seen, rest = behavior.sparse_transitions(counts, vocab)
    got = {(r.src, r.dst): r.p for r in seen.collect()}
    default = {r.src: r for r in rest.collect()}
    assert len(got) < len(dense) and len(default) == 12
    assert {k: got.get(k, default[k[0]].p) for k in dense} == pytest.approx(dense, rel=1e-12)
    initial = vocab.withColumn("p", F.lit(1 / 12))
    timing = vocab.select("op", F.lit(0.0).alias("mu"), F.lit(1.0).alias("sigma"))
    assert behavior.check_model(initial, seen, timing, rest=rest).count() == 0
    worse = rest.withColumn("p", F.when(F.col("src") == "11", 2.0).otherwise(F.col("p")))
    assert {(r.rule, r.item) for r in behavior.check_model(initial, seen, timing, rest=worse).collect()} == {
        ("transition_not_probability", "11->*"), ("transition_row_sum", "11")}

    model = scoring.fit_predictor(pairs.limit(60), vocab)
    want = evaluation.one_vs_rest(model, vocab, pairs)
    roc = {r.cls: r.roc_auc for r in evaluation.roc_auc(want, ["cls"]).collect() if r.n_pos}
    ap = {r.cls: r.average_precision for r in evaluation.average_precision(want, ["cls"]).collect() if r.n_pos}
    sparse = evaluation.one_vs_rest_sparse(model, pairs).collect()
    assert {r.cls: r.roc_auc for r in sparse} == pytest.approx(roc) and {r.cls: r.average_precision for r in sparse} == pytest.approx(ap)


def test_sparse_model_of_many_operations(spark):
    size = 200_000
    vocab = spark.range(size).select(F.format_string("op%06d", "id").alias("op"))
    pairs = spark.range(300_000).select(F.format_string("op%06d", F.pmod(F.xxhash64("id"), F.lit(size))).alias("prev_op"),
                                        F.format_string("op%06d", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(size))).alias("op"), F.lit(0.0).alias("z"))
    counts = behavior.transition_counts(pairs)
    seen, rest = behavior.sparse_transitions(counts, vocab)
    assert seen.count() == counts.count() <= 300_000 and rest.count() == size
    total = seen.agg(F.sum("p")).first()[0] + rest.agg(F.sum(F.col("unseen") * F.col("p"))).first()[0]
    assert total == pytest.approx(size)
    ranked = evaluation.one_vs_rest_sparse(scoring.fit_predictor(pairs, vocab), pairs)
    assert ranked.agg(F.sum("n_pos")).first()[0] == 300_000 and ranked.where("roc_auc < 0.5").count() == 0
