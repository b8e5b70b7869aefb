"""The registered queries: every operator bound to the given tables, always over all of their rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tempolog.functions.scalars import hmac_sha256, log_gap, micros, parse_time
from tempolog.operators import (
    behavior, detection, evaluation, features, gaps, injection, quality, scoring, signals)
from tempolog.plans.joins import spread
from tempolog.plans.timeline import Timeline
from tempolog.schema import CONTRACT_COLUMNS, CONTRACT_SCHEMA, DELTIFIED_COLUMNS
from tempolog.session import durable, shared_folder
from tempolog.sources import tables
from tempolog.sources.events import as_events, from_contract, to_stage
from tempolog.streaming import flows

TIE = ["event_id"]
WEEK_US = 604_800_000_000
SECRET = b"rotate-me"
SEED = 42
FOLDS = 5
TOP = 100
STREAM_THRESHOLD_SECONDS = 14_400
RULES = injection.Rules(
    time=[injection.Rule(0.05, mode="propagate", scale=1.5), injection.Rule(0.1, op="click", delta=30.0),
          injection.Rule(0.02, mode="propagate", delta=-60.0)],
    order=[injection.Rule(0.2), injection.Rule(0.1, op="view")],
    unauth=[injection.Rule(0.25)],
    token_replay=[injection.Rule(0.05), injection.Rule(0.1, op="error")],
    protected=["purchase"],
)


# --- inputs -------------------------------------------------------------------------------------------------------

def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def events(spark, folder) -> DataFrame:
    return as_events(read(spark, folder, "events"), "user_id", "ts", "event_type", TIE)


def weekly(spark, folder) -> DataFrame:
    """Events with sessions of their own: one per user and week."""
    week = F.floor(F.col("ts_us") / WEEK_US)
    return events(spark, folder).withColumn("session_id", F.printf(F.lit("%s-w%d"), F.col("uid"), week))


def user_line(spark, folder) -> Timeline:
    return gaps.with_user_gap(gaps.user_timeline(events(spark, folder), TIE))


def order_line(spark, folder) -> Timeline:
    orders = as_events(read(spark, folder, "orders"), "o_custkey", "o_orderdate", "o_orderpriority", ["o_orderkey"])
    return gaps.with_user_gap(gaps.user_timeline(orders, ["o_orderkey"]))


def week_line(spark, folder) -> Timeline:
    return gaps.with_session_gap(gaps.session_timeline(weekly(spark, folder), TIE))


def week_line_z(spark, folder) -> Timeline:
    line = week_line(spark, folder)
    return features.with_model_z(line, features.raw_scale_stats(line))


def fitted(spark, folder):
    """Events with what came before them (stored), vocabulary, next-event pairs, and the predictor fitted on them."""
    rows = durable(week_line_z(spark, folder).previous(prev_op="op").rows)
    vocab = behavior.vocabulary(rows)
    pairs = rows.filter("prev_op is not null")
    return rows, vocab, pairs, scoring.fit_predictor(pairs, vocab)


def scored(spark, folder):
    """The scored table, stored, as it would be between the stages of a real run."""
    rows, vocab, pairs, model = fitted(spark, folder)
    residuals = scoring.residuals(scoring.with_prediction(pairs, model))
    thresholds = durable(scoring.category_thresholds(residuals, vocab))
    table = scoring.score(scoring.with_prediction(rows, model), thresholds)
    return durable(table), vocab, pairs, model, thresholds


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), d) for c, d in digits.items()})


# --- gaps and sessions ----------------------------------------------------------------------------------------------

def user_gaps(spark, folder):
    rows = user_line(spark, folder).rows
    return rows.select("event_id", "uid", "gap_us", F.round(log_gap("gap_us"), 6).alias("log_gap"))


def _histogram(spark, folder):
    line = user_line(spark, folder)
    positive = durable(gaps.positive_gaps(line))
    return gaps.gap_histogram(positive, gaps.gap_statistics(positive, line.total))


def gap_histogram(spark, folder):
    return rounded(_histogram(spark, folder), lo=6, hi=6)


def otsu_threshold(spark, folder):
    return rounded(gaps.otsu_threshold(_histogram(spark, folder)), threshold_seconds=3, ratio=6)


def session_curve(spark, folder):
    line = user_line(spark, folder)
    return gaps.session_curve(gaps.positive_gaps(line), line.groups)


def elbow_threshold(spark, folder):
    return rounded(gaps.elbow_threshold(durable(session_curve(spark, folder))), threshold_seconds=3)


def assign_sessions(spark, folder):
    line = gaps.auto_sessions(events(spark, folder), TIE)
    return line.rows.select("event_id", "uid", "session_no", "session_id")


def session_rollup(spark, folder):
    return gaps.session_rollup(gaps.auto_sessions(events(spark, folder), TIE).rows)


def elapsed_in_session(spark, folder):
    return gaps.with_elapsed(week_line(spark, folder)).rows.select("event_id", "session_id", "elapsed_seconds")


# --- features ---------------------------------------------------------------------------------------------------------

def global_robust_stats(spark, folder):
    return rounded(features.global_robust_stats(user_line(spark, folder).store("gap_us")), median=6, mad=6)


def _order_stats(spark, folder):
    return features.feature_stats(order_line(spark, folder))


def user_robust_stats(spark, folder):
    stats = _order_stats(spark, folder).withColumn("is_fallback", F.col("is_fallback").cast("int"))
    return rounded(stats, median=6, mad=6)


def fallback_users(spark, folder):
    return features.fallback_users(_order_stats(spark, folder))


def robust_z(spark, folder):
    line = user_line(spark, folder)
    out = features.with_robust_z(line, features.feature_stats(line)).rows
    return rounded(out.select("event_id", "robust_z", "robust_z_clipped"), robust_z=6, robust_z_clipped=6)


def rolling_quartiles(spark, folder):
    return features.with_rolling(user_line(spark, folder)).rows.select("event_id", "prev_q25_seconds", "prev_q75_seconds")


def burst_ratio(spark, folder):
    return rounded(features.with_rolling(user_line(spark, folder)).rows.select("event_id", "burst_ratio"), burst_ratio=6)


def deltified_table(spark, folder):
    """Raw text to the full feature table: map, check, normalise, find sessions, add features."""
    df = read(spark, folder, "events")
    time = F.date_format(F.timestamp_micros(micros(df, "ts")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    raw = df.select("event_id", time.alias("time"), F.col("user_id").alias("user"), F.lit("none").alias("session"),
                    F.lit("GET").alias("verb"), F.col("event_type").alias("url"), F.lit("-").alias("from"),
                    F.lit("agent").alias("agent"), F.col("event_type").alias("kind"))
    mapped = quality.map_columns(raw, RAW_MAPPING, keep=TIE)
    quality.require_clean(quality.check(mapped, "event_id", quality.required_rules(), quality.timestamp_rules()))
    line = gaps.auto_sessions(from_contract(quality.normalize_contract(mapped), TIE), TIE)
    table = to_stage(features.deltify(line).rows, DELTIFIED_COLUMNS)
    out = table.withColumn("timestamp_utc", F.unix_micros("timestamp_utc"))
    return rounded(out, log_delta_t=6, robust_z=6, robust_z_clipped=6, burst_ratio=6)


def session_gaps_raw_z(spark, folder):
    return rounded(week_line_z(spark, folder).rows.select("event_id", "session_id", "gap_us", "z"), z=6)


# --- behaviour model --------------------------------------------------------------------------------------------------

def initial_distribution(spark, folder):
    rows = weekly(spark, folder)
    return rounded(behavior.initial_distribution(rows, TIE, behavior.vocabulary(rows)), p=9)


def _matrix(line: Timeline, vocab: DataFrame) -> DataFrame:
    counts = behavior.transition_counts(behavior.next_event_pairs(line))
    return behavior.transition_matrix(counts, vocab)


def transition_matrix(spark, folder):
    line = gaps.session_timeline(weekly(spark, folder), TIE)
    return rounded(_matrix(line, behavior.vocabulary(line.rows)), p=9)


def _part_pairs(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Shipments of a supplier in order of time, with parts as operations: many of them, few pairs seen."""
    tie = ["l_orderkey", "l_linenumber"]
    rows = as_events(read(spark, folder, "lineitem"), "l_suppkey", "l_shipdate", "l_partkey", tie).withColumn("op", F.col("op").cast("string"))
    pairs = gaps.user_timeline(rows, tie).previous(prev_op="op").rows.filter("prev_op is not null")
    return behavior.vocabulary(rows), durable(pairs.select("uid", "prev_op", "op"))


def _sparse(spark, folder) -> tuple[DataFrame, DataFrame]:
    vocab, pairs = _part_pairs(spark, folder)
    return behavior.sparse_transitions(behavior.transition_counts(pairs), vocab)


def sparse_transitions(spark, folder):
    return rounded(_sparse(spark, folder)[0], p=12)


def sparse_transition_rows(spark, folder):
    return rounded(_sparse(spark, folder)[1], p=12)


def sparse_class_ranking(spark, folder):
    """Suppliers with odd numbers fit the model, the others are scored by it."""
    vocab, pairs = _part_pairs(spark, folder)
    pairs = spread(pairs, pairs.count(), ["prev_op", "op"])  # nearly all are different, so counting them by task first saves nothing
    odd = F.col("uid").cast("bigint") % 2 == 1
    model = scoring.fit_predictor(pairs.where(odd).withColumn("z", F.lit(0.0)), vocab)
    return rounded(evaluation.one_vs_rest_sparse(model, pairs.where(~odd)), roc_auc=9, average_precision=9)


def lognormal_params(spark, folder):
    return rounded(behavior.lognormal_params(week_line(spark, folder).rows), mu=6, sigma=6)


def model_summary(spark, folder):
    return behavior.model_summary(weekly(spark, folder))


def model_checks(spark, folder):
    """A fitted model with four faults put in: two sums, a missing entry, a negative probability, a zero sigma."""
    line = week_line(spark, folder)
    vocab = behavior.vocabulary(line.rows)
    initial = behavior.initial_distribution(line.rows, TIE, vocab)
    initial = initial.withColumn("p", F.col("p") + F.when(F.col("op") == "view", 0.5).otherwise(0.0))
    matrix = _matrix(line, vocab).filter("not (src = 'error' and dst = 'view')")
    matrix = matrix.withColumn("p", F.when((F.col("src") == "click") & (F.col("dst") == "click"), -F.col("p")).otherwise(F.col("p")))
    timing = behavior.lognormal_params(line.rows)
    timing = timing.withColumn("sigma", F.when(F.col("op") == "signup", 0.0).otherwise(F.col("sigma")))
    return rounded(behavior.check_model(durable(initial), durable(matrix), durable(timing)), value=6)


def next_event_pairs(spark, folder):
    pairs = behavior.next_event_pairs(week_line_z(spark, folder), carry=["z"])
    return rounded(pairs.select("event_id", "prev_op", "op", "prev_z", "z"), prev_z=6, z=6)


def session_sequences(spark, folder):
    line = week_line_z(spark, folder)
    seqs = behavior.session_sequences(line, behavior.vocabulary(line.rows))
    joined = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",")
    whole = F.transform("delta_seconds", lambda v: F.rint(v * 1e6).cast("bigint"))
    return seqs.select("uid", "session_id", "part", "length", joined(F.col("op_indices")).alias("ops"),
                       joined(F.col("timestamps_us")).alias("times"), joined(whole).alias("gaps"))


def encode_category(spark, folder):
    rows = events(spark, folder)
    return behavior.encode(rows, behavior.vocabulary(rows)).select("event_id", "op", "op_index")


def group_kfold(spark, folder):
    return behavior.group_kfold(weekly(spark, folder), FOLDS)


# --- scoring ------------------------------------------------------------------------------------------------------------

def score_events(spark, folder):
    out = scored(spark, folder)[0].select(
        "event_id", "uid", "session_id", F.col("op").alias("op_category"),
        "z", "z_hat", "s_cls", "s_time", F.col("S").alias("score"), "flag_cls", "flag_dt")
    return rounded(out, z=6, z_hat=6, s_cls=6, s_time=6, score=6)


def category_thresholds(spark, folder):
    _, vocab, pairs, model = fitted(spark, folder)
    residuals = scoring.residuals(scoring.with_prediction(pairs, model))
    return rounded(scoring.category_thresholds(residuals, vocab), tau_lo=6, tau_hi=6)


def flag_events(spark, folder):
    return scored(spark, folder)[0].filter("flag_cls = 1 or flag_dt = 1").select("event_id", "flag_cls", "flag_dt")


def top_anomalies(spark, folder):
    return rounded(scoring.top_anomalies(scored(spark, folder)[0], TOP, TIE).select("event_id", F.col("S").alias("score")), score=6)


def top_anomalies_per_user(spark, folder):
    top = scoring.top_anomalies_per_user(scored(spark, folder)[0], 3, TIE)
    return rounded(top.select("uid", "place", "event_id", F.col("S").alias("score")), score=6)


# --- evaluation -----------------------------------------------------------------------------------------------------------

def _predicted(spark, folder):
    _, _, pairs, model = fitted(spark, folder)
    return scoring.with_prediction(pairs, model)


def micro_f1(spark, folder):
    return rounded(evaluation.micro_f1(_predicted(spark, folder)), f1=9)


def loss_summary(spark, folder):
    return rounded(evaluation.loss_summary(_predicted(spark, folder), lambda_time=0.5), ce=6, huber=6, total=6)


def _purchase_tally(spark, folder):
    rows = read(spark, folder, "events").select("value", (F.col("event_type") == "purchase").alias("label"))
    return evaluation.tally(rows, "value", "label")


def roc_auc(spark, folder):
    return rounded(evaluation.roc_auc(_purchase_tally(spark, folder)), roc_auc=9)


def average_precision(spark, folder):
    return rounded(evaluation.average_precision(_purchase_tally(spark, folder)), average_precision=9)


def macro_auc(spark, folder):
    _, vocab, pairs, model = fitted(spark, folder)
    per_class = evaluation.one_vs_rest(model, vocab, pairs)
    return rounded(evaluation.macro_over_classes(per_class), roc_auc=9, pr_auc=9)


def detection_delay(spark, folder):
    return rounded(evaluation.detection_delay(scored(spark, folder)[0]), delay_seconds=3)


def evaluation_report(spark, folder):
    table, vocab, pairs, model, _ = scored(spark, folder)
    per_class = evaluation.one_vs_rest(model, vocab, pairs)
    report = evaluation.evaluation_report(scoring.with_prediction(pairs, model), table, per_class)
    return rounded(report, f1=9, pr_auc=9, roc_auc=9, detection_delay=3)


# --- data quality -----------------------------------------------------------------------------------------------------------

RAW_MAPPING = {
    "timestamp_utc": "time", "uid": "user", "session_id": "session", "method": "verb", "path": "url",
    "referer": "from", "user_agent": "agent", "op_category": "kind",
}


def raw_log(spark, folder) -> DataFrame:
    """The events as a raw text log: four notations of the time, some naive, and some values missing."""
    df = read(spark, folder, "events")
    us, form = micros(df, "ts"), F.col("event_id") % 5
    iso = lambda shift, tail: F.concat(
        F.date_format(F.timestamp_micros(us + shift * 1_000_000), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit(tail))
    time = (F.when(form == 0, iso(0, "Z")).when(form == 1, iso(32_400, "+09:00"))
            .when(form == 2, F.floor(us / 1_000_000).cast("string")).when(form == 3, F.floor(us / 1000).cast("string"))
            .otherwise(iso(0, "")))
    blank = lambda every, c: F.when(F.col("event_id") % every == 0, F.lit("")).otherwise(c)
    return df.select(
        "event_id", time.alias("time"), blank(17, F.col("user_id").cast("string")).alias("user"),
        F.get_json_object("props", "$.k").alias("session"), F.lit("GET").alias("verb"),
        F.concat(F.lit("/"), "event_type").alias("url"), blank(23, F.lit("-")).alias("from"), F.lit("agent").alias("agent"),
        F.when(F.col("event_id") % 29 == 0, F.lit(" UNK ")).otherwise(F.col("event_type")).alias("kind"))


def mapped_log(spark, folder) -> DataFrame:
    return quality.map_columns(raw_log(spark, folder), RAW_MAPPING, keep=TIE)


def map_contract(spark, folder):
    return mapped_log(spark, folder).select("event_id", *CONTRACT_COLUMNS)


def normalize_timestamps(spark, folder):
    mapped = mapped_log(spark, folder)
    return mapped.select("event_id", F.unix_micros(parse_time("timestamp_utc")).cast("string").alias("ts_us"))


def contract_violations(spark, folder):
    """All rules for contract tables in one scan."""
    return quality.check(mapped_log(spark, folder), "event_id", quality.required_rules(), quality.timestamp_rules(),
                         quality.contract_row_rules(require_ip=False))


def value_violations(spark, folder):
    """The typed checks: zone, unknown and unseen operations, waits, signals, order of arrival."""
    mapped = mapped_log(spark, folder)
    df = read(spark, folder, "events")
    text = (F.when(F.col("event_id") % 31 == 0, "NaN").when(F.col("event_id") % 37 == 0, "Infinity")
            .when(F.col("event_id") % 41 == 0, "-1").when(F.col("event_id") % 43 == 0, "")
            .otherwise(F.col("event_id").cast("string")))
    numbers = df.select("event_id", text.alias("delta_t"))
    arrival = df.select(F.col("user_id").alias("uid"), "event_id",
                        F.when(F.col("event_id") % 19 == 0, F.lit(0)).otherwise(micros(df, "ts")).alias("ts_us"))
    vocab = durable(df.select(F.col("event_type").alias("op")).filter("op <> 'error'").distinct())
    checks = [
        quality.check_known_vocab(mapped, "event_id", vocab, "op_category", quality.utc_rules(), quality.known_op_rules("op_category")),
        quality.check(numbers, "event_id", quality.positive_delta_rules("delta_t"), quality.finite_signal_rules(["delta_t"])),
        quality.check_increasing_time(arrival, ["uid"], "event_id"),
    ]
    out = checks[0]
    for more in checks[1:]:
        out = out.unionByName(more)
    return out


def pseudonymize(spark, folder):
    return read(spark, folder, "events").select("event_id", hmac_sha256(SECRET, F.col("user_id")).alias("uid"))


def stage_roundtrip(spark, folder):
    """Contract table to CSV and back through the strict reader."""
    contract = quality.normalize_contract(mapped_log(spark, folder))
    path = f"{shared_folder(spark)}/stage-{spark.sparkContext.applicationId}/contract"
    tables.write_stage(contract, path, CONTRACT_COLUMNS, fmt="csv")
    back = tables.read_table(spark, path, CONTRACT_SCHEMA, fmt="csv")
    grouped = back.withColumn("us", F.unix_micros("timestamp_utc")).groupBy("op_category", "path").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("uid").alias("users"),
        F.min("us").alias("first_us"), F.max("us").alias("last_us"),
        F.count(F.when(F.coalesce("referer", F.lit("")) == "", 1)).alias("no_referer"))
    return grouped


def dataset_fingerprint(spark, folder):
    return tables.dataset_fingerprint(read(spark, folder, "events"))


def file_fingerprints(spark, folder):
    return tables.file_fingerprints(spark, f"{folder}/events.parquet").select("length", "sha256")


def run_metadata(spark, folder):
    line = user_line(spark, folder)
    positive = durable(gaps.positive_gaps(line))
    stats = durable(gaps.gap_statistics(positive, line.total))
    return tables.run_metadata({
        "threshold": gaps.select_threshold(line),
        "gap_statistics": stats,
        "histogram": gaps.gap_histogram(positive, stats),
        "input": tables.dataset_fingerprint(read(spark, folder, "events")),
    })


# --- signals -----------------------------------------------------------------------------------------------------------------

def _series(spark, folder):
    return durable(signals.resample_linear(signals.as_signals(scored(spark, folder)[0], "uid")))


def resample_linear(spark, folder):
    return rounded(_series(spark, folder), ref=6, y=6, y_base=6)


def control_errors(spark, folder):
    return rounded(signals.control_errors(_series(spark, folder)), iae=3, ise=3, itae=0)


def step_response(spark, folder):
    out = signals.step_response(_series(spark, folder))
    return rounded(out, rise_time=7, settling_time=7, overshoot_pct=4, steady_state_error=6)


# --- detection and injection -----------------------------------------------------------------------------------------------------

def detect_order(spark, folder):
    line = gaps.session_timeline(weekly(spark, folder), TIE)
    usual = _matrix(line, behavior.vocabulary(line.rows)).filter("p >= 0.2")
    allowed = durable(usual.select(F.col("src").alias("prev_op"), F.col("dst").alias("op")))
    return detection.detect_order(behavior.next_event_pairs(line), allowed).select("event_id", "prev_op", "op")


def detect_unauth(spark, folder):
    line = gaps.session_timeline(weekly(spark, folder), TIE)
    return detection.detect_unauth(line, ["signup"], ["purchase"]).select("event_id", "session_id")


def detect_token_replay(spark, folder):
    token = F.get_json_object("props", "$.k")
    rows = as_events(read(spark, folder, "events"), "user_id", "ts", "event_type", TIE, session=token)
    return detection.detect_token_replay(rows, TIE).select("event_id", "session_id", "uid", "owner")


def detect_time(spark, folder):
    return detection.detect_time(scored(spark, folder)[0]).select("event_id")


def week_plain(spark, folder) -> Timeline:
    return gaps.session_timeline(weekly(spark, folder), TIE)


def inject_time_local(spark, folder):
    rules = [r for r in RULES.time if r.mode == "local"]
    line = injection.inject_time(week_plain(spark, folder).within("uid", "session_id"), rules, SEED, "event_id")
    return line.rows.select("event_id", "wait_us", "new_ts_us", F.size("time_hits").alias("hits"))


def inject_time_propagate(spark, folder):
    line = injection.inject_time(week_plain(spark, folder).within("uid", "session_id"), RULES.time, SEED, "event_id")
    return line.rows.select("event_id", "new_ts_us", F.size("time_hits").alias("hits"))


def inject_order_swap(spark, folder):
    line = injection.inject_order(week_plain(spark, folder).within("uid", "session_id"), RULES.order[0], 0, SEED, "event_id")
    return line.rows.select("event_id", "op", F.col("swap.with").cast("string").alias("swap_with"))


def inject_unauth(spark, folder):
    rows = injection.inject_unauth(weekly(spark, folder), RULES.unauth, SEED, "event_id", RULES.protected)
    return rows.select("event_id", "session_id", F.col("unauth").cast("int").alias("unauth"))


def inject_token_replay(spark, folder):
    rows = injection.inject_unauth(weekly(spark, folder), RULES.unauth, SEED, "event_id", RULES.protected)
    owners = detection.session_owners(weekly(spark, folder), TIE)
    out = injection.inject_token_replay(rows, owners, RULES.token_replay, SEED, "event_id")
    return out.select("event_id", "session_id", F.col("replay").cast("int").alias("replay"), "replay_owner")


def injected(spark, folder) -> DataFrame:
    return injection.inject(week_plain(spark, folder).within("uid", "session_id"), RULES, SEED, "event_id")


def audit_table(spark, folder):
    audit = injection.audit_table(injected(spark, folder), RULES, SEED, "event_id")
    # Nullable whole numbers as text: data frames on the two sides of a comparison hold their nulls differently.
    return audit.drop("reason", "params").withColumns({c: F.col(c).cast("string") for c in ("swap_with", "auth_required")})


def evaluate_against_audit(spark, folder):
    """Inject, score with the model of the clean table, and see how well the score finds the changed rows."""
    _, vocab, pairs, model = fitted(spark, folder)
    thresholds = durable(scoring.category_thresholds(scoring.residuals(scoring.with_prediction(pairs, model)), vocab))
    changed = injected(spark, folder)
    audit = injection.audit_table(changed, RULES, SEED, "event_id")
    dirty = gaps.with_session_gap(gaps.session_timeline(injection.changed_events(changed), TIE))
    dirty = features.with_model_z(dirty, features.raw_scale_stats(dirty))
    table = scoring.score_events(dirty, model, thresholds)
    labelled = evaluation.label_from_audit(table.select("event_id", "S"), audit, "event_id")
    tallied = evaluation.tally(labelled.withColumn("S", F.round("S", 9)), "S", "label")
    auc = evaluation.roc_auc(tallied)
    ap = evaluation.average_precision(tallied).select("average_precision").scalar()
    return rounded(auc.withColumn("average_precision", ap), roc_auc=6, average_precision=6)


def _pinned(query):
    """Times mean UTC in every query, whatever the session came with."""
    def run(spark: SparkSession, folder: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return query(spark, folder)
    run.__name__, run.__doc__ = query.__name__, query.__doc__
    return run


def stream_sessions(spark, folder):
    found = flows.sessions_so_far(spark, read(spark, folder, "events").schema, f"{folder}/events.parquet", STREAM_THRESHOLD_SECONDS)
    return found.withColumn("is_final", F.col("is_final").cast("int"))


def _event_files(spark, folder) -> tuple:
    """The events as four files that overlap in time by some hours, for streams that take one file at a time."""
    raw, path = read(spark, folder, "events"), f"{shared_folder(spark)}/streams/input-{uuid.uuid4().hex}"
    shifted = F.unix_micros(F.col("ts").cast("timestamp")) + F.pmod(F.hash("event_id"), F.lit(7200)).cast("bigint") * 1_000_000
    raw.repartitionByRange(4, shifted).write.parquet(path)
    return raw.schema, path


def stream_features(spark, folder):
    stats = durable(features.feature_stats(user_line(spark, folder)))
    return rounded(flows.features_so_far(spark, *_event_files(spark, folder), stats, files_per_trigger=1), robust_z=6, burst_ratio=6)


def stream_transition_counts(spark, folder):
    return flows.transitions_so_far(spark, *_event_files(spark, folder), files_per_trigger=1)


QUERIES = {q.__name__: _pinned(q) for q in (
    user_gaps, gap_histogram, otsu_threshold, session_curve, elbow_threshold, assign_sessions, session_rollup,
    elapsed_in_session, deltified_table, top_anomalies_per_user,
    global_robust_stats, user_robust_stats, robust_z, rolling_quartiles, burst_ratio, fallback_users, session_gaps_raw_z,
    initial_distribution, transition_matrix, sparse_transitions, sparse_transition_rows, sparse_class_ranking, lognormal_params, model_summary, model_checks, next_event_pairs,
    session_sequences, encode_category, group_kfold, score_events, category_thresholds, flag_events, top_anomalies,
    micro_f1, loss_summary, roc_auc, average_precision, macro_auc, detection_delay, evaluation_report,
    map_contract, normalize_timestamps, contract_violations, value_violations, pseudonymize, stage_roundtrip,
    dataset_fingerprint, file_fingerprints, run_metadata, resample_linear, control_errors, step_response,
    detect_order, detect_unauth, detect_token_replay, detect_time, inject_time_local, inject_time_propagate,
    inject_order_swap, inject_unauth, inject_token_replay, audit_table, evaluate_against_audit,
    stream_sessions, stream_features, stream_transition_counts,
)}
