"""Live versions of sessions, gap features and transition counts.

Each flow is a function from a streaming table of events to a streaming result, plus a small runner that reads
a growing folder of files, writes to the shared folder and returns what was written so far. Thresholds and
statistics come from a batch run. ``files_per_trigger`` bounds the rows of one trigger; no result depends on it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor

from tempolog.functions.scalars import clip, log_gap, quartile_us, robust_score, seconds
from tempolog.schema import GAP_EPSILON, HISTORY
from tempolog.plans.joins import match_all
from tempolog.plans.timeline import timeline
from tempolog.session import durable, shared_folder

DELAY = "1 hour"
FILES_PER_TRIGGER = 1000


def read_events(
    spark: SparkSession, schema: T.StructType, path: str, files_per_trigger: int = FILES_PER_TRIGGER,
    uid: str = "user_id", ts: str = "ts", op: str = "event_type", tie: str = "event_id",
) -> DataFrame:
    """Parquet files as a stream of ``uid, ts, ts_us, op, <tie>``. The path is a folder that grows, or one file."""
    # Written as a pattern, as the reader takes a plain path for a folder.
    pattern = f"{path[:-1]}[{path[-1]}]"
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(pattern)
    return _as_events(raw, uid, ts, op, tie)


def _as_events(raw: DataFrame, uid: str = "user_id", ts: str = "ts", op: str = "event_type", tie: str = "event_id") -> DataFrame:
    time = F.col(ts).cast("timestamp")
    return raw.select(F.col(uid).cast("string").alias("uid"), time.alias("ts"), F.unix_micros(time).alias("ts_us"),
                      F.col(op).alias("op"), tie)


# --- sessions -----------------------------------------------------------------------------------------------------

def stream_sessions(events: DataFrame, threshold_seconds: int, delay: str = DELAY) -> DataFrame:
    """Sessions by a given gap. A session is final, and emitted, once the watermark has passed its end plus the gap.

    Two events exactly one gap apart share a session, as in the batch operator.
    """
    window = F.session_window("ts", f"{threshold_seconds} seconds")
    return events.withWatermark("ts", delay).groupBy("uid", window).agg(
        F.count(F.lit(1)).alias("n_events"), F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"),
    ).drop("session_window")


# --- state per user -------------------------------------------------------------------------------------------------

IDLE = 30 * 86_400  # seconds after which the state of a silent user is given up


class Reorder(StatefulProcessor):
    """Holds a user's events back until the watermark has passed them, and gives each its own past in order of time.

    State of a user, read and written once per call: the last event let go with the latest gaps, the events that wait,
    and the time of the one timer that is set. It lets go what the watermark has passed if the user stays away, and then
    clears the state of a user who has been silent for ``idle`` seconds, so that state
    is kept for active users only. Nothing is lost by that: the rows let go hold all that the state held. ``since_us``
    is the time of the first event of the state a row came from and ``age`` its number there (at most
    ``HISTORY + 1``), by which :func:`events_so_far` joins a returning user's rows to the earlier ones.

    An event comes, waits and leaves as one text, ``time tie operation`` (:func:`with_past` makes it and reads it): one value
    per event to convert, not one per column. A row of the result holds up to ``piece`` consecutive events of a user,
    the operation ``before`` them, and their ``gaps`` after those of the ``seen`` events that went before.
    """

    RESULT = "uid string, events array<string>, before string, gaps array<bigint>, seen int, since_us bigint, age int"
    RECENT = "ts_us bigint, op string, gaps array<bigint>, since_us bigint, age int, waiting array<string>, wake bigint"
    OUT = Row("uid", "events", "before", "gaps", "seen", "since_us", "age")

    def __init__(self, idle: int = IDLE, piece: int = 10_000):
        self.idle, self.piece = idle, piece

    def init(self, handle) -> None:
        self.handle = handle
        self.recent = handle.getValueState("recent", self.RECENT)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        return self._advance(key, self.recent.get(), [row[1] for row in rows], timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state = self.recent.get()
        if state is None or state[-1] != expiredTimerInfo.getExpiryTimeInMs():
            return iter(())
        # Spark removes the timer that has gone off.
        return self._advance(key, (*state[:-1], None), [], timerValues)

    def _advance(self, key, state, new: list[str], timerValues) -> Iterator[Row]:
        """Let go what the watermark has passed, and keep the rest and the new events with a timer for the first of them."""
        *last, held, wake = state or (None, None, [], None, 0, [], None)
        now = timerValues.getCurrentWatermarkInMs()
        timed = []
        for event in (*held, *new):
            time, tie, *op = event.split(" ", 2)
            timed.append((int(time), int(tie), op[0] if op else None, event))
        ready = sorted((e for e in timed if e[0] <= now * 1000), key=lambda e: e[:2])
        waiting = [e for e in timed if e[0] > now * 1000]
        out = []
        for start in range(0, len(ready), self.piece):
            row, last = self._let_go(key[0], last, ready[start:start + self.piece])
            out.append(row)
        if waiting:
            due = max(-(-min(e[0] for e in waiting) // 1000), now + 1)
        else:
            due = last[0] // 1000 + self.idle * 1000
        if wake is not None and wake != due:
            self.handle.deleteTimer(wake)
        if due <= now:  # nothing waits, and the user has been silent for long
            self.recent.clear()
            return iter(out)
        if wake != due:
            self.handle.registerTimer(due)
        self.recent.update((*last, [e[3] for e in waiting], due))
        return iter(out)

    def _let_go(self, uid, last, ready: list[tuple]) -> tuple[Row, tuple]:
        times = [e[0] for e in ready]
        last_us, last_op, past, since, age = last
        if since is None:
            last_us = since = times[0]
        # The first event of a user has a gap of zero that later events see as part of their past.
        every = [*past, *(b - a for a, b in zip([last_us, *times], times))]
        row = self.OUT(uid, [e[3] for e in ready], last_op, every, len(past), since, age)
        return row, (times[-1], ready[-1][2], every[-HISTORY:], since, min(age + len(times), HISTORY + 1))

    def close(self) -> None:
        pass


def with_past(events: DataFrame, tie: str = "event_id", delay: str = DELAY, idle: int = IDLE) -> DataFrame:
    """The events of a stream in order of time with ``prev_op, gap_us, past`` (up to five earlier gaps), once the watermark passes them."""
    event = F.concat_ws(" ", "ts_us", tie, "op").alias("event")  # a null operation leaves two parts
    timed = events.select("uid", event, "ts").withWatermark("ts", delay)
    pieces = timed.groupBy("uid").transformWithState(
        statefulProcessor=Reorder(idle), outputStructType=Reorder.RESULT, outputMode="Append", timeMode="EventTime")
    # One array of structs, so that the generator takes nothing else along.
    part = lambda i, k: F.get(F.split(F.get("events", i), " ", 3), F.lit(k))
    at = lambda i: F.col("seen") + i
    each = F.transform(F.sequence(F.lit(0), F.size("events") - 1), lambda i: F.struct(
        part(i, 1).cast("bigint").alias(tie), part(i, 0).cast("bigint").alias("ts_us"), part(i, 2).alias("op"),
        F.when(i == 0, F.col("before")).otherwise(part(i - 1, 2)).alias("prev_op"),
        F.get("gaps", at(i)).alias("gap_us"),
        F.slice("gaps", F.greatest(at(i) - HISTORY, F.lit(0)) + 1, F.least(at(i), F.lit(HISTORY))).alias("past"),
        F.least(F.col("age") + i, F.lit(HISTORY + 1)).alias("age")))
    rows = pieces.select("uid", "since_us", F.explode(each).alias("e"))
    return rows.select("uid", f"e.{tie}", "e.ts_us", "e.op", "e.prev_op", "e.gap_us", "e.past", "since_us", "e.age")


def _newest(gaps: Column) -> Column:
    return F.slice(gaps, F.greatest(F.size(gaps) - HISTORY + 1, F.lit(1)), HISTORY)


def _segments(let_go: DataFrame, tie: str) -> DataFrame:
    """One row per user and lifetime of the user's state: how it ends, and what went before it (null in the first).

    The first gap of a later lifetime is the time since the end of the one before.
    """
    ends = let_go.groupBy("uid", "since_us").agg(
        F.count(F.lit(1)).alias("n"),
        F.max_by(F.struct("ts_us", "op", _newest(F.concat("past", F.array("gap_us"))).alias("gaps")), F.struct("ts_us", tie)).alias("e"))
    line = timeline(durable(ends.select("uid", "since_us", "n", F.col("e.ts_us").alias("end_us"), F.col("e.op").alias("end_op"), F.col("e.gaps").alias("gaps"))),
                    ["uid"], ["since_us"]).previous(before_us="end_us", before_op="end_op")
    real = F.when(F.col("before_us").isNull() | (F.col("n") > HISTORY), F.col("gaps")).otherwise(
        F.concat(F.array(F.col("since_us") - F.col("before_us")), F.slice("gaps", 2, HISTORY)))
    line = line.map(gaps=real).history("_early", "gaps", HISTORY)
    return durable(line.rows.select("uid", "since_us", "n", "end_us", "end_op", "before_us", "before_op",
                                    _newest(F.flatten("_early")).alias("before_gaps"), "gaps"))


def _joined_up(let_go: DataFrame, segments: DataFrame) -> DataFrame:
    """Rows let go after a state was made anew, with the past of the earlier state in place of none."""
    later = segments.where("before_us is not null").select("uid", "since_us", "before_us", "before_op", "before_gaps")
    rows = match_all(let_go, later, ["uid", "since_us"], "left")
    first, returning = F.col("age") == 0, F.col("before_us").isNotNull() & (F.col("age") <= HISTORY)
    pause = F.col("since_us") - F.col("before_us")
    own = F.when(first, F.slice("past", 1, 0)).otherwise(F.concat(F.array(pause), F.slice("past", 2, HISTORY)))
    return rows.select(
        *[c for c in let_go.columns if c not in ("prev_op", "gap_us", "past", "since_us", "age")],
        F.when(returning & first, F.col("before_op")).otherwise(F.col("prev_op")).alias("prev_op"),
        F.when(returning & first, pause).otherwise(F.col("gap_us")).alias("gap_us"),
        F.when(returning, _newest(F.concat("before_gaps", own))).otherwise(F.col("past")).alias("past"))


def _made_now(events: DataFrame, known: DataFrame, tie: str) -> DataFrame:
    """Rows for the given events through the batch timeline; they go on from where ``known`` says a user's rows end."""
    line = timeline(durable(events), ["uid"], ["ts_us", tie]).attach(known).previous(_before="ts_us", prev_op="op")
    first, start = F.col("_before").isNull(), F.col("end_us").isNotNull()
    line = line.map(
        prev_op=F.when(first & start, F.col("end_op")).otherwise(F.col("prev_op")),
        gap_us=F.when(first, F.when(start, F.col("ts_us") - F.col("end_us")).otherwise(F.lit(0))).otherwise(F.col("ts_us") - F.col("_before")),
    ).history("_own", "gap_us", HISTORY)
    past = F.when(start, _newest(F.concat("end_gaps", "_own"))).otherwise(F.col("_own"))
    return line.rows.select("uid", tie, "ts_us", "op", "prev_op", F.col("gap_us").cast("bigint").alias("gap_us"), past.alias("past"))


def events_so_far(let_go: DataFrame, events: DataFrame, tie: str = "event_id") -> DataFrame:
    """Every event that has arrived with ``prev_op, gap_us, past``, whatever the order of arrival.

    ``let_go`` is what the stream has written and ``events`` the events themselves. Users some of whose events came too
    late for the stream are noticed by the number of rows up to their last one, and made again from the events; for
    the others only the events that still wait are added.
    """
    segments = _segments(let_go, tie)
    ends = segments.groupBy("uid").agg(
        F.sum("n").alias("_n"),
        F.max_by(F.struct("end_us", "end_op", _newest(F.concat("before_gaps", "gaps")).alias("gaps")), "since_us").alias("e"))
    ends = durable(ends.select("uid", "_n", F.col("e.end_us").alias("end_us"), F.col("e.end_op").alias("end_op"), F.col("e.gaps").alias("end_gaps")))
    there = match_all(events.select("uid", "ts_us"), ends.select("uid", "_n", "end_us"), ["uid"], "inner").groupBy("uid", "_n").agg(
        F.count(F.when(F.col("ts_us") <= F.col("end_us"), 1)).alias("_all"))
    # Without a user there is no key to look the end up by, so those events are made again.
    good = there.where("_n = _all and uid is not null").select("uid")
    whole = durable(match_all(ends, good, ["uid"], "left_semi").drop("_n"))
    rest = match_all(events, whole.select("uid", "end_us"), ["uid"], "left").where("end_us is null or ts_us > end_us").drop("end_us")
    kept = match_all(let_go, whole.select("uid"), ["uid"], "left_semi")
    return _joined_up(kept, segments).unionByName(_made_now(rest.select("uid", tie, "ts_us", "op"), whole, tie))


def live_features(rows: DataFrame, stats: DataFrame, tie: str = "event_id") -> DataFrame:
    """The batch features of events with their past, against stored statistics ``uid, median, mad``."""
    none = F.size("past") == 0
    before = F.when(none, F.col("gap_us")).otherwise(F.element_at("past", -1))
    z = F.when(F.col("gap_us") == 0, F.lit(0.0)).otherwise(robust_score(log_gap("gap_us"), "median", "mad"))
    return match_all(rows, stats.select("uid", "median", "mad"), ["uid"], "left").select(
        "uid", tie, "gap_us", clip(z).alias("robust_z"),
        F.when(none, seconds("gap_us")).otherwise(quartile_us("past", 1)).alias("prev_q25_seconds"),
        F.when(none, seconds("gap_us")).otherwise(quartile_us("past", 3)).alias("prev_q75_seconds"),
        ((seconds(before) + F.lit(GAP_EPSILON)) / (seconds("gap_us") + F.lit(GAP_EPSILON))).alias("burst_ratio"))


def live_transitions(rows: DataFrame) -> DataFrame:
    """``src, dst, n`` over consecutive operations of a user."""
    pairs = rows.filter("prev_op is not null").groupBy(F.col("prev_op").alias("src"), F.col("op").alias("dst"))
    return pairs.agg(F.count(F.lit(1)).alias("n"))


# --- runners ----------------------------------------------------------------------------------------------------------

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/streams/{name}-{uuid.uuid4().hex}"


def _run(writer, folder: str) -> None:
    writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def to_table(spark: SparkSession, stream: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Process everything there is and return the table written so far. Pass the same folder to go on later."""
    folder = folder or _folder(spark, name)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    _run(stream.writeStream.format("parquet").option("path", f"{folder}/table").outputMode("append"), folder)
    return spark.read.schema(stream.schema).parquet(f"{folder}/table")


def sessions_to_table(spark, schema, path, threshold_seconds, folder=None, files_per_trigger: int = FILES_PER_TRIGGER) -> DataFrame:
    # Events of a session are merged where they are read, so a busy user sends sessions, not events, over the network.
    spark.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    return to_table(spark, stream_sessions(read_events(spark, schema, path, files_per_trigger), threshold_seconds), "sessions", folder)


def sessions_so_far(spark, schema, path, threshold_seconds, folder=None, files_per_trigger: int = FILES_PER_TRIGGER) -> DataFrame:
    """All sessions of the events that have arrived, with ``is_final``: whether the stream has closed them.

    Sessions still open at the watermark are added. A user some of whose events came too late for the stream (files
    out of order) is noticed by the number of events in closed sessions; that user's sessions are made again from
    the events, so that the order of arrival never changes the table.
    """
    closed = sessions_to_table(spark, schema, path, threshold_seconds, folder, files_per_trigger)
    events = _as_events(spark.read.schema(schema).parquet(path))
    counted = closed.groupBy("uid").agg(F.max("end_us").alias("_last"), F.sum("n_events").alias("_n"))
    covered = match_all(events.select("uid", "ts_us"), counted, ["uid"], "inner").groupBy("uid", "_last", "_n").agg(
        F.count(F.when(F.col("ts_us") <= F.col("_last"), 1)).alias("_all"))
    known = durable(covered.select("uid", "_last", (F.col("_n") != F.col("_all")).alias("_short")))
    again = match_all(events, known, ["uid"], "left").where("_last is null or _short or ts_us > _last").drop("_last", "_short")
    made = match_all(stream_sessions(again, threshold_seconds), known, ["uid"], "left")
    made = made.select("uid", "n_events", "start_us", "end_us", F.coalesce(F.col("end_us") <= F.col("_last"), F.lit(False)).alias("is_final"))
    kept = match_all(closed, known.where("not _short").select("uid"), ["uid"], "left_semi")
    return kept.select("uid", "n_events", "start_us", "end_us", F.lit(True).alias("is_final")).unionByName(made)


def _rows_so_far(spark, schema, path, folder, files_per_trigger: int, delay: str, idle: int) -> DataFrame:
    """Let the stream take what there is, and return all events of the folder with their past. The tables of one folder share a stream."""
    let_go = to_table(spark, with_past(read_events(spark, schema, path, files_per_trigger), delay=delay, idle=idle), "events", folder)
    return events_so_far(let_go, _as_events(spark.read.schema(schema).parquet(path)))


def features_so_far(spark, schema, path, stats, folder=None, files_per_trigger: int = FILES_PER_TRIGGER, delay: str = DELAY, idle: int = IDLE) -> DataFrame:
    """The features of every event that has arrived; the order of files does not matter."""
    return live_features(_rows_so_far(spark, schema, path, folder, files_per_trigger, delay, idle), stats)


def transitions_so_far(spark, schema, path, folder=None, files_per_trigger: int = FILES_PER_TRIGGER, delay: str = DELAY, idle: int = IDLE) -> DataFrame:
    """Transition counts ``src, dst, n`` over every event that has arrived; the order of files does not matter."""
    return live_transitions(_rows_so_far(spark, schema, path, folder, files_per_trigger, delay, idle))
