"""Put anomalies of four kinds into a table of events, with a record of every change.

All draws depend on (seed, kind, rule number, record index) only, so a run is repeatable under any
partitioning. The order of the kinds is part of the meaning: time rules look at operations before swaps,
authentication rules at operations after them, and replays skip rows that already lost their session.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from tempolog.functions.scalars import draw, seconds
from tempolog.operators.detection import is_protected, session_owners
from tempolog.plans.joins import lookup
from tempolog.plans.timeline import Timeline, timeline
from tempolog.schema import PROTECTED_OPS
from tempolog.session import durable


@dataclass(frozen=True)
class Rule:
    """One anomaly rule: probability, optionally only for one operation; scale and delta for time rules."""

    p: float
    op: str | None = None
    mode: str = "local"          # time rules: "local" or "propagate"
    scale: float | None = None
    delta: float | None = None

    def hits(self, seed: int, kind: str, number: int, index: str, op: Column | str = "op") -> Column:
        hit = draw(seed, kind, number, index) <= F.lit(float(self.p))
        op = F.col(op) if isinstance(op, str) else op
        return hit if self.op is None else hit & (op == F.lit(self.op))

    @property
    def text(self) -> str:
        parts = [f"{n} {v}" for n, v in (("times", self.scale), ("plus", self.delta)) if v is not None]
        return " ".join(parts) or "unchanged"


@dataclass(frozen=True)
class Rules:
    time: Sequence[Rule] = ()
    order: Sequence[Rule] = ()
    unauth: Sequence[Rule] = ()
    token_replay: Sequence[Rule] = ()
    protected: Sequence[str] = field(default=PROTECTED_OPS)


def inject_time(line: Timeline, rules: Sequence[Rule], seed: int, index: str) -> Timeline:
    """Stretch or shift waits. Adds ``new_ts_us`` and ``time_hits`` (one entry per rule that applied).

    The wait of an event is the time to the next event of its session. A local rule changes one wait; a
    propagating rule also changes every later wait of the session, through the running product of scales and
    the running sum of shifts of earlier hits.
    """
    hit = [r.hits(seed, "time", i, index) for i, r in enumerate(rules)]
    line = line.following(_next="ts_us")
    line = line.map(wait_us=F.coalesce(F.col("_next") - F.col("ts_us"), F.lit(0)).cast("bigint"))

    carry_on = [(h, r) for h, r in zip(hit, rules) if r.mode == "propagate"]
    factor, shift = F.lit(1.0), F.lit(0.0)
    for h, r in carry_on:
        factor = factor * F.when(h, F.lit(1.0 if r.scale is None else float(r.scale))).otherwise(F.lit(1.0))
        shift = shift + F.when(h, F.lit(0.0 if r.delta is None else float(r.delta))).otherwise(F.lit(0.0))
    value = seconds("wait_us")
    if carry_on:
        line = line.map(_factor=factor, _add=shift)
        line = line.scan(_scale=line.fold("product", "_factor", False), _shift=line.fold("sum", "_add", False))
        value = value * F.col("_scale") + F.col("_shift")

    entries = []
    for i, (h, r) in enumerate(zip(hit, rules)):
        after = value
        if r.scale is not None:
            after = after * F.lit(float(r.scale))
        if r.delta is not None:
            after = after + F.lit(float(r.delta))
        entries.append(F.when(h, F.struct(
            F.lit(i).alias("rule"), value.alias("seconds_before"), F.greatest(after, F.lit(0.0)).alias("seconds_after"))))
        value = F.when(h, after).otherwise(value)
    line = line.map(
        time_hits=F.filter(F.array(*entries), lambda e: e.isNotNull()),
        _wait=F.rint(F.greatest(value, F.lit(0.0)) * 1e6).cast("bigint"))
    line = line.running("sum", "_moved", F.col("_wait") - F.col("wait_us"), inclusive=False)
    line = line.map(new_ts_us=F.col("ts_us") + F.col("_moved"))
    return line.drop("_next", "_wait", "_moved", "_factor", "_add", "_scale", "_shift")


def inject_order(line: Timeline, rule: Rule, number: int, seed: int, index: str, attributes: Sequence[str] = ("op",)) -> Timeline:
    """Swap the operation attributes of neighbours, first come first served, without overlaps.

    In a run of consecutive candidates the first, third, fifth ... swap with their successor: that is what a
    scan that jumps over both rows of a swap does. Adds ``swap`` on the first row of each pair.
    """
    line = line.following(_succ=index)
    candidate = rule.hits(seed, "order", number, index) & F.col("_succ").isNotNull()
    line = line.map(_cand=candidate.cast("int"))
    line = line.scan(_pos=line.fold("sum", F.lit(1)), **line.neighbours(F.lag, {"_cand_before": "_cand"}))
    run_starts = F.when((F.col("_cand") == 1) & (F.coalesce("_cand_before", F.lit(0)) == 0), F.col("_pos"))
    line = line.running("last", "_run", run_starts)
    line = line.map(_first=F.when((F.col("_cand") == 1) & ((F.col("_pos") - F.col("_run")) % 2 == 0), 1).otherwise(0))
    line = line.scan(
        **line.neighbours(F.lag, {"_second": "_first", **{f"_p_{a}": a for a in attributes}}),
        **line.neighbours(F.lead, {f"_n_{a}": a for a in attributes}))
    first, second = F.col("_first") == 1, F.coalesce("_second", F.lit(0)) == 1
    line = line.map(swap=F.when(first, F.struct(
        F.col("_succ").alias("with"), F.col("op").alias("before"), F.col("_n_op").alias("other_before"))))
    line = line.map(**{
        a: F.when(first, F.col(f"_n_{a}")).when(second, F.col(f"_p_{a}")).otherwise(F.col(a)) for a in attributes})
    scratch = ["_succ", "_cand", "_cand_before", "_pos", "_run", "_first", "_second"]
    return line.drop(*scratch, *[f"_{s}_{a}" for s in "pn" for a in attributes])


def _forged_session(session: str, seed: int, index: str) -> Column:
    base = F.when(F.coalesce(session, F.lit("")) != "", F.col(session)).otherwise(F.lit(f"sess-{seed}"))
    return F.concat_ws("-", base, F.lit("unauth"), F.lit(str(seed)), F.col(index).cast("string"))


def inject_unauth(rows: DataFrame, rules: Sequence[Rule], seed: int, index: str, protected: Sequence[str] = PROTECTED_OPS) -> DataFrame:
    """Replace the session of protected operations by one nobody signed in to. Adds ``session_before`` and ``unauth``."""
    hit = F.lit(False)
    for i, r in enumerate(rules):
        hit = hit | r.hits(seed, "unauth", i, index)
    hit = hit & is_protected("op_category" if "op_category" in rows.columns else "op", protected)
    forged = _forged_session("session_id", seed, index)
    return (rows.withColumn("unauth", hit).withColumn("session_before", F.col("session_id"))
            .withColumn("session_id", F.when(F.col("unauth"), forged).otherwise(F.col("session_id"))))


def inject_token_replay(rows: DataFrame, sessions: DataFrame, rules: Sequence[Rule], seed: int, index: str) -> DataFrame:
    """Replace the session of some rows by a session of another user, each such session equally likely.

    ``sessions(session_id, owner)`` are numbered by (owner, session). A row must not draw its own user's
    sessions, which are one block of numbers, nor the session it already has. It draws a place in the shortened
    list and steps over what is left out, so finding the session is one join on the number.
    Needs ``session_before``; skips rows with ``unauth``. Adds ``replay`` and ``replay_owner``.
    """
    numbered = timeline(durable(sessions), [], ["owner", "session_id"]).position("_rank").rows
    numbered = durable(numbered.withColumn("_rank", F.col("_rank") - 1))
    count = numbered.count()
    blocks = durable(numbered.groupBy(F.col("owner").alias("uid")).agg(
        F.min("_rank").alias("_lo"), F.count(F.lit(1)).alias("_size")))
    current = numbered.select(F.col("session_id").alias("session_before"), F.col("_rank").alias("_own"))

    hit = F.lit(False)
    for i, r in enumerate(rules):
        hit = hit | r.hits(seed, "token_replay", i, index)
    rows = rows.withColumn("_hit", hit & ~F.col("unauth"))
    chosen = lookup(lookup(rows.filter("_hit").select(index, "uid", "session_before"), blocks, ["uid"]), current, ["session_before"])

    lo, size = F.coalesce("_lo", F.lit(0)), F.coalesce("_size", F.lit(0))
    in_block = F.col("_own").between(lo, lo + size - 1)
    extra = F.when(F.col("_own").isNull() | in_block, F.lit(None)).otherwise(F.col("_own"))
    left = F.lit(count) - size - F.when(extra.isNotNull(), 1).otherwise(0)
    step = lambda k, start, width: F.when(k >= start, k + width).otherwise(k)
    chosen = chosen.withColumns({"_l": lo, "_s": size, "_extra": extra, "_left": left})
    k = F.floor(draw(seed, "token_pick", 0, index) * F.col("_left")).cast("bigint")
    chosen = chosen.filter("_left > 0").withColumn("_k", k)
    block_first = step(F.col("_k"), F.col("_l"), F.col("_s"))
    number = (
        F.when(F.col("_extra").isNull(), block_first)
        .when(F.col("_extra") < F.col("_l"), step(step(F.col("_k"), F.col("_extra"), 1), F.col("_l"), F.col("_s")))
        .otherwise(step(block_first, F.col("_extra"), 1))
    )
    picks = chosen.select(index, number.alias("_rank")).join(numbered, "_rank").select(
        index, F.col("session_id").alias("_new"), F.col("owner").alias("replay_owner"))
    # Record indexes are unique, so this join is even whatever the users look like.
    out = rows.join(picks, index, "left")
    return (out.withColumn("replay", F.col("_new").isNotNull())
            .withColumn("session_id", F.coalesce("_new", "session_id")).drop("_new", "_hit"))


def inject(line: Timeline, rules: Rules, seed: int, index: str, attributes: Sequence[str] = ("op",)) -> DataFrame:
    """All four kinds in order. The result has the changed columns and everything the audit needs.

    It is written once: the changed table and the audit are both read off it.
    """
    sessions = session_owners(line.rows, [index])
    line = inject_time(line, rules.time, seed, index) if rules.time else line.map(
        new_ts_us=F.col("ts_us"), time_hits=F.lit(None).cast("array<struct<rule:int,seconds_before:double,seconds_after:double>>"))
    swaps = []
    for number, rule in enumerate(rules.order):
        line = inject_order(line, rule, number, seed, index, attributes)
        line = line.map(**{f"swap_{number}": F.col("swap")}).drop("swap")
        swaps.append(number)
    rows = line.rows
    nothing = F.lit(None).cast("struct<with:bigint,before:string,other_before:string,number:int>")
    found = [F.when(F.col(f"swap_{n}").isNotNull(), F.struct(
        F.col(f"swap_{n}.with").cast("bigint").alias("with"), F.col(f"swap_{n}.before").alias("before"),
        F.col(f"swap_{n}.other_before").alias("other_before"), F.lit(n).alias("number"))) for n in swaps]
    rows = rows.withColumn("swaps", F.filter(F.array(*(found or [nothing])), lambda s: s.isNotNull()))
    rows = rows.drop(*[f"swap_{n}" for n in swaps])
    rows = inject_unauth(rows, rules.unauth, seed, index, rules.protected)
    if not rules.token_replay:
        return durable(rows.withColumns({"replay": F.lit(False), "replay_owner": F.lit(None).cast("string")}))
    return durable(inject_token_replay(rows, sessions, rules.token_replay, seed, index))


def changed_events(injected: DataFrame) -> DataFrame:
    """The event table after injection: new time, operation and session."""
    gone = ["wait_us", "time_hits", "swaps", "unauth", "session_before", "replay", "replay_owner", "gap_us",
            "is_first", "session_no"]
    return injected.withColumn("ts_us", F.col("new_ts_us")).drop("new_ts_us", *gone)


# The columns of the audit table and their types.
AUDIT_COLUMNS = {
    "type": "string", "seed": "bigint", "record_index": "bigint", "mode": "string", "op": "string", "uid": "string",
    "op_category": "string", "seconds_before": "double", "seconds_after": "double", "scale": "double", "delta": "double",
    "params": "string", "swap_with": "bigint", "op_before": "string", "op_after": "string", "swap_op_before": "string",
    "swap_op_after": "string", "constraint": "string", "session_original": "string", "session_mutated": "string",
    "session_replayed": "string", "token_owner_uid": "string", "auth_required": "boolean", "reason": "string",
}


def audit_table(injected: DataFrame, rules: Rules, seed: int, index: str) -> DataFrame:
    """One row per change, in one pass over the injected rows. Columns that do not apply to a kind are null."""
    idx = F.col(index).cast("bigint")
    category = F.col("op_category" if "op_category" in injected.columns else "op")

    def entry(kind: str, **values: Column) -> Column:
        values = {"type": F.lit(kind), "seed": F.lit(seed), "record_index": idx, **values}
        return F.struct(*[values.get(n, F.lit(None)).cast(t).alias(n) for n, t in AUDIT_COLUMNS.items()])

    def time_entry(hit: Column) -> Column:
        def per_rule(attribute, kind):
            return F.element_at(F.array(*[F.lit(getattr(r, attribute)).cast(kind) for r in rules.time]), hit["rule"] + 1)

        mode, scale, delta = per_rule("mode", "string"), per_rule("scale", "double"), per_rule("delta", "double")
        before, after = hit["seconds_before"], hit["seconds_after"]
        reach = F.when(mode == "propagate", F.lit("this wait and all later ones of the session")).otherwise(F.lit("this wait only"))
        told = F.printf(F.lit("wait of %.3f s became %.3f s (%s; %s)"), before, after, per_rule("text", "string"), reach)
        return entry("time", mode=mode, op=F.col("op"), seconds_before=before, seconds_after=after, scale=scale, delta=delta,
                     params=F.to_json(F.struct(scale.alias("scale"), delta.alias("delta"))), reason=told)

    def order_entry(swap: Column) -> Column:
        constraint = F.concat_ws("->", swap["before"], swap["other_before"])
        return entry("order", swap_with=swap["with"], op_before=swap["before"], op_after=swap["other_before"],
                     swap_op_before=swap["other_before"], swap_op_after=swap["before"], constraint=constraint,
                     reason=F.printf(F.lit("operation traded with row %s, which breaks %s"), swap["with"].cast("string"), constraint))

    who = {"op": F.col("op"), "uid": F.col("uid"), "op_category": category, "session_original": F.col("session_before")}
    unauth = entry("unauth", **who, session_mutated=_forged_session("session_before", seed, index), auth_required=F.lit(True),
                   reason=F.printf(F.lit("%s under a session without sign-in"), F.col("op")))
    replay = entry("token_replay", **who, session_replayed=F.col("session_id"), token_owner_uid=F.col("replay_owner"),
                   reason=F.printf(F.lit("%s acts under a session of %s"), F.col("uid"), F.col("replay_owner")))
    parts = [F.transform("swaps", order_entry), F.array(F.when(F.col("unauth"), unauth), F.when(F.col("replay"), replay))]
    if rules.time:
        parts.insert(0, F.transform("time_hits", time_entry))
    every = F.filter(F.concat(*parts), lambda e: e.isNotNull())
    return injected.select(F.explode(every).alias("e")).select("e.*")
