"""The state step of the live features: how often it speaks to the state store, and what it lets go, without a stream."""

from pyspark.sql import Row

from tempolog.streaming.flows import Reorder

SECOND = 1_000_000
Event = Row("uid", "event", "ts")


class Store:
    """One user's state and timers in memory. Every call is counted, as each is a round trip to the state store."""

    def __init__(self):
        self.calls, self.value, self.timers = 0, None, set()

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def clear(self):
        self.calls, self.value = self.calls + 1, None

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)


class Times:
    def __init__(self, ms):
        self.ms = ms

    getCurrentWatermarkInMs = getExpiryTimeInMs = lambda self: self.ms


def trigger(step, store, now, events):
    """One trigger as Spark runs it: the rows, then the timers that the watermark has passed. Rows let go, and calls made."""
    before, out = store.calls, []
    if events:
        out += step.handleInputRows(("a",), iter([Event("a", e, None) for e in events]), Times(now))
    for at in sorted(t for t in store.timers if t <= now):
        out += step.handleExpiredTimer(("a",), Times(now), Times(at))
        store.timers.remove(at)
    return out, store.calls - before


def test_calls_do_not_grow_with_events_and_pieces_join_up():
    step, store = Reorder(idle=100, piece=4), Store()
    step.init(store)
    text = lambda i: f"{i * i * SECOND} {i} {'view' if i % 2 else 'a b'}" if i != 7 else f"{49 * SECOND} 7"
    lots = [range(9, -1, -1), range(10, 30), range(30, 50)]
    let_go = []
    for lot in lots:
        now = max((lot[0] ** 2 - 1) * 1000, 0) if lot[0] < lot[-1] else 0
        out, calls = trigger(step, store, now, [text(i) for i in lot])
        assert calls <= 4
        let_go += out
    out, calls = trigger(step, store, 49 * 49 * 1000, [])
    assert calls <= 3 and store.timers == {(49 * 49 + 100) * 1000}
    let_go += out
    assert all(len(r.events) <= 4 for r in let_go)
    assert [e for r in let_go for e in r.events] == [text(i) for i in range(50)]
    every = [0] + [(2 * i - 1) * SECOND for i in range(1, 50)]
    at = 0
    for r in let_go:
        assert r.gaps[r.seen:] == every[at:at + len(r.events)] and r.gaps[:r.seen] == every[max(0, at - 5):at]
        assert r.before == (None if at in (0, 8) else "view" if (at - 1) % 2 else "a b") and r.since_us == 0 and r.age == min(at, 6)
        at += len(r.events)
    out, calls = trigger(step, store, (49 * 49 + 100) * 1000, [])
    assert out == [] and store.value is None and store.timers == set()
