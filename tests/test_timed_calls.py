"""What rows in order cost: calls of the state and timers by key and micro-batch, not by row."""

import random
from types import SimpleNamespace

import pytest
from pyspark.sql import Row

from folioflow.streaming import timed as T


class Handle:
    """The states and timers of one key, and how often they were called."""

    def __init__(self):
        self.values, self.timers, self.calls = {}, set(), 0

    def getMapState(self, name, *_):
        return Kept(self, name)

    def getValueState(self, name, *_):
        value = Kept(self, name)
        return SimpleNamespace(get=lambda: value.getValue(()), update=lambda v: value.updateValue((), v), clear=lambda: value.removeKey(()), exists=lambda: value.containsKey(()))

    def registerTimer(self, ms):
        self.calls += 1
        self.timers.add(ms)


class Kept:
    def __init__(self, handle, name):
        self.handle, self.name = handle, name

    def _called(self):
        self.handle.calls += 1
        return self.handle.values

    def getValue(self, key):
        return self._called().get((self.name, key))

    def containsKey(self, key):
        return (self.name, key) in self._called()

    def updateValue(self, key, value):
        self._called()[self.name, key] = value

    def removeKey(self, key):
        self._called().pop((self.name, key), None)


def run(processor, parts, late_ms):
    """The output for micro-batches of one key, and the state after them."""
    processor.key, handle, out, newest, mark = "key", Handle(), [], 0, 0
    processor.init(handle)
    for part in parts:
        values = SimpleNamespace(getCurrentWatermarkInMs=lambda: mark)
        out += processor.handleInputRows(("k",), iter(part), values)
        for ms in sorted(t for t in handle.timers if t <= mark):
            handle.timers.discard(ms)
            out += processor.handleExpiredTimer(("k",), values, SimpleNamespace(getExpiryTimeInMs=lambda: ms))
        newest = max([newest, *(r["at"] // 1000 for r in part)])
        mark = max(mark, newest - late_ms)
    return [tuple(r) for r in out], handle


@pytest.mark.parametrize("processor", [T.Lock(3, 60), T.HandOut(15, 3), T.Wake(5), T.Commands()])
def test_calls_do_not_grow_with_rows(processor):
    fields = {"Lock": ["ok"], "HandOut": ["done"], "Wake": [], "Commands": ["seq", "cmd", "arg", "done_at"]}[type(processor).__name__]
    value = {"ok": lambda i: i % 7 == 0, "done": lambda i: i % 7 == 0, "seq": lambda i: i, "cmd": lambda i: "edit", "arg": lambda i: None, "done_at": lambda i: i}
    named = Row("key", "at", *fields)
    rows = [named("k", 1_000_000 + 1_234_567 * i, *(value[f](i) for f in fields)) for i in range(1000)]
    random.Random(5).shuffle(rows)
    end = [named("k", 10**12 + i, *(value[f](i) for f in fields)) for i in range(2)]
    _, handle = run(processor, [rows, end[:1], end[1:]], 1000)
    assert handle.calls < 40


def test_runs_are_merged_in_order(monkeypatch):
    monkeypatch.setattr(T, "RUN", 8)
    monkeypatch.setattr(T, "CHUNK", 50)
    dice, named = random.Random(3), Row("key", "at", "seq", "cmd", "arg", "done_at")
    for _ in range(20):
        rows = [named("k", dice.randrange(2_000_000, 4_000_000), i, "edit", dice.choice([None, "a"]), i) for i in range(dice.randrange(1, 700))]
        cuts = sorted(dice.randrange(len(rows) + 1) for _ in range(4))
        parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
        out, handle = run(T.Commands(), [*parts, [named("k", 10**10, -1, "", "", 0)], []], 3000)
        assert [(r[1], r[2]) for r in out] == sorted((r["at"], r["seq"]) for r in rows)
        out, handle = run(T.Commands(), [*parts, [named("k", 10**10, -1, "", "", 0)], []], 300)  # some come too late
        assert sorted(r[2] for r in out) == list(range(len(rows)))
        in_time = [r[1] for r in out if not r[-1]]
        assert in_time == sorted(in_time)
        assert {name for name, _ in handle.values} == {"memory"}  # no run is left


def test_failures_are_forgotten():
    named = Row("key", "at", "ok")
    parts = [[named("k", 1_000_000, False), named("k", 31_000_000, False)], [named("other", 70_000_000, True)], [], [named("other", 200_000_000, True)], []]
    processor = T.Lock(3, 60)
    own = [[r for r in p if r["key"] == "k"] for p in parts]
    processor.key, handle = "key", Handle()
    processor.init(handle)
    for part, mark in zip(own, [0, 0, 62_000, 69_000, 199_000]):
        values = SimpleNamespace(getCurrentWatermarkInMs=lambda: mark)
        list(processor.handleInputRows(("k",), iter(part), values))
        for ms in sorted(t for t in handle.timers if t <= mark):
            handle.timers.discard(ms)
            list(processor.handleExpiredTimer(("k",), values, SimpleNamespace(getExpiryTimeInMs=lambda: ms)))
    assert not handle.values and not handle.timers
