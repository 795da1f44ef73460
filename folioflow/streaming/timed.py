"""Stateful operators that take the rows of a key in the order of their time, and act by themselves when a time comes.

A row waits in the state until the watermark passes it, and a timer hands it on: so the order is that of the events
however they are cut into micro-batches, and what an operator does later without a further row is a timer, too. A key has
one timer, for its first waiting row or alarm, and when that rings, all rows that the watermark has passed are taken: a few from the
key's own state, many from sorted runs, which are merged. So a micro-batch costs a key a few calls of the state, however many rows
it has, and of the waiting rows a run for each ``CHUNK`` that came is in memory, with what a task writes in a micro-batch. Rows that come after the watermark has passed them are left out by Spark,
but for ``ordered_commands``, which hands them on as late.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MICROS = 1_000_000

#: Rows of a key that are sorted at a time, and rows of a run.
CHUNK, RUN = 16_384, 1024


def _place(row: list) -> list[tuple]:
    """What rows of one time are ordered by: their fields, null first."""
    return [(v is not None, v or 0) if not isinstance(v, str) else (True, v) for v in row]


class InOrder(StatefulProcessor):
    """``on_row(at, row)`` gets the rows in order, ``on_time(at)`` is asked what is due up to a time before each of them and when
    the watermark has come to a time; times are microseconds. Both return rows of the output without the key."""

    out: tuple[str, ...] = ()
    key = "key"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("runs", "run bigint", "rows string")
        self.memory = handle.getValueState("memory", "state string")
        self.alarms: set[int] = set()
        self.named = Row(self.key, *self.out)

    def start(self) -> dict:
        return {}

    def alarm(self, at: int) -> None:
        self.alarms.add(-(-at // 1000))

    def on_time(self, state: dict, at: int) -> list[tuple]:
        return []

    def on_row(self, state: dict, at: int, row: list) -> list[tuple]:
        raise NotImplementedError

    def late(self, row: list) -> list[tuple]:
        return []

    def _recall(self) -> dict:
        """What a key has: its state, waiting rows in order, runs of more of them (time of the first row, number), and times at which
        it is to be looked at."""
        held = self.memory.get()
        return json.loads(held[0]) if held else {"state": self.start(), "rows": [], "runs": [], "next": 0, "alarms": [], "timer": None}

    def _keep(self, memory: dict) -> None:
        """Write it, with one timer for whatever comes first; nothing is kept of a key that is as at its start."""
        first = min([*memory["alarms"], *(r[0] // 1000 for r in (*memory["rows"][:1], *memory["runs"][:1]))], default=None)
        if first is None:
            memory.update(next=0, timer=None)
            if memory["state"] == self.start():
                return self.memory.clear()
        elif memory["timer"] is None or memory["timer"] > first:
            memory["timer"] = first
            self.handle.registerTimer(first)
        self.memory.update((json.dumps(memory),))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        watermark, memory = timerValues.getCurrentWatermarkInMs(), None
        while chunk := list(islice(rows, CHUNK)):
            names = [c for c in chunk[0].__fields__ if c not in (self.key, "at")]
            places = [chunk[0].__fields__.index(c) for c in ("at", *names)]
            held = []
            for r in chunk:
                at, *row = (r[i] for i in places)
                if at // 1000 > watermark:
                    held.append([at, *row])
                else:
                    yield from (self.named(key[0], *out) for out in self.late(row))
            if not held:
                continue
            memory = memory or self._recall()
            held = sorted(memory["rows"] + held, key=_place)
            while len(held) > RUN:
                self.waiting.updateValue((memory["next"],), (json.dumps(held[:RUN]),))
                memory["runs"].append([held[0][0], memory["next"]])
                memory["next"], held = memory["next"] + 1, held[RUN:]
            memory["rows"] = held
        if memory:
            memory["runs"].sort()
            self._keep(memory)

    def _passed(self, memory: dict, watermark: int) -> Iterator[list]:
        """The waiting rows that the watermark has passed, in order. A run is read when its first row is next."""
        passed = lambda at: at // 1000 <= watermark
        due = lambda rows: next((i for i, r in enumerate(rows) if not passed(r[0])), len(rows))
        runs, left, n = memory["runs"], [], 0
        own = memory["rows"][: due(memory["rows"])]
        heads = [(_place(own[0]), -1, own, 0)] if own else []
        memory["rows"] = memory["rows"][len(own) :]
        while heads or (n < len(runs) and passed(runs[n][0])):
            while n < len(runs) and passed(runs[n][0]) and (not heads or runs[n][0] <= heads[0][2][heads[0][3]][0]):
                run, n = runs[n][1], n + 1
                rows = json.loads(self.waiting.getValue((run,))[0])
                if (end := due(rows)) == len(rows):
                    self.waiting.removeKey((run,))
                else:
                    self.waiting.updateValue((run,), (json.dumps(rows[end:]),))
                    left.append([rows[end][0], run])
                heapq.heappush(heads, (_place(rows[0]), run, rows[:end], 0))
            _, run, rows, i = heads[0]
            if i + 1 < len(rows):
                heapq.heapreplace(heads, (_place(rows[i + 1]), run, rows, i + 1))
            else:
                heapq.heappop(heads)
            yield rows[i]
        memory["runs"] = sorted(left + runs[n:])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        watermark, memory = timerValues.getCurrentWatermarkInMs(), self._recall()
        if memory["timer"] is None or memory["timer"] > watermark:
            return  # an earlier one of this key has been here
        state, self.alarms = memory["state"], set(memory["alarms"])
        for at, *row in self._passed(memory, watermark):
            for out in self.on_time(state, at) + self.on_row(state, at, row):
                yield self.named(key[0], *out)
        for out in self.on_time(state, watermark * 1000):  # rows to come are later
            yield self.named(key[0], *out)
        memory["alarms"], memory["timer"] = sorted(ms for ms in self.alarms if ms > watermark), None
        self._keep(memory)

    def close(self) -> None:
        pass


def in_order(rows: DataFrame, key: str, processor: InOrder, schema: str, late: str, at: str = "at") -> DataFrame:
    """``rows`` with a time ``at`` through a processor; up to ``late`` after the newest row, older ones still count. The time goes on as a
    number, so Spark's own filter, which drops late rows, doesn't see it."""
    processor.key = key
    others = [c for c in rows.columns if c not in (key, at)]
    marked = rows.withWatermark(at, late).select(key, F.unix_micros(F.col(at)).alias("at"), *others)
    return marked.groupBy(key).transformWithState(processor, schema, "Append", "EventTime")


class Lock(InOrder):
    """Failures of a source to the times at which it is locked and unlocked."""

    out = ("event", "at")

    def __init__(self, limit: int, seconds: float):
        self.limit, self.window = limit, round(seconds * MICROS)

    def start(self) -> dict:
        return {"recent": [], "until": None}

    def on_time(self, state: dict, at: int) -> list[tuple]:
        if state["until"] is None or state["until"] > at:
            state["recent"] = state["recent"] if state["until"] else [x for x in state["recent"] if x > at - self.window]
            return []
        until, state["until"] = state["until"], None
        state["recent"] = [x for x in state["recent"] if x > at - self.window]
        return [("unlocked", until)]

    def on_row(self, state: dict, at: int, row: list) -> list[tuple]:
        locked = state["until"] is not None
        if row[0]:
            state["recent"], state["until"] = [], None
            return [("unlocked", at)] if locked else []
        if locked:
            return []  # not counted
        state["recent"].append(at)
        if len(state["recent"]) < self.limit:
            self.alarm(at + self.window)  # to forget it
            return []
        state["until"] = state["recent"][0] + self.window
        self.alarm(state["until"])
        return [("locked", at)]


def lock_stream(attempts: DataFrame, limit: int = 5, seconds: float = 60, late: str = "10 seconds") -> DataFrame:
    """(ip, at, ok) to (ip, event, at): ``locked`` by ``limit`` failures within the time, and ``unlocked`` when the first of them is that old
    or an attempt succeeds. The unlocking needs no further row of the source; nothing is kept of a source once its failures
    are old."""
    return in_order(attempts.select("ip", "at", "ok"), "ip", Lock(limit, seconds), "ip string, event string, at long", late)


class HandOut(InOrder):
    """Asks for an item to hand-outs, and to giving it up."""

    out = ("action", "at")

    def __init__(self, quiet: float, most: int):
        self.quiet, self.most = round(quiet * MICROS), most

    def start(self) -> dict:
        return {"tries": 0, "last": None}

    def on_time(self, state: dict, at: int) -> list[tuple]:
        if state["tries"] < self.most or state["last"] + self.quiet > at:
            return []
        gone = state["last"] + self.quiet
        state.update(self.start())
        return [("give_up", gone)]

    def on_row(self, state: dict, at: int, row: list) -> list[tuple]:
        if row[0]:
            state.update(self.start())
            return []
        if state["last"] is not None and at - state["last"] < self.quiet:
            return []
        state["tries"], state["last"] = state["tries"] + 1, at
        if state["tries"] == self.most:
            self.alarm(at + self.quiet)
        return [("hand", at)]


def hand_out_stream(asks: DataFrame, quiet: float = 15, most: int = 5, late: str = "10 seconds") -> DataFrame:
    """(item, at, done) to (item, action, at): ``hand`` at most once in a quiet time, and ``give_up`` a quiet time after the last of ``most``
    hand-outs if the item isn't done by then, whether somebody asks or not. An item that was done or given up begins anew."""
    return in_order(asks.select("item", "at", "done"), "item", HandOut(quiet, most), "item string, action string, at long", late)


class Wake(InOrder):
    """A counter of changes that a reader compares with the one it has seen."""

    out = ("generation", "at")

    def __init__(self, busy: float):
        self.busy = round(busy * MICROS)

    def start(self) -> dict:
        return {"generation": 0, "seen": 0, "until": None}

    def _wake(self, state: dict, at: int) -> list[tuple]:
        state["seen"], state["until"] = state["generation"], at + self.busy
        return [(state["generation"], at)]

    def on_time(self, state: dict, at: int) -> list[tuple]:
        due = state["until"]
        return self._wake(state, due) if due is not None and due <= at and state["generation"] > state["seen"] else []

    def on_row(self, state: dict, at: int, row: list) -> list[tuple]:
        state["generation"] += 1
        if state["until"] is None or state["until"] <= at:
            return self._wake(state, at)
        if state["generation"] == state["seen"] + 1:
            self.alarm(state["until"])
        return []


def wakeups(changes: DataFrame, busy: float = 5, late: str = "10 seconds") -> DataFrame:
    """(area, at) to (area, generation, at): a reader wakes at a change and is busy for the time; changes meanwhile move the generation
    on, and then it wakes once for all of them, at once. So none is missed, however many come."""
    return in_order(changes.select("area", "at"), "area", Wake(busy), "area string, generation long, at long", late)


class Commands(InOrder):
    """Commands in the order of their time, each when the watermark has passed it; those that come later than that, as late."""

    out = ("given", "seq", "cmd", "arg", "at", "late")

    def late(self, row: list) -> list[tuple]:
        return [(None, *row, True)]

    def on_row(self, state: dict, at: int, row: list) -> list[tuple]:
        return [(at, *row, False)]


def ordered_commands(commands: DataFrame, late: str = "10 seconds") -> DataFrame:
    """(id, at as a time, seq, cmd, arg, done_at) to (id, given, seq, cmd, arg, at, late), ``given`` being that time."""
    rows = commands.select("id", "at", "seq", "cmd", "arg", "done_at")
    return in_order(rows, "id", Commands(), "id long, given long, seq long, cmd string, arg string, at long, late boolean", late)


class Positions(StatefulProcessor):
    """The last position of a book on each device. What isn't written again within the time to live is gone, and so are those of a
    book that is gone."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", "device string", "page long, at_ms long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            out = []
            for r in batch.sort_values("at_ms").itertuples():
                if r.what == "put":
                    before = self.held.getValue((r.device,)) if self.held.containsKey((r.device,)) else None
                    if before is None or before[1] <= r.at_ms:
                        self.held.updateValue((r.device,), (int(r.page), int(r.at_ms)))
                elif r.what == "gone":
                    self.held.clear()
                else:
                    out += [(d[0], v[0], v[1]) for d, v in self.held.iterator()]
            yield pd.DataFrame({"uuid": pd.Series([key[0]] * len(out), dtype=object), **{c: pd.Series([o[i] for o in out], dtype=object) for i, c in enumerate(("device", "page", "at_ms"))}})

    def close(self) -> None:
        pass


def position_stream(rows: DataFrame, days: float = 30) -> DataFrame:
    """(uuid, what: put, gone or ask, device, page, at_ms) to the positions (uuid, device, page, at_ms) that a book has when it is asked
    for. The state forgets by the clock, so the stream is one that runs on."""
    return rows.groupBy("uuid").transformWithStateInPandas(Positions(round(days * 86_400_000)), "uuid string, device string, page long, at_ms long", "Append", "ProcessingTime")
