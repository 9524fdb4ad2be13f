"""State kept per key with event-time timers: burst counts and alert decisions, for events that come in any order within the watermark.

Both keep what the watermark has not passed in list state, and settle it in the order of time when a timer says that nothing earlier can come. A timer needs no
event of its key: keys that fall silent are settled, reminded of and forgotten all the same. State lives in RocksDB, so that it may outgrow memory.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MINUTE = 60_000_000  # microseconds


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state with lists and timers needs a store that has them."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def _at_or_after(us: int) -> int:
    """The first whole millisecond, which timers count in, that is not before."""
    return -(-us // 1000)


# --- bursts ---


class Trail(NamedTuple):
    """Trailing counts so far: first and last event, number of events, largest and summed count."""

    since: int
    last: int
    events: int = 0
    most: int = 0
    total: int = 0


def lives(trail: Trail | None, recent: deque[int], times: Iterable[int], seconds: int, idle: int) -> Iterator[Trail]:
    """The trail after further events in order; a silence of more than ``idle`` ends it and opens another. ``recent``, the times of the last ``seconds``, is moved on."""
    for us in times:
        if trail is not None and us > trail.last + idle:
            yield trail
            trail = None
        if trail is None:
            recent.clear()
            trail = Trail(us, us)
        recent.append(us)
        while recent[0] < us - seconds * 1_000_000:
            recent.popleft()
        trail = Trail(trail.since, us, trail.events + 1, max(trail.most, len(recent)), trail.total + len(recent))
    if trail is not None:
        yield trail


class BurstCounts(StatefulProcessor):
    """Running trailing counts of a key. A key silent for more than ``idle_seconds`` is closed and forgotten; events after that open a new life of it."""

    OUT = "fingerprint string, since long, events long, max_count long, sum_count long, closed boolean"

    def __init__(self, seconds: int, idle_seconds: int) -> None:
        if idle_seconds < seconds:
            raise ValueError("a key must not be forgotten while its last events still count")
        self.seconds, self.idle = seconds, idle_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long")
        self.recent = handle.getListState("recent", "us long")
        self.trail = handle.getValueState("trail", "since long, last long, events long, most long, total long")

    def _state(self) -> tuple[list[int], deque[int], Trail | None]:
        waiting = sorted(r[0] for r in self.waiting.get()) if self.waiting.exists() else []
        recent = deque(r[0] for r in self.recent.get()) if self.recent.exists() else deque()
        return waiting, recent, Trail(*self.trail.get()) if self.trail.exists() else None

    def _row(self, key: tuple, trail: Trail, closed: bool) -> Row:
        return Row(fingerprint=key[0], since=trail.since, events=trail.events, max_count=trail.most, sum_count=trail.total, closed=closed)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        settled = timerValues.getCurrentWatermarkInMs() * 1000
        new = [r["us"] for r in rows if r["us"] > settled]  # the others are late and left to a replay
        if not new:
            return
        self.waiting.appendList([(us,) for us in new])
        self.handle.registerTimer(_at_or_after(max(new)))
        waiting, recent, trail = self._state()
        for life in lives(trail, recent, waiting, self.seconds, self.idle):  # what is known by now; it may change until the watermark has passed
            yield self._row(key, life, False)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting, recent, trail = self._state()
        due = [us for us in waiting if us <= passed]
        rest = waiting[len(due) :]
        *over, trail = [None] if trail is None and not due else lives(trail, recent, due, self.seconds, self.idle)
        for life in over:
            yield self._row(key, life, True)
        if trail is None:
            return
        if trail.last + self.idle <= passed:
            yield self._row(key, trail, True)
            trail = None
            recent.clear()
        elif not rest:
            self.handle.registerTimer(_at_or_after(trail.last + self.idle))
        self.waiting.put([(us,) for us in rest]) if rest else self.waiting.clear()
        self.recent.put([(us,) for us in recent]) if recent else self.recent.clear()
        self.trail.update(tuple(trail)) if trail else self.trail.clear()

    def close(self) -> None:
        pass


def stream_bursts(records: DataFrame, seconds: int = 60, delay: str = "15 minutes", idle_seconds: int = 86_400) -> DataFrame:
    """Running burst counts per fingerprint and life (``since``, its first event), as the batch counts them; the last row of a life has them all.

    Events may come in any order within ``delay``; later ones are left to a replay. State of a key: times of the last ``seconds`` and of ``delay``.
    """
    use_rocksdb(records.sparkSession)
    rows = records.filter(F.col("ts").isNotNull()).select("fingerprint", "ts", F.unix_micros("ts").alias("us")).withWatermark("ts", delay)
    return rows.groupBy("fingerprint").transformWithState(BurstCounts(seconds, idle_seconds), BurstCounts.OUT, "Update", "EventTime")


def burst_totals(emitted: DataFrame) -> DataFrame:
    """``fingerprint, events, max_count, sum_count`` from all rows that a stream of bursts has emitted."""
    lives = emitted.groupBy("fingerprint", "since").agg(F.max(F.struct("events", "max_count", "sum_count")).alias("l"))
    return lives.groupBy("fingerprint").agg(F.sum("l.events").alias("events"), F.max("l.max_count").alias("max_count"), F.sum("l.sum_count").alias("sum_count"))


# --- alerts ---


class Sent(NamedTuple):
    """The last alert of a peak."""

    at: int
    window_key: str | None
    trend: str | None
    error_count: int
    cooldown_until: int


def decide(p: Row, sent: Sent | None, heartbeat: int, cooldown: int, min_delta_pct: float) -> tuple[bool, str]:
    """Whether to send a payload, and why; the first rule that fits. The rules are those of ``alerts.decision``, row by row."""
    if p["is_test"]:
        return False, "test_peak_suppressed" + (f":{p['test_originator']}" if p["test_originator"] else "")
    if sent is None:
        return True, "first_seen_in_state"
    if not p["is_known"]:
        return True, "new_peak"
    if sent.window_key and p["window_key"] and sent.window_key == p["window_key"]:
        return False, "same_window_duplicate"
    if sent.trend and p["trend"] and sent.trend != p["trend"]:
        return True, "trend_changed"
    if p["error_count"] > 0 and sent.error_count > 0:
        delta = abs(p["error_count"] - sent.error_count) / max(sent.error_count, 1) * 100
        if delta >= min_delta_pct:
            return True, f"count_delta_{round(delta, 1):.1f}_pct"
    if p["new_apps"] or p["new_namespaces"]:
        return True, "scope_changed"
    if p["us"] < sent.cooldown_until:
        return False, "cooldown_active"
    if p["us"] - heartbeat >= sent.at:
        return True, "heartbeat"
    return False, "no_trigger" if cooldown <= 0 else "no_material_change"


class AlertDecisions(StatefulProcessor):
    """Decides the payloads of a peak in the order of time. Two timers speak without a payload: when the cooldown ends, and when the heartbeat is due,
    if a payload was held back since the last alert. They are told (``cooldown_over``, ``heartbeat_due``) and change no later decision."""

    PAYLOAD = ("us", "window_key", "error_count", "trend", "is_test", "test_originator", "is_known", "new_apps", "new_namespaces")
    STATE = "us long, window_key string, error_count long, trend string, is_test boolean, test_originator string, is_known boolean, new_apps array<string>, new_namespaces array<string>"
    OUT = "peak_key string, us long, window_key string, error_count long, send boolean, reason string"

    def __init__(self, cooldown_min: int = 45, heartbeat_min: int = 120, min_delta_pct: float = 30.0) -> None:
        self.cooldown, self.heartbeat, self.min_delta_pct = max(0, cooldown_min) * MINUTE, heartbeat_min * MINUTE, min_delta_pct

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.STATE)
        self.sent = handle.getValueState("sent", "at long, window_key string, trend string, error_count long, cooldown_until long")
        self.held = handle.getValueState("held", "us long, window_key string, error_count long, cooldown_told boolean, heartbeat_told boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        settled = timerValues.getCurrentWatermarkInMs() * 1000
        new = [tuple(r[c] for c in self.PAYLOAD) for r in rows if r["us"] > settled]
        if new:
            self.waiting.appendList(new)
            for us in {p[0] for p in new}:
                self.handle.registerTimer(_at_or_after(us))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = [Row(*self.PAYLOAD)(*r) for r in self.waiting.get()] if self.waiting.exists() else []
        waiting.sort(key=lambda p: (p["us"], p["window_key"] or ""))
        due = [p for p in waiting if p["us"] <= passed]
        if due:
            rest = [tuple(p) for p in waiting if p["us"] > passed]
            self.waiting.put(rest) if rest else self.waiting.clear()
        sent = Sent(*self.sent.get()) if self.sent.exists() else None
        for p in due:
            yield from self._reminders(key, sent, p["us"])
            send, reason = decide(p, sent, self.heartbeat, self.cooldown, self.min_delta_pct)
            yield Row(peak_key=key[0], us=p["us"], window_key=p["window_key"], error_count=p["error_count"], send=send, reason=reason)
            if send:
                sent = Sent(p["us"], p["window_key"], p["trend"], p["error_count"], p["us"] + self.cooldown)
                self.sent.update(tuple(sent))
                self.held.clear()
            elif sent is not None and not p["is_test"]:
                told = self.held.get()[3:] if self.held.exists() else (False, False)
                self.held.update((p["us"], p["window_key"], p["error_count"], *told))
                for at in (sent.cooldown_until, sent.at + self.heartbeat):
                    if at > p["us"]:
                        self.handle.registerTimer(_at_or_after(at))
        yield from self._reminders(key, sent, passed + 1)

    def _reminders(self, key: tuple, sent: Sent | None, before: int) -> Iterator[Row]:
        """What timers before ``before`` have to say of the payload held back last."""
        if sent is None or not self.held.exists():
            return
        us, window_key, n, *told = self.held.get()
        for i, (at, reason) in enumerate(((sent.cooldown_until, "cooldown_over"), (sent.at + self.heartbeat, "heartbeat_due"))):
            if us < at < before and not told[i]:
                told[i] = True
                self.held.update((us, window_key, n, *told))
                yield Row(peak_key=key[0], us=at, window_key=window_key, error_count=n, send=False, reason=reason)

    def close(self) -> None:
        pass


def stream_decisions(payloads: DataFrame, delay: str = "15 minutes", **limits) -> DataFrame:
    """Decisions on a stream of payloads (peak_key, at, and what ``AlertDecisions.PAYLOAD`` names but ``us``), each once the watermark has passed it, and reminders."""
    use_rocksdb(payloads.sparkSession)
    rows = payloads.filter(F.col("at").isNotNull() & (F.coalesce("peak_key", F.lit("")) != "")).withColumn("us", F.unix_micros("at")).withWatermark("at", delay)
    rows = rows.select("peak_key", "at", *AlertDecisions.PAYLOAD)
    return rows.groupBy("peak_key").transformWithState(AlertDecisions(**limits), AlertDecisions.OUT, "Append", "EventTime")
