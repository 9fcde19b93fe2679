"""Faults that persist and instances that stopped reporting, noticed while the stream runs."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.streaming.inorder import InOrder

OUTPUT = "instance STRING, last_s BIGINT, stale_at_ms BIGINT"
NAMES = [part.split()[0] for part in OUTPUT.split(", ")]


class Stale(StatefulProcessor):
    def __init__(self, limit_ms: int):
        self._limit_ms = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._last = handle.getValueState("last", "last_s BIGINT")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = int(self._last.get()[0]) if self._last.exists() else 0
        for pdf in rows:
            last = max(last, int(pdf["observed_s"].max()))
        self._last.update((last,))
        for timer in list(self._handle.listTimers()):
            self._handle.deleteTimer(timer)
        due = timerValues.getCurrentProcessingTimeInMs() + self._limit_ms
        self._handle.registerTimer(due)
        yield pd.DataFrame(columns=NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = int(self._last.get()[0]) if self._last.exists() else 0
        now = expiredTimerInfo.getExpiryTimeInMs()
        yield pd.DataFrame([(key[0], last, now)], columns=NAMES)

    def close(self) -> None:
        pass


def stale_stream(stream: DataFrame, limit_s: int = 180) -> DataFrame:
    """One row each time an instance has been silent for ``limit_s`` seconds."""
    return (
        stream.select(F.col("instance").cast("string"), "observed_s")
        .groupBy("instance")
        .transformWithStateInPandas(Stale(limit_s * 1000), OUTPUT, "append", "processingTime")
    )


class Holds(InOrder):
    """States that start, hold for a time and clear: of a fault, of failed deliveries, and of silence."""

    ROW = "at_s BIGINT, faulty BOOLEAN, send_failed BOOLEAN"
    OUTPUT = "instance STRING, rule STRING, state STRING, at_s BIGINT"
    RULES = ("operational_fault", "notification_failed")

    def __init__(self, stale_s: int, stale_hold_s: int, fault_s: int, failed_s: int):
        self._stale_s, self._stale_hold_s, self._hold = stale_s, stale_hold_s, (fault_s, failed_s)

    def start(self) -> tuple:
        return (None, None, False, None, False, False, False)

    def advance(self, key, state, rows, now_s):
        last, *flags, silent, silent_fires = state
        since, fires = [flags[0], flags[2]], [flags[1], flags[3]]
        out: list[tuple] = []

        def pass_time(before: int) -> None:
            """What time alone brings about up to a second, without it."""
            nonlocal silent, silent_fires
            if last is not None:
                if not silent and last + self._stale_s + 1 < before:
                    silent = True
                    out.append((key, "stale", "started", last + self._stale_s + 1))
                if not silent_fires and last + self._stale_s + self._stale_hold_s + 1 < before:
                    silent_fires = True
                    out.append((key, "stale", "firing", last + self._stale_s + self._stale_hold_s + 1))
            for k, rule in enumerate(self.RULES):
                if since[k] is not None and not fires[k] and since[k] + self._hold[k] < before:
                    fires[k] = True
                    out.append((key, rule, "firing", since[k] + self._hold[k]))

        at = 0
        while at < len(rows):
            now, stop = rows[at][0], at
            while stop < len(rows) and rows[stop][0] == now:
                stop += 1
            # Reports of one second are one: bad if any of them is.
            bad = [any(r[1 + k] for r in rows[at:stop]) for k in range(2)]
            pass_time(now)
            if silent:
                out.append((key, "stale", "cleared", now))
            last, silent, silent_fires = now, False, False
            for k, rule in enumerate(self.RULES):
                if bad[k] and since[k] is None:
                    since[k] = now
                    out.append((key, rule, "started", now))
                elif not bad[k] and since[k] is not None:
                    since[k], fires[k] = None, False
                    out.append((key, rule, "cleared", now))
            at = stop
        pass_time(now_s + 1)
        later = [last + self._stale_s + 1, last + self._stale_s + self._stale_hold_s + 1] if last is not None else []
        later += [s + h for s, h in zip(since, self._hold) if s is not None]
        later = [t for t in later if t > now_s]
        return (last, since[0], fires[0], since[1], fires[1], silent, silent_fires), out, [], min(later, default=None)


def hold_stream(
    reports: DataFrame,
    stale_s: int = 180,
    stale_hold_s: int = 60,
    fault_s: int = 120,
    failed_s: int = 300,
    delay: str = "10 minutes",
) -> DataFrame:
    """Changes of the alerts of every instance: ``rule``, ``state`` (started, firing, cleared) and ``at_s``.

    ``reports`` has instance, observed_s, faulty and send_failed. A state fires once it has held for its time, by the clock of
    the reports: what fires up to the watermark is what ``operators.ops.stale_monitor`` finds on the reports up to it. Reports
    may come in any order and micro-batches within ``delay``.
    """
    timed = reports.select(
        F.col("instance").cast("string"), F.timestamp_seconds("observed_s").alias("time"),
        F.col("observed_s").cast("long").alias("at_s"), "faulty", "send_failed",
    ).withWatermark("time", delay)
    return Holds(stale_s, stale_hold_s, fault_s, failed_s).over(timed)


def firing_at(changes: DataFrame, now_s: int) -> DataFrame:
    """Alerts that fire at a second: ``instance`` and ``rule``, from the changes up to it."""
    latest = F.max_by("state", F.struct("at_s", F.col("state") != "started"))
    held = changes.where(F.col("at_s") <= now_s).groupBy("instance", "rule").agg(latest.alias("state"))
    return held.where("state = 'firing'").select("instance", "rule")
