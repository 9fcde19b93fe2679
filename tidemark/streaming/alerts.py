"""Alert delivery per instance: what is worth sending, and whether the budget allows it.

Every decision rests on a state of a few numbers, so reports are judged one by one in order, many instances in one
call. Stream and batch share this.
"""

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import astuple, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from tidemark import fixed
from tidemark.streaming import buckets
from tidemark.streaming.inorder import InOrder

INPUT = ["instance", "observed_s", "seq", "severity", "codes", "send_ok"]
OUTPUT = (
    "instance STRING, observed_s BIGINT, seq BIGINT, severity STRING, codes STRING, "
    "delivery STRING, event STRING, notification_failed BOOLEAN"
)
NAMES = [part.split()[0] for part in OUTPUT.split(", ")]
HOUR, DAY = 3600, 86400
NEVER = -(1 << 40)


@dataclass
class Delivery:
    """What the next decision of one instance rests on."""

    latest_s: int = NEVER  # newest time seen
    told: str = ""  # last delivered report
    told_ok: bool = True
    told_s: int = 0
    tried_s: int = NEVER  # last attempt; the counts below are of its hour and day
    in_hour: int = 0
    in_day: int = 0
    failing: bool = False

    def due(self, at: int, report: str, ok: bool) -> bool:
        """Whether a report is worth an attempt that the budget allows, given this state."""
        return (
            (not ok or not self.told_ok or self.failing)
            and (report != self.told or at - self.told_s >= fixed.REMINDER_S)
            and at - self.tried_s >= fixed.COOLDOWN_S
            and (at // HOUR != self.tried_s // HOUR or self.in_hour < fixed.HOURLY_CAP)
            and (at // DAY != self.tried_s // DAY or self.in_day < fixed.DAILY_CAP)
        )

    def attempt(self, at: int, report: str, ok: bool, answered: bool) -> None:
        """Count an attempt, whatever the answer, and note what was delivered."""
        self.in_hour = 1 + (self.in_hour if at // HOUR == self.tried_s // HOUR else 0)
        self.in_day = 1 + (self.in_day if at // DAY == self.tried_s // DAY else 0)
        self.tried_s, self.failing = at, not answered
        if answered:
            self.told, self.told_ok, self.told_s = report, ok, at


def judge(known: dict[str | None, Delivery], reports: pd.DataFrame) -> pd.DataFrame:
    """Decisions on reports that are in order for each instance; the states in ``known``, which makes new ones, move on.

    ``send_ok`` is what the receiver answered; NULL counts as failed. A report older than
    one before it shows a clock that went back: it is flagged and changes nothing.
    """
    out = []
    for instance, at, seq, severity, codes, answered in zip(*[reports[c].astype(object).tolist() for c in INPUT]):
        state, delivery, event = known[instance], "suppressed", None
        if at < state.latest_s:
            severity, codes = "critical", fixed.CLOCK_CODE
        else:
            state.latest_s = at
            report, ok = f"{severity}:{codes}", severity == "ok"
            if state.due(at, report, ok):
                state.attempt(at, report, ok, not pd.isna(answered) and bool(answered))
                delivery, event = "failed" if state.failing else "sent", "recovery" if ok else "alert"
        out.append((instance, at, seq, severity, codes, delivery, event, state.failing))
    return pd.DataFrame(out, columns=NAMES)


def decide(state: Delivery, reports: pd.DataFrame) -> pd.DataFrame:
    """Decisions on the reports of one instance in order; ``state`` moves on."""
    return judge(defaultdict(lambda: state), reports)


class Deliveries(InOrder):
    """Attempts with a reservation and an outcome: an attempt counts as failed until its answer puts it right."""

    ROW = "at_s BIGINT, seq BIGINT, severity STRING, codes STRING, accepted BOOLEAN"  # severity NULL: an outcome
    OUTPUT = "instance STRING, seq BIGINT, at_s BIGINT, step STRING, event STRING"
    NONE = (None, None, None, None)  # of an open attempt: seq, end of waiting, report, whether it is ok

    def __init__(self, wait_s: int):
        if wait_s >= fixed.COOLDOWN_S:
            raise ValueError("an attempt must be settled before the next one may follow")
        self._wait_s = wait_s

    def start(self) -> tuple:
        return (*astuple(Delivery()), *self.NONE)

    def advance(self, key, state, rows, now_s):
        known, pending = Delivery(*state[: -len(self.NONE)]), tuple(state[-len(self.NONE) :])
        answers: dict[int, list[tuple[int, bool]]] = {}
        for at, seq, severity, _, accepted in rows:
            if severity is None:
                answers.setdefault(seq, []).append((at, bool(accepted)))
        reports = [r for r in rows if r[2] is not None]
        out: list[tuple] = []

        def settle() -> None:
            """Put the open attempt right by its first answer in time; without one it stays failed."""
            nonlocal pending
            seq, until, report, ok = pending
            event = "recovery" if ok else "alert"
            found = min((a for a in answers.get(seq, []) if a[0] <= until), default=None, key=lambda a: a[0])
            if found is not None:
                if found[1]:
                    known.told, known.told_ok, known.told_s, known.failing = report, ok, until - self._wait_s, False
                out.append((key, seq, found[0], "sent" if found[1] else "failed", event))
            elif until < now_s:
                out.append((key, seq, until, "expired", event))
            else:
                return
            pending = self.NONE

        if pending[0] is not None:
            settle()
        for at, seq, severity, codes, _ in reports:
            report, ok = f"{severity}:{codes}", severity == "ok"
            # While an attempt is open none can follow: it is settled long before its cooldown ends.
            if pending[0] is not None or not known.due(at, report, ok):
                out.append((key, seq, at, "suppressed", None))
                continue
            known.attempt(at, report, ok, False)
            pending = (seq, at + self._wait_s, report, ok)
            out.append((key, seq, at, "attempt", "recovery" if ok else "alert"))
            settle()
        if reports:
            known.latest_s = max(known.latest_s, reports[-1][0])
        deadline = pending[1] + 1 if pending[0] is not None else None
        return (*astuple(known), *pending), out, [], deadline


def alert_delivery(reports: DataFrame, outcomes: DataFrame, wait_s: int = 10, delay: str = "10 minutes") -> DataFrame:
    """Every report's decision, and how every attempt ended: the stream of reports and that of their answers.

    ``reports`` has instance, observed_s, seq, severity and codes; ``outcomes`` has instance, answered_s, seq (of the report that was
    sent) and accepted. A report that is worth an attempt, and that the budget allows, is an ``attempt``: it is counted, and
    failed, before it is sent. Its first answer within ``wait_s`` seconds makes it ``sent`` or ``failed``; without one it
    is ``expired``, and a later answer changes nothing. Other reports are ``suppressed``. Both streams are taken in order of time, so
    that the result is the same for any micro-batches within ``delay``.
    """
    timed = [
        df.select(F.col("instance").cast("string"), F.timestamp_seconds(at).alias("time"), F.col(at).cast("long").alias("at_s"), "seq", *rest)
        .withWatermark("time", delay)
        for df, at, rest in (
            (reports, "observed_s", ["severity", "codes", F.lit(None).cast("boolean").alias("accepted")]),
            (outcomes, "answered_s", [F.lit(None).cast("string").alias("severity"), F.lit(None).cast("string").alias("codes"), "accepted"]),
        )
    ]
    return Deliveries(wait_s).over(timed[0].unionByName(timed[1]))


def throttle(key: tuple, reports: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A micro-batch of one bucket: the reports of its instances since the last trigger."""
    known = defaultdict(Delivery, {instance: Delivery(*kept) for instance, kept in buckets.load(state)})
    yield judge(known, pd.concat(list(reports)).sort_values("seq", kind="stable"))
    buckets.store(state, [(instance, astuple(kept)) for instance, kept in known.items()])


def alert_throttle(stream: DataFrame, count: int = buckets.COUNT) -> DataFrame:
    """Decisions of a stream of reports.

    Reports are taken in ``seq`` order, the order in which the monitor made them. The
    source's trigger limit (``maxFilesPerTrigger``) bounds what a task sorts at once.
    """
    rows = stream.select(F.col("instance").cast("string"), *INPUT[1:])
    return buckets.grouped(rows, count).applyInPandasWithState(throttle, OUTPUT, buckets.STATE, "append", "NoTimeout")


def alert_throttle_batch(reports: DataFrame) -> DataFrame:
    """The same decisions for a table of reports.

    Rows are partitioned by instance and sorted, then pass through one Arrow batch
    at a time; only the state of the current instance is kept. The sequence of one
    instance cannot be split, as every decision depends on the one before, but its
    rows stream through and are never gathered.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = defaultdict(Delivery)
        for pdf in batches:
            if not len(pdf):
                continue
            yield judge(known, pdf)
            last = pdf["instance"].iloc[-1]
            known = defaultdict(Delivery, {last: known[last]})

    return (
        reports.select(F.col("instance").cast("string"), *INPUT[1:])
        .repartition("instance")
        .sortWithinPartitions("instance", "seq")
        .mapInPandas(run, OUTPUT)
    )


def reports_from_codes(events: DataFrame, keys: list[str]) -> DataFrame:
    """Reports with severity and sorted distinct codes from single code rows."""
    from tidemark.operators.ops import health_rollup

    return health_rollup(events, keys).drop("reports").withColumn(
        "codes", F.coalesce("codes", F.lit(""))
    )
