"""Keyed streams whose rows count in event-time order, whatever the order and the cut of their arrival.

A row waits in the state of its instance until the watermark has passed its time; then it is taken, in
order, with everything else that is due. So results do not depend on micro-batches. Waiting rows are those of the
watermark's delay, and what was derived from older ones is a small state. Instances share state rows (``buckets``).
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState

from tidemark.streaming import buckets


class InOrder:
    """Subclasses name their schemas and say what rows that are complete up to a second lead to."""

    ROW: str  # of waiting rows; the first field is at_s BIGINT
    OUTPUT: str

    def start(self) -> tuple:
        """State of an instance without rows; its values are numbers, texts, booleans and NULL."""
        raise NotImplementedError

    def advance(self, key: str, state: tuple, rows: list[tuple], now_s: int) -> tuple[tuple, list[tuple], list[tuple], int | None]:
        """New state, output rows, rows that wait on, and the next second at which time alone matters.

        ``rows`` are all that wait with times up to ``now_s``; none with such a time will follow.
        """
        raise NotImplementedError

    def over(self, rows: DataFrame, count: int = buckets.COUNT) -> DataFrame:
        """Output of rows with ``instance``, a watermark and the fields of ``ROW``."""
        names = [part.split()[0] for part in self.OUTPUT.split(", ")]
        fields = [part.split()[0] for part in self.ROW.split(", ")]

        def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
            # Of each instance: its state, the rows that wait, and the next second at which time alone matters.
            known = {instance: (tuple(kept), [tuple(r) for r in waiting], due) for instance, (kept, waiting, due) in buckets.load(state)}
            if not state.hasTimedOut:
                for pdf in batches:
                    columns = [pdf[c].astype(object).where(pdf[c].notna(), None).tolist() for c in ["instance", *fields]]
                    for instance, *row in zip(*columns):
                        if instance not in known:
                            known[instance] = (self.start(), [], None)
                        known[instance][1].append(tuple(row))
            watermark_ms = state.getCurrentWatermarkMs()
            now_s = watermark_ms // 1000
            out: list[tuple] = []
            wake = None
            for instance, (kept, waiting, deadline) in known.items():
                due = sorted((r for r in waiting if r[0] <= now_s), key=lambda r: tuple((v is None, v) for v in r))
                if due or (deadline is not None and deadline <= now_s):
                    kept, found, back, deadline = self.advance(instance, kept, due, now_s)
                    out += found
                    waiting = back + [r for r in waiting if r[0] > now_s]
                    known[instance] = (kept, waiting, deadline)
                later = [r[0] for r in waiting] + ([deadline] if deadline is not None else [])
                if later:
                    wake = min(later) if wake is None else min(wake, min(later))
            buckets.store(state, list(known.items()))
            if wake is not None:
                state.setTimeoutTimestamp(max(wake * 1000, watermark_ms + 1))
            yield pd.DataFrame(out, columns=names)

        return buckets.grouped(rows, count).applyInPandasWithState(run, self.OUTPUT, buckets.STATE, "append", "EventTimeTimeout")
