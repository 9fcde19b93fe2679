"""Only strictly newer generations pass; a changed content is flagged."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators import ordered

OUTPUT = "namespace STRING, obs BIGINT, seq DECIMAL(20,0), manifest STRING, verdict STRING"
NAMES = ["namespace", "obs", "seq", "manifest", "verdict"]


def verdicts(
    top: int, content: str | None, seq: np.ndarray, manifest: np.ndarray
) -> tuple[np.ndarray, int, str | None]:
    """Verdict on each observation in order, and the highest sequence with its content.

    A running maximum finds the highest sequence before each observation, and the content
    first seen with it.
    """
    highest = np.maximum.accumulate(np.concatenate([np.array([top], np.uint64), seq]))
    newer = seq > highest[:-1]
    place = np.arange(1, len(seq) + 1)
    leader = np.maximum.accumulate(np.where(newer, place, 0))
    contents = np.concatenate([np.array([content], object), manifest])
    same = contents[leader] == manifest
    out = np.select(
        [newer, seq < highest[1:], same], ["newer", "regressed", "unchanged"], "changed_at_same_sequence"
    )
    return out, int(highest[-1]), contents[leader[-1]]


class Guard(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self._top = handle.getValueState("top", "seq STRING, manifest STRING")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        top, content = self._top.get() if self._top.exists() else ("0", None)
        # The observations of one micro-batch, in the order they were made.
        pdf = pd.concat(list(rows)).sort_values("obs", kind="stable")
        seq = np.array([int(s) for s in pdf["seq"]], np.uint64)
        found, top, content = verdicts(int(top), content, seq, pdf["manifest"].to_numpy(dtype=object))
        yield pdf.assign(verdict=found)[NAMES]
        self._top.update((str(top), content))

    def close(self) -> None:
        pass


def generation_guard(stream: DataFrame) -> DataFrame:
    """Verdict on each observed generation; needs the RocksDB state store provider.

    Pass on the rows whose verdict is ``newer``. Observations of a namespace are
    expected in order between micro-batches; inside one they are sorted, so the
    source's trigger limit (``maxFilesPerTrigger``) bounds what a task sorts. Sequences are
    unsigned 64-bit numbers.
    """
    return (
        stream.select(
            F.col("namespace").cast("string"), "obs", F.col("seq").cast("decimal(20,0)"), "manifest"
        )
        .groupBy("namespace")
        .transformWithStateInPandas(Guard(), OUTPUT, "append", "none")
    )


def generation_guard_batch(seen: DataFrame, width: int = ordered.RECORDS) -> DataFrame:
    """The same verdicts for a table of observations, one for each ``obs`` of a namespace.

    The highest earlier sequence and the content first seen with it are a running maximum in
    slices of ``width`` observations, so no task holds a whole namespace.
    """
    rows = seen.select(
        F.col("namespace").cast("string"), "obs", F.col("seq").cast("decimal(20,0)"), "manifest"
    )
    # Of equal sequences the first observation is the largest.
    leader = F.struct("seq", (-F.col("obs")).alias("first"), "manifest")
    known = ordered.with_running_max(rows, ["namespace"], ["obs"], leader, width, "leader")
    top = F.coalesce(F.col("leader")["seq"], F.lit(0).cast("decimal(20,0)"))
    content = F.col("leader")["manifest"]
    verdict = (
        F.when(F.col("seq") > top, "newer").when(F.col("seq") < top, "regressed")
        .when(F.col("manifest").eqNullSafe(content), "unchanged").otherwise("changed_at_same_sequence")
    )
    return known.select("namespace", "obs", "seq", "manifest", verdict.alias("verdict"))
