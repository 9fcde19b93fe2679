"""Best-two-fit packing of tokenised documents into sequences of fixed length.

Whether a piece fits depends on its length only, so the plan is made on the histogram of
lengths: at most one count per length up to the capacity, whatever the size of the corpus. The
planner fills a sequence greedily, longest piece first, then takes out its
smallest piece if two unpacked ones fill the widened gap more tightly, and repeats
the pattern as often as its lengths last. Pieces find their place by their rank
among those of equal length, which is a local rank within a task plus the counts of
the tasks before it.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.bpe import Encoder, default_path
from tidemark.llm.texts import slices
from tidemark.session import materialize

CAPACITY = 2048
SLICE_BYTES = 2 << 20  # of texts that are encoded at once: smaller ones cost no more time, and less memory
END_ID = 0
PIECES = (
    "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
)


def cut(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of every row of ``docs(doc_id, text)``: its ids and the end id, cut at ``capacity``.

    ``part`` and ``nth`` number the pieces of equal length within the writing task. A null or empty
    text is one piece with the end id alone. The result is stored, so the numbers don't change.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                ids, first = encoder(part.column("text"))
                n = part.num_rows
                ends = first[1:] + np.arange(1, n + 1)  # each text's ids and its end id
                row = np.zeros(n + len(ids), "<u4")
                body = np.ones(len(row), bool)
                body[ends - 1] = False
                row[body], row[ends - 1] = ids, END_ID
                total = np.diff(np.concatenate([[0], ends]))
                count = -(-total // capacity)
                doc = np.repeat(np.arange(n), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                length = np.minimum(total[doc] - start, capacity)
                begin = (ends - total)[doc] + start
                raw = row.tobytes()
                view = memoryview(raw)
                crc = [zlib.crc32(view[4 * a : 4 * (a + k)]) for a, k in zip(begin.tolist(), length.tolist())]
                order = np.argsort(length, kind="stable")
                of = length[order]
                head = np.searchsorted(of, of)
                nth = np.empty(len(of), np.int64)
                nth[order] = seen[of] + np.arange(len(of)) - head
                seen += np.bincount(length, minlength=capacity + 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array(doc)),
                        pa.array(piece.astype(np.int32)),
                        pa.array(start),
                        pa.array(length),
                        pa.array(np.array(crc, np.int64)),
                        pa.array(np.full(len(doc), task, np.int32)),
                        pa.array(nth),
                    ],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"],
                )

    read = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return materialize(read.mapInArrow(run, PIECES), "pieces")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """Patterns as (copies, lengths) that use up ``counts`` (pieces by length)."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    out: list[tuple[int, list[int]]] = []
    while left.any():
        fill = _fill(left, capacity)
        lengths, uses = np.unique(fill, return_counts=True)
        copies = int((left[lengths] // uses).min())
        left[lengths] -= copies * uses
        out.append((copies, fill))
    return out


def _fill(left: np.ndarray, capacity: int) -> list[int]:
    """One sequence: greedy, then one exchange of its smallest piece for two."""
    free = left.copy()
    fill: list[int] = []
    gap = capacity
    while True:
        fitting = np.flatnonzero(free[: gap + 1])
        if not len(fitting):
            break
        best = int(fitting[-1])
        # As many of this length as fit and are there.
        n = min(gap // best, int(free[best]))
        fill += [best] * n
        free[best] -= n
        gap -= n * best
    if gap and len(fill) > 1:
        smallest = fill[-1]
        free[smallest] += 1
        pair = _two(free, gap + smallest)
        if sum(pair) > smallest:
            fill = fill[:-1] + sorted(pair, reverse=True)
    return fill


def _two(free: np.ndarray, room: int) -> list[int]:
    """Two free pieces, the first not shorter, whose sum comes closest to ``room`` from below."""
    have = np.flatnonzero(free[: room + 1])
    if not len(have):
        return []
    upto = np.zeros(room + 1, np.int64)  # longest free piece up to each length
    upto[have] = have
    upto = np.maximum.accumulate(upto)
    single = have[free[have] < 2]
    other = np.minimum(room - have, have)
    second = upto[other]
    # A length that is there once cannot be both; the next shorter one then.
    clash = np.isin(have, single) & (second == have)
    second[clash] = upto[np.maximum(have[clash] - 1, 0)]
    total = np.where(second > 0, have + second, 0)
    i = int(np.argmax(total))
    return [int(have[i]), int(second[i])] if total[i] else []


def slots(patterns: list[tuple[int, list[int]]]) -> dict[str, np.ndarray]:
    """Where the pieces of each length go, by rank: sorted by ``length`` and ``rank``."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for copies, fill in patterns:
        offset = 0
        for length in fill:
            rank = used.get(length, 0)
            rows.append((length, rank, sequence, offset))
            used[length] = rank + copies
            offset += length
        sequence += copies
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return dict(zip(("length", "rank", "sequence", "offset"), table.T))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to stored pieces; ``part`` and ``nth`` go.

    ``pieces`` must be a stored table: it is read three times.
    """
    spark = pieces.sparkSession
    by_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = {r.length: r.n for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = spark.sparkContext.broadcast(slots(plan(counts, capacity)))
    before = F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")
    bases = by_part.select(
        F.col("part").alias("_part"), F.col("length").alias("_length"), before.alias("_before")
    )
    ranked = pieces.join(
        bases, (F.col("part") == F.col("_part")) & (F.col("length") == F.col("_length"))
    ).withColumn("rank", F.col("nth") + F.col("_before")).drop("part", "nth", "_part", "_length", "_before")
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = table.value
        key = (s["length"] << 48) | s["rank"]
        for batch in batches:
            rank = np.asarray(batch.column("rank"))
            at = np.searchsorted(key, (np.asarray(batch.column("length")) << 48) | rank, side="right") - 1
            names = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(n) for n in names],
                    pa.array(s["sequence"][at] + rank - s["rank"][at]),
                    pa.array(s["offset"][at]),
                ],
                [*names, "sequence_id", "offset"],
            )

    return ranked.mapInArrow(run, f"{out}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Contract of the registered query: one row per piece with its place.

    Repeated rows are packed as often as they occur. Empty input gives no rows.
    """
    return pack(cut(docs, path, capacity), capacity)
