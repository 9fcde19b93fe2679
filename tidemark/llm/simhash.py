"""SimHash fingerprints and near duplicates by anchor-point covering.

A covering code places anchors in Hamming space so that every point lies within one
bit of an anchor. For a block of ``w`` bits the code is a perfect Hamming code on
``2^r - 1`` of them and every value of the rest. Two fingerprints within ``t`` bits
differ in at most ``t // blocks`` bits of at least one block; there, one of them is
within the covering radius 1 of its nearest anchor, and the other within
``1 + t // blocks`` of the same anchor. So each fingerprint is compared as a guest at every
anchor within that distance with the fingerprints at home there, and no link is lost.

Equal fingerprints are one row from the start, so copies cost nothing. At one anchor, links are
reduced to a spanning forest as they are found; neither all pairs of a dense group nor
its comparisons are ever stored.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tables import components, replaced
from tidemark.llm.texts import slices
from tidemark.session import materialize, sized

BITS = 64
SHINGLE = 4
MAX_BITS = 4
SEED = 42
HOME_ROWS = 2048  # fingerprints at home at an anchor before it is split
WIDE_FROM = 1 << 22  # distinct fingerprints from which wider blocks pay
SHARES = 32  # of the fingerprints of one group
PAIRS = 1 << 20  # comparisons made at once

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of one text as an unsigned number; zero without words.

    A-Z are lower-cased; a bit is set if over half of the shingles' hashes have it.
    """
    parts = (text or "").encode().translate(_LOWER).split()
    if not parts:
        return 0
    line = b" ".join(parts)
    if len(parts) <= shingle:
        return xxhash.xxh64_intdigest(line, SEED)
    length = np.fromiter(map(len, parts), np.int64, len(parts))
    stop = np.cumsum(length + 1) - 1
    start = (stop - length)[: len(parts) - shingle + 1].tolist()
    stop = stop[shingle - 1 :].tolist()
    votes = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for lo in range(0, len(start), 1 << 16):
        pairs = zip(start[lo : lo + (1 << 16)], stop[lo : lo + (1 << 16)])
        h = np.array([digest(line[a:b], SEED) for a, b in pairs], dtype="<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * votes > len(start)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id`` and ``fp`` (the 64 bits as a signed long) of every row; null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                fps = [fingerprint(t, shingle) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.array(fps, np.uint64).view(np.int64))],
                    ["doc_id", "fp"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, fp long"
    )


@dataclass(frozen=True)
class Block:
    """Covering code on bits ``[shift, shift + width)`` of a fingerprint."""

    shift: int
    width: int
    budget: int  # differing bits to allow for inside the block

    @property
    def checks(self) -> int:
        return (self.width + 1).bit_length() - 1

    def syndrome(self, values: np.ndarray) -> np.ndarray:
        """Xor of the numbers (from 1) of the set bits among the first ``2^r - 1``."""
        out = np.zeros(values.shape, np.uint64)
        for i in range((1 << self.checks) - 1):
            out ^= ((values >> np.uint64(i)) & np.uint64(1)) * np.uint64(i + 1)
        return out

    def part(self, fps: np.ndarray) -> np.ndarray:
        return (fps >> np.uint64(self.shift)) & np.uint64((1 << self.width) - 1)

    def home(self, fps: np.ndarray) -> np.ndarray:
        """Nearest anchor of each fingerprint's block: the bit that its syndrome names is flipped."""
        values = self.part(fps)
        s = self.syndrome(values)
        return values ^ np.where(s > 0, np.uint64(1) << (np.maximum(s, 1) - np.uint64(1)), np.uint64(0))

    def guests(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every anchor within radius plus budget: index of the fingerprint, anchor."""
        values = self.part(fps)
        by = _flips(self.width, 1 + self.budget)
        s = self.syndrome(values).astype(np.int64)
        count = np.array([len(f) for f in by])[s]
        row = np.repeat(np.arange(len(fps)), count)
        flat = np.concatenate(by)
        first = np.cumsum([0] + [len(f) for f in by])[:-1][s]
        step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        return row, values[row] ^ flat[np.repeat(first, count) + step]


@lru_cache
def _flips(width: int, most: int) -> list[np.ndarray]:
    """Sets of at most ``most`` flipped bits, by the syndrome that they cancel."""
    masks = np.array(
        [sum(1 << i for i in c) for k in range(most + 1) for c in combinations(range(width), k)],
        np.uint64,
    )
    code = Block(0, width, 0)
    s = code.syndrome(masks)
    return [masks[s == v] for v in range(1 << code.checks)]


def cover(blocks: int, max_bits: int = MAX_BITS) -> list[Block]:
    """Codes of equal blocks that together cover all links of up to ``max_bits`` bits."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    return [Block(a, b - a, max_bits // blocks) for a, b in zip(edges, edges[1:])]


def _first_shared(diff: np.ndarray, code: list[Block], own: np.ndarray) -> np.ndarray:
    """True where block ``own`` is the first whose difference keeps to its budget."""
    found = np.full(len(diff), len(code))
    for i in range(len(code) - 1, -1, -1):
        found[np.bitwise_count(code[i].part(diff)) <= code[i].budget] = i
    return found == own


def forest(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges that join the same values as the pairs ``x``-``y`` do, one fewer than values."""
    nodes, ends = np.unique(np.concatenate([x, y]), return_inverse=True)
    a, b = ends[: len(x)], ends[len(x) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            next_ = new[new]
            if np.array_equal(next_, new):
                break
            new = next_
        if np.array_equal(new, label):
            break
        label = new
    child = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[child], nodes[label[child]]


def links(fps: DataFrame, max_bits: int = MAX_BITS, blocks: int | None = None) -> DataFrame:
    """Links of distinct fingerprints (column ``fp``): ``a``, ``b``, connecting exactly what is near.

    Every returned row joins two fingerprints of one component. A batch that finds few links
    returns them all, one that finds many a spanning forest of them.
    ``blocks`` is 3, or 2 from ``WIDE_FROM`` fingerprints: longer codes have more
    anchors to spread larger inputs over. Both give the same components.
    """
    if blocks is None:
        blocks = 2 if fps.count() >= WIDE_FROM else 3
    code = cover(blocks, max_bits)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = np.asarray(batch.column("fp")).view(np.uint64)
            for lo in range(0, len(every), 1 << 14):
                x = every[lo : lo + (1 << 14)]
                for i, block in enumerate(code):
                    row, near = block.guests(x)
                    anchor = np.concatenate([block.home(x), near]) | np.uint64(i << 60)
                    guest = np.repeat([False, True], [len(x), len(row)])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(anchor.view(np.int64)),
                            pa.array(guest),
                            pa.array(np.concatenate([x, x[row]]).view(np.int64)),
                        ],
                        ["anchor", "guest", "fp"],
                    )

    placed = fps.select("fp").mapInArrow(place, "anchor long, guest boolean, fp long")
    crowded = (
        placed.where("not guest").groupBy("anchor").count().where(F.col("count") > HOME_ROWS)
        .select("anchor", F.ceil(F.col("count") / HOME_ROWS).cast("int").alias("shares"))
    )
    crowded = materialize(crowded, "anchors")
    placed = placed.withColumn("share", F.lit(0))
    if crowded.limit(1).count():
        # Homes of a crowded anchor are dealt over shares; its guests visit each share.
        share = F.pmod(F.xxhash64("fp"), F.col("shares")).cast("int")
        placed = (
            placed.drop("share").join(crowded, "anchor", "left")
            .withColumn("shares", F.coalesce("shares", F.lit(1)))
            .withColumn("share", F.explode(
                F.when(F.col("guest"), F.sequence(F.lit(0), F.col("shares") - 1)).otherwise(F.array(share))
            ))
        )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.uint64)
        held_key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor = np.asarray(batch.column("anchor")).view(np.uint64)
            share = np.asarray(batch.column("share"))
            guest = np.asarray(batch.column("guest").cast(pa.int8())).astype(bool)
            fp = np.asarray(batch.column("fp")).view(np.uint64)
            new = np.r_[True, (anchor[1:] != anchor[:-1]) | (share[1:] != share[:-1])]
            run = np.cumsum(new) - 1
            heads = np.flatnonzero(new)
            if held_key != (anchor[0], share[0]):
                held = held[:0]
            homes = np.concatenate([held, fp[~guest]])
            size = np.bincount(run[~guest], minlength=len(heads))
            size[0] += len(held)
            first = np.cumsum(size) - size
            rows = np.flatnonzero(guest)
            each = size[run[rows]]
            yield from pairs(code, max_bits, fp[rows], (anchor[rows] >> np.uint64(60)).astype(np.int64),
                             homes, first[run[rows]], each)
            held_key = (anchor[-1], share[-1])
            held = homes[first[-1] : first[-1] + size[-1]]

    return (
        placed.repartition("anchor", "share")
        .sortWithinPartitions("anchor", "share", "guest")
        .mapInArrow(compare, "a long, b long")
    )


def pairs(code, max_bits, guests, own, homes, first, each) -> Iterator[pa.RecordBatch]:
    """Compare guest i with ``homes[first[i] : first[i] + each[i]]``; yield links or their forest."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    ends = np.cumsum(each)
    total, lo = int(ends[-1]) if len(ends) else 0, 0
    while lo < total:
        hi = min(lo + PAIRS, total)
        number = np.arange(lo, hi)
        i = np.searchsorted(ends, number, side="right")
        x, y = guests[i], homes[first[i] + number - (ends[i] - each[i])]
        diff = x ^ y
        near = (x < y) & (np.bitwise_count(diff) <= max_bits)
        x, y, diff, i = x[near], y[near], diff[near], i[near]
        once = _first_shared(diff, code, own[i])
        found.append((x[once], y[once]))
        held += int(once.sum())
        if held > PAIRS:
            found = [forest(*map(np.concatenate, zip(*found)))]
            held = len(found[0][0])
        lo = hi
    if held:
        a, b = map(np.concatenate, zip(*found))
        if held > 2 * len(guests) or held > 1 << 14:
            a, b = forest(a, b)
        yield pa.RecordBatch.from_arrays(
            [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"]
        )


def near_groups(docs: DataFrame, max_bits: int = MAX_BITS, shingle: int = SHINGLE) -> DataFrame:
    """Near-duplicate groups of ``docs(doc_id, text)``: one row per row of ``docs``.

    Columns ``doc_id``, ``fp`` (signed long) and ``component_id``, the smallest ``doc_id``
    reachable over links of at most ``max_bits`` differing bits. A text without words
    has fingerprint zero and links like any other. Null ``doc_id`` never names a group
    unless all its members are null. Empty input gives no rows.
    """
    marked = materialize(fingerprints(docs, shingle), "fingerprints")
    distinct = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    roots = components(links(distinct, max_bits)).withColumnRenamed("node", "fp")
    # Only fingerprints with a link need their group's smallest id; those of a large group are
    # dealt over shares.
    linked = roots.hint("merge").join(distinct, "fp").withColumn("share", F.pmod(F.xxhash64("fp"), F.lit(SHARES)))
    lowest = linked.groupBy("root").agg(F.min("low").alias("component_id")).withColumn(
        "share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SHARES - 1).cast("long")))
    )
    named = linked.join(lowest.hint("merge"), ["root", "share"]).select("fp", "component_id")
    by_fp = distinct.join(named.hint("merge"), "fp", "left").select(
        "fp", F.coalesce("component_id", "low").alias("component_id")
    )
    # Copies of one text may be a third of all rows: written first, so that this join is free to split them.
    return marked.join(materialize(by_fp, "named").hint("merge"), "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, max_bits: int = MAX_BITS, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with the rows of the smallest ``doc_id`` of each group; columns unchanged.

    The ids to drop are few, so they are joined and not the ids to keep. Rows of equal ``doc_id``,
    and rows without one, stay or go together, and stay if one of them is first in its group.
    """
    first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    judged = near_groups(docs, max_bits, shingle).groupBy("doc_id").agg(F.max(first).alias("first"))
    dropped = materialize(judged.where("not first").select(F.col("doc_id").alias("_dropped")), "dropped")
    return docs.join(sized(dropped), docs["doc_id"].cast("long").eqNullSafe(F.col("_dropped")), "left_anti")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Contract of the registered query: ``doc_id``, ``fingerprint`` (hex), ``component_id``.

    One row per row of ``docs``, repeated ones alike. Null and empty texts have fingerprint zero and link like any
    other; a null ``doc_id`` names a group only if all its ids are null. Empty input gives no rows.
    """
    return replaced(
        near_groups(docs).select("doc_id", "fp", "component_id"),
        fingerprint=F.lower(F.lpad(F.hex("fp"), 16, "0")),
    ).select("doc_id", "fingerprint", "component_id")
