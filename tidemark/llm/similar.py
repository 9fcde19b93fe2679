"""Near duplicates at a similarity of 0.8 by wide SimHash fingerprints and anchor points.

For two texts of similarity ``s`` (of their sets of shingles), about ``acos(2s / (1 + s)) / pi`` of the bits
of their fingerprints differ: 15 in 100 at 0.8. Sixty-four bits tell this too coarsely, so a fingerprint has
four lanes of 64 here, and a link is a difference of ``MAX_BITS`` of the 256 at most. Covering that
radius in full would take thousands of anchors a text. Instead the bits are put in several orders and cut
into blocks; in each block the anchors are a Hamming code with covering radius 1, and every
fingerprint goes to the anchor nearest to it. Fingerprints that share an anchor are compared in full.
One order alone brings any two together that differ in fewer bits than it has blocks; the other orders raise
the chance of wider pairs.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.simhash import PAIRS, SEED, Block, forest
from tidemark.llm.tables import components
from tidemark.llm.texts import slices, stir
from tidemark.session import materialize, sized

SHINGLE = 5
LANES = 4
BITS = 64 * LANES
MAX_BITS = 46  # of BITS: a similarity of about 0.8
WIDTH = 21  # bits of a block
ORDERS = 4
HOME_ROWS = 2048  # fingerprints at an anchor before it is split
SHARES = 32

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_LANE = np.array([0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_NAMES = [f"lane{i}" for i in range(LANES)]


def fingerprint(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The lanes of one text; zeros without words. A-Z are lower-cased; fewer words than a shingle are one."""
    parts = (text or "").encode().translate(_LOWER).split()
    if not parts:
        return np.zeros(LANES, np.uint64)
    line = b" ".join(parts)
    length = np.fromiter(map(len, parts), np.int64, len(parts))
    stop = np.cumsum(length + 1) - 1
    start = stop - length
    shingle = min(shingle, len(parts))
    start, stop = start[: len(parts) - shingle + 1].tolist(), stop[shingle - 1 :].tolist()
    votes = np.zeros((LANES, 64), np.int64)
    digest = xxhash.xxh64_intdigest
    for lo in range(0, len(start), 1 << 14):
        pairs = zip(start[lo : lo + (1 << 14)], stop[lo : lo + (1 << 14)])
        h = np.array([digest(line[a:b], SEED) for a, b in pairs], np.uint64)
        for lane in range(LANES):
            mixed = stir(h ^ _LANE[lane]) if lane else h
            bits = np.unpackbits(mixed.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            votes[lane] += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(2 * votes > len(start), axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id`` and the lanes (as signed longs) of every row; null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                lanes = np.array([fingerprint(t, shingle) for t in part.column("text").to_pylist()], np.uint64)
                lanes = lanes.reshape(-1, LANES).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *[pa.array(lanes[:, i]) for i in range(LANES)]], ["doc_id", *_NAMES]
                )

    read = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return read.mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in _NAMES))


def anchors(lanes: np.ndarray, orders: int = ORDERS, width: int = WIDTH) -> np.ndarray:
    """Anchor of every fingerprint (rows of ``lanes``) in every block of every order: one column each."""
    bits = np.unpackbits(lanes.astype("<u8").view(np.uint8).reshape(len(lanes), -1), axis=1, bitorder="little")
    rng = np.random.default_rng(20240601)
    code = Block(0, width, 0)
    weights = np.uint64(1) << np.arange(width, dtype=np.uint64)
    out = []
    for _ in range(orders):
        turned = bits[:, rng.permutation(BITS)]
        for lo in range(0, BITS - width + 1, width):
            values = (turned[:, lo : lo + width] * weights).sum(axis=1, dtype=np.uint64)
            out.append(code.home(values) | np.uint64(len(out) << width))
    return np.stack(out, axis=1) if len(lanes) else np.zeros((0, orders * (BITS // width)), np.uint64)


def differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)


def _lanes(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([np.asarray(batch.column(n)) for n in _NAMES], axis=1).view(np.uint64)


def links(prints: DataFrame, max_bits: int = MAX_BITS, orders: int = ORDERS, home_rows: int = HOME_ROWS) -> DataFrame:
    """Links ``a``, ``b`` (nodes) of distinct fingerprints ``prints(node, lanes)`` that share an anchor and are near.

    Where many are found, a spanning forest of the links of a batch stands for them.
    """

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1 << 12):
                part = batch.slice(lo, 1 << 12)
                at = anchors(_lanes(part), orders)
                row = np.repeat(np.arange(at.shape[0]), at.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at.ravel().view(np.int64)), *[part.column(n).take(pa.array(row)) for n in ("node", *_NAMES)]],
                    ["anchor", "node", *_NAMES],
                )

    lane_schema = ", ".join(f"{n} long" for n in _NAMES)
    placed = prints.select("node", *_NAMES).mapInArrow(place, f"anchor long, node long, {lane_schema}")
    crowded = placed.groupBy("anchor").count().where(F.col("count") > home_rows).select(
        "anchor", F.ceil(F.col("count") / home_rows).cast("int").alias("shares")
    )
    crowded = materialize(crowded, "crowded")
    # Kind 0: compared with the rows before it; 1 and 2: at home in a share of a crowded anchor, and visiting each share.
    alone = placed.withColumn("share", F.lit(0)).withColumn("kind", F.lit(0))
    if crowded.limit(1).count():
        own = F.pmod(F.xxhash64("node"), F.col("shares")).cast("int")
        home = F.array(F.struct(own.alias("share"), F.lit(1).alias("kind")))
        guest = F.transform(F.sequence(F.lit(0), F.col("shares") - 1), lambda s: F.struct(s.alias("share"), F.lit(2).alias("kind")))
        single = F.array(F.struct(F.lit(0).alias("share"), F.lit(0).alias("kind")))
        alone = (
            placed.join(sized(crowded), "anchor", "left")
            .withColumn("at", F.explode(F.when(F.col("shares").isNull(), single).otherwise(F.concat(home, guest))))
            .select("anchor", "node", *_NAMES, "at.share", "at.kind")
        )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, LANES), np.uint64)
        held_node = np.zeros(0, np.int64)
        held_key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor, share, kind, node = (np.asarray(batch.column(n)) for n in ("anchor", "share", "kind", "node"))
            lanes = _lanes(batch)
            new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (share[1:] != share[:-1])])
            if held_key != (anchor[0], share[0]):
                held, held_node = held[:0], held_node[:0]
            homes = kind < 2
            all_lanes = np.concatenate([held, lanes[homes]])
            all_nodes = np.concatenate([held_node, node[homes]])
            # Homes before each row, and where those of its group begin.
            before = len(held) + np.cumsum(homes) - homes
            heads = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            start = before[heads]
            start[0] = 0
            first = start[group]
            each = np.where(kind == 1, 0, before - first)
            yield from _near(lanes, node, all_lanes, all_nodes, first, each, max_bits)
            held_key = (anchor[-1], share[-1])
            held, held_node = all_lanes[start[-1] :], all_nodes[start[-1] :]

    return (
        alone.repartition("anchor", "share").sortWithinPartitions("anchor", "share", "kind").mapInArrow(compare, "a long, b long")
    )


def _near(lanes, node, homes, home_node, first, each, max_bits: int) -> Iterator[pa.RecordBatch]:
    """Compare row i with ``homes[first[i] : first[i] + each[i]]``; yield links or their forest."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    ends = np.cumsum(each)
    total, count = int(ends[-1]), 0
    for lo in range(0, total, PAIRS // LANES):
        number = np.arange(lo, min(lo + PAIRS // LANES, total))
        i = np.searchsorted(ends, number, side="right")
        j = first[i] + number - (ends[i] - each[i])
        # The first lane alone settles most comparisons.
        close = np.bitwise_count(lanes[i, 0] ^ homes[j, 0]) <= max_bits
        i, j = i[close], j[close]
        near = (differing(lanes[i], homes[j]) <= max_bits) & (node[i] != home_node[j])
        found.append((node[i[near]], home_node[j[near]]))
        count += int(near.sum())
        if count > PAIRS:
            found = [_forest(found)]
            count = len(found[0][0])
    if count:
        a, b = _forest(found)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _forest(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return forest(*map(np.concatenate, zip(*found)))


def near_groups(docs: DataFrame, max_bits: int = MAX_BITS, shingle: int = SHINGLE, orders: int = ORDERS) -> DataFrame:
    """Group of every row of ``docs(doc_id, text)``: ``doc_id`` and ``component_id``, the smallest id reachable over links.

    Texts without words have one fingerprint and form a group. A null ``doc_id`` names a group only if all its
    ids are null. Rows that repeat are in one group. Empty input gives no rows.
    """
    node = F.xxhash64(*_NAMES)
    marked = materialize(fingerprints(docs, shingle).withColumn("node", node), "fingerprints")
    distinct = materialize(marked.groupBy("node", *_NAMES).agg(F.min("doc_id").alias("low")), "distinct")
    salt = 0
    while distinct.groupBy("node").count().where("count > 1").limit(1).count():
        # Two fingerprints of one number: number them anew.
        salt += 1
        fresh = F.xxhash64(F.lit(salt), *_NAMES)
        marked, distinct = (materialize(t.withColumn("node", fresh), "numbered") for t in (marked, distinct))
    roots = components(links(distinct, max_bits, orders))
    linked = materialize(
        distinct.select("node", "low").join(roots.hint("merge"), "node").withColumn("share", F.pmod(F.xxhash64("node"), F.lit(SHARES))),
        "linked",
    )
    lowest = linked.groupBy("root").agg(F.min("low").alias("component_id")).withColumn(
        "share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SHARES - 1).cast("long")))
    )
    named = linked.join(lowest.hint("merge"), ["root", "share"]).select("node", "component_id")
    by_node = distinct.select("node", "low").join(named.hint("merge"), "node", "left").select(
        "node", F.coalesce("component_id", "low").alias("component_id")
    )
    by_node = materialize(by_node, "named")
    # Copies of one text may be a third of all rows: this join must be free to split them.
    return marked.select("doc_id", "node").join(by_node.hint("merge"), "node").select("doc_id", "component_id")


def keep_first(docs: DataFrame, max_bits: int = MAX_BITS, shingle: int = SHINGLE, orders: int = ORDERS) -> DataFrame:
    """``docs`` with the rows of the smallest ``doc_id`` of each group; columns unchanged.

    The ids to drop are few, so they are joined and not the ids to keep. Rows of equal ``doc_id``,
    and rows without one, stay or go together, and stay if one of them is first in its group.
    """
    first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    judged = near_groups(docs, max_bits, shingle, orders).groupBy("doc_id").agg(F.max(first).alias("first"))
    dropped = materialize(judged.where("not first").select(F.col("doc_id").alias("_dropped")), "dropped")
    return docs.join(sized(dropped), docs["doc_id"].cast("long").eqNullSafe(F.col("_dropped")), "left_anti")
