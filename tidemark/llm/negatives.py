"""Hard negatives by bounds along spanning trees of anchors.

Anchors of one label that lie near each other form a minimum spanning tree of bounded size. For a
candidate ``x``, the scores at two anchors differ by at most the length of the edge between them times
the norm of ``x``. So a task scores its candidates at the root of a tree in full and carries an interval for each
candidate down the edges; only where an interval overlaps what is still wanted at an anchor (its best positives,
or the windows below their scores) the candidate is scored again, and its interval shrinks to that score.

Two scans of the candidates answer all anchors: the first finds the positives, the second the negatives in
their windows. A task keeps the best rows of each anchor and hands on only these. Anchors are a stated query set; they
are sent to the tasks in waves of bounded bytes, as many as it takes.
"""

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.session import materialize

POSITIVES = 5
NEGATIVES = 5
LEAST_PERCENT = 80  # of a positive's score that a negative must reach
LEVELS = 256  # a component x becomes floor(LEVELS * x)
LARGEST = 1 << 28  # components are held within this, so that scores fit a long
TREE_ROWS = 512  # anchors of one tree
CODE_BITS = 16
WAVE_BYTES = 32 << 20  # of the anchors sent to tasks at once
SLICE_ROWS, SLICE_VALUES = 4096, 1 << 20
NO_ID = np.iinfo(np.int64).max  # stands for a null id, which comes last


def rounded(vectors: DataFrame) -> DataFrame:
    """``vec_id``, ``label`` and integer components ``v`` of the rows that take part.

    Rows with a null label or vector, or any null or non-finite component, take no part.
    """
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    level = lambda x: F.floor(F.least(F.greatest(x.cast("double") * LEVELS, F.lit(float(-LARGEST))), F.lit(float(LARGEST))))
    return vectors.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & whole).select(
        F.coalesce(F.col("vec_id").cast("long"), F.lit(int(NO_ID))).alias("vec_id"), F.col("label").cast("long"),
        F.transform("embedding", lambda x: level(x).cast("int")).alias("v"),
    )


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and components of the rows of each length, in slices of bounded size."""
    column = batch.column("v")
    flat = np.asarray(column.flatten())
    size = np.asarray(column.value_lengths()).astype(np.int64)
    start = np.cumsum(size) - size
    for width in np.unique(size).tolist():
        rows = np.flatnonzero(size == width)
        step = max(1, min(SLICE_ROWS, SLICE_VALUES // max(width, 1)))
        for lo in range(0, len(rows), step):
            part = rows[lo : lo + step]
            yield part, flat[start[part][:, None] + np.arange(width)]


def spanning_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimum spanning tree of the rows of ``x``: their order from the root, places of parents in it, lengths of edges."""
    x = x.astype(np.float64)
    norms = (x * x).sum(axis=1)
    root = int(np.argmin(((x - x.mean(axis=0)) ** 2).sum(axis=1))) if len(x) else 0
    best = np.full(len(x), np.inf)
    best[root] = 0
    from_ = np.full(len(x), -1)
    out = np.zeros(len(x), bool)
    order, parent, length = [], [], []
    for n in range(len(x)):
        i = int(np.argmin(np.where(out, np.inf, best)))
        out[i] = True
        order.append(i)
        parent.append(from_[i])
        length.append(float(np.sqrt(((x[i] - x[order[from_[i]]]) ** 2).sum())) if n else 0.0)
        near = norms + norms[i] - 2 * (x @ x[i])
        closer = (near < best) & ~out
        best[closer], from_[closer] = near[closer], n
    return np.array(order, np.int64), np.array(parent, np.int64), np.array(length)


def trees(anchors: DataFrame) -> DataFrame:
    """Spanning trees of at most ``TREE_ROWS`` anchors of one label and length each.

    Columns ``tree``, ``label``, ``width``, ``ids``, ``parents``, ``lengths`` and ``components`` (32-bit integers, row by row).
    Anchors near each other come together by the signs of their projections; a label, or copies of
    one vector, that hold a third of all anchors are many trees.
    """

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = np.zeros(batch.num_rows, np.int64)
            for rows, x in _matrices(batch):
                planes = np.random.default_rng(x.shape[1]).normal(size=(x.shape[1], CODE_BITS))
                code[rows] = (x @ planes > 0) @ (1 << np.arange(CODE_BITS))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code)], [*batch.schema.names, "code"])

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            for row in range(0, batch.num_rows, TREE_ROWS):
                held.append(pa.table(batch.slice(row, TREE_ROWS)))
                table = pa.concat_tables(held)
                kinds = np.stack([np.asarray(table.column("label")), np.asarray(table.column("width"))])
                edge = np.flatnonzero((kinds[:, 1:] != kinds[:, :-1]).any(axis=0)) + 1
                # All but the last run of a label and length are complete; that one waits for its rest.
                last = int(edge[-1]) if len(edge) else 0
                cuts = [0, *edge.tolist()]
                for a, b in zip(cuts, cuts[1:]):
                    yield from _grown(table.slice(a, b - a))
                while table.num_rows - last >= TREE_ROWS:
                    yield from _grown(table.slice(last, TREE_ROWS))
                    last += TREE_ROWS
                held = [table.slice(last)]
        if held:
            yield from _grown(pa.concat_tables(held))

    wide = anchors.withColumn("width", F.size("v"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in wide.schema)
    near = wide.mapInArrow(coded, f"{schema}, code long")
    parts = -(-anchors.count() // TREE_ROWS) or 1
    placed = near.repartitionByRange(parts, "label", "width", "code", "vec_id").sortWithinPartitions(
        "label", "width", "code", "vec_id"
    )
    made = placed.mapInArrow(
        grown, "label long, width int, ids array<long>, parents array<int>, lengths array<double>, components binary"
    )
    return made.withColumn("tree", F.monotonically_increasing_id())


def _grown(table: pa.Table) -> Iterator[pa.RecordBatch]:
    for lo in range(0, table.num_rows, TREE_ROWS):
        part = table.slice(lo, TREE_ROWS).combine_chunks()
        width = part.column("width")[0].as_py()
        values = part.column("v").combine_chunks()
        x = np.asarray(values.flatten()).reshape(part.num_rows, width)
        order, parent, length = spanning_tree(x)
        yield pa.RecordBatch.from_pylist(
            [{
                "label": part.column("label")[0].as_py(), "width": width,
                "ids": np.asarray(part.column("vec_id"))[order].tolist(), "parents": parent.tolist(),
                "lengths": length.tolist(), "components": x[order].astype("<i4").tobytes(),
            }],
            schema=pa.schema([
                ("label", pa.int64()), ("width", pa.int32()), ("ids", pa.list_(pa.int64())), ("parents", pa.list_(pa.int32())),
                ("lengths", pa.list_(pa.float64())), ("components", pa.binary()),
            ]),
        )


@dataclass
class Best:
    """Best rows by score, then id, of those offered."""

    most: int
    scores: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    @property
    def least(self) -> float:
        """Score that a row must reach to matter."""
        return float(self.scores[-1]) if len(self.scores) >= self.most else -np.inf

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(scores):
            return
        if len(self.scores) >= self.most:
            near = scores >= self.scores[-1]
            scores, ids = scores[near], ids[near]
            if not len(scores):
                return
        s, i = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((i, -s))[: self.most]
        self.scores, self.ids = s[order], i[order]


class Tree:
    """A tree of anchors with what each still wants; ``windows`` is None while positives are sought."""

    def __init__(self, row: dict, positives: int, negatives: int, percent: int):
        self.number, self.label = row["tree"], row["label"]
        self.ids, self.parents = np.array(row["ids"], np.int64), row["parents"]
        self.lengths = row["lengths"]
        self.x = np.frombuffer(row["components"], "<i4").reshape(len(self.ids), row["width"]).astype(np.int64)
        # Edges may only seem longer: rounding must not lose a candidate.
        self.lengths = [d * (1 + 1e-9) + 1e-9 for d in self.lengths]
        self.largest = int(np.abs(self.x).max(initial=0))
        if "found" not in row:
            self.windows = None
            self.best = [[Best(positives)] for _ in self.ids]
            return
        self.windows = [[] for _ in self.ids]
        self.best = [[] for _ in self.ids]
        for node, place, score in sorted((f["node"], f["place"], f["score"]) for f in row["found"]):
            self.windows[node].append((place, -(-percent * score // 100), score))
            self.best[node].append(Best(negatives))

    def visit(self, x: np.ndarray, ids: np.ndarray) -> int:
        """Offer candidates to every anchor; the number of scores that it took."""
        width = min(x.shape[1], self.x.shape[1])
        exact = float(np.abs(x).max(initial=0)) * self.largest * max(width, 1) < 2**53
        kind = np.float64 if exact else np.int64
        x, anchors = x[:, :width].astype(kind), self.x[:, :width].astype(kind)
        norms = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
        middle = np.empty((len(self.ids), len(ids)))
        spread = np.zeros_like(middle)
        scored = 0
        for node, (parent, length) in enumerate(zip(self.parents, self.lengths)):
            if parent < 0:
                rows = np.arange(len(ids))
            else:
                middle[node] = middle[parent]
                spread[node] = spread[parent] + length * norms
                rows = np.flatnonzero(self.wanted(node, middle[node], spread[node], x, anchors, ids))
            if not len(rows):
                continue
            scores = x[rows] @ anchors[node] if len(rows) < len(ids) else x @ anchors[node]
            scored += len(rows)
            middle[node][rows], spread[node][rows] = scores, 0
            self.offer(node, scores.astype(np.int64), ids[rows])
        return scored

    def wanted(self, node, middle, spread, x, anchors, ids) -> np.ndarray:
        slack = spread + 1e-9 * np.abs(middle) + 1e-6
        if self.windows is None:
            best = self.best[node][0]
            least = best.least
            if least == -np.inf and len(ids) > 2 * best.most:
                # The parent's best rows show early how good a row must be.
                few = np.argpartition(-middle, best.most)[: best.most + 1]
                few = few[ids[few] != self.ids[node]]
                if len(few) >= best.most:
                    least = float(np.sort(x[few] @ anchors[node])[-best.most])
            return middle + slack >= least
        out = np.zeros(len(ids), bool)
        for (_, low, high), best in zip(self.windows[node], self.best[node]):
            if low <= high:
                out |= (middle + slack >= max(low, best.least)) & (middle - slack <= high)
        return out

    def offer(self, node: int, scores: np.ndarray, ids: np.ndarray) -> None:
        if self.windows is None:
            other = ids != self.ids[node]
            self.best[node][0].offer(scores[other], ids[other])
            return
        for (_, low, high), best in zip(self.windows[node], self.best[node]):
            inside = (scores >= low) & (scores <= high)
            best.offer(scores[inside], ids[inside])

    def rows(self) -> Iterator[tuple]:
        """Tree, node, place of the positive (0 for positives themselves), id and score of every row kept."""
        for node, bests in enumerate(self.best):
            places = [0] if self.windows is None else [w[0] for w in self.windows[node]]
            for place, best in zip(places, bests):
                yield from ((self.number, node, place, i, s) for i, s in zip(best.ids.tolist(), best.scores.tolist()))


def _scan(rows: DataFrame, wave: list[dict], positives: int, negatives: int, percent: int) -> DataFrame:
    """What the tasks over ``rows`` find for the trees of a wave."""
    shared = rows.sparkSession.sparkContext.broadcast(wave)
    schema = pa.schema([
        ("tree", pa.int64()), ("node", pa.int32()), ("place", pa.int32()), ("id", pa.int64()), ("score", pa.int64()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grove = [Tree(row, positives, negatives, percent) for row in shared.value]
        for batch in batches:
            all_ids, labels = np.asarray(batch.column("vec_id")), np.asarray(batch.column("label"))
            for rows_, x in _matrices(batch):
                ids, own = all_ids[rows_], labels[rows_]
                parts: dict[int, np.ndarray] = {}
                for tree in grove:
                    if tree.label not in parts:
                        parts[tree.label] = np.flatnonzero((own == tree.label) == (tree.windows is None))
                    part = parts[tree.label]
                    if len(part):
                        tree.visit(x[part], ids[part])
        for tree in grove:
            found = list(tree.rows())
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)

    return rows.mapInArrow(run, "tree long, node int, place int, id long, score long")


def _answered(rows: DataFrame, grown: DataFrame, most: int, positives: int, negatives: int, percent: int) -> DataFrame:
    """Best rows of every place of every anchor, wave after wave: ``tree``, ``node``, ``place``, ``rank``, ``id``, ``score``."""
    numbered = grown.select(
        "tree", F.sum(F.octet_length("components") + 64 * F.size("ids")).over(W.orderBy("tree").rowsBetween(W.unboundedPreceding, -1)).alias("bytes")
    )
    waves = materialize(
        numbered.select(F.col("tree").alias("of"), F.floor(F.coalesce("bytes", F.lit(0)) / WAVE_BYTES).alias("wave")), "waves"
    )
    last = waves.agg(F.max("wave")).first()[0]
    found = None
    for wave in range(int(last or 0) + 1):
        mine = waves.where(F.col("wave") == wave)
        sent = [r.asDict(recursive=True) for r in grown.join(F.broadcast(mine), F.col("tree") == F.col("of"), "left_semi").collect()]
        part = _scan(rows, sent, positives, negatives, percent)
        best = W.partitionBy("tree", "node", "place").orderBy(F.col("score").desc(), "id")
        part = part.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)
        part = materialize(part, "answered")
        found = part if found is None else found.unionByName(part)
    return found


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    percent: int = LEAST_PERCENT,
) -> DataFrame:
    """Hard negatives of the anchors among ``vectors(vec_id, embedding, label)``.

    One row for each anchor, positive and negative: ``anchor_id``, ``positive_id``, ``rank`` (of the negative, from 1),
    ``negative_id``, ``positive_score``, ``negative_score``. Positives are the best other rows of the anchor's label, negatives
    the best rows of other labels that score at least ``percent`` hundredths of the positive, and not
    more than it. Equal scores go by id, null ids last. Anchors need an id; rows with the anchor's id are not its positives.
    Repeated rows are rows of their own, as candidates and as anchors. The shorter of two vectors counts as padded with zeros.
    Components are held within ``LARGEST`` in size. An anchor without a positive or without a negative in a window has no row.
    """
    rows = materialize(rounded(vectors), "vectors")
    return _mined(rows, rows.where((F.col("vec_id") != int(NO_ID)) & is_anchor), positives, negatives, percent)


def _mined(rows: DataFrame, anchors: DataFrame, positives: int, negatives: int, percent: int) -> DataFrame:
    grown = materialize(trees(anchors), "trees")
    best = _answered(rows, grown, positives, positives, negatives, percent)
    best = best.select("tree", "node", F.col("rank").alias("place"), F.col("id").alias("positive"), F.col("score").alias("above"))
    listed = best.groupBy(F.col("tree").alias("of")).agg(
        F.collect_list(F.struct("node", "place", F.col("above").alias("score"))).alias("found")
    )
    ready = materialize(grown.join(listed, F.col("tree") == F.col("of")).drop("of"), "ready")
    found = _answered(rows, ready, negatives, positives, negatives, percent)
    named = grown.select("tree", F.posexplode("ids").alias("node", "anchor"))
    given = lambda c: F.when(F.col(c) != int(NO_ID), F.col(c))
    return found.join(best, ["tree", "node", "place"]).join(named, ["tree", "node"]).select(
        F.col("anchor").alias("anchor_id"), given("positive").alias("positive_id"), "rank",
        given("id").alias("negative_id"), F.col("above").alias("positive_score"), F.col("score").alias("negative_score"),
    )


def mined(vectors: DataFrame) -> DataFrame:
    """Contract of the registered query: every 100th row is an anchor, every 7th moves to the next label."""
    label = F.col("label").cast("long")
    moved = vectors.select(
        "vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label")
    )
    return hard_negatives(moved, F.col("vec_id") % 100 == 0)


NEGATIVES_SQL = r"""
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)) as e
  from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scores as (
  select a.vec_id as anchor_id, r.vec_id as id, a.label = r.label as same, list_inner_product(a.e, r.e)::bigint as score
  from v a join v r on a.vec_id % 100 = 0 and r.vec_id <> a.vec_id
), positives as (
  select anchor_id, id as positive_id, score as positive_score from scores where same
  qualify row_number() over (partition by anchor_id order by score desc, id) <= 5
)
select anchor_id, positive_id, (row_number() over each)::int as rank, id as negative_id, positive_score, score as negative_score
from positives join scores using (anchor_id)
where not same and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score
window each as (partition by anchor_id, positive_id order by score desc, id)
qualify row_number() over each <= 5
"""
