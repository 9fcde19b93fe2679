"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text falls in a bin of a lookup table, and each chosen pair of features in a
cell of a grid; the log odds of good quality are the sum of these entries. Cyclic
boosting learns the tables: features take turns, and each turn adds a shallow tree over
one feature's bins (or one grid), fitted to the present gradients. Scoring adds up
table entries for whole batches.
"""

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.language import bucket_of
from tidemark.llm.quality_rules import measure
from tidemark.llm.texts import slices, words
from tidemark.session import materialize

ROWS = 20_000  # bound of the training sample, whatever the size of the corpus

BINS = 32
COARSE = 8
PAIRS = 6
RATE = 0.1
SMOOTH = 1.0
ROUNDS, PAIR_ROUNDS, PATIENCE = 200, 60, 15

FEATURES = (
    "log_words", "word_length", "word_length_spread", "longest_word", "symbol_share", "repeated_lines",
    "repeated_windows", "capital_share", "bang_share", "digit_share", "mark_share", "foreign_share",
    "distinct_share", "echo_share", "words_a_line", "one_letter_share", "sentence_ends", "bars",
)


def features(column: pa.Array) -> np.ndarray:
    """One row per text, finite for every text; a null or empty text is all zeros."""
    w = words(column)
    m = {k: v.astype(float) for k, v in measure(column).items()}
    n = len(w.first) - 1
    count = np.maximum(m["n_words"], 1)
    size = np.maximum(np.diff(w.texts), 1)

    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return (total[w.texts[1:]] - total[w.texts[:-1]]).astype(float)

    text = w.text_of()
    length = (w.stop - w.start).astype(float)
    mean = np.bincount(text, length, minlength=n) / count
    spread = np.sqrt(np.maximum(np.bincount(text, length**2, minlength=n) / count - mean**2, 0))
    longest = np.zeros(n)
    np.maximum.at(longest, text, length)
    hashes = w.hashes(0)
    order = np.lexsort((hashes, text))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (text[order][1:] != text[order][:-1])
    distinct = np.bincount(text[order][new], minlength=n)
    echo = np.zeros(len(text), bool)
    echo[1:] = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
    raw = w.raw
    last = raw[w.stop - 1] if len(text) else np.zeros(0, np.uint8)
    marks = (raw > 32) & (raw < 127) & ~(
        ((raw >= 48) & (raw <= 57)) | ((raw >= 65) & (raw <= 90)) | ((raw >= 97) & (raw <= 122))
    )
    letters = np.maximum(m["n_upper"] + m["n_lower"], 1)
    out = np.stack(
        [
            np.log1p(m["n_words"]), m["word_chars"] / count, spread, np.log1p(longest),
            m["n_symbols"] / count, m["n_dup_lines"] / np.maximum(m["n_lines"], 1),
            m["n_repeat_words"] / count, m["n_upper"] / letters, m["n_bang_words"] / count,
            per_text((raw >= 48) & (raw <= 57)) / size, per_text(marks) / size, per_text(raw >= 128) / size,
            distinct / count, np.bincount(text[echo], minlength=n) / count,
            m["n_words"] / np.maximum(m["n_lines"], 1),
            np.bincount(text[length == 1], minlength=n) / count,
            np.bincount(text[(last == 46) | (last == 33) | (last == 63)], minlength=n) / count,
            per_text(raw == 124) / count,
        ],
        axis=1,
    )
    return out.astype(np.float64)


def score_columns(docs: DataFrame, *carried: str) -> DataFrame:
    """``doc_id``, the ``carried`` columns and ``values`` (the features in the order of ``FEATURES``) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x = features(part.column("text"))
                at = pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(n) for n in names], pa.ListArray.from_arrays(at, pa.array(x.ravel()))],
                    [*names, "values"],
                )

    read = docs.select(F.col("doc_id").cast("long"), *carried, F.col("text").cast("string"))
    names = ["doc_id", *carried]
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema if f.name in names)
    return read.mapInArrow(run, f"{kept}, values array<double>")


@dataclass
class Model:
    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    grids: list[np.ndarray] = field(default_factory=list)  # coarse bins of both, flattened

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T)], axis=1)

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Log odds of good quality: bin additions only."""
        out = np.full(len(x), self.base)
        if not self.tables:
            return out
        b = self.bins(x)
        for j, table in enumerate(self.tables):
            out += table[b[:, j]]
        for (i, j), grid in zip(self.pairs, self.grids):
            out += grid[coarse(b[:, i]) * COARSE + coarse(b[:, j])]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.odds(x))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def coarse(b: np.ndarray) -> np.ndarray:
    return b * COARSE // BINS


def cuts(values: np.ndarray) -> np.ndarray:
    """At most ``BINS - 1`` cut points: midpoints between quantiles that differ."""
    q = np.unique(np.quantile(values, np.linspace(0, 1, BINS), method="lower"))
    return (q[1:] + q[:-1]) / 2


def stump(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a histogram of gradients and curvatures."""
    a, c = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(a):
        return 0.0, 0
    gain = a**2 / (c + SMOOTH) + (g.sum() - a) ** 2 / (h.sum() - c + SMOOTH) - g.sum() ** 2 / (h.sum() + SMOOTH)
    i = int(np.argmax(gain))
    return float(gain[i]), i + 1


def tree(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """Value of every bin by a tree of few leaves over one histogram."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = max(((*stump(g[a:b], h[a:b]), a, b) for a, b in parts), key=lambda s: s[0])
        gain, at, a, b = best
        if gain <= 1e-9:
            break
        parts.remove((a, b))
        parts += [(a, a + at), (a + at, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + SMOOTH)
    return out


def pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Values of a grid by a tree of depth two, one cut of rows and one of columns on either side; its gain."""
    best, out = -1.0, np.zeros_like(g)
    for cut in range(1, len(g)):
        values, gain = np.zeros_like(g), 0.0
        for rows in (slice(0, cut), slice(cut, None)):
            a, c = g[rows].sum(axis=0), h[rows].sum(axis=0)
            _, at = stump(a, c)
            for columns in (slice(0, at), slice(at, None)):
                s, t = a[columns].sum(), c[columns].sum() + SMOOTH
                values[rows, columns] = s / t
                gain += s**2 / t
        if gain > best:
            best, out = gain, values
    return out, best


def train(x: np.ndarray, y: np.ndarray, seed: int = 5) -> Model:
    """Fit the model to features and labels (0 or 1); a fifth of the rows decides when to stop.

    No rows give even odds; labels of one kind give their smoothed share.
    """
    share = (y.sum() + 1) / (len(y) + 2)
    model = Model(base=float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2:
        return model
    model.edges = [cuts(c) for c in x.T]
    b = model.bins(x)
    model.tables = [np.zeros(BINS) for _ in x.T]
    held = np.random.default_rng(seed).permutation(len(y)) < len(y) // 5
    odds = np.full(len(y), model.base)

    def gradients(cells: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        p = sigmoid(odds[~held])
        c = cells[~held]
        return np.bincount(c, y[~held] - p, minlength=size), np.bincount(c, p * (1 - p), minlength=size)

    def loss() -> float:
        rows = held if held.any() else ~held
        return float(np.logaddexp(0, np.where(y[rows] == 1, -odds[rows], odds[rows])).mean())

    best, since = (loss(), [t.copy() for t in model.tables], odds.copy()), 0
    for _ in range(ROUNDS):
        for j, table in enumerate(model.tables):
            step = RATE * tree(*gradients(b[:, j], BINS))
            table += step
            odds += step[b[:, j]]
        now = loss()
        since = 0 if now < best[0] - 1e-6 else since + 1
        if not since:
            best = (now, [t.copy() for t in model.tables], odds.copy())
        if since >= PATIENCE:
            break
    _, model.tables, odds = best
    cells = {
        (i, j): coarse(b[:, i]) * COARSE + coarse(b[:, j])
        for i in range(x.shape[1]) for j in range(i)
    }
    gains = {}
    for pair, cell in cells.items():
        g, h = gradients(cell, COARSE * COARSE)
        gains[pair] = pair_tree(g.reshape(COARSE, COARSE), h.reshape(COARSE, COARSE))[1]
    model.pairs = sorted(gains, key=lambda p: (-gains[p], p))[:PAIRS]
    model.grids = [np.zeros(COARSE * COARSE) for _ in model.pairs]
    best, since = (loss(), [g.copy() for g in model.grids]), 0
    for _ in range(PAIR_ROUNDS):
        for pair, grid in zip(model.pairs, model.grids):
            g, h = gradients(cells[pair], COARSE * COARSE)
            step = RATE * pair_tree(g.reshape(COARSE, COARSE), h.reshape(COARSE, COARSE))[0].ravel()
            grid += step
            odds += step[cells[pair]]
        now = loss()
        since = 0 if now < best[0] - 1e-6 else since + 1
        if not since:
            best = (now, [g.copy() for g in model.grids])
        if since >= PATIENCE:
            break
    _, model.grids = best
    return model


def sample(docs: DataFrame, labels: DataFrame, usable: Column) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``ROWS`` usable labelled contents, the same ones on every run.

    A document with several labels takes the smallest. Rows of one labelled id with equal texts count
    as one, and those with different texts as one each, within the same bound; texts of any length
    are read whole, and only their features reach the driver. Null texts count as empty.
    """
    marked = (
        labels.where(usable & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("_id"))
        .agg(F.min("quality").cast("int").alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id").limit(ROWS)
    )
    rows = docs.select(
        F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    digest = F.sha2("text", 256)
    keys = (
        rows.join(F.broadcast(marked), F.col("doc_id") == F.col("_id"))
        .select("_id", "_label", digest.alias("_digest")).distinct()
        .orderBy(F.xxhash64("_id", "_digest"), "_id", "_digest").limit(ROWS)
    )
    keys = materialize(keys, "sample")
    chosen = rows.join(F.broadcast(keys.select("_id").distinct()), F.col("doc_id") == F.col("_id"), "left_semi")
    each = (
        chosen.withColumn("digest", digest)
        .join(F.broadcast(keys), (F.col("doc_id") == F.col("_id")) & (F.col("digest") == F.col("_digest")))
    )
    found = score_columns(each, "_label", "digest").groupBy("doc_id", "digest").agg(
        F.first("_label").alias("label"), F.first("values").alias("values")
    )
    table = found.toPandas().sort_values(["doc_id", "digest"])
    x = np.array(table["values"].tolist(), float).reshape(-1, len(FEATURES))
    return x, table["label"].to_numpy(dtype=int)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1) of every row; null and empty texts score as texts without words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                values = shared.value.scores(features(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(values)], ["doc_id", "score"])

    read = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return read.mapInArrow(run, "doc_id long, score double")


def predictions(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Contract of the registered query: scores learned from the labelled rows not held out.

    One row per row of ``docs``, repeated ones alike. Null and empty texts score as texts without words, and a null
    ``doc_id`` is not held out. Without labels, or with labels of one kind, all scores are equal.
    """
    held = F.coalesce(bucket_of(F.col("doc_id"), 5) == 0, F.lit(False))
    model = train(*sample(docs, labels, ~held))
    return scored(docs, model).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
