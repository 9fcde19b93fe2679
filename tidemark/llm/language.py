"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is lower-cased; its subwords are the byte sequences of two to four bytes inside words, a
space marking either end, each hashed to one of ``BUCKETS`` embeddings. The mean embedding
feeds a linear softmax, trained by stochastic gradient descent in numpy on a bounded sample of rows. Executors
count the subwords of their whole texts; training draws bags of subwords from these counts.
As mean and softmax weights are both linear, scoring needs one table of scores per
bucket. A temperature and a rejection threshold are fitted on sampled texts held back.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.texts import slices, string_data
from tidemark.session import sized

BUCKETS = 1 << 16
SIZES = (2, 3, 4)
DIMENSIONS = 16
UNKNOWN = "und"

# Bounds of the training sample in rows, whatever the size of the corpus and the length of its texts.
TEXTS_PER_LANGUAGE = 400
TEXTS = 1_600
BAG_WORDS = (4, 250)  # smallest and largest number of subwords of a bag
BAGS_PER_TEXT = 8
ACCEPTED_ACCURACY = 0.99

_LETTERS = np.arange(256, dtype=np.uint8)
_LETTERS[:128] = 0x20
_LETTERS[97:123] = np.arange(97, 123)


def subwords(raw: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size: first bytes of the subwords in lower-cased UTF-8 ``raw``, and their buckets.

    Bytes of ASCII that are no letters part words. No subword goes beyond a word and the one
    space before and after it.
    """
    chars = _LETTERS[raw].astype(np.uint32)
    gap = chars == 0x20
    for size in SIZES:
        n = len(chars) - size + 1
        if n <= 0:
            continue
        code = chars[:n].copy()
        for k in range(1, size):
            code |= chars[k : k + n] << np.uint32(8 * k)
        inner = np.zeros(n, bool)
        for k in range(1, size - 1):
            inner |= gap[k : k + n]
        if size == 2:
            inner = gap[:n] & gap[1 : 1 + n]
        at = np.flatnonzero(~inner)
        mixed = (code[at] + np.uint32(size)) * np.uint32(2654435761)
        mixed ^= mixed >> np.uint32(15)
        yield at, (mixed * np.uint32(2246822519)) >> np.uint32(16)


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # buckets x languages
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean scores of the subwords that start in each range of ``raw``."""
        n = len(offsets) - 1
        total = np.zeros((n, len(self.languages)))
        count = np.zeros(n)
        for at, bucket in subwords(raw):
            # The space between texts ends every subword, so that none reaches into the next text.
            edge = np.searchsorted(at, offsets)
            size = np.diff(edge)
            some = np.flatnonzero(size)
            if not len(some):
                continue
            total[some] += np.add.reduceat(self.scores[bucket], edge[:-1][some], axis=0)[:, :]
            count += size
        return total / np.maximum(count, 1)[:, None] + self.bias

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def spaced(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts with one space around each, and the offsets of the texts."""
    raw, offs = string_data(column)
    n = len(offs) - 1
    out = np.full(len(raw) + n + 1, 0x20, np.uint8)
    shift = np.repeat(np.arange(1, n + 1), np.diff(offs))
    out[np.arange(len(raw)) + shift] = raw
    return out, offs + np.arange(n + 1)


def counted(texts: DataFrame, *carried: str) -> DataFrame:
    """``carried`` columns, ``buckets`` (distinct, increasing) and ``counts`` of the subwords of every whole ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                raw, offs = spaced(part.column("text"))
                keys = []
                for at, bucket in subwords(raw):
                    text = np.searchsorted(offs, at, side="right") - 1
                    keys.append(text * BUCKETS + bucket.astype(np.int64))
                key, n = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.int64), return_counts=True)
                at = pa.array(np.searchsorted(key, np.arange(part.num_rows + 1) * BUCKETS), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        *[part.column(c) for c in carried],
                        pa.ListArray.from_arrays(at, pa.array((key % BUCKETS).astype(np.int32))),
                        pa.ListArray.from_arrays(at, pa.array(n.astype(np.int32))),
                    ],
                    [*carried, "buckets", "counts"],
                )

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.select(*carried).schema)
    return texts.select(*carried, "text").mapInArrow(run, f"{kept}, buckets array<int>, counts array<int>")


Counts = tuple[np.ndarray, np.ndarray]


def sample(docs: DataFrame, usable: Column) -> list[tuple[Counts, str]]:
    """Subword counts and language of at most ``TEXTS`` usable rows, the same ones on every run.

    Texts of any length are counted whole, on executors.
    """
    labelled = docs.where(usable & F.col("lang").isNotNull()).select(
        F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string")
    ).withColumn("hash", F.xxhash64("text"))
    # A place of each content of an id in [0, 1): only about twice the wanted rows of a language are ranked.
    place = F.pmod(F.xxhash64("doc_id", "hash"), F.lit(1 << 30)) / float(1 << 30)
    rows = labelled.where(has_letter(F.col("text")))
    sizes = rows.groupBy(F.col("lang").alias("_of")).agg(F.approx_count_distinct(F.xxhash64("doc_id", "hash")).alias("n"))
    ids = (
        rows.select("doc_id", "lang", "hash", place.alias("place"))
        .join(sized(sizes), F.col("lang") == F.col("_of"))
        .where(F.col("place") * F.col("n") <= 2 * TEXTS_PER_LANGUAGE)
        .groupBy("lang", "doc_id", "hash").agg(F.min("place").alias("place"))
        .withColumn("nth", F.row_number().over(W.partitionBy("lang").orderBy("place", "doc_id", "hash")))
        .where(F.col("nth") <= TEXTS_PER_LANGUAGE)
        .orderBy("nth", "lang").limit(TEXTS)
        .select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"), F.col("hash").alias("_hash"), "nth")
    )
    same = (
        rows["doc_id"].eqNullSafe(F.col("_id")) & (F.col("lang") == F.col("_lang")) & (F.col("hash") == F.col("_hash"))
    )
    chosen = rows.join(F.broadcast(ids), same).select("nth", "lang", F.lower("text").alias("text"))
    # Repeated rows of a chosen content have equal counts and come out as one.
    found = (
        counted(chosen, "nth", "lang").groupBy("nth", "lang")
        .agg(F.first(F.struct("buckets", "counts")).alias("of"))
        .select("nth", "lang", "of.*").orderBy("nth", "lang").toArrow()
    )
    lists = [found.column(c).combine_chunks() for c in ("buckets", "counts")]
    each = [[np.asarray(x.values) for x in column] for column in lists]
    return [((b, n), lang) for b, n, lang in zip(*each, found.column("lang").to_pylist())]


def bags(counts: Counts, rng: np.random.Generator) -> list[np.ndarray]:
    """Bags of subwords drawn from the counts of a whole text; none without subwords."""
    buckets, n = counts
    if not len(buckets):
        return []
    ends = np.cumsum(n)
    most = int(min(ends[-1], BAG_WORDS[1]))
    sizes = np.geomspace(min(BAG_WORDS[0], most), most, BAGS_PER_TEXT).astype(int)
    return [buckets[np.searchsorted(ends, rng.integers(0, ends[-1], size), side="right")].astype(np.int64) for size in sizes]


def train(texts: list[tuple[Counts, str]], epochs: int = 2, batch: int = 32, seed: int = 7) -> Model | None:
    """Fit the model; every fifth text is held back for calibration. No texts give no model."""
    languages = sorted({lang for _, lang in texts})
    if not languages:
        return None
    number = {lang: i for i, lang in enumerate(languages)}
    fit = [t for i, t in enumerate(texts) if i % 5] or texts
    held = [t for i, t in enumerate(texts) if not i % 5]
    rng = np.random.default_rng(seed)
    segments, labels = [], []
    for counts, lang in fit:
        drawn = bags(counts, rng)
        segments += drawn
        labels += [number[lang]] * len(drawn)
    labels = np.array(labels)
    embed = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    weight = rng.normal(0, 0.1, (DIMENSIONS, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)
    steps, done = epochs * -(-len(segments) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(segments))
        for lo in range(0, len(order), batch):
            rate = 2.0 * (1 - done / steps) + 0.02
            done += 1
            chosen = order[lo : lo + batch]
            size = np.array([len(segments[i]) for i in chosen])
            flat = np.concatenate([segments[i] for i in chosen])
            first = np.cumsum(size) - size
            mean = np.add.reduceat(embed[flat], first, axis=0) / size[:, None]
            z = mean @ weight + bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            grad = z / z.sum(axis=1, keepdims=True)
            grad[np.arange(len(chosen)), labels[chosen]] -= 1
            grad /= len(chosen)
            back = (grad @ weight.T) / size[:, None]
            weight -= rate * (mean.T @ grad)
            bias -= rate * grad.sum(axis=0)
            by = np.argsort(flat, kind="stable")
            ids, at = np.unique(flat[by], return_index=True)
            # Rows of a batch are few; their rate makes up for the mean over the text.
            embed[ids] -= rate * len(chosen) * np.add.reduceat(np.repeat(back, size, axis=0)[by], at, axis=0)
    model = Model(languages, (embed @ weight).astype(np.float32), bias.astype(np.float64))
    return calibrated(model, held, number)


def calibrated(model: Model, held: list[tuple[Counts, str]], number: dict[str, int]) -> Model:
    """Set the temperature of least log loss and the lowest threshold of the wanted accuracy."""
    if not held:
        return model
    logits = np.array([
        n @ model.scores[b] / max(n.sum(), 1) + model.bias for (b, n), _ in held
    ])
    truth = np.array([number[lang] for _, lang in held])
    losses = {}
    for t in np.geomspace(0.05, 20, 61):
        model.temperature = float(t)
        p = model.probabilities(logits)[np.arange(len(truth)), truth]
        losses[float(t)] = -np.log(np.maximum(p, 1e-12)).mean()
    model.temperature = min(losses, key=losses.get)
    p = model.probabilities(logits)
    best = p.max(axis=1)
    order = np.argsort(-best)
    right = np.cumsum(p.argmax(axis=1)[order] == truth[order]) / np.arange(1, len(order) + 1)
    enough = np.flatnonzero(right >= ACCEPTED_ACCURACY)
    model.threshold = float(best[order][enough[-1]]) if len(enough) else 1.0
    return model


def identified(docs: DataFrame, model: Model | None) -> DataFrame:
    """Best language of every whole text: ``doc_id``, ``best``, ``score`` (0 to 1) and ``accepted``.

    ``best`` is ``und`` with score 0 for null texts and texts without a letter, and for all texts
    when there is no model. ``accepted`` is false there and where the calibrated
    probability is below the threshold.
    """
    read = docs.select(
        F.col("doc_id").cast("long"), F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"),
        has_letter(F.col("text").cast("string")).alias("letters"),
    )
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                n = part.num_rows
                best, score = np.full(n, UNKNOWN, object), np.zeros(n)
                letters = np.asarray(part.column("letters").cast(pa.int8())).astype(bool)
                if m is not None:
                    p = m.probabilities(m.logits(*spaced(part.column("text"))))
                    names = np.array(m.languages, object)[p.argmax(axis=1)]
                    best[letters], score[letters] = names[letters], p.max(axis=1)[letters]
                accepted = letters & (score >= (m.threshold if m else np.inf))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(best, pa.string()), pa.array(score), pa.array(accepted)],
                    ["doc_id", "best", "score", "accepted"],
                )

    return read.mapInArrow(run, "doc_id long, best string, score double, accepted boolean")


def languages(docs: DataFrame, usable: Column) -> DataFrame:
    """Train on the usable labelled rows and name the language of every row; ``und`` where rejected."""
    found = identified(docs, train(sample(docs, usable)))
    lang = F.when(F.col("accepted"), F.col("best")).otherwise(UNKNOWN)
    return found.select("doc_id", lang.alias("lang"), "score")


def bucket_of(doc_id: Column, parts: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def predictions(docs: DataFrame) -> DataFrame:
    """Contract of the registered query: best languages, learned from the rows not held out.

    One row per row of ``docs``, repeated ones alike; a null ``doc_id`` is not held out. ``lang_pred`` is ``und`` with
    score 0 for null texts and texts without a letter, and everywhere if no row has a language to learn.
    """
    held = F.coalesce(bucket_of(F.col("doc_id"), 3) == 1, F.lit(False))
    found = identified(docs, train(sample(docs, ~held)))
    return found.select(
        "doc_id", held.alias("held_out"), F.col("best").alias("lang_pred"), "score", "accepted"
    )
