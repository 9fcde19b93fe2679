"""Removal of repeated passages, found through difference-cover anchors.

A difference cover D of period ``v`` holds, for any two places, one shift below ``v`` that brings
both to cover places. So if the same ``width`` words start at two places, both have an anchor, a run of
``width - v + 1`` words at a cover place, at the same distance below ``v`` from their start. Only
places in D modulo ``v`` are hashed corpus-wide (5 in 21); texts whose anchors occur
twice are extended: the windows around those anchors are hashed in full, and
exactly the windows that occur twice are removed.

Both rounds match hashes the same way (``_settled`` and ``_confirmed``): what repeats within a task is
settled there in batches. One row of it travels on to meet other tasks, and the rest as
runs of neighbouring places, so a passage in very many texts costs few rows, and no
pairs are made. Texts that are copies of another in full are known from the
start: the first of them speaks for all.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.texts import slices, stir, windows, words
from tidemark.session import materialize

WIDTH = 35
# Perfect difference covers by period: every difference modulo the period occurs.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 6, 8, 18)}
SETTLE_ROWS = 1 << 20  # candidate places of a task that are matched at once
RUN_BITS = 24
COPY_SHARES = 32
LEADS, FOLLOWS = -1, -2  # marks of a copied text: the first one, the others

def cover_for(width: int) -> tuple[int, tuple[int, ...]]:
    """Longest period whose anchors still have a third of the window's words."""
    fitting = [v for v in COVERS if width - v + 1 >= max(1, width // 3)]
    return (max(fitting), COVERS[max(fitting)]) if fitting else (1, (0,))


def _span(place: np.ndarray, run: np.ndarray) -> np.ndarray:
    return (place.astype(np.int64) << RUN_BITS) | run


def _settled(ids: list[np.ndarray], place, key, more, sure, gap: int) -> pa.RecordBatch:
    """Rows of a batch of places: one per key, sure if it repeats, and the rest as sure runs.

    A row holds the ids of its text, ``key`` and ``more`` (what must meet), ``span`` (place and number
    of neighbouring candidates) and ``sure``. Runs travel under keys of their own; neighbours
    are at most ``gap`` places apart.
    """
    order = np.lexsort((more, key))
    k, m = key[order], more[order]
    again = np.zeros(len(k), bool)
    again[1:] = (k[1:] == k[:-1]) & (m[1:] == m[:-1])
    twice = again.copy()
    twice[:-1] |= again[1:]
    known = sure.copy()
    known[order] |= twice
    rest = np.zeros(len(k), bool)
    rest[order] = again
    # Runs of the rest: candidates that follow each other in one text, none missing between.
    at = np.flatnonzero(rest)
    new = np.ones(len(at), bool)
    if len(at):
        new[1:] = (np.diff(at) > 1) | (at[1:] % (1 << 20) == 0)
        for i in ids:
            new[1:] |= i[at[1:]] != i[at[:-1]]
        step = place[at[1:]] - place[at[:-1]]
        new[1:] |= (step <= 0) | (step > gap)
    head, last = at[new], at[np.r_[np.flatnonzero(new)[1:] - 1, len(at) - 1]] if len(at) else at
    one = np.flatnonzero(~rest)
    rows = np.concatenate([one, head])
    run = np.concatenate([np.ones(len(one), np.int64), place[last] - place[head] + 1])
    own = stir(sum((i[head].view(np.uint64) for i in ids), place[head].astype(np.uint64)))
    columns = [i[rows] for i in ids]
    return pa.RecordBatch.from_arrays(
        [
            *[pa.array(c) for c in columns],
            pa.array(np.concatenate([key[one], own]).view(np.int64)),
            pa.array(np.concatenate([more[one], stir(own)]).astype(np.uint32).view(np.int32)),
            pa.array(_span(place[rows], run)),
            pa.array(known[rows] | (np.arange(len(rows)) >= len(one))),
        ],
        [*ID_NAMES[: len(ids)], "key", "more", "span", "sure"],
    )


ID_NAMES = ["doc", "tie"]


def _places(docs: DataFrame, ids: list[str], find, gap: int) -> DataFrame:
    """Run ``find`` on slices of ``docs`` and settle what it finds, batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        count = 0
        for batch in batches:
            for part in slices(batch, "text"):
                w = words(part.column("text"))
                at, key, more, sure = find(w, part)
                if not len(at):
                    continue
                text = w.text_of()[at]
                own = [np.asarray(part.column(i)).astype(np.int64)[text] for i in ids]
                held.append((*own, w.place()[at], key, more, sure))
                count += len(at)
                if count >= SETTLE_ROWS:
                    yield _of(held)
                    held, count = [], 0
        if held:
            yield _of(held)

    def _of(held: list[tuple]) -> pa.RecordBatch:
        *own, place, key, more, sure = map(np.concatenate, zip(*held))
        return _settled(own, place, key, more, sure, gap)

    schema = ", ".join(f"{i} long" for i in ids) + ", key long, more int, span long, sure boolean"
    return docs.mapInArrow(run, schema)


def _confirmed(rows: DataFrame, ids: list[str], copies: DataFrame) -> DataFrame:
    """Spans whose key occurs twice and the marks of ``copies``, gathered per text as ``spans``."""
    n = F.count("*").over(W.partitionBy("key", "more"))
    twice = rows.withColumn("n", n).where((F.col("n") > 1) | F.col("sure")).select(*ids, "span")
    return twice.unionByName(copies).groupBy(*ids).agg(F.collect_list("span").alias("spans"))


def _copies(docs: DataFrame, ids: list[str]) -> DataFrame:
    """Texts that occur in full more than once: their ids and ``LEADS`` or ``FOLLOWS`` as ``span``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    hashed = docs.where(F.length(text) > 0).select(
        *ids, F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("g"),
        F.char_length(text).alias("n_points"),
    )
    same = ["h", "g", "n_points"]
    groups = hashed.groupBy(*same).agg(F.count("*").alias("n"), F.min("doc").alias("lead")).where("n > 1")
    # A group may hold a third of all texts: its rows are dealt over shares.
    shares = F.pmod(F.xxhash64("doc"), F.lit(COPY_SHARES)).cast("int")
    groups = groups.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(COPY_SHARES - 1))))
    return (
        hashed.withColumn("share", shares).join(groups, [*same, "share"])
        .select(*ids, F.when(F.col("doc") == F.col("lead"), LEADS).otherwise(FOLLOWS).cast("long").alias("span"))
        .distinct()
    )


def _anchors(docs: DataFrame, ids: list[str], width: int) -> DataFrame:
    period, cover = cover_for(width)
    length = width - period + 1
    chosen = np.zeros(period, bool)
    chosen[list(cover)] = True

    def find(w, part):
        # A text shorter than one window has nothing to share.
        fits = (w.left() >= length) & np.repeat(w.counts >= width, w.counts)
        at = np.flatnonzero(chosen[w.place() % period] & fits)
        key = windows(w.hashes(0), length)[at] if len(at) else np.zeros(0, np.uint64)
        return at, key, np.zeros(len(at), np.uint64), np.zeros(len(at), bool)

    return _places(docs.select(*ids, "text"), ids, find, period)


def _extended(docs: DataFrame, ids: list[str], width: int) -> DataFrame:
    """Full windows that hold a repeated anchor (``spans``); all windows of the first of copies."""
    period, _ = cover_for(width)

    def find(w, part):
        start, run, marks = _spans(w, part.column("spans"))
        near = _marked(w, np.maximum(start - period + 1, w.first[:-1][_row_of(w, start)]), start + run)
        leads = np.repeat(marks == LEADS, w.counts)
        near = (near | leads) & ~np.repeat(marks == FOLLOWS, w.counts)
        at = np.flatnonzero(near & (w.left() >= width))
        if not len(at):
            return at, at, at, at
        key, more = (windows(w.hashes(i), width)[at] for i in (0, 1))
        return at, key, more & np.uint64(0xFFFFFFFF), leads[at]

    return _places(docs, ids, find, 1)


def _row_of(w, at: np.ndarray) -> np.ndarray:
    return np.minimum(np.searchsorted(w.first, at, side="right"), len(w.first) - 1) - 1


def _spans(w, spans: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers and lengths of the listed spans, and the mark of each text (0 if none)."""
    count = np.asarray(spans.value_lengths().fill_null(0)).astype(np.int64)
    flat = np.asarray(spans.flatten()).astype(np.int64)
    row = np.repeat(np.arange(len(count)), count)
    marks = np.zeros(len(count), np.int64)
    marks[row[flat < 0]] = flat[flat < 0]
    flat, row = flat[flat >= 0], row[flat >= 0]
    return (flat >> RUN_BITS) + w.first[row], flat & ((1 << RUN_BITS) - 1), marks


def _marked(w, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """True at the words of the ranges."""
    edge = np.zeros(len(w.start) + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, stop, -1)
    return np.cumsum(edge)[:-1] > 0


def without_passages(docs: DataFrame, width: int = WIDTH, respace: bool = True) -> DataFrame:
    """``docs`` with the words of every repeated window of ``width`` words removed.

    Adds ``n_words``, ``n_removed`` and ``kept_text``, the kept words joined by one space (or
    empty); without ``respace``, texts that lose nothing are returned as they are. Null and
    empty texts have no words; texts shorter than a window stay whole. A repeated
    row repeats all its windows. Texts under one ``doc_id`` (or none) are told apart by their hash.
    Other columns are carried; those of the names above are replaced.
    """
    # Plain ids compress better than hashes; a tie-breaker joins them only where ids repeat.
    number = F.coalesce(F.col("doc_id").cast("long"), F.lit(0))
    tied = docs.groupBy(number.alias("doc")).count().where("count > 1").limit(1).count() > 0
    ids = ID_NAMES if tied else ID_NAMES[:1]
    tie = [F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("tie")] if tied else []
    keyed = docs.select(
        number.alias("doc"), *tie,
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("rest"),
        F.col("text").cast("string").alias("text"),
    )
    # Both joins below read the texts in this one distribution, with the same columns.
    held = keyed.repartition(*ids)
    copies = materialize(_copies(keyed, ids), "copies")
    anchors = _confirmed(_anchors(keyed, ids, width), ids, copies)
    near = held.join(anchors.hint("merge"), ids).select(*ids, "rest", "text", "spans")
    marks = _confirmed(_extended(near, ids, width), ids, copies)
    joined = held.join(marks.hint("merge"), ids, "left").select("rest", "text", "spans")
    rest = joined.schema["rest"].dataType.simpleString()
    schema = f"rest {rest}, n_words long, n_removed long, kept_text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w = words(part.column("text"))
                start, length, marks = _spans(w, part.column("spans"))
                cut = _marked(w, start, start + length + width - 1)
                cut |= np.repeat((marks < 0) & (w.counts >= width), w.counts)
                total = np.concatenate([[0], np.cumsum(cut)])
                gone = total[w.first[1:]] - total[w.first[:-1]]
                edges = zip(w.first[:-1].tolist(), w.first[1:].tolist())
                kept = [_text(w, a, b, cut) for a, b in edges]
                if not respace:
                    whole = part.column("text").to_pylist()
                    kept = [k if g else t for k, g, t in zip(kept, gone.tolist(), whole)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("rest"), pa.array(w.counts.astype(np.int64)), pa.array(gone), pa.array(kept, pa.string())],
                    ["rest", "n_words", "n_removed", "kept_text"],
                )

    done = joined.mapInArrow(run, schema)
    taken = {"n_words", "n_removed", "kept_text"}
    carried = [F.col("rest")[c].alias(c) for c in docs.columns if c != "text" and c.lower() not in taken]
    return done.select(*carried, "n_words", "n_removed", "kept_text")


def _text(w, a: int, b: int, cut: np.ndarray) -> str:
    if a == b:
        return ""
    parts = w.raw[w.start[a] : w.stop[b - 1]].tobytes().split()
    if cut[a:b].any():
        parts = [p for p, c in zip(parts, cut[a:b].tolist()) if not c]
    return b" ".join(parts).decode()


def passage_digests(docs: DataFrame) -> DataFrame:
    """Contract of the registered query."""
    done = without_passages(docs.select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def cut_passages(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` with shortened texts, unchanged where nothing repeats; columns unchanged.

    ``n_chars``, where present, follows the new text. Texts that lose every word become empty.
    """
    taken = {"n_words", "n_removed", "kept_text"}
    source = docs.select(*[F.col(f"`{c}`").alias(f"_{c}" if c.lower() in taken else c) for c in docs.columns])
    done = without_passages(source, width, respace=False)
    shorter = F.col("n_removed") > 0
    out = {c: F.col(f"`_{c}`" if c.lower() in taken else f"`{c}`").alias(c) for c in docs.columns if c != "text"}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new = F.char_length("kept_text").cast(kind)
        out["n_chars"] = F.when(shorter, new).otherwise(F.col("n_chars")).alias("n_chars")
    out["text"] = F.col("kept_text").alias("text")
    return done.select(*[out[c] for c in docs.columns])


PASSAGES_SQL = r"""
with words as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), runs as (
  select doc_id, i, array_to_string(w[i:i + 34], ' ') as run
  from (select doc_id, w, unnest(range(1, len(w) - 33)) as i from words where len(w) >= 35)
), twice as (
  select doc_id, i from (select doc_id, i, count(*) over (partition by run) as n from runs) where n > 1
), gone as (
  select distinct doc_id, i + k as i from twice, (select unnest(range(0, 35)) as k)
), each as (
  select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from words
), kept as (
  select doc_id, string_agg(word, ' ' order by i) as t, count(*) as n
  from each anti join gone using (doc_id, i) group by doc_id
)
select doc_id, len(w) as n_words, len(w) - coalesce(n, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256
from words left join kept using (doc_id)
"""
