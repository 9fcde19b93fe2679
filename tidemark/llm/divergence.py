"""Divergence between the sources of a language, by single-pass in-memory indexing.

Tasks read texts once and gather postings (language, term, source, occurrences, documents) in a block
in memory. A full block is sorted by term and spilled as a run: its rows leave for the shard
that the hash of (language, term) names. A shard merges its runs in term order, which Spark's
external sort does with a heap over spilled runs, and adds up the postings of each term; terms in too few documents
end there. So the frequencies of a term are complete in one place, and a frequent term is one row of each
source and block.

The distance of two sources sums over all kept terms of their language. Most terms are missing in
at least one of them, so the sum is taken from the distance of two missing terms, a correction for each number of
occurrences in one source against a missing term, and a correction for each term that both
have; the last are streamed from the shards. All sums are exact integers.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.texts import slices, string_data
from tidemark.session import materialize, sized

MIN_DOCUMENTS = 10
TOP_TERMS = 10
SCALE = 1_000_000_000
PRIOR = 2
BLOCK_ROWS = 1 << 19  # postings held in memory before a run is spilled
PAIR_ROWS = 1 << 20  # pair corrections held in memory before equal pairs are added up

_GROUP = ["lang", "source"]
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_INSIDE = np.zeros(256, bool)
_INSIDE[97:123] = True
_INSIDE[128:] = True


def terms_of(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Terms of the texts of a column and the text of each: runs of letters and bytes beyond ASCII, A-Z lower-cased."""
    raw, offs = string_data(column)
    raw = _FOLD[raw]
    inside = _INSIDE[raw]
    edge = np.zeros(len(raw) + 1, bool)  # texts end terms
    edge[offs] = True
    before = np.concatenate([[False], inside[:-1]])[: len(raw)]
    after = np.concatenate([inside[1:], [False]])[: len(raw)]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    stop = np.flatnonzero(inside & (~after | edge[1:])) + 1
    ends = np.concatenate([[0], np.cumsum(stop - start)])
    kind = pa.binary() if ends[-1] < 1 << 31 else pa.large_binary()
    width = np.int32 if ends[-1] < 1 << 31 else np.int64
    data = raw[inside].tobytes()
    found = pa.Array.from_buffers(kind, len(start), [None, pa.py_buffer(ends.astype(width).tobytes()), pa.py_buffer(data)])
    return found, np.searchsorted(offs, start, side="right") - 1


_POSTING = pa.schema([
    ("lang", pa.string()), ("term", pa.binary()), ("source", pa.string()), ("n", pa.int64()), ("documents", pa.int64()),
])


def postings(part: pa.RecordBatch) -> pa.Table:
    """One row for each term of each group of a slice of texts: occurrences, and documents with it."""
    found, text = terms_of(part.column("text"))
    coded = found.dictionary_encode()
    term = np.asarray(coded.indices).astype(np.int64)
    tables = [part.column(c).dictionary_encode() for c in _GROUP]
    langs, sources = (np.asarray(t.indices).astype(np.int64) for t in tables)
    width = len(tables[1].dictionary)
    group = langs * width + sources
    # Occurrences of each term of each text, then of each term of each group.
    each, times = np.unique(term * part.num_rows + text, return_counts=True)
    by = each // part.num_rows * (len(tables[0].dictionary) * width) + group[each % part.num_rows]
    order = np.argsort(by, kind="stable")
    by = by[order]
    first = np.flatnonzero(np.concatenate([[True], by[1:] != by[:-1]])) if len(by) else np.zeros(0, np.int64)
    n = np.add.reduceat(times[order], first) if len(by) else first
    documents = np.diff(np.concatenate([first, [len(by)]]))
    key = by[first]
    of = key % (len(tables[0].dictionary) * width) if len(key) else key
    return pa.Table.from_arrays(
        [
            tables[0].dictionary.take(pa.array(of // max(width, 1))),
            coded.dictionary.take(pa.array(key // max(len(tables[0].dictionary) * width, 1))).cast(pa.binary()),
            tables[1].dictionary.take(pa.array(of % max(width, 1))),
            pa.array(n.astype(np.int64)), pa.array(documents.astype(np.int64)),
        ],
        schema=_POSTING,
    )


def _block(held: list[pa.Table]) -> pa.Table:
    """Postings of a block with equal ones added up, in term order."""
    keys = ["lang", "term", "source"]
    added = pa.concat_tables(held).group_by(keys).aggregate([("n", "sum"), ("documents", "sum")])
    added = added.rename_columns([c.removesuffix("_sum") for c in added.column_names]).select(_POSTING.names)
    return added.sort_by([(k, "ascending") for k in keys])


def runs(docs: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Sorted runs of postings of ``docs(lang, source, text)`` without nulls; groups repeat from run to run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        count = 0
        for batch in batches:
            for part in slices(batch, "text"):
                held.append(postings(part))
                count += held[-1].num_rows
                if count >= block_rows:
                    held = [_block(held)]
                    count = held[0].num_rows
                    if count >= block_rows // 2:  # adding up made little room: the block is full
                        yield from held[0].to_batches(max_chunksize=1 << 16)
                        held, count = [], 0
        if held:
            yield from _block(held).to_batches(max_chunksize=1 << 16)

    return docs.select(*_GROUP, "text").mapInArrow(
        run, "lang string, term binary, source string, n long, documents long"
    )


def _starts(table: pa.Table | pa.RecordBatch, names: list[str]) -> np.ndarray:
    """True at rows that differ from the row before in one of the columns."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for name in names:
        column = table.column(name)
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        new[1:] |= np.asarray(pc.not_equal(column[1:], column[:-1]).cast(pa.uint8())).astype(bool)
    return new


def _summed(table: pa.Table) -> pa.Table:
    """Neighbouring postings of one term and source as one."""
    if not table.num_rows:
        return table
    first = np.flatnonzero(_starts(table, ["lang", "term", "source"]))
    kept = table.take(pa.array(first))
    for name in ("n", "documents"):
        at = kept.schema.get_field_index(name)
        kept = kept.set_column(at, name, pa.array(np.add.reduceat(np.asarray(table.column(name)), first)))
    return kept


def _kept(table: pa.Table, least: int) -> pa.RecordBatch:
    """Postings of the terms in enough documents; each with the occurrences of its term in all sources."""
    first = np.flatnonzero(_starts(table, ["lang", "term"])) if table.num_rows else np.zeros(0, np.int64)
    size = np.diff(np.concatenate([first, [table.num_rows]]))
    sums = [np.add.reduceat(np.asarray(table.column(c)), first) if len(first) else first for c in ("n", "documents")]
    enough = pa.array(np.repeat(sums[1] >= least, size))
    whole = table.append_column("whole", pa.array(np.repeat(sums[0], size).astype(np.int64))).filter(enough)
    whole = whole.set_column(1, "term", whole.column("term").cast(pa.string()))
    return whole.drop_columns(["documents"]).combine_chunks()


def frequencies(docs: DataFrame, least: int = MIN_DOCUMENTS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Occurrences ``n`` of every kept term in every source that has it, and ``whole``, those in its language."""
    out = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("n", pa.int64()), ("whole", pa.int64())])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _POSTING.empty_table()
        for batch in batches:
            if not batch.num_rows:
                continue
            held = _summed(pa.concat_tables([held, pa.table(batch).cast(_POSTING)]))
            # The last term may go on in the next batch.
            last = int(np.flatnonzero(_starts(held, ["lang", "term"]))[-1])
            yield from _kept(held.slice(0, last), least).cast(out).to_batches()
            held = held.slice(last)
        yield from _kept(held, least).cast(out).to_batches()

    sharded = runs(docs, block_rows).repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    return sharded.mapInArrow(merge, "lang string, term string, source string, n long, whole long")


def share(n: Column, words: Column, terms: Column) -> Column:
    """Scaled share of a term with ``n`` of ``words`` occurrences in a vocabulary of ``terms``, at least 1."""
    wide = [c.cast("decimal(20,0)") for c in (n, words, terms)]
    top = (wide[0] + PRIOR) * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", top, wide[1] + wide[2] * PRIOR) + 1


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _both(terms: DataFrame) -> DataFrame:
    """Corrections ``value`` of pairs of sources ``a`` < ``b`` (numbers) that both have a term, added up by task."""

    def added(held: list[np.ndarray]) -> list[np.ndarray]:
        rows = np.concatenate(held, axis=1)
        order = np.lexsort(rows[:3])
        rows = rows[:, order]
        first = np.flatnonzero(np.concatenate([[True], (rows[:3, 1:] != rows[:3, :-1]).any(axis=0)]))
        return [np.concatenate([rows[:3, first], np.add.reduceat(rows[3], first)[None]])]

    def told(rows: np.ndarray, codes: dict[str, int]) -> pa.RecordBatch:
        names = pa.array(list(codes), pa.string()).take(pa.array(rows[0]))
        return pa.RecordBatch.from_arrays([names, *map(pa.array, rows[1:])], ["lang", "a", "b", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        count = 0
        codes: dict[str, int] = {}
        for batch in batches:
            of = batch.column("of")
            flat = of.flatten()
            number, p, none = (np.asarray(flat.field(i)).astype(np.int64) for i in range(3))
            size = np.asarray(of.value_lengths()).astype(np.int64)
            langs = batch.column("lang").dictionary_encode()
            code = np.array([codes.setdefault(x, len(codes)) for x in langs.dictionary.to_pylist()], np.int64)
            lang = np.repeat(code[np.asarray(langs.indices)], size)
            end = np.repeat(np.cumsum(size), size)
            at = np.arange(len(number))
            # Sources of a term are in order: each meets the next one, the one after it, and so on.
            for step in range(1, int(size.max()) if len(size) else 0):
                i = at[at + step < end]
                j = i + step
                value = (
                    _distance(p[i], p[j]) - _distance(p[i], none[j]) - _distance(none[i], p[j]) + _distance(none[i], none[j])
                )
                held.append(np.stack([lang[i], number[i], number[j], value]))
                count += len(i)
                if count >= PAIR_ROWS:
                    held = added(held)
                    count = held[0].shape[1]
                    if count >= PAIR_ROWS // 2:
                        yield told(held[0], codes)
                        held, count = [], 0
        if held:
            yield told(added(held)[0], codes)

    return terms.mapInArrow(run, "lang string, a long, b long, value long")


def divergence(docs: DataFrame, least: int = MIN_DOCUMENTS, top: int = TOP_TERMS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Distances of the sources of each language, and the terms that set a source apart from its language.

    ``docs`` has ``lang``, ``source`` and ``text``; nulls count as empty, each row is a document, and other columns are
    not read. Returns ``lang``, ``source``, ``part``, ``item``, ``value`` and ``rank``. Part ``pair`` has every other source of the
    language, also of groups without terms (value 0 where the language has no kept term); part ``term`` up to ``top`` kept
    terms of which the source has a larger share than its language. A source alone in its language has no pair; empty
    input gives no rows.
    """
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    kept = materialize(frequencies(read, least, block_rows), "frequencies")
    # Every group, with its words and the vocabulary and words of its language; numbers name the sources.
    vocabulary = kept.groupBy("lang").agg(F.count_distinct("term").alias("terms"), F.sum("n").alias("lang_words"))
    words = kept.groupBy(*_GROUP).agg(F.sum("n").alias("words"))
    groups = (
        read.select(*_GROUP).distinct().join(words, _GROUP, "left").join(vocabulary, "lang", "left")
        .withColumn("number", F.row_number().over(W.partitionBy("lang").orderBy("source")).cast("long"))
        .select(
            *_GROUP, "number",
            *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("words", "terms", "lang_words")],
        )
    )
    groups = materialize(groups, "groups").withColumn(
        "none", F.when(F.col("terms") > 0, share(F.lit(0), F.col("words"), F.col("terms"))).otherwise(1)
    )
    known = sized(groups)
    shares = kept.join(known, _GROUP).select(
        *_GROUP, "term", "n", "number", "none",
        share(F.col("n"), F.col("words"), F.col("terms")).alias("p"),
        share(F.col("whole"), F.col("lang_words"), F.col("terms")).alias("q"),
    )
    apart = shares.where("p > q").select(
        *_GROUP, F.lit("term").alias("part"), F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value")
    )
    best = W.partitionBy(*_GROUP).orderBy(F.col("value").desc(), "item")
    apart = apart.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    # Corrections of a source against sources without the term depend on the share alone.
    single = shares.groupBy("lang", "number", "none", "p").agg(F.count("*").alias("times"))
    other = groups.select("lang", F.col("number").alias("b"), F.col("none").alias("none_b"))
    against = (
        single.join(sized(other), "lang").where(F.col("number") != F.col("b"))
        .withColumn("value", F.col("times") * (distance(F.col("p"), F.col("none_b")) - distance(F.col("none"), F.col("none_b"))))
        .groupBy("lang", F.least("number", "b").alias("a"), F.greatest("number", "b").alias("b"))
        .agg(F.sum("value").alias("value"))
    )
    listed = shares.groupBy("lang", "term").agg(
        F.array_sort(F.collect_list(F.struct("number", "p", "none"))).alias("of")
    )
    both = _both(listed.select("lang", "of"))
    corrections = materialize(
        against.unionByName(both).groupBy("lang", "a", "b").agg(F.sum("value").alias("value")), "corrections"
    )
    left, right = (groups.select("lang", *[F.col(c).alias(f"{c}_{s}") for c in ("source", "number", "none", "terms")]) for s in "xy")
    pairs = (
        left.join(sized(right), "lang").where("number_x <> number_y")
        .withColumn("a", F.least("number_x", "number_y")).withColumn("b", F.greatest("number_x", "number_y"))
        .join(corrections, ["lang", "a", "b"], "left")
        .select(
            "lang", F.col("source_x").alias("source"), F.lit("pair").alias("part"), F.col("source_y").alias("item"),
            (F.col("terms_x") * distance(F.col("none_x"), F.col("none_y")) + F.coalesce("value", F.lit(0))).alias("value"),
        )
    )
    pairs = pairs.withColumn("rank", F.row_number().over(best))
    return pairs.unionByName(apart).select(*_GROUP, "part", "item", F.col("value").cast("long").alias("value"), "rank")


def audit(docs: DataFrame) -> DataFrame:
    """Contract of the registered query."""
    return divergence(docs)


AUDIT_SQL = r"""
with d as (
  select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text
  from documents
), each as (
  select r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d
), kept as (
  select lang, term, count(*)::hugeint as whole from each group by lang, term having count(distinct r) >= 10
), counts as (
  select lang, source, term, count(*)::hugeint as n from each group by all
), groups as (
  select distinct lang, source from d
), vocabulary as (
  select lang, count(*)::hugeint as terms, sum(whole)::hugeint as lang_words from kept group by lang
), dense as (
  select g.lang, g.source, k.term, k.whole, coalesce(c.n, 0) as n
  from groups g join kept k using (lang) left join counts c using (lang, source, term)
), words as (
  select lang, source, sum(n)::hugeint as words from dense group by all
), shares as (
  select lang, source, term, n, 1 + 1000000000 * (n + 2) // (words + 2 * terms) as p,
         1 + 1000000000 * (whole + 2) // (lang_words + 2 * terms) as q
  from dense join words using (lang, source) join vocabulary using (lang)
), sums as (
  select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value
  from shares a join shares b using (lang, term) where a.source <> b.source group by all
), pairs as (
  select g.lang, g.source, 'pair' as part, o.source as item, coalesce(value, 0)::bigint as value
  from groups g join groups o on g.lang = o.lang and g.source <> o.source
  left join sums s on s.lang = g.lang and s.source = g.source and s.item = o.source
), apart as (
  select lang, source, 'term' as part, term as item, ((p - q) * (p - q) // (p + q))::bigint as value
  from shares where n > 0 and p > q
), ranked as (
  select *, row_number() over (partition by lang, source, part order by value desc, item) as rank
  from (select * from pairs union all select * from apart)
)
select lang, source, part, item, value, rank::int as rank from ranked where part = 'pair' or rank <= 10
"""
