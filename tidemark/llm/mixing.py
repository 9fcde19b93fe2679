"""Mixing sources to target weights by hash thresholds, in DataFrame functions only.

Each source has a budget of words. Whole passes over a source come first; what is left of its
budget goes to the documents whose hash lies below a threshold, so thresholds of larger budgets
take what smaller ones take and more. Thresholds are found on histograms: words are summed by source
and the leading bits of the hash, the bucket in which the budget runs out is the boundary, and only
its rows are summed again by the next bits, until a boundary holds one hash. Then a filter
takes the documents; nothing is sorted, and a source that holds most rows is 1 024 sums.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.tables import SPACES
from tidemark.session import materialize, sized

WEIGHTS = (5, 2, 1)
SHARE = 1.5  # words of the mix, as a share of all words
MOST = 2  # no document is taken more often
KEY_BITS = 60
STEP_BITS = 10  # of a histogram
RANGE_ROWS = 65_536  # sources that are ordered in one task

_RUN = r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+"
_OWN = ["size", "source_size", "target", "taken"]


def word_count(text: Column) -> Column:
    """Number of words; null has none. Each word with the space behind it becomes one mark."""
    marks = F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), _RUN, "x"), SPACES, "")
    return F.char_length(marks).cast("long")


def hash_key(doc_id: Column, text: Column, seed: int = 0) -> Column:
    """60 bits of the MD5 of an id and a text; null counts as empty."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (doc_id, text)]
    digest = F.md5(F.concat(F.lit(f"{seed}:"), parts[0], F.lit(" "), parts[1]))
    return F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")


def _numbered(sizes: DataFrame) -> DataFrame:
    """Position of every source by code point, null last: slices of the order are numbered apart."""
    order = F.col("source").asc_nulls_last()
    slices = -(-sizes.count() // RANGE_ROWS) or 1
    ranged = materialize(
        sizes.repartitionByRange(slices, order).withColumn("slice", F.spark_partition_id()), "ranged"
    )
    before = W.orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    starts = ranged.groupBy("slice").count().select("slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("at"))
    inside = F.row_number().over(W.partitionBy("slice").orderBy(order))
    return ranged.join(sized(starts), "slice").select("source", "source_size", (F.col("at") + inside - 1).alias("position"))


def targets(
    rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST
) -> DataFrame:
    """Budget of every source of ``rows(source, size)``: ``source``, ``source_size``, ``target``.

    Sources in order of code points, null last, have ``weights`` in turn, and share ``share`` of all
    words by them. No target is above ``most`` times its source's words; what a source cannot take is shared by
    the others by weight, until none is above.
    """
    sizes = materialize(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.col("position") % len(weights) + 1).cast("int"))
    weighed = materialize(_numbered(sizes).withColumn("weight", turn), "weighed")
    whole = weighed.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    level, full = 0.0, (0, 0)
    while whole.words and full[1] < whole.weight:
        level = (share * whole.words - most * full[0]) / (whole.weight - full[1])
        capped = weighed.where(most * F.col("source_size") <= level * F.col("weight"))
        found = capped.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
        now = (found.words or 0, found.weight or 0)
        if now == full:
            break
        full = now
    target = F.least((most * F.col("source_size")).cast("double"), level * F.col("weight").cast("double"))
    return weighed.select("source", "source_size", target.alias("target"))


def thresholds(rows: DataFrame, budgets: DataFrame, step_bits: int = STEP_BITS) -> DataFrame:
    """How often every source is passed in whole, and the hash at which the last pass ends.

    ``rows`` has ``source``, ``size`` and ``key``. Returns ``budgets`` with ``passes``, ``cut``, ``ties`` (rows at the
    cut, which have one id and text) and ``takes`` (of these rows): a budget ends where it is nearest,
    that is a row is taken if the budget reaches its middle.
    """
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    budgets = materialize(
        budgets.withColumn("passes", passes.cast("long"))
        .withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")),
        "budgets",
    )
    known = sized(budgets.select(F.col("source").alias("of"), "rest"))
    edge = rows.where("size > 0").join(known, F.col("source").eqNullSafe(F.col("of"))).select(
        "source", "key", "size", "rest", F.lit(0).cast("long").alias("base")
    )
    upto = W.partitionBy("source").orderBy("bucket")
    for shift in range(KEY_BITS - step_bits, -1, -step_bits):
        summed = edge.groupBy("source", F.shiftright("key", shift).alias("bucket")).agg(
            F.sum("size").alias("words"), F.count("*").alias("ties"), F.min("key").alias("low"),
            F.max("key").alias("high"), F.max("rest").alias("rest"), F.max("base").alias("base"),
        )
        after = F.col("base") + F.sum("words").over(upto)
        boundary = (
            summed.withColumn("after", after).withColumn("base", F.col("after") - F.col("words"))
            .where((F.col("after") > F.col("rest")) & (F.col("base") <= F.col("rest")))
        )
        boundary = materialize(boundary, "boundary")
        if not boundary.where("low < high").limit(1).count():
            break
        held = sized(boundary.select(F.col("source").alias("of"), "low", "high", F.col("base").alias("from")))
        inside = F.col("source").eqNullSafe(F.col("of")) & F.col("key").between(F.col("low"), F.col("high"))
        edge = materialize(
            edge.join(held, inside).select("source", "key", "size", "rest", F.col("from").alias("base")), "edge"
        )
    each = F.col("words") / F.col("ties")
    reached = F.floor((2 * F.col("rest") - 2 * F.col("base") - each) / (2 * each)) + 1
    cuts = boundary.select(
        F.col("source").alias("of"), F.col("high").alias("cut"), "ties",
        F.greatest(F.lit(0), F.least(F.col("ties"), reached)).cast("long").alias("takes"),
    )
    return budgets.join(sized(materialize(cuts, "cuts")), F.col("source").eqNullSafe(F.col("of")), "left").drop("of")


def _nth(tied: DataFrame) -> DataFrame:
    """Number equal rows of a source from 1: parts are numbered apart, as one source may hold very many."""
    part = tied.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    part = materialize(part, "tied")
    before = W.partitionBy("_of").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = part.groupBy(F.col("_source").alias("_of"), "_part").count().select(
        "_of", F.col("_part").alias("_in"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start")
    )
    same = F.col("_source").eqNullSafe(F.col("_of")) & (F.col("_part") == F.col("_in"))
    inside = F.row_number().over(W.partitionBy("_source", "_part").orderBy("_at"))
    return part.join(sized(starts), same).withColumn("_nth", F.col("_start") + inside)


def _taken(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` with ``_source``, ``_size`` and ``_key``, as planned: adds the columns of the mix, drops its own."""
    carried = [f"`{c}`" for c in rows.columns if c not in ("_source", "_size", "_key")]
    known = sized(plan.select(F.col("source").alias("_plan"), *[F.col(c).alias(f"_{c}") for c in plan.columns[1:]]))
    joined = rows.join(known, F.col("_source").eqNullSafe(F.col("_plan"))).drop("_plan")
    at_cut = F.coalesce(F.col("_key") == F.col("_cut"), F.lit(False))
    nth = F.lit(1).cast("long")
    split = at_cut & (F.col("_takes") > 0) & (F.col("_takes") < F.col("_ties"))
    if plan.where("takes > 0 and takes < ties").limit(1).count():
        whole = joined.where(~split).withColumn("_nth", nth)
        joined = whole.unionByName(_nth(joined.where(split)).select(*whole.columns))
    else:
        joined = joined.withColumn("_nth", nth)
    more = F.coalesce(F.col("_key") < F.col("_cut"), F.lit(False)) | (at_cut & (F.col("_nth") <= F.col("_takes")))
    return joined.select(
        *carried, F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"), (F.col("_size") * (F.col("_passes") + more.cast("long"))).alias("taken"),
    )


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(
        *[F.col(f"`{c}`") for c in docs.columns if c.lower() not in _OWN],
        F.col("source").cast("string").alias("_source"), word_count(text).alias("_size"),
        hash_key(F.col("doc_id"), text, seed).alias("_key"),
    )


def mixed(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    seed: int = 0,
) -> DataFrame:
    """``docs(doc_id, text, source)`` with ``size``, ``source_size``, ``target`` and ``taken``; other columns are carried.

    ``taken`` is the words that the mix takes of a document: its ``size`` times 0 to ``most``. The words taken of a
    source differ from its target by half of one document at most. Null and empty texts have size 0 and take nothing; a
    null source is one of its own. Rows that repeat id and text are interchangeable: as many of
    them are taken as fit. Choice depends on seed, ids and texts only, so that reruns agree. Empty input gives no rows.
    """
    rows = _sized(docs, seed)
    narrow = materialize(
        rows.select(F.col("_source").alias("source"), F.col("_size").alias("size"), F.col("_key").alias("key")), "sizes"
    )
    return _taken(rows, thresholds(narrow, targets(narrow, weights, share, most)))


def mixture(docs: DataFrame) -> DataFrame:
    """Contract of the registered query: words taken of every document. Texts are read once."""
    rows = materialize(_sized(docs.select("doc_id", "text", "source"), 0).drop("text", "source"), "sizes")
    narrow = rows.select(F.col("_source").alias("source"), F.col("_size").alias("size"), F.col("_key").alias("key"))
    return _taken(rows, thresholds(narrow, targets(narrow)))


MIX_SQL = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
         md5('0:' || coalesce(doc_id::varchar, '') || ' ' || coalesce(text, ''))[1:15] as key
  from documents
), s as (
  select source, sum(size)::double as source_size, row_number() over (order by source nulls last) as n from d group by source
), w as (
  select *, [5.0, 2.0, 1.0][(n - 1) % 3 + 1]::double as weight from s
), o as (
  select *, 2 * source_size / weight as ratio,
         sum(source_size) over (order by 2 * source_size / weight, n) - source_size as size_before,
         sum(weight) over (order by 2 * source_size / weight, n) - weight as weight_before,
         sum(source_size) over () as size_all, sum(weight) over () as weight_all
  from w
), l as (
  select *, (1.5 * size_all - 2 * size_before)::double / (weight_all - weight_before) as level from o
), t as (
  select source, source_size,
         coalesce(least(2 * source_size, (select level from l where ratio > level order by ratio, n limit 1) * weight),
                  2 * source_size) as target
  from w
), p as (
  select d.*, source_size, target, case when source_size > 0 then floor(target / source_size) else 0 end as passes,
         sum(size) over (partition by d.source order by key rows unbounded preceding) - size as before
  from d join t on d.source is not distinct from t.source
)
select doc_id, size::bigint as size, source_size::bigint as source_size, target,
       (size * (passes + case when 2 * before + size <= 2 * (target - passes * source_size) then 1 else 0 end))::bigint as taken
from p
"""
