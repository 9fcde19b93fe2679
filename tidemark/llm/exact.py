"""Exact deduplication by content sort, in DataFrame functions only.

Normalised contents are range partitioned by sampled splitters and sorted externally,
so that equal contents stand next to each other; a window over the sorted rows then compares each
content with its neighbour in full. The sort order is that of the first ``HEAD`` characters, then of
the digest, so that samples and splitters stay small however long texts are, and many texts
with one beginning can still be parted. Large groups of copies are split first: contents are
counted by digest with partial aggregation, and each group of more than ``SHARE_ROWS``
rows is dealt over at most ``SHARES`` shares, which the splitters may part. Neighbours of a share are compared
in full and elect a row; the few elected rows of a group are matched by their SHA-256.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.tables import SPACES
from tidemark.session import materialize, sized

SHARE_ROWS = 256
SHARES = 1024  # of one group, so that its elected rows are few
HEAD = 64  # leading characters that place a content in the sort order


def normalised(text: Column) -> Column:
    """``text`` without space and 0x09-0x0D; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def content_groups(docs: DataFrame, share_rows: int = SHARE_ROWS) -> DataFrame:
    """Group of every row of ``docs(doc_id, text)``.

    Columns ``doc_id``, ``keep_id`` (of the row with the most code points in its original text,
    then the smallest ``doc_id``, nulls last), ``group_size``, ``kept`` (true on exactly
    one row of a group, also where rows repeat) and ``text_sha256`` of the normalised content.
    Texts that are null, empty or all white space form one group. Empty input gives no rows.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.char_length(F.coalesce("text", F.lit(""))).alias("points"),
        normalised(F.col("text").cast("string")).alias("content"),
    ).withColumn("digest", F.sha2("content", 256))
    large = (
        rows.groupBy("digest").agg(F.count("*").alias("n")).where(F.col("n") > share_rows)
        .select("digest", F.least(F.ceil(F.col("n") / share_rows), F.lit(SHARES)).cast("int").alias("shares"))
    )
    large = materialize(large, "large")
    if large.limit(1).count():
        # Ids may repeat too, so rows of one id are dealt by the task that reads them.
        dealt = F.pmod(F.xxhash64("doc_id", F.spark_partition_id()), F.col("shares"))
        rows = rows.join(sized(large), "digest", "left").withColumn(
            "share", F.when(F.col("shares").isNull(), 0).otherwise(dealt).cast("int")
        )
    else:
        rows = rows.withColumn("share", F.lit(0))
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    best = [F.col("points").desc(), F.col("doc_id").asc_nulls_last()]
    same = W.partitionBy("head", "digest", "share", "content")
    first = same.orderBy(*best)
    sorted_rows = (
        rows.withColumn("head", F.substring("content", 1, HEAD))
        .repartitionByRange(width, "head", "digest", "share")
        .select(
            "digest", "share", "doc_id",
            F.row_number().over(first).alias("place"),
            F.first("points").over(first).alias("best_points"),
            F.first("doc_id").over(first).alias("best_id"),
            F.count("*").over(same).alias("n"),
        )
    )
    sorted_rows = materialize(sorted_rows, "sorted")
    # One row per content and share; only large contents have several.
    group = W.partitionBy("digest")
    order = group.orderBy(F.col("best_points").desc(), F.col("best_id").asc_nulls_last(), "share")
    elected = (
        sorted_rows.where("place = 1")
        .select(
            F.col("digest").alias("of"), F.col("share").alias("part"),
            F.first("best_id").over(order).alias("keep_id"),
            (F.row_number().over(order) == 1).alias("wins"),
            F.sum("n").over(group).alias("group_size"),
        )
    )
    return sorted_rows.join(
        elected.hint("merge"), (F.col("digest") == F.col("of")) & (F.col("share") == F.col("part"))
    ).select(
        "doc_id", "keep_id", "group_size",
        ((F.col("place") == 1) & F.col("wins")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, share_rows: int = SHARE_ROWS) -> DataFrame:
    """``docs`` with one row of each group of equal contents; columns unchanged.

    The ids to drop are few, so they are joined and not the ids to keep. Where ids repeat, rows
    are told apart by their content, and of repeats of one row the first by its other columns stays.
    """
    groups = materialize(content_groups(docs, share_rows), "groups")
    names = [f"`{c}`" for c in docs.columns]
    if not docs.groupBy("doc_id").count().where("count > 1").limit(1).count():
        dropped = materialize(groups.where("not kept").select(F.col("doc_id").alias("_dropped")), "dropped")
        return docs.join(sized(dropped), docs["doc_id"].cast("long").eqNullSafe(F.col("_dropped")), "left_anti")
    kept = groups.where("kept").select(F.col("doc_id").alias("_kept_id"), F.col("text_sha256").alias("_digest"))
    row = docs.select(
        F.struct(*names).alias("row"),
        F.col("doc_id").cast("long").alias("of"),
        F.sha2(normalised(F.col("text").cast("string")), 256).alias("content"),
    )
    left = row.join(
        kept.hint("merge"), F.col("of").eqNullSafe(F.col("_kept_id")) & (F.col("content") == F.col("_digest")), "left_semi"
    )
    # Combined before its shuffle, so that a row that repeats very often is one row of each task.
    order = F.struct(*[F.col("row")[c].cast("string") for c in docs.columns])
    return left.groupBy("of", "content").agg(F.min_by("row", order).alias("row")).select("row.*")


EXACT_SQL = r"""
with t as (
  select doc_id, length(coalesce(text, '')) as points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as content
  from documents
), w as (
  select doc_id, content,
         first_value(doc_id) over (partition by content order by points desc, doc_id) as keep_id,
         count(*) over (partition by content) as group_size
  from t
)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(content) as text_sha256 from w
"""
