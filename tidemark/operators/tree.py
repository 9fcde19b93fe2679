"""A stored tree of digests: what two snapshots differ in, and proof of a range, by descent.

Leaves are the days of a series. Inner nodes hash their children: 32 days, 32 of these, the series, and then groups of series
by the first digits of their id, up to one root. A node has few children at every level, so two trees are
compared from the root down, reading only children of nodes that differ, and a range is proved
by the nodes on its path.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions import clock, identity
from tidemark.operators import digest, snapshot
from tidemark.schemas import SERIES
from tidemark.session import materialize, sized

DAYS_BITS = 5  # 32 children of the levels below a series
LEVELS = 7
NODE = ["key", "slot"]
FEW = 1000  # parents that are looked up by their names, so that statistics skip the rest


def _parent(level: int) -> tuple[Column, Column]:
    """Name of the parent of a node: ``key`` (id of a series or its first digits) and ``slot`` (of days)."""
    key, slot = F.col("key"), F.col("slot")
    if level < 2:
        return key, F.shiftright(slot, DAYS_BITS)
    none = F.lit(0).cast("bigint")
    return (key if level == 2 else F.substring(key, 1, {3: 4, 4: 2, 5: 0}[level])), none


def leaves(bars: DataFrame) -> DataFrame:
    """One row for each day of each series: the series, ``key``, ``slot``, ``rows`` and ``digest``.

    The digest covers the exact bytes of the rows in any order, and is combined before its shuffle.
    """
    day = clock.floor_div(F.col("ts_ms"), fixed.DAY_MS)
    return (
        digest.with_words(bars).groupBy(*SERIES, day.alias("slot"))
        .agg(F.count(F.lit(1)).alias("rows"), snapshot.content_sum().alias("_sum"))
        .select(
            *SERIES, identity.series_id(*[F.col(c) for c in SERIES]).alias("key"), "slot", "rows",
            snapshot.content_hash(F.col("rows"), F.col("_sum")).alias("digest"),
        )
    )


def _above(level: DataFrame, number: int) -> DataFrame:
    key, slot = _parent(number)
    child = F.concat_ws("/", "key", F.col("slot").cast("string"), "digest")
    lines = F.array_join(F.array_sort(F.collect_list(child)), "\n")
    return level.groupBy(key.alias("key"), slot.alias("slot")).agg(
        F.sum("rows").alias("rows"), F.sha2(lines, 256).alias("digest")
    )


def build_tree(bars: DataFrame, path: str) -> None:
    """Write the tree of a snapshot: a folder for each ``level``, children of one parent next to each other."""
    level = leaves(bars)
    for number in range(LEVELS):
        key, slot = _parent(number) if number < LEVELS - 1 else (F.lit(""), F.lit(0).cast("bigint"))
        named = level.withColumns({"parent_key": key, "parent_slot": slot})
        folder = f"{path}/level={number}"
        named.repartitionByRange("parent_key", "parent_slot", "slot").sortWithinPartitions("parent_key", "parent_slot", "slot").write.parquet(folder)
        if number < LEVELS - 1:
            level = _above(bars.sparkSession.read.parquet(folder), number)


def nodes(spark: SparkSession, path: str, level: int) -> DataFrame:
    return spark.read.parquet(f"{path}/level={level}")


def _children(level: DataFrame, parents: DataFrame, few: list | None) -> DataFrame:
    """Nodes of the given parents; names of few parents reach the scan as a filter."""
    if few is not None:
        level = level.where(F.col("parent_key").isin(sorted({r.key for r in few})))
    held = sized(parents.select(F.col("key").alias("parent_key"), F.col("slot").alias("parent_slot")))
    return level.join(held, ["parent_key", "parent_slot"], "left_semi")


def differing_days(spark: SparkSession, left: str, right: str) -> DataFrame:
    """Days of series whose rows differ between two trees, or that only one has: the series and ``slot``.

    Level after level, only children of differing nodes are read.
    """
    open_ = None
    for number in range(LEVELS - 1, -1, -1):
        sides = [nodes(spark, path, number) for path in (left, right)]
        if open_ is not None:
            few = open_.limit(FEW + 1).collect()
            sides = [_children(side, open_, few if len(few) <= FEW else None) for side in sides]
        columns = [*(SERIES if number == 0 else []), *NODE]
        a, b = (s.select(*columns, F.col("digest").alias(f"_{n}")) for s, n in zip(sides, "ab"))
        open_ = a.join(b, columns, "full").where(~F.col("_a").eqNullSafe(F.col("_b"))).select(*columns)
        open_ = materialize(open_, "differing")
    return open_


def snapshot_tree_diff(left: DataFrame, right: DataFrame, left_tree: str, right_tree: str, cols: list[str]) -> DataFrame:
    """Rows of ``exact_rows_diff`` of two snapshots with stored trees, reading only the days that differ."""
    days = differing_days(left.sparkSession, left_tree, right_tree)
    return snapshot.exact_rows_diff(*[rows_of_days(side, days) for side in (left, right)], cols)


def rows_of_days(bars: DataFrame, days: DataFrame) -> DataFrame:
    """Bars of the listed days (``slot``); the months of few days reach the scan as a filter."""
    spread = days.agg(F.min("slot").alias("a"), F.max("slot").alias("b")).first()
    if spread.a is not None:
        bars = bars.where((F.col("ts_ms") >= spread.a * fixed.DAY_MS) & (F.col("ts_ms") < (spread.b + 1) * fixed.DAY_MS))
    slot = clock.floor_div(F.col("ts_ms"), fixed.DAY_MS)
    return bars.withColumn("slot", slot).join(sized(days.select(*SERIES, "slot")), [*SERIES, "slot"], "left_semi").drop("slot")


def range_problems(bars: DataFrame, path: str, days: DataFrame) -> DataFrame:
    """What the stored tree does not vouch for in the bars of the listed days (series and ``slot``).

    One row for each node on the paths of the days that fails: ``level``, ``key``, ``slot``, ``problem``. A leaf fails if its digest is not
    that of the bars given for its day (``content``), an inner node if its digest is not that of its stored children (``children``).
    Only the bars of these days, and the children of nodes on their paths, are read.
    """
    spark = bars.sparkSession
    wanted = materialize(days.select(*SERIES, F.col("slot").cast("bigint").alias("slot")).distinct(), "wanted")
    wanted = wanted.withColumn("key", identity.series_id(*[F.col(c) for c in SERIES]))
    found = leaves(rows_of_days(bars, wanted)).select(*NODE, F.col("digest").alias("_found"))
    path_nodes = materialize(wanted.select(*NODE).distinct(), "path")
    stored = nodes(spark, path, 0).join(sized(path_nodes), NODE, "left_semi").select(*NODE, F.col("digest").alias("_stored"))
    bad = stored.join(found, NODE, "full").where(~F.col("_stored").eqNullSafe(F.col("_found")))
    out = bad.select(F.lit(0).alias("level"), *NODE, F.lit("content").alias("problem"))
    for number in range(1, LEVELS):
        key, slot = _parent(number - 1)
        path_nodes = materialize(path_nodes.select(key.alias("key"), slot.alias("slot")).distinct(), "path")
        few = path_nodes.limit(FEW + 1).collect()
        below = _children(nodes(spark, path, number - 1), path_nodes, few if len(few) <= FEW else None)
        again = _above(below, number - 1).select(*NODE, F.col("digest").alias("_found"))
        stored = nodes(spark, path, number).join(sized(path_nodes), NODE, "left_semi").select(*NODE, F.col("digest").alias("_stored"))
        bad = stored.join(again, NODE, "full").where(~F.col("_stored").eqNullSafe(F.col("_found")))
        out = out.unionByName(bad.select(F.lit(number).alias("level"), *NODE, F.lit("children").alias("problem")))
    return out
