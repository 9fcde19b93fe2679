"""Row order within a key, without ever sorting a whole key in one task.

Every key is cut into slices along its order column (a day of bars, 65 536
records of a log). Windows run inside (key, slice); a summary with one row per
slice is carried across slices and joined back. The summary is thousands of
times smaller than the data, so a key that holds a third of all rows still
spreads over as many tasks as it has slices.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions.clock import floor_div

DAY = fixed.DAY_MS
RECORDS = 65536
SLICE = "slice_no"


def with_slice(df: DataFrame, order: str, width: int) -> DataFrame:
    return df.withColumn(SLICE, floor_div(F.col(order), width))


def _inside(keys: list[str], order: list[str]) -> Window:
    return Window.partitionBy(*keys, SLICE).orderBy(*order)


def _before(keys: list[str]) -> Window:
    return (
        Window.partitionBy(*keys)
        .orderBy(SLICE)
        .rowsBetween(Window.unboundedPreceding, -1)
    )


def with_row_number(
    df: DataFrame, keys: list[str], order: list[str], width: int = DAY, out: str = "rn"
) -> DataFrame:
    """1-based position of each row in its key, ordered by ``order``.

    The first order column defines the slices and must be a BIGINT.
    """
    df = with_slice(df, order[0], width)
    sizes = df.groupBy(*keys, SLICE).agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select(
        *keys, SLICE, F.coalesce(F.sum("_n").over(_before(keys)), F.lit(0)).alias("_off")
    )
    numbered = df.withColumn("_rn", F.row_number().over(_inside(keys, order)))
    return (
        numbered.join(offsets, [*keys, SLICE])
        .withColumn(out, F.col("_rn") + F.col("_off"))
        .drop("_rn", "_off", SLICE)
    )


def with_previous(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    cols: list[str],
    width: int = DAY,
    prefix: str = "prev_",
) -> DataFrame:
    """Values of ``cols`` in the preceding row of the key, NULL in the first."""
    df = with_slice(df, order[0], width)
    place = F.struct(*[F.col(c) for c in order])
    last = F.max_by(F.struct(*[F.col(c) for c in cols]), place)
    tails = df.groupBy(*keys, SLICE).agg(last.alias("_tail"))
    carried = tails.select(
        *keys,
        SLICE,
        F.lag("_tail").over(Window.partitionBy(*keys).orderBy(SLICE)).alias("_carry"),
    )
    inside = _inside(keys, order)
    local = df.withColumn("_rn", F.row_number().over(inside))
    for c in cols:
        local = local.withColumn(f"_lag_{c}", F.lag(c).over(inside))
    joined = local.join(carried, [*keys, SLICE])
    for c in cols:
        value = F.when(F.col("_rn") == 1, F.col("_carry")[c]).otherwise(F.col(f"_lag_{c}"))
        joined = joined.withColumn(prefix + c, value)
    return joined.drop("_rn", "_carry", SLICE, *[f"_lag_{c}" for c in cols])


def with_running_max(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    value: Column,
    width: int = DAY,
    out: str = "max_before",
) -> DataFrame:
    """Largest ``value`` among the earlier rows of the key, NULL in the first."""
    df = with_slice(df, order[0], width).withColumn("_v", value)
    tops = df.groupBy(*keys, SLICE).agg(F.max("_v").alias("_top"))
    carried = tops.select(*keys, SLICE, F.max("_top").over(_before(keys)).alias("_carry"))
    inside = _inside(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.withColumn("_max", F.max("_v").over(inside))
        .join(carried, [*keys, SLICE])
        .withColumn(out, F.greatest("_max", "_carry"))
        .drop("_v", "_max", "_carry", SLICE)
    )
