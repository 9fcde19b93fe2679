"""Trading suspensions: hide confirmed placeholders, report everything else NULL."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions import clock
from tidemark.operators import quality
from tidemark.session import materialize, sized

DAY = fixed.DAY_MS


def suspension_days(suspensions: DataFrame) -> DataFrame:
    """Confirmed intervals cut by day and merged: disjoint pieces per symbol and day."""
    days = F.sequence(
        clock.floor_div(F.col("start_ms"), DAY), clock.floor_div(F.col("end_ms") - 1, DAY)
    )
    cut = (
        suspensions.where("end_ms > start_ms")
        .select("symbol", "start_ms", "end_ms", F.explode(days).alias("slice_no"))
        .select(
            "symbol",
            "slice_no",
            F.greatest(F.col("start_ms"), F.col("slice_no") * DAY).alias("lo"),
            F.least(F.col("end_ms"), (F.col("slice_no") + 1) * DAY).alias("hi"),
        )
        .distinct()
    )
    order = Window.partitionBy("symbol", "slice_no").orderBy("lo", "hi")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.col("lo") > F.coalesce(F.max("hi").over(earlier), F.lit(-1))
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    return (
        cut.withColumn("_fresh", fresh.cast("int"))
        .withColumn("_island", F.sum("_fresh").over(so_far))
        .groupBy("symbol", "slice_no", "_island")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .drop("_island")
    )


def mark_suspension_days(rows: DataFrame, days: DataFrame, instant: str = "ts_ms") -> DataFrame:
    """Add ``null_class`` and ``confirmed``; no row is added or lost.

    Pieces of one day are disjoint, so a bar meets at most one of them, and the
    join key (symbol, day) holds at most one day of bars.
    """
    marked = rows.withColumn("null_class", quality.null_class()).withColumn(
        "_at", clock.floor_div(F.col(instant), DAY)
    )
    left, right = marked.alias("b"), days.withColumnRenamed("slice_no", "_day").alias("s")
    hit = (
        (F.col("b.symbol") == F.col("s.symbol"))
        & (F.col("b._at") == F.col("s._day"))
        & (F.col("b.null_class") == "suspended")
        & (F.col(f"b.{instant}") >= F.col("s.lo"))
        & (F.col(f"b.{instant}") < F.col("s.hi"))
    )
    return left.join(right, hit, "left").select(
        "b.*", F.col("s.lo").isNotNull().alias("confirmed")
    ).drop("_at")


def mark_suspensions(rows: DataFrame, suspensions: DataFrame, instant: str = "ts_ms") -> DataFrame:
    """``mark_suspension_days`` from confirmed intervals."""
    days = materialize(suspension_days(suspensions), "suspensions")
    return mark_suspension_days(rows, sized(days), instant)


def suspension_filter(bars: DataFrame, suspensions: DataFrame) -> DataFrame:
    """Bars without confirmed placeholders; NULL rows left over are unconfirmed."""
    return mark_suspensions(bars, suspensions).where("not confirmed").drop("confirmed")
