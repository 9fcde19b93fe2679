"""Rows for many range requests in one pass over the bars."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import clock
from tidemark.operators import quality, visibility
from tidemark.operators.ordered import SLICE
from tidemark.schemas import SERIES
from tidemark.session import materialize, sized


def half_open(start: str, end: str, at: str = "ts_ms"):
    """Rows from ``start`` on and before ``end``."""
    return (F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))


def piece_slices(pieces: DataFrame) -> DataFrame:
    """Cut (request, lo, hi) pieces into exchange-local days."""
    market = F.col("market")
    days = F.sequence(
        clock.stored_day(F.col("lo"), market), clock.stored_day(F.col("hi") - 1, market)
    )
    return pieces.where("hi > lo").withColumn(SLICE, F.explode(days))


def rows_of_slices(slices: DataFrame, bars: DataFrame, keys: list[str]) -> DataFrame:
    """Join day slices of requests to bars on series and day.

    A join key is one day of one series, whatever the size of the series. Few slices
    are broadcast (after counting them), so the bars are only scanned; where bars come
    with their ``yyyymm`` partition, it joins too and prunes the scan.
    """
    cut = bars.withColumn(SLICE, clock.stored_day(F.col("ts_ms"), F.col("market")))
    # Both sides are sorted by the keys in this order, and few values of the others differ.
    on = ["symbol", SLICE, *[k for k in keys if k != "symbol"]]
    wanted = slices
    if "yyyymm" in bars.columns:
        wanted = wanted.withColumn(
            "yyyymm", F.date_format(clock.day_date(F.col(SLICE)), "yyyyMM")
        )
        on = [*on, "yyyymm"]
    return sized(wanted).join(cut, on).where(half_open("lo", "hi"))


def range_scan(bars: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rows of each (request_id, series, lo, hi) range."""
    wanted = ranges.select("request_id", *SERIES, "lo", "hi")
    return rows_of_slices(piece_slices(wanted), bars, SERIES).drop(SLICE, "lo", "hi")


def with_reach(slices: DataFrame, reach: DataFrame) -> DataFrame:
    """Day slices with what was counted for them; neither side is ever broadcast.

    Slices were exploded from pieces, so the optimizer, which sees the size of the
    pieces, would gather them on the driver.
    """
    return slices.hint("merge").join(reach, ["request_id", SLICE])


def first_n(
    pieces: DataFrame,
    bars: DataFrame,
    suspensions: DataFrame | None = None,
    keys: list[str] | None = None,
) -> DataFrame:
    """The earliest ``max_rows`` visible rows of each request, with what they hid.

    ``pieces`` has request_id, the join ``keys``, market, lo, hi and max_rows. A row
    is kept while fewer than ``max_rows`` visible rows precede it, so placeholders
    never use up the limit and those behind the last visible row are not counted.

    A first pass only counts visible rows per piece and day, from times alone and
    where the join leaves them; the second pass then reads just the days the limit
    reaches, and numbers rows inside one day. Only placeholders meet the suspensions.
    """
    keys = keys or SERIES
    slices = piece_slices(pieces)
    shown = F.lit(1) if suspensions is None else (quality.null_class() == "normal").cast("int")
    month = [c for c in ["yyyymm"] if c in bars.columns]
    times = bars.select(*keys, "ts_ms", *month, shown.alias("visible"))
    counts = rows_of_slices(slices, times, keys).groupBy(*slices.columns).agg(F.sum("visible").alias("_n"))
    # Earlier days, whatever the pieces of a day.
    before = (
        Window.partitionBy("request_id")
        .orderBy(SLICE)
        .rangeBetween(Window.unboundedPreceding, -1)
    )
    reach = counts.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    # Request days within reach: written once, so that they can be counted for the join.
    needed = materialize(reach.where("_off < max_rows"), "slices")
    inside = (
        Window.partitionBy("request_id", SLICE)
        .orderBy("ts_ms")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    rows = (
        rows_of_slices(needed, bars, keys)
        .withColumn("utc_ms", clock.served_ms(F.col("ts_ms"), F.col("market")))
        .withColumn("null_class", F.lit("normal") if suspensions is None else quality.null_class())
        .withColumn("visible", (F.col("null_class") == "normal").cast("int"))
        .withColumn("_seen", F.coalesce(F.sum("visible").over(inside), F.lit(0)))
        .where(F.col("_seen") + F.col("_off") < F.col("max_rows"))
        .drop("_seen", "_off", SLICE, "lo", "hi")
    )
    if suspensions is None:
        return rows.withColumn("confirmed", F.lit(False))
    stored = materialize(rows, "reached")
    days_off = sized(materialize(visibility.suspension_days(suspensions), "suspensions"))
    hidden = F.col("null_class") == "suspended"
    held = visibility.mark_suspension_days(stored.where(hidden), days_off, "utc_ms")
    # Stated again, so that steps that ask for visible rows leave the join out.
    return stored.where(~hidden).withColumn("confirmed", F.lit(False)).unionByName(
        held.withColumn("visible", F.lit(0))
    )


def read_summary(rows: DataFrame, keys: list[str], at: str = "ts_ms") -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(at).alias("first_ms"),
        F.max(at).alias("last_ms"),
    )
