"""Price adjustment for corporate actions.

Factors are looked up per (symbol, civil day), never per bar: the distinct days of
a symbol are at most the calendar, so the window that carries the last event
forward stays small even when one symbol owns a third of the bars, and the join
back to the bars has one day of one symbol as its key.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions import clock, numbers
from tidemark.operators.quality import PRICES
from tidemark.session import sized


def factor_asof(days: DataFrame, events: DataFrame, values: list[str]) -> DataFrame:
    """Last event on or before each (symbol, day), NULL values where there is none."""
    asked = days.select(
        "symbol",
        F.col("day").cast("int").alias("day"),
        F.lit(1).alias("_ask"),
        F.lit(None).cast(events.select(F.struct(*values).alias("v")).schema["v"].dataType).alias("_v"),
    ).distinct()
    known = events.select(
        "symbol",
        F.col("day").cast("int").alias("day"),
        F.lit(0).alias("_ask"),
        F.struct(*values).alias("_v"),
    )
    so_far = (
        Window.partitionBy("symbol")
        .orderBy("day", "_ask")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    carried = F.last("_v", ignorenulls=True).over(so_far)
    return (
        known.unionByName(asked)
        .withColumn("_v", carried)
        .where("_ask = 1")
        .select("symbol", "day", *[F.col("_v")[v].alias(v) for v in values])
    )


def bars_asof(
    bars: DataFrame, events: DataFrame, values: list[str], day: str = "local_day"
) -> DataFrame:
    """Bars with the event values in force on their civil day."""
    found = factor_asof(bars.select("symbol", F.col(day).alias("day")), events, values)
    return bars.join(found.withColumnRenamed("day", day), ["symbol", day], "left")


def affine_maps(factors: DataFrame) -> DataFrame:
    """Composed affine maps per event: price * a + b in force from its day on.

    Forward maps compose the events after the day, nearest last; backward maps those
    up to the day, earliest first. A first row per symbol, before all its events,
    holds the maps of the days before them. Running products and sums add one event
    at a time, so the order of the floating-point operations is fixed.
    """
    first = factors.groupBy("symbol").agg(F.lit(fixed.FIRST_CIVIL_DAY - 1).alias("day"))
    same = {"fa": 1.0, "fb": 0.0, "ba": 1.0, "bb": 0.0}
    rows = factors.select(
        "symbol",
        F.col("day").cast("int").alias("day"),
        "fa",
        F.coalesce("fb", F.lit(0.0)).alias("fb"),
        "ba",
        F.coalesce("bb", F.lit(0.0)).alias("bb"),
    ).unionByName(first.select("symbol", "day", *[F.lit(v).alias(k) for k, v in same.items()]))
    later = (
        Window.partitionBy("symbol")
        .orderBy(F.col("day").desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    ascending = Window.partitionBy("symbol").orderBy("day")
    before = ascending.rowsBetween(Window.unboundedPreceding, -1)
    so_far = ascending.rowsBetween(Window.unboundedPreceding, 0)

    def one(x: Column) -> Column:
        return F.coalesce(x, F.lit(1.0))

    return (
        rows.withColumn("suffix_a", one(F.product("fa").over(later)))
        .withColumn("_f", F.col("fb") * F.col("suffix_a"))
        .withColumn("suffix_b", F.coalesce(F.sum("_f").over(later), F.lit(0.0)))
        .withColumn("prefix_a", one(F.product("ba").over(so_far)))
        .withColumn("_b", F.col("bb") * one(F.product("ba").over(before)))
        .withColumn("prefix_b", F.sum("_b").over(so_far))
        .select("symbol", "day", "suffix_a", "suffix_b", "prefix_a", "prefix_b")
    )


WINDOW_DAYS = 256  # of one slice of a window


def factor_window(factors: DataFrame, windows: DataFrame, model: str) -> DataFrame:
    """Events each (request_id, symbol, first_day, end_day) window works with.

    Cumulative: the events inside and the last one before. Affine: all events.
    """
    if model == fixed.MODEL_AFFINE:
        return windows.join(factors, "symbol")
    before = windows.select("symbol", (F.col("first_day") - 1).alias("day")).distinct()
    carry = factor_asof(
        before, factors.withColumn("carry_day", F.col("day")), ["carry_day"]
    ).select("symbol", (F.col("day") + 1).alias("first_day"), "carry_day")
    known = windows.join(carry, ["symbol", "first_day"], "left")
    slice_of = lambda day: clock.floor_div(day.cast("bigint"), WINDOW_DAYS)
    cut = known.where(F.col("end_day") > F.col("first_day")).withColumn(
        "_slice", F.explode(F.sequence(slice_of(F.col("first_day")), slice_of(F.col("end_day") - 1)))
    )
    # Windows meet events by symbol and slice of days; the event carried in has a day of its own.
    within = (
        cut.join(factors.withColumn("_slice", slice_of(F.col("day"))), ["symbol", "_slice"])
        .where((F.col("day") >= F.col("first_day")) & (F.col("day") < F.col("end_day")))
        .drop("_slice", "carry_day")
    )
    early = F.col("carry_day").isNotNull() & (F.col("carry_day") < F.col("first_day")) & (F.col("carry_day") < F.col("end_day"))
    carried = known.where(early).withColumn("day", F.col("carry_day")).join(factors, ["symbol", "day"])
    return within.unionByName(carried.select(within.columns))


def forward_anchor(rows: DataFrame, keys: list[str], factor: str = "factor") -> DataFrame:
    """Factor of the last returned row of each request, added to all its rows."""
    anchors = rows.groupBy(*keys).agg(
        F.max_by(factor, "ts_ms").alias("anchor"), F.max("local_day").alias("anchor_day")
    )
    return rows.join(anchors, keys)


def adjust(
    rows: DataFrame,
    factors: DataFrame,
    model: str,
    keys: list[str],
    mode: str = "mode",
    last_day: str = "last_day",
) -> DataFrame:
    """Adjusted prices of the final, already truncated rows of each request.

    ``rows`` carries ``local_day``, the mode column (forward or backward) and the
    last day the request asked for. Cumulative prices are rounded to cents, affine
    ones are not, and without any event in reach prices stay as they are. NULL stays
    NULL. ``adjust_ok`` is false where a result does not fit a client record.
    """
    forward = F.col(mode) == "forward"
    if model == fixed.MODEL_CUMULATIVE:
        days = rows.select("symbol", F.col("local_day").alias("day"))
        on_day = factor_asof(days, factors, ["cum"]).withColumnRenamed("day", "local_day")
        # Whether any factor is in force by the last day is a fact of the symbol's first one.
        first = factors.where("cum is not null").groupBy("symbol").agg(F.min("day").alias("_first"))
        df = (
            rows.join(on_day, ["symbol", "local_day"], "left")
            .join(sized(first), "symbol", "left")
            .withColumn("_any", F.coalesce(F.col("_first") <= F.col(last_day), F.lit(False)))
            .withColumn("factor", F.coalesce("cum", F.lit(1.0)))
            .drop("_first")
        )
        df = forward_anchor(df, keys).withColumn(
            "_scale", F.when(forward, F.col("factor") / F.col("anchor")).otherwise(F.col("factor"))
        )

        def price(p: str) -> Column:
            return F.when(F.col("_any"), numbers.round2(F.col(p) * F.col("_scale"))).otherwise(
                F.col(p)
            )

        spare = ["cum", "_any", "_scale", "factor", "anchor"]
    else:
        maps = affine_maps(factors)
        names = ["suffix_a", "suffix_b", "prefix_a", "prefix_b"]
        df = bars_asof(rows, maps, names)
        a = F.when(forward, F.col("suffix_a")).otherwise(F.col("prefix_a"))
        b = F.when(forward, F.col("suffix_b")).otherwise(F.col("prefix_b"))
        df = df.withColumn("_a", a).withColumn("_b", b)
        df = df.withColumn("anchor_day", F.lit(None).cast("int"))

        def price(p: str) -> Column:
            moved = F.col(p) * F.col("_a") + F.col("_b")
            return F.when(F.col("_a").isNotNull(), moved).otherwise(F.col(p))

        spare = [*names, "_a", "_b"]
    df = df.withColumns({p: price(p) for p in PRICES})
    fits = F.lit(True)
    for p in PRICES:
        fits = fits & F.coalesce(numbers.fits_float(F.col(p)), F.lit(True))
    return (
        df.withColumn("adjust_ok", fits)
        .withColumn("anchor_day", F.when(forward, F.col("anchor_day")))
        .drop(*spare)
    )


def latest_revision(factor_rows: DataFrame) -> DataFrame:
    """One row per factor day, the last updated; equal update times are ambiguous."""
    keys = ["symbol", "market", "day"]
    rest = [c for c in factor_rows.columns if c not in [*keys, "update_ms"]]
    # Two levels: revisions sharing an update time first, so ties are counted exactly.
    tied = factor_rows.groupBy(*keys, "update_ms").agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.struct(*rest)).alias("_row")
    )
    last = tied.groupBy(*keys).agg(
        F.max("update_ms").alias("_at"),
        F.max_by("_row", "update_ms").alias("_row"),
        F.max("_n").alias("_ties"),
        F.sum("_n").alias("revisions"),
    )
    return last.select(
        *keys,
        *[F.col("_row")[c].alias(c) for c in rest],
        F.col("_at").alias("update_ms"),
        "revisions",
        (F.col("_ties") > 1).alias("ambiguous"),
    )
