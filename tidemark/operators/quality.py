"""Row and catalog quality: each check returns the offending rows as data."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions import identity, numbers
from tidemark.operators import ordered
from tidemark.schemas import SERIES

PRICES = ["open", "high", "low", "close"]


def null_class() -> Column:
    """normal, suspended (the placeholder shape) or unexpected_null."""
    missing = F.lit(False)
    for p in PRICES:
        missing = missing | F.col(p).isNull()
    placeholder = (
        F.col("open").isNull()
        & F.col("close").isNull()
        & (F.col("high") == 0)
        & (F.col("low") == 0)
        & (F.col("volume") == 0)
        & (F.col("open_oi") == 0)
        & (F.col("close_oi") == 0)
    )
    return (
        F.when(F.coalesce(placeholder, F.lit(False)), "suspended")
        .when(missing, "unexpected_null")
        .otherwise("normal")
    )


def null_price_class(bars: DataFrame) -> DataFrame:
    return bars.withColumn("null_class", null_class())


def row_problems(native: bool = True, nullable: Column | None = None) -> Column:
    """Array of broken rules of one row, empty when the row is valid."""
    allowed = F.lit(False) if nullable is None else nullable
    rules = [("negative_ts", F.col("ts_ms") < 0)]
    for p in PRICES:
        rules.append((f"nonfinite_{p}", ~numbers.finite(F.col(p))))
        rules.append((f"null_{p}", F.col(p).isNull() & ~allowed))
    rules.append(("negative_volume", F.col("volume") < 0))
    counts = ["open_oi", "close_oi"] if native else ["open_interest"]
    rules += [(f"negative_{c}", F.col(c) < 0) for c in counts]
    if not native:
        rules.append(("nonfinite_turnover", ~numbers.finite(F.col("turnover"))))
    return F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules]), F.isnotnull)


def row_violations(
    bars: DataFrame, native: bool = True, nullable: Column | None = None
) -> DataFrame:
    """Offending rows with all their reasons, comma separated in rule order."""
    return (
        bars.withColumn("reasons", F.array_join(row_problems(native, nullable), ","))
        .where(F.col("reasons") != "")
    )


def project_rows(bars: DataFrame, encoding: str) -> DataFrame:
    """Rows as clients of ``encoding`` read them: float prices, NULL as NaN.

    A column the encoding needs but the source lacks is an error, never filled in. A price
    that single precision cannot hold is NaN too, and named in ``price_problem``.
    """
    extra = {
        fixed.ENCODING_LEGACY: [],
        fixed.ENCODING_COMPLETE: ["turnover", "open_interest"],
        fixed.ENCODING_NATIVE: ["open_oi", "close_oi"],
    }[encoding]
    need = [*SERIES, "ts_ms", *PRICES, "volume", *extra]
    lacking = [c for c in need if c not in bars.columns]
    if lacking:
        raise ValueError(f"source lacks {', '.join(lacking)} for {encoding}")
    prices = [numbers.client_price(F.col(p)).alias(p) for p in PRICES]
    over = F.concat_ws(",", *[F.when(~numbers.fits_float(F.col(p)), p) for p in PRICES])
    problem = F.when(over != "", over).alias("price_problem")
    return bars.select(*SERIES, "ts_ms", *prices, "volume", *extra, problem)


def validate_symbols(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "problem", identity.symbol_problem(F.col("symbol"), F.col("market"))
    )


def validate_identity(df: DataFrame) -> DataFrame:
    names = ["dataset", "market", "symbol", "period_seconds", "adjust"]
    return df.withColumn("problem", identity.identity_problem(*[F.col(c) for c in names]))


def order_violations(bars: DataFrame, row_no: str | None = None) -> DataFrame:
    """Rows whose time does not exceed that of the row before them.

    ``row_no`` is the position in the source. Without it a table has no order to
    check, and only repeated times can be found.
    """
    if row_no is None:
        repeats = bars.groupBy(*SERIES, "ts_ms").agg(F.count(F.lit(1)).alias("copies"))
        return repeats.where(F.col("copies") > 1)
    seen = ordered.with_previous(bars, SERIES, [row_no], ["ts_ms"], ordered.RECORDS)
    return seen.where(F.col("ts_ms") <= F.col("prev_ts_ms"))


def gap_profile(bars: DataFrame) -> DataFrame:
    """How often each step between neighbouring bars, and each change of step, occurs.

    One window per day lags twice; the last two times of each day are carried over days.
    """
    day = ordered.with_slice(bars.select(*SERIES, "ts_ms"), "ts_ms", ordered.DAY)
    inside = Window.partitionBy(*SERIES, ordered.SLICE).orderBy("ts_ms")
    local = day.select(
        "*",
        F.row_number().over(inside).alias("_rn"),
        F.lag("ts_ms", 1).over(inside).alias("_one"),
        F.lag("ts_ms", 2).over(inside).alias("_two"),
    )
    over = Window.partitionBy(*SERIES).orderBy(ordered.SLICE)
    # Largest and second largest time; a day has at most its minutes.
    two = F.slice(F.sort_array(F.collect_list("ts_ms"), asc=False), 1, 2)
    tails = day.groupBy(*SERIES, ordered.SLICE).agg(two.alias("_t")).select(
        *SERIES, ordered.SLICE, F.get("_t", F.lit(0)).alias("_last"), F.get("_t", F.lit(1)).alias("_next")
    )
    tails = tails.withColumn("_next", F.coalesce("_next", F.lag("_last").over(over)))
    carried = tails.select(
        *SERIES, ordered.SLICE, F.lag("_last").over(over).alias("_p1"), F.lag("_next").over(over).alias("_p2")
    )
    first, second = F.col("_rn") == 1, F.col("_rn") == 2
    one = F.when(first, F.col("_p1")).otherwise(F.col("_one"))
    two = F.when(first, F.col("_p2")).when(second, F.col("_p1")).otherwise(F.col("_two"))
    return (
        local.join(carried, [*SERIES, ordered.SLICE])
        .select((F.col("ts_ms") - one).alias("delta"), (one - two).alias("_before"))
        .where("delta is not null")
        .groupBy("delta", (F.col("delta") - F.col("_before")).alias("delta_of_delta"))
        .agg(F.count(F.lit(1)).alias("bars"))
    )


def catalog_violations(catalog: DataFrame) -> DataFrame:
    """Catalog entries that may not be published, with their reasons.

    Entries of one series are a few per month, so a window per series is small.
    """
    by_series = Window.partitionBy("epoch", "generation", "tier", "series_id").orderBy(
        "cov_start", "cov_end"
    )
    earlier = by_series.rowsBetween(Window.unboundedPreceding, -1)
    expected = identity.series_id(
        F.col("dataset"),
        F.col("market"),
        F.col("symbol"),
        F.col("period_seconds"),
        F.col("adjust"),
    )
    checks = [
        ("identity", F.col("_identity").isNotNull()),
        ("series_id", F.col("series_id") != expected),
        ("coverage", (F.col("cov_start") < 0) | (F.col("cov_end") <= F.col("cov_start"))),
        (
            "unsupported_series",
            (F.col("period_seconds") != fixed.PERIOD_SECONDS)
            | (F.col("adjust") != fixed.ADJUST_NONE),
        ),
        (
            "version",
            (F.col("source_version") <= 0) | ~identity.is_digest(F.col("data_version")),
        ),
        (
            "nullable_dataset",
            F.col("nullable_prices") & (F.col("dataset") != fixed.DATASET_NATIVE),
        ),
        ("duplicate_start", F.col("_prev_start") == F.col("cov_start")),
        ("overlap", F.col("_prev_end") > F.col("cov_start")),
        ("mixed_data_version", F.col("_prev_version") != F.col("data_version")),
        (
            "object",
            F.col("content_hash").isNotNull() != (F.col("row_count") != 0),
        ),
        ("object_digest", ~identity.is_digest(F.col("content_hash"))
         & F.col("content_hash").isNotNull()),
    ]
    names = ["dataset", "market", "symbol", "period_seconds", "adjust"]
    marked = (
        catalog.withColumn("_identity", identity.identity_problem(*[F.col(c) for c in names]))
        .withColumn("_prev_start", F.lag("cov_start").over(by_series))
        .withColumn("_prev_end", F.max("cov_end").over(earlier))
        .withColumn("_prev_version", F.lag("data_version").over(by_series))
    )
    reasons = F.filter(F.array(*[F.when(bad, F.lit(n)) for n, bad in checks]), F.isnotnull)
    return (
        marked.withColumn("reasons", F.array_join(reasons, ","))
        .where(F.col("reasons") != "")
        .drop("_identity", "_prev_start", "_prev_end", "_prev_version")
    )
