"""Range requests as a table: normal form, or the status that ends them early."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions import clock, identity
from tidemark.operators.steps import bind

# Optional request columns and the value a request without them has.
DEFAULTS = {
    "max_rows": fixed.MAX_ANSWER_ROWS,
    "period_seconds": fixed.PERIOD_SECONDS,
    "adjust": fixed.ADJUST_NONE,
    "row_encoding": fixed.ENCODING_LEGACY,
    "include_intraday": False,
    "allow_partial": False,
    "protocol_version": 1,
    "timestamp_semantics": "utc-instant-ms",
    "range_semantics": "half-open",
}


def normalize_requests(
    requests: DataFrame, max_rows: int = fixed.MAX_ANSWER_ROWS
) -> DataFrame:
    """Add market, dataset, slug and stored range; first failing rule sets status.

    ``status`` stays NULL for a request that can go on to the catalog. ``max_rows`` is
    the most that a request may ask for; any number will do.
    """
    df = requests
    for name, default in DEFAULTS.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(default))
    dataset = F.lit(None).cast("string")
    for encoding, name in fixed.DATASET_OF_ENCODING.items():
        dataset = F.when(F.col("row_encoding") == encoding, name).otherwise(dataset)
    in_bounds = clock.request_bounds(F.col("start_ms"), F.col("end_ms")) & F.coalesce(
        F.col("max_rows").between(1, max_rows), F.lit(False)
    )
    named = F.struct(
        dataset.alias("dataset"),
        identity.classify_market(F.col("symbol")).alias("market"),
        in_bounds.alias("in_bounds"),
    )

    def place(n: Column) -> Column:
        # Conversions see only ranges inside the clock, so no arithmetic can overflow.
        stored = [
            clock.stored_ms(F.when(n["in_bounds"], F.col(c)), n["market"]).alias(s)
            for c, s in [("start_ms", "start_stored"), ("end_ms", "end_stored")]
        ]
        slug = identity.slug(F.col("symbol"), n["market"]).alias("slug")
        placed = F.struct(
            *[n[c].alias(c) for c in ["dataset", "market", "in_bounds"]], slug, *stored
        )
        return bind(placed, judge)

    def judge(p: Column) -> Column:
        rule = F.lit(0)
        for n, bad in reversed(list(enumerate(_broken(p), 1))):
            rule = F.when(F.coalesce(bad, F.lit(True)), n).otherwise(rule)
        names = ["dataset", "market", "slug", "start_stored", "end_stored"]
        return F.struct(*[p[c].alias(c) for c in names], rule.alias("rule"))

    df = df.withColumn("_n", bind(named, place))
    # Rule 0 means none is broken: the lists start with NULL.
    verdict = [
        F.get(F.array(F.lit(None).cast("string"), *[F.lit(r[i]) for r in RULES]), F.col("_n.rule"))
        .alias(name)
        for i, name in enumerate(["status", "reason", "detail"])
    ]
    places = ["dataset", "market", "slug", "start_stored", "end_stored"]
    return df.select("*", *[F.col(f"_n.{c}") for c in places], *verdict).drop("_n")


# Status, reason and detail of each rule, in the order they apply.
RULES = [
    ("ERROR", "invalid_request", "row_encoding"),
    ("ERROR", "invalid_request", "protocol"),
    ("ERROR", "invalid_request", "bounds"),
    ("MISS", "unsupported_series", "series"),
    ("ERROR", "invalid_request", "symbol"),
    ("MISS", "unsupported_adjustment_market", "market"),
    ("ERROR", "invalid_request", "wall_clock"),
    ("ERROR", "invalid_request", "native_only"),
]


def _broken(p: Column) -> list[Column]:
    """True (or NULL) for each rule of ``RULES`` that a request breaks."""
    native = p["dataset"] == fixed.DATASET_NATIVE
    adjusted = F.col("adjust") != fixed.ADJUST_NONE
    return [
        p["dataset"].isNull(),
        (F.col("protocol_version") != 1)
        | (F.col("timestamp_semantics") != "utc-instant-ms")
        | (F.col("range_semantics") != "half-open"),
        ~p["in_bounds"],
        (F.col("period_seconds") != fixed.PERIOD_SECONDS)
        | (adjusted & ~(native & F.col("adjust").isin("forward", "backward"))),
        p["market"].isNull(),
        adjusted & ~p["market"].isin(fixed.ADJUSTABLE_MARKETS),
        p["start_stored"] >= p["end_stored"],
        (F.col("include_intraday") | F.col("allow_partial")) & ~native,
    ]


def partition_key(df: DataFrame) -> DataFrame:
    """Routing names of a bar: series slug, month and day of its archive parts."""
    day = clock.stored_day(F.col("ts_ms"), F.col("market"))
    return (
        df.withColumn("slug", identity.slug(F.col("symbol"), F.col("market")))
        .withColumn("month_key", F.date_format(clock.day_date(day), "yyyyMM"))
        .withColumn("day_key", F.date_format(clock.day_date(day), "yyyyMMdd"))
    )
