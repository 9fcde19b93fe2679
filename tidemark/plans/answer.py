"""Answer many range requests at once; every outcome is a row, none an exception."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions import clock
from tidemark.functions.identity import identity_problem, is_digest
from tidemark.operators import coverage, digest, requests as asks, scan
from tidemark.schemas import SERIES
from tidemark.session import materialize

TIERED = [*SERIES, "tier"]


def judge(
    requests: DataFrame,
    catalog: DataFrame,
    max_rows: int = fixed.MAX_ANSWER_ROWS,
    extend: Callable[[DataFrame], DataFrame] = lambda judged: judged,
):
    """(refused requests, requests with pieces, frontier and status by coverage).

    Every later step starts from these tables, one row per request. They are written
    to shared scratch once, so that neither the rules nor the catalog join run again
    for each step, and a lost executor does not bring them back. ``extend`` adds columns
    to the second table before it is written.
    """
    normal = materialize(asks.normalize_requests(requests, max_rows), "requests")
    refused = normal.where("status is not null")
    planned = coverage.serve_plan(normal.where("status is null"), catalog)
    partial = F.col("frontier") < F.col("end_stored")
    adjusted = F.col("adjust") != fixed.ADJUST_NONE
    empty = F.col("frontier") <= F.col("start_stored")
    status = (
        F.when(F.col("mixed_versions"), "ERROR")
        .when(partial & (adjusted | ~F.col("allow_partial") | empty), "MISS")
        .when(partial, "PARTIAL")
        .otherwise("HIT")
    )
    reason = (
        F.when(F.col("mixed_versions"), "read_failed")
        .when(partial & adjusted, "adjustment_requires_complete_range")
        .when(F.col("status") == "MISS", "uncovered_range")
    )
    detail = F.when(F.col("mixed_versions"), "data_version")
    judged = (
        planned.withColumn("status", status)
        .withColumn("reason", reason)
        .withColumn("detail", detail)
    )
    return refused, materialize(extend(judged), "judged")


def selected_rows(
    judged: DataFrame, bars: DataFrame, suspensions: DataFrame | None = None
) -> DataFrame:
    """Rows of all served requests up to each limit, hidden rows still marked."""
    served = judged.where("status in ('HIT', 'PARTIAL')")
    pieces = served.select(
        "request_id", *SERIES, "max_rows", F.explode("pieces").alias("p")
    ).select("request_id", *SERIES, "max_rows", "p.*")
    return scan.first_n(pieces, bars, suspensions, TIERED)


def outcome(refused: DataFrame, judged: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per request: status, reason, coverage, sources and row counts."""
    seen = rows.groupBy("request_id").agg(
        F.sum("visible").alias("_rows"),
        F.sum(F.col("confirmed").cast("int")).alias("_omitted"),
        F.sum(
            ((F.col("null_class") != "normal") & ~F.col("confirmed")).cast("int")
        ).alias("_unclassified"),
        F.sum(F.col("utc_ms").isNull().cast("int")).alias("_unclocked"),
        F.min(F.when(F.col("visible") == 1, F.col("utc_ms"))).alias("_first"),
        F.max(F.when(F.col("visible") == 1, F.col("utc_ms"))).alias("_last"),
    )
    df = judged.join(seen, "request_id", "left")
    null_rows = F.coalesce(F.col("_unclassified") > 0, F.lit(False))
    bad_clock = F.coalesce(F.col("_unclocked") > 0, F.lit(False))
    failed = null_rows | bad_clock
    df = (
        df.withColumn("status", F.when(failed, "ERROR").otherwise(F.col("status")))
        .withColumn("reason", F.when(failed, "invalid_request").otherwise(F.col("reason")))
        .withColumn(
            "detail",
            F.when(null_rows, "unclassified_null")
            .when(bad_clock, "wall_clock")
            .otherwise(F.col("detail")),
        )
    )
    served = F.col("status").isin("HIT", "PARTIAL")
    open_end = F.col("status").isin("PARTIAL", "MISS")
    cursor = clock.served_ms(F.col("frontier"), F.col("market"))
    answered = df.select(
        "request_id",
        "status",
        "reason",
        "detail",
        F.when(served, F.coalesce("_rows", F.lit(0))).alias("rows"),
        F.when(served, F.col("_first")).alias("first_ms"),
        F.when(served, F.col("_last")).alias("last_ms"),
        F.when(served, F.coalesce("_omitted", F.lit(0))).alias("omitted_rows"),
        F.when(served, cursor).alias("coverage_end_ms"),
        F.when(open_end, cursor).alias("uncovered_from_ms"),
        F.when(served, F.coalesce(F.col("_rows") == F.col("max_rows"), F.lit(False))).alias(
            "row_limit_reached"
        ),
        F.when(served, F.array_join("sources", ",")).alias("sources"),
    )
    early = refused.select("request_id", "status", "reason", "detail")
    return answered.unionByName(early, allowMissingColumns=True)


def answer_digests(
    judged: DataFrame, rows: DataFrame, encoding: str = fixed.ENCODING_NATIVE, payload: bool = False
) -> DataFrame:
    """Row count and SHA-256, on request also the packed bytes, of each served answer.

    ``judged`` and ``rows`` are what ``judge`` and ``selected_rows`` return. Records carry
    instants. An answer without rows has the digest of nothing; one that fails for its rows
    has none. The row limits of the requests bound each group.
    """
    bad = ((F.col("null_class") != "normal") & ~F.col("confirmed")) | F.col("utc_ms").isNull()
    failed = rows.where(bad).select("request_id").distinct()
    shown = rows.where("visible = 1").withColumn("ts_ms", F.col("utc_ms"))
    found = digest.rows_digest(shown, ["request_id"], encoding, payload)
    served = judged.where("status in ('HIT', 'PARTIAL')").select("request_id")
    whole = served.join(failed, "request_id", "left_anti").join(found, "request_id", "left")
    filled = whole.withColumn("rows", F.coalesce("rows", F.lit(0))).withColumn(
        "rows_sha256", F.coalesce("rows_sha256", F.sha2(F.lit(""), 256))
    )
    if payload:
        filled = filled.withColumn("data", F.coalesce("data", F.lit(b"")))
    return filled


def answer_requests(
    requests: DataFrame,
    catalog: DataFrame,
    bars: DataFrame,
    suspensions: DataFrame | None = None,
    max_rows: int = fixed.MAX_ANSWER_ROWS,
) -> DataFrame:
    """HIT, PARTIAL, MISS or ERROR for every request, answered from complete coverage.

    ``bars`` and ``catalog`` carry a ``tier`` column (history or intraday).
    """
    refused, judged = judge(requests, catalog, max_rows)
    return outcome(refused, judged, selected_rows(judged, bars, suspensions))


def merge_tiers(requests: DataFrame, catalog: DataFrame, bars: DataFrame) -> DataFrame:
    """Rows of each request from the tier that serves them, archive first."""
    _, judged = judge(requests, catalog)
    pieces = judged.select(
        "request_id", *SERIES, F.explode("pieces").alias("p")
    ).select("request_id", *SERIES, "p.*")
    rows = scan.rows_of_slices(scan.piece_slices(pieces), bars, TIERED)
    return rows.drop("slice_no", "lo", "hi")


def plan_requests(
    requests: DataFrame,
    catalog: DataFrame,
    enabled: bool = True,
    healthy: bool = True,
    max_rows: int = fixed.SNAPSHOT_ROWS,
) -> DataFrame:
    """Offline form: requests name a data version; HIT only for complete coverage.

    ``max_rows`` is the most that a request may ask for.
    """
    names = ["dataset", "market", "symbol", "period_seconds", "adjust"]
    invalid = (
        identity_problem(*[F.col(c) for c in names]).isNotNull()
        | ~F.coalesce(
            (F.col("start_stored") >= 0)
            & (F.col("end_stored") > F.col("start_stored"))
            & F.col("max_rows").between(1, max_rows),
            F.lit(False),
        )
        | ~is_digest(F.col("data_version"))
    )
    reached = coverage.coverage_frontier(requests, catalog, ["data_version"]).select(
        "request_id", "frontier", "complete"
    )
    off = not (enabled and healthy)
    unsupported = (F.col("period_seconds") != fixed.PERIOD_SECONDS) | (
        F.col("adjust") != fixed.ADJUST_NONE
    )
    result = (
        F.when(invalid, "ERROR")
        .when(F.lit(off), "BYPASS")
        .when(~unsupported & F.col("complete"), "HIT")
        .otherwise("MISS")
    )
    reason = (
        F.when(invalid, "invalid_query")
        .when(F.lit(off), "unhealthy" if enabled else "disabled")
        .when(unsupported, "unsupported_series")
        .when(F.col("complete"), "complete_coverage")
        .otherwise("uncovered_range_or_version")
    )
    return (
        requests.join(reached, "request_id", "left")
        .withColumn("result", result)
        .withColumn("reason", reason)
    )
