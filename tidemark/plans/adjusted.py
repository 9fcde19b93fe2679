"""Adjusted answers: complete coverage, the requested factor window, the returned anchor."""

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions import clock
from tidemark.operators import adjust, digest
from tidemark.plans import answer
from tidemark.session import materialize

SET_COLUMNS = [
    "model",
    "first_day",
    "end_day",
    "allow_empty",
    "observed_at_ms",
    "valid_until_ms",
    "data_hash",
]


MODELS = [fixed.MODEL_CUMULATIVE, fixed.MODEL_AFFINE]


def _bind(requests: DataFrame, factor_sets: DataFrame, factors: DataFrame, now_ms: Column):
    """Add the factor set of each request and the first reason it cannot be used."""
    # Whether any event is in reach is a fact of the symbol's first one.
    first = factors.groupBy("symbol").agg(F.min("day").alias("_first"))
    sets = factor_sets.select(
        "symbol", "market", *[F.col(c).alias(f"set_{c}") for c in SET_COLUMNS]
    ).join(first, "symbol", "left")
    df = (
        requests.withColumn("ask_first", clock.stored_day(F.col("start_stored"), F.col("market")))
        .withColumn("ask_last", clock.stored_day(F.col("end_stored") - 1, F.col("market")))
        .join(sets, ["symbol", "market"], "left")
    )
    cumulative = F.col("set_model") == fixed.MODEL_CUMULATIVE
    # In reach: cumulative sets need an event up to the last asked day, affine any event.
    horizon = F.when(cumulative, F.col("ask_last")).otherwise(F.lit(fixed.LAST_CIVIL_DAY))
    reached = F.coalesce(F.col("_first") <= horizon, F.lit(False))
    problem = (
        F.when(F.col("set_model").isNull(), "factors_missing")
        .when(F.col("set_observed_at_ms") > now_ms, "future_dated")
        .when(
            (F.col("ask_first") < F.col("set_first_day"))
            | (F.col("ask_last") >= F.col("set_end_day")),
            "factor_window",
        )
        .when(~reached & ~F.col("set_allow_empty"), "no_factors")
    )
    return df.withColumn("factor_problem", problem).drop("_first")


def adjusted_rows(
    served: DataFrame, rows: DataFrame, factors: DataFrame
) -> DataFrame:
    """Adjusted visible rows of the served requests, both models."""
    terms = served.where("factor_problem is null").select(
        "request_id", F.col("adjust").alias("mode"), "set_model", F.col("ask_last").alias("last_day")
    )
    shown = (
        rows.where("visible = 1")
        .withColumn("local_day", clock.stored_day(F.col("ts_ms"), F.col("market")))
        .join(terms, "request_id")
    )
    # A model that no set has would read all rows for nothing.
    found = terms.where(F.col("set_model").isin(MODELS)).select("set_model").distinct().collect()
    parts = [
        adjust.adjust(
            shown.where(F.col("set_model") == model),
            factors.where(F.col("model") == model),
            model,
            ["request_id"],
        )
        for model in sorted(r.set_model for r in found) or MODELS[:1]
    ]
    return functools.reduce(DataFrame.unionByName, parts)


def adjusted_query(
    requests: DataFrame,
    catalog: DataFrame,
    bars: DataFrame,
    suspensions: DataFrame,
    factor_sets: DataFrame,
    factors: DataFrame,
    now_ms: Column,
) -> tuple[DataFrame, DataFrame]:
    """(outcome per request, adjusted rows) for requests with ``adjust`` set.

    The factor window is taken from the requested days, the forward anchor from the
    last row that was returned; truncating an answer therefore moves its anchor.
    """
    refused, judged = answer.judge(
        requests, catalog, extend=lambda df: _bind(df, factor_sets, factors, now_ms)
    )
    # At most the row limit per request, stored; outcome, lookups and anchors all read it.
    rows = answer.selected_rows(judged, bars, suspensions)
    result = answer.outcome(refused, judged, rows)
    adjusted = adjusted_rows(judged.where("status in ('HIT', 'PARTIAL')"), rows, factors)
    anchors = adjusted.groupBy("request_id").agg(
        F.max("anchor_day").alias("anchor_day"), F.min("adjust_ok").alias("_fits")
    )
    terms = judged.select(
        "request_id",
        F.col("factor_problem"),
        F.col("set_data_hash").alias("factor_set_hash"),
        F.col("set_model").alias("model"),
        clock.check_status(
            F.col("set_observed_at_ms"), F.col("set_valid_until_ms"), now_ms
        ).alias("factor_check_status"),
    )
    hit = F.col("status") == "HIT"
    missing_set = hit & F.col("factor_problem").isNotNull()
    too_large = hit & F.coalesce(~F.col("_fits"), F.lit(False))
    df = result.join(terms, "request_id", "left").join(anchors, "request_id", "left")
    df = df.withColumns(
        {
            "status": F.when(missing_set | too_large, "ERROR").otherwise(F.col("status")),
            "reason": F.when(missing_set, "read_failed")
            .when(too_large, "invalid_request")
            .otherwise(F.col("reason")),
            "detail": F.when(missing_set, F.col("factor_problem"))
            .when(too_large, "price_overflow")
            .otherwise(F.col("detail")),
        }
    )
    served = F.col("status") == "HIT"
    for name in [
        "rows",
        "first_ms",
        "last_ms",
        "omitted_rows",
        "coverage_end_ms",
        "row_limit_reached",
        "sources",
        "factor_set_hash",
        "model",
        "factor_check_status",
        "anchor_day",
    ]:
        df = df.withColumn(name, F.when(served, F.col(name)))
    return df.drop("factor_problem", "_fits"), adjusted


def merge_prefix_tail(prefix: DataFrame, tail: DataFrame, terms: DataFrame) -> DataFrame:
    """Raw prefix and tail of each request as one sequence, with its problem if any.

    ``terms`` has request_id, start_ms, end_ms, split_ms and prefix_rows. Rows are
    numbered by part and time; a time both parts hold is a break of order. A request
    that lacks all its rows is one row without a time, with its problem.
    """
    parts = prefix.withColumn("part", F.lit(0)).unionByName(tail.withColumn("part", F.lit(1)))
    df = parts.join(terms, "request_id")
    misplaced = (
        F.when(
            (F.col("split_ms") <= F.col("start_ms")) | (F.col("split_ms") > F.col("end_ms")),
            "boundary",
        )
        .when((F.col("ts_ms") < F.col("start_ms")) | (F.col("ts_ms") >= F.col("end_ms")), "range")
        .when((F.col("part") == 0) & (F.col("ts_ms") >= F.col("split_ms")), "prefix_side")
        .when((F.col("part") == 1) & (F.col("ts_ms") < F.col("split_ms")), "tail_side")
        .when(
            F.col("open").isNull()
            | F.col("high").isNull()
            | F.col("low").isNull()
            | F.col("close").isNull(),
            "null_price",
        )
    )
    # Equal times in one request: with each part on its side of the split, the only
    # way for the merged sequence not to increase strictly.
    copies = df.groupBy("request_id", "ts_ms").agg(F.count(F.lit(1)).alias("_copies"))
    checked = (
        df.join(copies, ["request_id", "ts_ms"])
        .withColumn("_bad", F.coalesce(misplaced, F.when(F.col("_copies") > 1, "order")))
    )
    found = checked.groupBy("request_id").agg(
        F.min("_bad").alias("_found"), F.sum((F.col("part") == 0).cast("int")).alias("_prefix")
    )
    # From the terms, so that a request without any row still has its verdict.
    short = F.coalesce("_prefix", F.lit(0)) != F.col("prefix_rows")
    verdict = terms.join(found, "request_id", "left").select(
        "request_id", F.coalesce("_found", F.when(short, "prefix_rows")).alias("problem")
    )
    merged = checked.drop("_copies", "_bad").join(verdict, "request_id")
    empty = verdict.where("problem is not null").join(
        checked.select("request_id").distinct(), "request_id", "left_anti"
    )
    return merged.unionByName(empty.join(terms, "request_id"), allowMissingColumns=True)


def adjust_composite(
    prefix: DataFrame,
    tail: DataFrame,
    terms: DataFrame,
    factors: DataFrame,
    model: str = fixed.MODEL_CUMULATIVE,
) -> tuple[DataFrame, DataFrame]:
    """Adjust externally merged raw rows with one factor version.

    ``terms`` further has mode, market and last_day, and may declare ``rows_sha256``,
    which is compared with the digest of the merged rows. Returns adjusted rows of
    sound requests and the problems of the others.
    """
    merged = materialize(merge_prefix_tail(prefix, tail, terms), "merged")
    problems = merged.where("problem is not null").select("request_id", "problem").distinct()
    if "rows_sha256" in terms.columns:
        present = merged.where("ts_ms is not null")
        found = digest.rows_digest(present, ["request_id"], fixed.ENCODING_NATIVE)
        found = found.select("request_id", F.col("rows_sha256").alias("_found"))
        nothing = F.sha2(F.lit(""), 256)
        wrong = (
            terms.select("request_id", F.col("rows_sha256").alias("_declared"))
            .join(found, "request_id", "left")
            .where(F.col("_declared") != F.coalesce("_found", nothing))
            .select("request_id", F.lit("digest").alias("problem"))
        )
        problems = problems.unionByName(
            wrong.join(problems.select("request_id"), "request_id", "left_anti")
        )
    sound = merged.join(problems.select("request_id"), "request_id", "left_anti")
    sound = sound.withColumn(
        "local_day", clock.local_civil_day(F.col("ts_ms"), F.col("market"))
    )
    adjusted = adjust.adjust(sound, factors, model, ["request_id"])
    return adjusted.drop("problem", "start_ms", "end_ms", "split_ms", "prefix_rows"), problems
