"""Operational logs: usage, health, publication attempts, hash chains, retention."""

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.operators import ordered
from tidemark.session import materialize, sized


FEW = 200  # logs whose heads are told to a scan one by one


def transfer_usage(log: DataFrame, budgets: DataFrame) -> DataFrame:
    """Totals per stage against its budget; a stage without budget is over it."""
    used = log.groupBy("stage").agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("requests").alias("requests"),
        F.sum("bytes").alias("bytes"),
        F.sum("elapsed_us").alias("elapsed_us"),
        F.sum("failures").alias("failures"),
    )
    return (
        used.join(budgets, "stage", "left")
        .withColumn(
            "within_budget",
            F.coalesce(
                (F.col("requests") <= F.col("max_requests"))
                & (F.col("bytes") <= F.col("max_bytes")),
                F.lit(False),
            ),
        )
        .drop("max_requests", "max_bytes")
    )


def severity(codes: Column) -> Column:
    """critical unless every code is soft; ok without codes."""
    soft = F.array(*[F.lit(c) for c in fixed.SOFT_CODES])
    return (
        F.when(F.size(F.array_except(codes, soft)) > 0, "critical")
        .when(F.size(codes) > 0, "warning")
        .otherwise("ok")
    )


def health_rollup(reports: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct sorted codes and severity per key; ``code`` is NULL for a clean report.

    Codes come from a short fixed vocabulary, so the set gathered per key is small.
    """
    codes = F.sort_array(F.collect_set("code"))
    return (
        reports.groupBy(*keys)
        .agg(codes.alias("_codes"), F.count(F.lit(1)).alias("reports"))
        .withColumn("severity", severity(F.col("_codes")))
        .withColumn("codes", F.array_join("_codes", ","))
        .drop("_codes")
    )


def publication_audit(
    events: DataFrame, key: str = "candidate", order: str = "idx"
) -> DataFrame:
    """Outcome of each candidate from its attempt log.

    An attempt not followed by a result is pending; followed by another attempt, or
    with an unknown result, its outcome is historically unknown. A commit settles
    both; records after it, and results without an attempt, break the log.
    """
    seen = ordered.with_previous(events, [key], [order], ["kind"], ordered.RECORDS)
    attempt = F.col("kind") == "attempt"
    after_attempt = F.coalesce(F.col("prev_kind") == "attempt", F.lit(False))
    per = seen.groupBy(key).agg(
        F.count(F.lit(1)).alias("records"),
        F.max_by("kind", order).alias("_last"),
        F.max((F.col("kind") == "committed") & after_attempt).alias("_committed"),
        F.min(F.when(F.col("kind") == "committed", F.col(order))).alias("_commit_at"),
        F.max(order).alias("_last_at"),
        F.max((attempt & after_attempt) | (F.col("kind") == "unknown")).alias("_unknown"),
        F.max(~attempt & ~after_attempt).alias("_orphan"),
    )
    late = F.coalesce(F.col("_last_at") > F.col("_commit_at"), F.lit(False))
    status = (
        F.when(F.col("_orphan"), "corrupt")
        .when(late, "corrupt")
        .when(F.col("_committed"), "committed")
        .when(F.col("_last") == "attempt", "pending")
        .when(F.col("_unknown"), "historically_unknown")
        .otherwise("not_applied")
    )
    return per.select(
        key,
        "records",
        status.alias("status"),
        (F.col("_unknown") & ~F.col("_committed")).alias("historical_unknown"),
    )


def hash_chain_breaks(
    events: DataFrame, key: str, order: str, payload: list[str], seed: Column
) -> DataFrame:
    """Records of an append-only log whose index, link or own hash is wrong.

    ``order`` is the storage position, ``idx`` the recorded one. The first record
    links to ``seed``.
    """
    numbered = ordered.with_row_number(events, [key], [order], ordered.RECORDS, "_place")
    linked = ordered.with_previous(numbered, [key], [order], ["hash"], ordered.RECORDS, "_prev_")
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in payload])
    problem = (
        F.when(F.col("idx") != F.col("_place"), "index")
        .when(F.sha2(text, 256) != F.col("hash"), "hash")
        .when(F.col("prev_hash") != F.coalesce("_prev_hash", seed), "link")
    )
    return linked.withColumn("problem", problem).where("problem is not null").drop(
        "_place", "_prev_hash"
    )


def hash_chain_heads(events: DataFrame, key: str, order: str) -> DataFrame:
    """Last record of each log, to verify on from there: ``key``, ``head``, ``head_place`` (records up to it), ``head_hash``."""
    return events.groupBy(key).agg(
        F.max(order).alias("head"), F.count(F.lit(1)).alias("head_place"), F.max_by("hash", order).alias("head_hash")
    )


def hash_chain_suffix(
    events: DataFrame, heads: DataFrame, key: str, order: str, payload: list[str], seed: Column, all_known: bool = False
) -> DataFrame:
    """Breaks behind the verified heads: with those found up to the heads, all of ``hash_chain_breaks``.

    Verifies each log from its head on, and one without a head in full; where ``all_known`` says that none is without, only
    records from the heads on are read. The head itself is read again: its hash vouches for all
    records before it, so a head that is gone, or has another hash than was verified, is the problem ``prefix``, and its
    log has to be verified from the start.
    """
    heads = materialize(heads.select(key, "head", "head_place", "head_hash"), "heads")
    if all_known:
        # Heads of few logs reach the scan one by one, of many by the earliest.
        few = heads.limit(FEW + 1).collect()
        if len(few) <= FEW:
            behind = [(F.col(key) == F.lit(r[key])) & (F.col(order) >= F.lit(r["head"])) for r in few]
            events = events.where(functools.reduce(Column.__or__, behind, F.lit(False)))
        else:
            events = events.where(F.col(order) >= F.lit(heads.agg(F.min("head")).first()[0]))
    rest = events.join(sized(heads), key, "left").where(F.col("head").isNull() | (F.col(order) >= F.col("head")))
    numbered = ordered.with_row_number(rest, [key], [order], ordered.RECORDS, "_place")
    place = F.col("_place") + F.coalesce(F.col("head_place") - 1, F.lit(0))
    linked = ordered.with_previous(numbered, [key], [order], ["hash"], ordered.RECORDS, "_prev_")
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in payload])
    is_head = F.coalesce(F.col(order) == F.col("head"), F.lit(False))
    problem = (
        F.when(is_head, F.when(F.col("hash") != F.col("head_hash"), "prefix"))
        .when(F.col("idx") != place, "index")
        .when(F.sha2(text, 256) != F.col("hash"), "hash")
        .when(F.col("prev_hash") != F.coalesce("_prev_hash", seed), "link")
    )
    found = linked.withColumn("problem", problem).where("problem is not null")
    found = found.drop("_place", "_prev_hash", "head", "head_place", "head_hash")
    there = rest.where(F.col(order) == F.col("head")).select(key)
    lost = heads.join(there.hint("merge"), key, "left_anti").select(key, F.col("head").alias(order), F.lit("prefix").alias("problem"))
    return found.unionByName(lost, allowMissingColumns=True)


def retention_select(
    results: DataFrame, keys: list[str], keep: int, age_s: int, now_s: Column,
    active: DataFrame | None = None, at_most: int = 8,
) -> DataFrame:
    """Finished results to archive: not the newest ``keep``, old enough, not active.

    At most ``at_most`` per key and run, newest first; the rest follow in later runs.
    Each limit runs as a ranked filter, so a large key is cut before its shuffle.
    """
    done = results.where("phase in ('ROLLED_BACK', 'ACCEPTED')")
    newest = Window.partitionBy(*keys).orderBy(
        F.col("updated_s").desc(), F.col("transaction_id").desc()
    )
    kept = done.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= keep)
    rest = done.join(
        kept.select(*keys, "transaction_id"), [*keys, "transaction_id"], "left_anti"
    ).where(now_s - F.col("updated_s") >= age_s)
    if active is not None:
        rest = rest.join(active, [*keys, "transaction_id"], "left_anti")
    return (
        rest.withColumn("_rank", F.row_number().over(newest))
        .where(F.col("_rank") <= at_most)
        .drop("_rank")
    )


def stale_monitor(
    reports: DataFrame,
    now_s: Column,
    stale_s: int = 180,
    stale_hold_s: int = 60,
    fault_s: int = 120,
    failed_s: int = 300,
) -> DataFrame:
    """Alerts that hold now: no report lately, a fault or a failed delivery persisting.

    A state persists since the first report after the last one without it. That
    needs two aggregates per instance and no ordering of its reports.
    """

    def since(bad: str) -> tuple[Column, Column]:
        return (
            F.max(F.when(~F.col(bad), F.col("observed_s"))).alias(f"_clear_{bad}"),
            F.max_by(bad, "observed_s").alias(f"_now_{bad}"),
        )

    df = reports.groupBy("instance", "observed_s").agg(
        F.max("faulty").alias("faulty"), F.max("send_failed").alias("send_failed")
    )
    last = df.groupBy("instance").agg(
        F.max("observed_s").alias("last_s"), *since("faulty"), *since("send_failed")
    )
    # One row per instance: counted, so that reports of a busy instance need not meet in one task.
    joined = df.join(sized(last), "instance")
    starts = joined.groupBy("instance").agg(
        *[
            F.min(
                F.when(
                    F.col("observed_s") > F.coalesce(F.col(f"_clear_{bad}"), F.lit(-1)),
                    F.col("observed_s"),
                )
            ).alias(f"_since_{bad}")
            for bad in ["faulty", "send_failed"]
        ]
    )
    df = last.join(starts, "instance")

    def holds(bad: str, seconds: int) -> Column:
        return F.coalesce(
            F.col(f"_now_{bad}") & (now_s - F.col(f"_since_{bad}") >= seconds), F.lit(False)
        )

    return df.select(
        "instance",
        "last_s",
        (now_s - F.col("last_s") > stale_s + stale_hold_s).alias("stale"),
        holds("faulty", fault_s).alias("operational_fault"),
        holds("send_failed", failed_s).alias("notification_failed"),
    )
