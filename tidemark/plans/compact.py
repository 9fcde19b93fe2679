"""Daily snapshots and their compaction into months."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions import clock
from tidemark.operators import digest, ordered, snapshot
from tidemark.schemas import SERIES
from tidemark.session import materialize


def daily_snapshot(proofs: DataFrame, bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries of sound proofs, problems of the others).

    Where proofs declare ``rows_sha256``, it must be the digest of the packed rows of the
    interval; the row limit of an export bounds each digest.
    """
    checked = proofs.withColumn("problem", snapshot.proof_problem(proofs.columns))
    declared = checked.where("problem is null").select(
        *SERIES,
        F.col("requested_start_ms").alias("cov_start"),
        F.col("requested_end_ms").alias("cov_end"),
        "data_version",
        "source_version",
        F.col("row_count").alias("proved_rows"),
        (F.col("rows_sha256") if "rows_sha256" in proofs.columns else F.lit(None).cast("string")).alias("proved_digest"),
    )
    built = snapshot.build_catalog(declared.drop("proved_rows", "proved_digest"), bars).join(
        declared.select(*snapshot.ENTRY, "proved_rows", "proved_digest"), snapshot.ENTRY
    )
    differs = F.when(F.col("row_count") != F.col("proved_rows"), "row_count")
    if "rows_sha256" in proofs.columns:
        found = digest.rows_digest(
            snapshot.rows_by_entry(declared, bars), snapshot.ENTRY, fixed.ENCODING_NATIVE
        ).select(*snapshot.ENTRY, F.col("rows_sha256").alias("_digest"))
        built = built.join(found, snapshot.ENTRY, "left")
        same = F.coalesce("_digest", F.sha2(F.lit(""), 256)) == F.col("proved_digest")
        differs = differs.when(~F.coalesce(same, F.lit(False)), "rows_sha256")
        built = built.withColumn("problem", differs).drop("_digest")
    else:
        built = built.withColumn("problem", differs)
    problems = checked.where("problem is not null").select(
        *SERIES,
        F.col("requested_start_ms").alias("cov_start"),
        F.col("requested_end_ms").alias("cov_end"),
        "problem",
    ).unionByName(
        built.where("problem is not null").select(*snapshot.ENTRY, "problem")
    )
    return built.where("problem is null").drop("proved_rows", "proved_digest", "problem"), problems


def compact_month(days: DataFrame) -> DataFrame:
    """One entry per series and local month of contiguous whole days, or its problem.

    ``days`` are day entries with data_version, source_version and guard, at most 31 per
    month. Only metadata is folded here; ``compact_rows`` also checks and returns the bars. A day
    may carry ``sound``, false if its rows are not those of its entry.
    """
    if "sound" not in days.columns:
        days = days.withColumn("sound", F.lit(True))
    month = clock.month_of(F.col("cov_start"), F.col("market"))
    df = days.withColumn("month_key", month)
    by_month = Window.partitionBy(*SERIES, "month_key").orderBy("cov_start")
    whole = (F.col("cov_end") - F.col("cov_start") == fixed.DAY_MS) & (
        F.pmod(F.col("cov_start") + F.when(F.col("market") == "US", 0).otherwise(
            fixed.CN_OFFSET_MS), F.lit(fixed.DAY_MS)) == 0
    )
    df = df.withColumn("_whole", whole).withColumn(
        "_joined",
        F.coalesce(F.lag("cov_end").over(by_month) == F.col("cov_start"), F.lit(True)),
    )
    digests = F.array_sort(F.collect_list(F.struct("cov_start", "content_hash")))
    text = F.array_join(
        F.transform(digests, lambda x: F.coalesce(x["content_hash"], F.lit("-"))), "|"
    )
    same = {
        c: F.min(c).eqNullSafe(F.max(c)) for c in ["data_version", "source_version", "guard"]
    }
    months = df.groupBy(*SERIES, "month_key").agg(
        F.min("cov_start").alias("cov_start"),
        F.max("cov_end").alias("cov_end"),
        F.count(F.lit(1)).alias("days"),
        F.sum("row_count").alias("row_count"),
        F.max("nullable_prices").alias("nullable_prices"),
        F.min("data_version").alias("data_version"),
        F.min("source_version").alias("source_version"),
        F.sha2(text, 256).alias("days_sha256"),
        F.min("_whole").alias("_whole"),
        F.min("_joined").alias("_joined"),
        F.min("sound").alias("_sound"),
        *[expr.alias(f"_same_{c}") for c, expr in same.items()],
    )
    problem = (
        F.when(~F.col("_whole"), "not_whole_days")
        .when(~F.col("_joined"), "gap")
        .when(~F.col("_same_data_version"), "data_version")
        .when(~F.col("_same_source_version"), "source_version")
        .when(~F.col("_same_guard"), "guard")
        .when(~F.col("_sound"), "day_rows")
    )
    spare = ["_whole", "_joined", "_sound", *[f"_same_{c}" for c in same]]
    return months.withColumn("problem", problem).drop(*spare)


def compact_rows(days: DataFrame, bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(months or their problem, bars of the sound months for ``write_snapshot``).

    The bars of every day are counted and hashed against its entry before its month is
    rewritten; a day that differs spoils its month with ``day_rows``.
    """
    facts = snapshot.entry_facts(days, bars).select(
        *snapshot.ENTRY, F.col("found_rows").alias("_n"), F.col("_sum")
    )
    found = F.coalesce("_n", F.lit(0))
    content = F.when(found > 0, snapshot.content_hash(found, F.col("_sum")))
    same = (found == F.col("row_count")) & content.eqNullSafe(F.col("content_hash"))
    checked = days.join(facts, snapshot.ENTRY, "left").withColumn("sound", same).drop("_n", "_sum")
    months = materialize(compact_month(checked), "months")
    sound = months.where("problem is null").select(*snapshot.ENTRY)
    return months, snapshot.rows_by_entry(sound, bars).drop("cov_start", "cov_end", ordered.SLICE)
