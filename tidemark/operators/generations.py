"""May this generation replace that one? Each rule returns the rows that break it."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.operators import coverage, digest, ordered, snapshot
from tidemark.schemas import SERIES

COMPARED = [
    "epoch",
    "data_version",
    "source_version",
    "cov_start",
    "cov_end",
    "row_count",
    "content_hash",
    "nullable_prices",
]


def overlapping(old: DataFrame, new: DataFrame) -> DataFrame:
    """Pairs of an old and a new entry of one series that overlap."""
    before = old.select(*SERIES, *[F.col(c).alias(f"old_{c}") for c in COMPARED])
    before = before.withColumn("start_stored", F.col("old_cov_start")).withColumn(
        "end_stored", F.col("old_cov_end")
    )
    return coverage.overlap(before, new.select(*SERIES, "series_id", *COMPARED))


def transition_violations(old: DataFrame, new: DataFrame) -> DataFrame:
    """Overlapping replacements that go back in version or change at the same one."""
    pairs = overlapping(old, new)
    same = F.lit(True)
    for c in COMPARED:
        if c not in ("source_version", "epoch"):
            same = same & F.col(c).eqNullSafe(F.col(f"old_{c}"))
    problem = (
        F.when(F.col("epoch") != F.col("old_epoch"), "epoch")
        .when(F.col("source_version") < F.col("old_source_version"), "stale_source_version")
        .when(
            (F.col("source_version") == F.col("old_source_version")) & ~same,
            "changed_at_same_version",
        )
    )
    return pairs.withColumn("problem", problem).where("problem is not null").select(
        *SERIES, "old_cov_start", "old_cov_end", "cov_start", "cov_end", "problem"
    )


def epoch_replacement_violations(
    old: DataFrame, new: DataFrame, old_bars: DataFrame, new_bars: DataFrame
) -> DataFrame:
    """Reasons a series rebuilt under a new epoch may not replace the old one."""
    key = [*SERIES, "cov_start", "cov_end"]
    renamed = new.select(
        *key, F.col("row_count").alias("_rows"), F.lit(True).alias("_kept")
    )
    kept = old.join(renamed, key, "left")
    lost = kept.withColumn(
        "problem",
        F.when(F.col("_kept").isNull(), "lost_coverage").when(
            F.col("_rows") < F.col("row_count"), "lost_rows"
        ),
    ).where("problem is not null").select(*key, "problem")
    floor = old.groupBy(*SERIES).agg(
        F.max("source_version").alias("_floor"),
        F.min("data_version").alias("_data"),
        (F.min("data_version") != F.max("data_version")).alias("_mixed"),
        F.min("epoch").alias("_epoch"),
    )
    changed = new.join(floor, SERIES).withColumn(
        "problem",
        F.when(F.col("epoch") == F.col("_epoch"), "same_epoch")
        .when(F.col("_mixed"), "mixed_source")
        .when(F.col("data_version") != F.col("_data"), "data_version")
        .when(F.col("source_version") <= F.col("_floor"), "source_version"),
    ).where("problem is not null").select(*key, "problem")
    stamps = (
        snapshot.lost_timestamps(old_bars, new_bars)
        .select(*SERIES, "ts_ms")
        .groupBy(*SERIES)
        .agg(F.min("ts_ms").alias("cov_start"), (F.max("ts_ms") + 1).alias("cov_end"))
        .withColumn("problem", F.lit("lost_timestamps"))
    )
    return lost.unionByName(changed).unionByName(stamps)


def factor_regressions(old: DataFrame, new: DataFrame) -> DataFrame:
    """New factor sets that narrow, go back in time or alter a revision."""
    key = ["symbol", "market"]
    cols = [
        "model",
        "first_day",
        "end_day",
        "source_epoch",
        "observed_at_ms",
        "valid_until_ms",
        "source_revision",
        "source_receipt_sha256",
        "data_hash",
    ]
    before = old.select(*key, *[F.col(c).alias(f"old_{c}") for c in cols])
    df = new.join(before, key)

    def old_(c: str):
        return F.col(f"old_{c}")

    rules = [
        ("source_epoch", F.col("source_epoch") != old_("source_epoch")),
        ("model", F.col("model") != old_("model")),
        (
            "window",
            (F.col("first_day") > old_("first_day")) | (F.col("end_day") < old_("end_day")),
        ),
        (
            "freshness",
            (F.col("observed_at_ms") < old_("observed_at_ms"))
            | (F.col("valid_until_ms") < old_("valid_until_ms")),
        ),
        ("revision", F.col("source_revision") < old_("source_revision")),
        (
            "changed_at_same_revision",
            (F.col("source_revision") == old_("source_revision"))
            & (
                (F.col("source_receipt_sha256") != old_("source_receipt_sha256"))
                | (F.col("data_hash") != old_("data_hash"))
            ),
        ),
    ]
    # Sets from unscheduled sources have no revision (0): its rules do not apply.
    rules = [
        (n, c & (old_("source_revision") > 0) if "revision" in n else c) for n, c in rules
    ]
    reasons = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules]), F.isnotnull)
    return df.withColumn("reasons", F.array_join(reasons, ",")).where("reasons <> ''").select(
        *key, "reasons"
    )


def sequence_regressions(
    generations: DataFrame, keys: list[str], order: str, width: int = ordered.RECORDS
) -> DataFrame:
    """Observations whose sequence fell below an earlier one, or changed content at it.

    The running maximum keeps the content first seen with the highest sequence.
    """
    top = F.struct(F.col("seq").alias("seq"), (-F.col(order)).alias("age"))
    seen = ordered.with_running_max(generations, keys, [order], top, width, "_top")
    first = generations.select(
        *keys, (-F.col(order)).alias("_age"), F.col("manifest").alias("_content")
    )
    df = seen.withColumn("_age", F.col("_top")["age"]).join(first, [*keys, "_age"])
    problem = F.when(F.col("seq") < F.col("_top")["seq"], "regressed").when(
        (F.col("seq") == F.col("_top")["seq"]) & (F.col("manifest") != F.col("_content")),
        "changed_at_same_sequence",
    )
    return (
        df.withColumn("problem", problem)
        .where("problem is not null")
        .withColumn("highest_seq", F.col("_top")["seq"])
        .drop("_top", "_age", "_content")
    )


def rollback_generation(
    generations: DataFrame, targets: DataFrame, keys: list[str]
) -> DataFrame:
    """New generation rows that publish an older content again.

    ``targets`` has the keys and ``seq`` of the generation to return to. The new
    sequence follows the highest one; sequences never go back.
    """
    highest = generations.groupBy(*keys).agg(F.max("seq").alias("_max"))
    content = generations.groupBy(*keys, "seq").agg(
        F.min("manifest").alias("manifest"), F.count_distinct("manifest").alias("_n")
    )
    return (
        targets.join(content, [*keys, "seq"])
        .where("_n = 1")
        .join(highest, keys)
        .select(
            *keys,
            (F.col("_max") + 1).alias("seq"),
            "manifest",
            F.col("seq").alias("rolled_back_to"),
        )
    )


def current_generation(
    generations: DataFrame, keys: list[str], min_seq: int = 0, order: str | None = None
) -> DataFrame:
    """Highest generation of each namespace; below the floor it is refused.

    Where one sequence came with several contents, the first by ``order`` (or else by its
    text) counts and ``ambiguous`` is set.
    """
    first = F.col(order) if order else F.lit(0)
    content = F.struct((-F.col("seq")).alias("s"), first.alias("o"), F.col("manifest").alias("manifest"))
    # Partial aggregation leaves few rows per sequence before the second step.
    each = generations.groupBy(*keys, "seq").agg(
        F.min(content)["manifest"].alias("manifest"),
        (F.min("manifest") != F.max("manifest")).alias("ambiguous"),
    )
    top = each.groupBy(*keys).agg(F.max(F.struct("seq", "manifest", "ambiguous")).alias("t"))
    return top.select(*keys, "t.*").withColumn("accepted", F.col("seq") >= F.lit(min_seq))


# Values of a factor event, of either model.
FACTOR_FIELDS = [(n, "<f8") for n in ("cum", "fa", "fb", "ba", "bb")]


def dedupe_factor_data(sets: DataFrame, factors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split factor sets into data, keyed by content hash, and observations.

    The hash covers identity, window and the exact values of all row fields present, but
    no observation time, so checking a source again without change keeps the version of its data.
    """
    present = [n for n, _ in FACTOR_FIELDS if n in factors.columns]
    rows = digest.with_bits(factors, FACTOR_FIELDS).groupBy("symbol", "market").agg(
        F.array_join(
            F.transform(
                F.array_sort(
                    F.collect_list(
                        F.struct("day", *[F.coalesce(f"_x_{n}", F.lit("-")).alias(n) for n in present])
                    )
                ),
                lambda x: F.concat_ws(":", x["day"].cast("string"), *[x[n] for n in present]),
            ),
            ";",
        ).alias("_rows")
    )
    text = F.concat_ws(
        "|",
        "symbol",
        "market",
        "model",
        F.col("first_day").cast("string"),
        F.col("end_day").cast("string"),
        F.col("source_epoch"),
        F.coalesce("_rows", F.lit("")),
    )
    df = sets.join(rows, ["symbol", "market"], "left").withColumn(
        "data_hash", F.sha2(text, 256)
    )
    data = df.groupBy("data_hash").agg(
        *[F.min(c).alias(c) for c in ["symbol", "market", "model", "first_day", "end_day"]],
        F.count(F.lit(1)).alias("observations"),
    )
    observations = df.select(
        "symbol", "market", "observed_at_ms", "valid_until_ms", "source_revision", "data_hash"
    )
    return data, observations


def policy_extension(old: DataFrame, new: DataFrame) -> DataFrame:
    """Intervals a new suspension table drops, alters or repeats."""
    cols = ["symbol", "start_ms", "end_ms", "evidence"]
    kept = new.groupBy(*cols).agg(F.count(F.lit(1)).alias("copies"))
    repeated = kept.where("copies > 1").select(*cols, F.lit("repeated").alias("problem"))
    dropped = (
        old.select(*cols)
        .distinct()
        .join(kept.select(*cols), cols, "left_anti")
        .withColumn("problem", F.lit("dropped"))
    )
    return dropped.unionByName(repeated)


def factor_source_check(capture: DataFrame) -> DataFrame:
    """Problems of captured factor sources, one row per (symbol, reason).

    ``capture`` has one row per source row: symbol, model, batch (0 carry, 1 range),
    position, day, first_day, partition path, chunk and tablet version.
    """
    carry_outside = (F.col("batch") == 0) & (F.col("day") >= F.col("first_day"))
    range_outside = (F.col("batch") == 1) & (F.col("day") < F.col("first_day"))
    cumulative = F.col("model") == fixed.MODEL_CUMULATIVE
    rows = capture.withColumn(
        "problem",
        F.when(cumulative & carry_outside, "carry_date")
        .when(cumulative & range_outside, "range_date")
        .when(~cumulative & (F.col("batch") != 0), "batch")
        .when(F.col("chunk_version") != F.col("tablet_version"), "version"),
    )
    paths = ordered.with_previous(
        capture, ["symbol"], ["position"], ["path"], ordered.RECORDS
    ).withColumn(
        "problem", F.when(F.col("prev_path") >= F.col("path"), "partition_order")
    )
    cols = ["symbol", "problem"]
    return (
        rows.select(*cols)
        .unionByName(paths.select(*cols))
        .where("problem is not null")
        .groupBy(*cols)
        .agg(F.count(F.lit(1)).alias("rows"))
    )
