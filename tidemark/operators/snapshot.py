"""Building, comparing and verifying snapshots against their catalog."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions import clock, identity
from tidemark.operators import digest, ordered, quality
from tidemark.schemas import SERIES
from tidemark.session import materialize, sized

ENTRY = [*SERIES, "cov_start", "cov_end"]


def rows_by_entry(entries: DataFrame, bars: DataFrame, outside: bool = False) -> DataFrame:
    """Bars with the entry that covers them; joined by series and days of coverage.

    With ``outside``, bars that no entry covers come too, once and without bounds.
    """
    held = entries.where("cov_end > cov_start").select(*ENTRY)
    # Few slices for each entry, and few entries in each slice.
    span = held.agg(F.avg(F.col("cov_end") - F.col("cov_start"))).first()[0] or 0
    width = fixed.DAY_MS * min(max(round(span / fixed.DAY_MS), 1), 32)
    slices = F.sequence(
        clock.floor_div(F.col("cov_start"), width), clock.floor_div(F.col("cov_end") - 1, width)
    )
    cut = held.withColumn(ordered.SLICE, F.explode(slices))
    rows = ordered.with_slice(bars, "ts_ms", width)
    names = [*SERIES, ordered.SLICE]
    cut = sized(cut.withColumnsRenamed({n: f"_{n}" for n in names}))
    same = (F.col("ts_ms") >= F.col("cov_start")) & (F.col("ts_ms") < F.col("cov_end"))
    for n in names:
        same = (F.col(n) == F.col(f"_{n}")) & same
    return rows.join(cut, same, "left" if outside else "inner").drop(*[f"_{n}" for n in names])


def content_sum() -> Column:
    """Aggregate of ``digest.with_words``: sums that do not depend on row order.

    They are the sums of the quarters of the rows' SHA-256, added as 32-bit halves, so that up to
    2 147 483 648 rows cannot overflow (more fail) and partial sums are combined before any shuffle. Times are unique in an
    entry, so two entries with equal counts and sums hold the same rows, collisions aside.
    """
    halves = [F.sum(w).cast("decimal(20,0)") for w in digest.WORDS]
    high = F.lit(1 << 32).cast("decimal(10,0)")
    return F.concat_ws(":", *[(a * high + b).cast("string") for a, b in zip(halves[::2], halves[1::2])])


def entry_facts(entries: DataFrame, bars: DataFrame, outside: bool = False) -> DataFrame:
    """Row count, bounds, content sum and NULL flag found for each entry.

    With ``outside``, also those of each series' bars that no entry covers, without bounds.
    """
    return (
        digest.with_words(rows_by_entry(entries, bars, outside))
        .groupBy(*ENTRY)
        .agg(
            F.count(F.lit(1)).alias("found_rows"),
            F.min("ts_ms").alias("first_ms"),
            F.max("ts_ms").alias("last_ms"),
            content_sum().alias("_sum"),
            F.max(
                F.col("open").isNull()
                | F.col("high").isNull()
                | F.col("low").isNull()
                | F.col("close").isNull()
            ).alias("found_null"),
        )
    )


def content_hash(rows: Column, total: Column) -> Column:
    return F.sha2(F.concat_ws(":", rows.cast("string"), total), 256)


def build_catalog(declared: DataFrame, bars: DataFrame) -> DataFrame:
    """Catalog entries of declared coverage; an interval without bars is an entry too.

    ``declared`` has the series columns, cov_start, cov_end, data_version and
    source_version. Coverage is a declaration and never inferred from rows.
    """
    facts = entry_facts(declared, bars)
    df = declared.join(facts, ENTRY, "left")
    return df.select(
        *SERIES,
        F.lit(fixed.PERIOD_SECONDS).alias("period_seconds"),
        F.lit(fixed.ADJUST_NONE).alias("adjust"),
        identity.series_id(F.col("dataset"), F.col("market"), F.col("symbol")).alias("series_id"),
        "data_version",
        "source_version",
        "cov_start",
        "cov_end",
        F.coalesce("found_rows", F.lit(0)).alias("row_count"),
        F.when(F.col("found_rows") > 0, content_hash(F.col("found_rows"), F.col("_sum"))).alias(
            "content_hash"
        ),
        F.coalesce("found_null", F.lit(False)).alias("nullable_prices"),
    )


def verify_snapshot(bars: DataFrame, catalog: DataFrame) -> DataFrame:
    """Compare bars with their catalog: one row per entry that differs, or per
    series with bars no entry covers. The bars are read once."""
    # Facts without bounds find no entry; they are the bars outside.
    facts = entry_facts(catalog, bars, outside=True)
    df = catalog.withColumn("_listed", F.lit(True)).join(facts, ENTRY, "full")
    found = F.coalesce("found_rows", F.lit(0))
    content = F.when(F.col("found_rows") > 0, content_hash(F.col("found_rows"), F.col("_sum")))
    problem = (
        F.when(F.col("_listed").isNull(), "outside_coverage")
        .when(found != F.col("row_count"), "row_count")
        .when(~content.eqNullSafe(F.col("content_hash")), "content_hash")
        .when(
            F.coalesce(F.col("found_null"), F.lit(False)) & ~F.col("nullable_prices"),
            "null_price",
        )
    )
    return df.withColumn("problem", problem).where("problem is not null").select(
        *ENTRY, "row_count", found.alias("found_rows"), "problem"
    )


def lost_timestamps(old: DataFrame, new: DataFrame) -> DataFrame:
    """Published times of a series that a rebuild no longer has."""
    key = [*SERIES, "ts_ms"]
    return old.select(*key).join(new.select(*key), key, "left_anti")


def exact_rows_diff(left: DataFrame, right: DataFrame, cols: list[str]) -> DataFrame:
    """Multiset difference in both directions: each distinct row with its surplus.

    One aggregation of the union, combined before its shuffle, instead of two
    EXCEPT ALL passes; equal copies cancel wherever they meet.
    """
    both = left.select(*cols, F.lit(1).alias("_w")).unionByName(
        right.select(*cols, F.lit(-1).alias("_w"))
    )
    surplus = both.groupBy(*cols).agg(F.sum("_w").alias("_w")).where("_w <> 0")
    return surplus.select(
        *cols,
        F.when(F.col("_w") > 0, "left").otherwise("right").alias("side"),
        F.abs("_w").alias("copies"),
    )


def ordered_rows(bars: DataFrame) -> DataFrame:
    """Bars ordered by series and time (range partitioned, then sorted)."""
    return bars.orderBy(*SERIES, "ts_ms")


def catalog_order(catalog: DataFrame) -> DataFrame:
    return catalog.orderBy("series_id", "cov_start")


def bounded_export(bars: DataFrame, ranges: DataFrame, limit: int) -> DataFrame:
    """Export of each range: its first ``limit`` + 1 rows in full value order.

    A range with more than ``limit`` rows is incomplete: every row of it carries
    ``incomplete``, and it has to be exported again in smaller ranges.
    """
    from tidemark.operators import scan

    keep = ["request_id", *SERIES, "ts_ms", *quality.PRICES, "volume", "open_oi", "close_oi"]
    order = ["ts_ms", *quality.PRICES, "volume", "open_oi", "close_oi"]
    slices = scan.piece_slices(ranges.select("request_id", *SERIES, "lo", "hi"))
    # Days are counted first; only those that the limit reaches are read again and numbered.
    counted = scan.rows_of_slices(slices, bars, SERIES).groupBy("request_id", ordered.SLICE).agg(F.count(F.lit(1)).alias("_n"))
    days = Window.partitionBy("request_id").orderBy(ordered.SLICE).rowsBetween(Window.unboundedPreceding, -1)
    all_rows = F.sum("_n").over(Window.partitionBy("request_id"))
    reach = counted.select(
        "request_id", ordered.SLICE, F.coalesce(F.sum("_n").over(days), F.lit(0)).alias("_off"), (all_rows > limit).alias("incomplete")
    )
    needed = materialize(scan.with_reach(slices, reach).where(F.col("_off") <= limit), "slices")
    inside = Window.partitionBy("request_id", ordered.SLICE).orderBy(*order)
    numbered = scan.rows_of_slices(needed, bars, SERIES).withColumn("rn", F.row_number().over(inside) + F.col("_off"))
    return numbered.where(F.col("rn") <= limit + 1).select(*keep, "rn", "incomplete")


PROOF_KEY = [*SERIES, "requested_start_ms", "requested_end_ms"]


def proof_match(proofs: DataFrame, catalog: DataFrame) -> DataFrame:
    """Entries and proofs that do not pair one to one, with the reason."""
    by_proof = proofs.groupBy(*PROOF_KEY).agg(
        F.count(F.lit(1)).alias("proofs"),
        F.min("row_count").alias("_rows"),
        F.min("source_version").alias("_source"),
        F.min("data_version").alias("_data"),
    )
    named = by_proof.withColumnsRenamed(
        {"requested_start_ms": "cov_start", "requested_end_ms": "cov_end"}
    )
    by_entry = catalog.groupBy(*ENTRY).agg(
        F.count(F.lit(1)).alias("entries"),
        F.min("row_count").alias("row_count"),
        F.min("source_version").alias("source_version"),
        F.min("data_version").alias("data_version"),
    )
    problem = (
        F.when(F.col("proofs").isNull(), "no_proof")
        .when(F.col("entries").isNull(), "no_entry")
        .when((F.col("proofs") > 1) | (F.col("entries") > 1), "not_unique")
        .when(F.col("_rows") != F.col("row_count"), "row_count")
        .when(F.col("_source") != F.col("source_version"), "source_version")
        .when(F.col("_data") != F.col("data_version"), "data_version")
    )
    return (
        named.join(by_entry, ENTRY, "full_outer")
        .withColumn("problem", problem)
        .where("problem is not null")
        .select(*ENTRY, "proofs", "entries", "problem")
    )


def proof_problem(
    columns: list[str] | None = None, limit: int = fixed.SNAPSHOT_ROWS, days: int = 7
) -> Column:
    """First reason a source proof does not prove a complete, finished export.

    ``limit`` rows and ``days`` are what one export may hold. A rule is applied when the
    proof table has all its ``columns``.
    """
    c = F.col
    span = c("requested_end_ms") - c("requested_start_ms")
    inside = F.concat(F.lit("/"), F.substr(c("database_name"), F.lit(len(fixed.DATABASE_SCHEME) + 1)), F.lit("/"))
    rules = [
        ("contract", ["contract"], c("contract") == fixed.PROOF_CONTRACT),
        ("source_changed", [], c("guard_before") == c("guard_after")),
        ("source_version", [], c("source_version") > 0),
        ("chunk_version", ["chunk_version", "tablet_version"],
         (c("chunk_version") == c("tablet_version")) & (c("chunk_version") == c("source_version"))),
        ("chunk_state", ["chunk_type", "chunk_flag", "chunk_state"],
         (c("chunk_type") == 1) & (c("chunk_flag") == 0) & (c("chunk_state") == 0)),
        ("partition", ["partition_path", "database_name"],
         c("database_name").startswith(fixed.DATABASE_SCHEME) & F.startswith(c("partition_path"), inside)
         & ~c("partition_path").contains("..") & (F.length("partition_path") <= fixed.MAX_PARTITION_PATH)),
        ("interval", [], (c("requested_start_ms") >= 0) & (span > 0) & (span <= days * fixed.DAY_MS)),
        ("incomplete", [], c("max_rows").between(1, limit) & (c("row_count") <= c("max_rows"))),
        ("incomplete", ["query_row_limit", "max_partitions"],
         (c("query_row_limit") == c("max_rows") + 1) & (c("max_partitions") == 1)),
    ]
    present = set(columns or [])
    checks = [F.when(~F.coalesce(ok, F.lit(False)), name) for name, need, ok in rules if present.issuperset(need)]
    return F.coalesce(*checks)


def projection_diff(
    factor_rows: DataFrame, source_rows: DataFrame, key: list[str], order: list[str], cols: list[str]
) -> DataFrame:
    """Positions at which captured rows differ from their source rows.

    The first order column must be a BIGINT.
    """
    def numbered(df: DataFrame, name: str) -> DataFrame:
        placed = ordered.with_row_number(df, key, order, ordered.RECORDS, "position")
        return placed.select(*key, "position", F.struct(*cols).alias(name))

    joined = numbered(factor_rows, "_f").join(
        numbered(source_rows, "_s"), [*key, "position"], "full_outer"
    )
    return joined.withColumn(
        "problem",
        F.when(F.col("_s").isNull(), "missing_source_row")
        .when(F.col("_f").isNull(), "extra_source_row")
        .when(~F.col("_f").eqNullSafe(F.col("_s")), "differs"),
    ).where("problem is not null").select(*key, "position", "problem")


def stored_plan(catalog: DataFrame, proofs: DataFrame, row_bytes: int = 64) -> DataFrame:
    """Rows, objects and bytes each series would store: data objects plus proofs."""
    data = catalog.where("row_count > 0").select(
        *SERIES,
        F.col("row_count").alias("rows"),
        (F.col("row_count") * row_bytes).alias("bytes"),
    )
    papers = proofs.select(
        *SERIES, F.lit(0).cast("bigint").alias("rows"), F.col("proof_bytes").alias("bytes")
    )
    return data.unionByName(papers).groupBy(*SERIES).agg(
        F.sum("rows").alias("rows"),
        F.count(F.lit(1)).alias("objects"),
        F.sum("bytes").alias("bytes"),
    )


def split_observations(
    df: DataFrame, limit: int = fixed.SNAPSHOT_ROWS, days: int = 7
) -> DataFrame:
    """Where a captured sample may go: catalog, observations or nowhere.

    ``limit`` rows and ``days`` are what one sample may hold.
    """
    span = F.col("requested_end_ms") - F.col("requested_start_ms")
    bounded = (
        (F.col("requested_start_ms") >= 0)
        & (span > 0)
        & (span <= days * fixed.DAY_MS)
        & F.col("row_count").between(1, limit)
    )
    return df.withColumn(
        "target",
        F.when(F.col("coverage_verified"), "catalog")
        .when(bounded & F.col("source_version").isNull(), "observations")
        .otherwise("rejected"),
    )

