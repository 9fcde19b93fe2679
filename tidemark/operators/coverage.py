"""Coverage calculus: which part of a request is covered without a gap, and by what."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions import clock
from tidemark.operators.steps import bind
from tidemark.schemas import SERIES
from tidemark.session import materialize, sized

# Requests span at most 366 days and archive entries a month, so a pair of them
# shares few buckets and no key of the overlap join is larger than a series-month.
BUCKET_MS = 32 * fixed.DAY_MS


def _buckets(start: str, end: str) -> Column:
    first = clock.floor_div(F.col(start), BUCKET_MS)
    last = clock.floor_div(F.col(end) - 1, BUCKET_MS)
    return F.sequence(first, last)


def overlap(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """Pairs of a request and a catalog entry of its series that overlap.

    ``requests`` carries the series columns, ``start_stored`` and ``end_stored``.
    The join is an equi-join on series and time bucket; a pair that shares several
    buckets is kept in the first one only.
    """
    asked = requests.where("end_stored > start_stored").withColumn(
        "_bucket", F.explode(_buckets("start_stored", "end_stored"))
    )
    covered = catalog.where("cov_end > cov_start").withColumn(
        "_bucket", F.explode(_buckets("cov_start", "cov_end"))
    )
    first = F.greatest(
        clock.floor_div(F.col("start_stored"), BUCKET_MS),
        clock.floor_div(F.col("cov_start"), BUCKET_MS),
    )
    # Both sides were exploded, so size estimates must not choose a broadcast.
    pairs = asked.hint("merge").join(covered, ["symbol", "_bucket", "dataset", "market"])
    return pairs.where(
        (F.col("cov_end") > F.col("start_stored"))
        & (F.col("cov_start") < F.col("end_stored"))
        & (F.col("_bucket") == first)
    ).drop("_bucket")


def entry_prune(catalog: DataFrame, requests: DataFrame) -> DataFrame:
    """Entries that some request overlaps, each once."""
    asked = requests.select("request_id", *SERIES, "start_stored", "end_stored")
    key = [*SERIES, "cov_start", "cov_end"]
    wanted = overlap(asked, catalog.select(*key)).select(*key)
    return catalog.join(wanted, key, "left_semi")


def coverage_frontier(
    requests: DataFrame, catalog: DataFrame, match: list[str] | None = None
) -> DataFrame:
    """End of the gap-free prefix of every request.

    ``match`` names further columns a request and its entries must agree on, such
    as ``data_version``. A request that nothing covers has its start as frontier.
    """
    keep = ["request_id", *SERIES, "start_stored", "end_stored"]
    entries = catalog
    for name in match or []:
        entries = entries.withColumnRenamed(name, f"_entry_{name}")
    carried = [f"_entry_{name}" for name in match or []]
    pairs = overlap(
        requests.select(*keep, *(match or [])),
        entries.select(*SERIES, "cov_start", "cov_end", *carried),
    )
    for name in match or []:
        pairs = pairs.where(F.col(name) == F.col(f"_entry_{name}"))
    order = Window.partitionBy("request_id").orderBy("cov_start", "cov_end")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    reached = F.greatest(F.col("start_stored"), F.max("cov_end").over(earlier))
    prefix = (
        pairs.withColumn("_gap", (F.col("cov_start") > reached).cast("int"))
        .withColumn("_broken", F.max("_gap").over(so_far))
        .where("_broken = 0")
        .groupBy("request_id")
        .agg(F.max(F.least("cov_end", "end_stored")).alias("_reached"))
    )
    frontier = F.coalesce("_reached", "start_stored")
    return (
        requests.select(*keep)
        .join(prefix, "request_id", "left")
        .withColumn("frontier", frontier)
        .withColumn("complete", F.col("frontier") >= F.col("end_stored"))
        .withColumn("uncovered_from", F.when(~F.col("complete"), F.col("frontier")))
        .drop("_reached")
    )


def with_chain(catalog: DataFrame) -> DataFrame:
    """Add ``chain``, the number of the gap-free chain each entry of a series is in."""
    order = Window.partitionBy(*SERIES).orderBy("cov_start", "cov_end")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    starts = F.col("cov_start") > F.coalesce(F.max("cov_end").over(earlier), F.lit(-1))
    chain = F.sum("_starts").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return (
        catalog.withColumn("_starts", starts.cast("int"))
        .withColumn("chain", chain)
        .drop("_starts")
    )


CHAIN = [*SERIES, "cov_start", "cov_end"]


def coverage_chains(entries: DataFrame) -> DataFrame:
    """Disjoint intervals that the entries of each series cover without a gap; entries that only touch are one interval."""
    whole = with_chain(entries.where("cov_end > cov_start").select(*CHAIN))
    return whole.groupBy(*SERIES, "chain").agg(
        F.min("cov_start").alias("cov_start"), F.max("cov_end").alias("cov_end")
    ).select(*CHAIN)


def extend_chains(stored: DataFrame, published: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(intervals of ``stored`` that go, intervals that take their place) after entries are published.

    ``stored`` holds the disjoint intervals of ``coverage_chains``. Only those that a new entry meets are read again and merged with it; as
    stored intervals never touch each other, what is merged touches no other one.
    """
    fresh = materialize(coverage_chains(published), "fresh")
    # One millisecond more on either side: intervals that only touch meet too.
    asked = fresh.select(
        F.concat_ws("/", *CHAIN).alias("request_id"), *SERIES,
        (F.col("cov_start") - 1).alias("start_stored"), (F.col("cov_end") + 1).alias("end_stored"),
    )
    met = materialize(overlap(asked, stored.select(*CHAIN)).select(*CHAIN).distinct(), "met")
    return met, coverage_chains(met.unionByName(fresh))


def with_chains(stored: DataFrame, published: DataFrame) -> DataFrame:
    """``stored`` after entries are published: equal to ``coverage_chains`` of all entries ever published."""
    gone, new = extend_chains(stored, published)
    return stored.select(*CHAIN).join(sized(gone), CHAIN, "left_anti").unionByName(new)


def with_chain_end(catalog: DataFrame) -> DataFrame:
    """Add the end of the gap-free chain of archive entries each entry belongs to."""
    last = F.max("cov_end").over(Window.partitionBy(*SERIES, "chain"))
    return with_chain(catalog).withColumn("chain_end", last).drop("chain")


def source_name(tier: Column, slug: Column, dataset: Column, stored: Column, market: Column):
    """Name of the archive part an entry is published in."""
    day = clock.day_date(clock.stored_day(stored, market))
    part = F.when(tier == "history", F.date_format(day, "yyyyMM")).otherwise(
        F.date_format(day, "yyyyMMdd")
    )
    kind = (
        F.when(dataset == fixed.DATASET_NATIVE, "-native64-001")
        .when(dataset == fixed.DATASET_COMPLETE, "-kline48-001")
        .otherwise("-001")
    )
    return F.concat(tier, F.lit("-"), slug, F.lit("-"), part, kind)


def _walk(entries: Column, start: Column, end: Column, market: Column) -> Column:
    """Fold of the five cursor steps over the entries of one request."""

    def covers(e: Column, tier: str, at: Column) -> Column:
        return (e["tier"] == tier) & (e["cov_start"] <= at) & (at < e["cov_end"])

    def archive(at: Column) -> Column:
        hits = F.filter(entries, lambda e: covers(e, "history", at))
        return F.array_max(F.transform(hits, lambda e: e["chain_end"]))

    def day_entry(at: Column, other_than: Column) -> Column:
        day = clock.stored_day(at, market)
        hits = F.filter(
            entries,
            lambda e: covers(e, "intraday", at)
            & (clock.stored_day(e["cov_start"], market) == day)
            & (day != other_than),
        )
        return F.array_min(F.transform(hits, lambda e: e["cov_end"]))

    def move(acc: Column, step: Column) -> Column:
        at = acc["at"]
        by_archive = step % 2 == 1
        found = F.when(by_archive, archive(at)).otherwise(day_entry(at, acc["day"]))

        def advance(to: Column) -> Column:
            taken = F.when(to < end, to).otherwise(end)
            piece = F.struct(
                F.when(by_archive, "history").otherwise("intraday").alias("tier"),
                at.alias("lo"),
                taken.alias("hi"),
            )
            moved = F.struct(
                taken.alias("at"),
                F.when(by_archive, acc["day"]).otherwise(clock.stored_day(at, market)).alias("day"),
                F.concat(acc["pieces"], F.array(piece)).alias("pieces"),
            )
            return F.when(to.isNull() | (at >= end), acc).otherwise(moved)

        return bind(found, advance)

    begin = F.struct(
        start.alias("at"),
        F.lit(fixed.FIRST_CIVIL_DAY - 1).alias("day"),
        F.from_json(F.lit("[]"), "array<struct<tier:string,lo:bigint,hi:bigint>>").alias("pieces"),
    )
    steps = F.array(*[F.lit(n) for n in [1, 2, 3, 4, 5]])
    return F.aggregate(steps, begin, move)


def serve_plan(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """For each request the pieces to read, in order, and where they end.

    The archive answers wherever it covers the cursor. Where it does not, a request
    that allows it takes the intraday entry of the cursor's civil day; at most two
    different days are taken, enough for a handover at midnight. So the cursor moves
    in at most five steps: archive, day, archive, day, archive.

    Adds ``pieces`` (tier, lo, hi), ``frontier``, ``mixed_versions`` and ``sources``.
    """
    history = with_chain_end(catalog.where("tier = 'history'"))
    # One entry per civil day: only the day's own entry can serve a cursor in it.
    intraday = catalog.where("tier = 'intraday'").withColumn("chain_end", F.col("cov_end"))
    keep = [*SERIES, "tier", "cov_start", "cov_end", "chain_end", "data_version"]
    entries = history.select(*keep).unionByName(intraday.select(*keep))
    asked = ["request_id", *SERIES, "start_stored", "end_stored", "include_intraday"]
    pairs = overlap(requests.select(*asked, "slug"), entries).where(
        "tier = 'history' or include_intraday"
    )
    # A request spans at most 366 days, so its entries are a short list.
    item = F.struct("tier", "cov_start", "cov_end", "chain_end", "data_version")
    found = pairs.groupBy(
        "request_id", "dataset", "market", "slug", "start_stored", "end_stored"
    ).agg(F.array_sort(F.collect_list(item)).alias("entries"))
    start, end, market = F.col("start_stored"), F.col("end_stored"), F.col("market")
    walked = found.withColumn("walk", _walk(F.col("entries"), start, end, market))

    def used(e: Column) -> Column:
        return F.exists(
            F.col("walk.pieces"),
            lambda p: (p["tier"] == e["tier"])
            & (e["cov_start"] < p["hi"])
            & (e["cov_end"] > p["lo"]),
        )

    def summary(taken: Column) -> Column:
        versions = F.array_distinct(F.transform(taken, lambda e: e["data_version"]))
        ordered = F.array_sort(
            F.transform(taken, lambda e: F.struct(e["cov_start"].alias("at"), e["tier"].alias("tier")))
        )
        names = F.transform(
            ordered,
            lambda e: source_name(e["tier"], F.col("slug"), F.col("dataset"), e["at"], market),
        )
        return F.struct(
            (F.size(versions) > 1).alias("mixed_versions"),
            F.array_distinct(names).alias("sources"),
        )

    plans = walked.select(
        "request_id", "walk", bind(F.filter("entries", used), summary).alias("use")
    )
    # The join keeps these expressions below it: they run once per request.
    return (
        requests.join(plans, "request_id", "left")
        .withColumn("frontier", F.coalesce("walk.at", "start_stored"))
        .withColumn("pieces", F.col("walk.pieces"))
        .withColumn("mixed_versions", F.coalesce("use.mixed_versions", F.lit(False)))
        .withColumn("sources", F.col("use.sources"))
        .drop("walk", "use")
    )


def stitch_sources(*parts: DataFrame) -> DataFrame:
    """Union of the parts of a series; series of mixed data versions are flagged.

    Parts carry ``data_version`` per row. ``one_version`` is false for every row of
    a series whose parts disagree, so that its request can fail as a row.
    """
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    mixed = (
        whole.groupBy(*SERIES)
        .agg((F.min("data_version") != F.max("data_version")).alias("_mixed"))
        .where("_mixed")
    )
    # Only series that disagree are joined: few as a rule, so bars stay where they are.
    return (
        whole.join(sized(mixed), SERIES, "left")
        .withColumn("one_version", F.col("_mixed").isNull())
        .drop("_mixed")
    )
