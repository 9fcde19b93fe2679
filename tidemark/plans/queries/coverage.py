"""Coverage, visibility and complete answers."""

from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.operators import coverage, digest, scan, visibility
from tidemark.plans import answer, bits
from tidemark.plans.queries.rows import ASKS, asks, ranges
from tidemark.plans.registry import query
from tidemark.session import materialize


@query(
    "request_coverage_join",
    f"""
    with o_asks as ({ASKS})
    select a.request_id, c.cov_start, c.cov_end, c.row_count
    from o_asks a join {{f_catalog}} c on c.symbol = a.symbol and c.dataset = a.dataset
     and c.cov_end > a.start_ms and c.cov_start < a.end_ms
    """,
)
def request_coverage_join(f):
    return coverage.overlap(asks(f), f.f_catalog.drop("uid", "period_seconds", "adjust")).select(
        "request_id", "cov_start", "cov_end", "row_count"
    )


@query(
    "entry_prune",
    f"""
    with o_asks as ({ASKS})
    select c.symbol, c.cov_start, c.cov_end from {{f_catalog}} c
    where exists (select 1 from o_asks a where a.symbol = c.symbol and a.dataset = c.dataset
      and c.cov_end > a.start_ms and c.cov_start < a.end_ms)
    """,
)
def entry_prune(f):
    return coverage.entry_prune(f.f_catalog, asks(f)).select("symbol", "cov_start", "cov_end")


@query(
    "interval_conflicts",
    """
    select o.symbol, o.cov_start as old_start, n.cov_start as new_start, n.cov_end as new_end
    from {f_catalog} o join {f_catalog_epoch} n on n.symbol = o.symbol and n.dataset = o.dataset
     and n.cov_start < o.cov_end + 60000 and o.cov_start < n.cov_end
    """,
)
def interval_conflicts(f):
    from tidemark.operators.generations import overlapping

    old = f.f_catalog.withColumn("cov_end", F.col("cov_end") + 60000)
    return overlapping(old, f.f_catalog_epoch).select(
        "symbol",
        F.col("old_cov_start").alias("old_start"),
        F.col("cov_start").alias("new_start"),
        F.col("cov_end").alias("new_end"),
    )


@query(
    "coverage_frontier",
    f"""
    with recursive o_asks as ({ASKS}),
    o_walk as (
      select request_id, symbol, dataset, start_ms as cur, end_ms from o_asks
      union all
      select w.request_id, w.symbol, w.dataset, least(c.cov_end, w.end_ms), w.end_ms
      from o_walk w join {{f_catalog}} c on c.symbol = w.symbol and c.dataset = w.dataset
        and c.cov_start <= w.cur and w.cur < c.cov_end and w.cur < w.end_ms)
    select request_id, max(cur) as frontier, max(cur) = max(end_ms) as complete,
           case when max(cur) < max(end_ms) then max(cur) end as uncovered_from
    from o_walk group by request_id
    """,
)
def coverage_frontier(f):
    return coverage.coverage_frontier(asks(f), f.f_catalog).select(
        "request_id", "frontier", "complete", "uncovered_from"
    )


@query(
    "coverage_chains",
    """
    with o_rows as (select *, case when cov_start > coalesce(max(cov_end) over (partition by symbol order by cov_start, cov_end rows between unbounded preceding and 1 preceding), -1) then 1 else 0 end as fresh
      from (select symbol, cov_start, cov_end from {f_catalog_tiers}) c),
    o_chain as (select *, sum(fresh) over (partition by symbol order by cov_start, cov_end rows unbounded preceding) as chain from o_rows)
    select symbol, min(cov_start) as cov_start, max(cov_end) as cov_end from o_chain group by symbol, chain
    """,
)
def coverage_chains(f):
    """Entries are published in three parts, out of order; each part extends the stored intervals."""
    entries = f.f_catalog_tiers.select(*coverage.CHAIN)
    part = F.pmod(F.xxhash64("symbol", "cov_start"), F.lit(3))
    stored = materialize(coverage.coverage_chains(entries.where(part == 0)), "chains")
    for k in (1, 2):
        stored = materialize(coverage.with_chains(stored, entries.where(part == k)), "chains")
    return stored.select("symbol", "cov_start", "cov_end")


# The greedy walk of one request over both tiers, one piece per step.
WALK = """
o_asks as (""" + ASKS + """),
o_cov as (select *, cast(floor((cov_start + 28800000) / 86400000) as bigint) as day from {f_catalog_tiers}),
o_walk as (
  select request_id, symbol, dataset, end_ms, include_intraday, 0 as step, 'none' as tier,
         start_ms as lo, start_ms as hi, cast(-1 as bigint) as day1, cast(-1 as bigint) as day2
  from o_asks
  union all
  select w.request_id, w.symbol, w.dataset, w.end_ms, w.include_intraday, w.step + 1, c.tier, w.hi, least(c.cov_end, w.end_ms),
         case when c.tier = 'intraday' and w.day1 < 0 then c.day else w.day1 end,
         case when c.tier = 'intraday' and w.day1 >= 0 then c.day else w.day2 end
  from o_walk w join o_cov c on c.symbol = w.symbol and c.dataset = w.dataset and c.cov_start <= w.hi and w.hi < c.cov_end
    and w.hi < w.end_ms
    and (c.tier = 'history' or (w.include_intraday and w.day2 < 0 and c.day <> w.day1
         and c.day = cast(floor((w.hi + 28800000) / 86400000) as bigint)
         and not exists (select 1 from o_cov h where h.tier = 'history' and h.symbol = w.symbol and h.dataset = w.dataset
                         and h.cov_start <= w.hi and w.hi < h.cov_end)))),
o_end as (select request_id, max(hi) as frontier from o_walk group by request_id),
o_versions as (
  select w.request_id, count(distinct c.data_version) as versions
  from o_walk w join o_cov c on c.symbol = w.symbol and c.tier = w.tier and c.cov_start < w.hi and c.cov_end > w.lo
  group by w.request_id)
"""


@query(
    "archive_over_intraday",
    f"""
    with recursive {WALK}
    select w.request_id, b.ts_ms, b.tier, b.volume
    from o_walk w join {{f_bars_tiers}} b on b.symbol = w.symbol and b.dataset = w.dataset and b.tier = w.tier
     and b.ts_ms >= w.lo and b.ts_ms < w.hi
    """,
)
def archive_over_intraday(f):
    return answer.merge_tiers(f.f_requests, f.f_catalog_tiers, f.f_bars_tiers).select(
        "request_id", "ts_ms", "tier", "volume"
    )


@query(
    "suspension_filter",
    """
    select b.symbol, b.ts_ms, b.volume,
           case when b.open is null and b.close is null and b.high = 0 and b.low = 0 and b.volume = 0 then 'suspended' else 'normal' end as null_class
    from {f_bars_nullable} b
    where not (b.open is null and exists (select 1 from {f_suspensions} s where s.symbol = b.symbol
      and b.ts_ms >= s.start_ms and b.ts_ms < s.end_ms))
    """,
)
def suspension_filter(f):
    return visibility.suspension_filter(f.f_bars_nullable, f.f_suspensions).select(
        "symbol", "ts_ms", "volume", "null_class"
    )


# Rows a request looks at, up to its limit of visible rows.
SEEN = """
o_rows as (
  select a.request_id, a.max_rows, b.symbol, b.tier, b.ts_ms, b.open, b.high, b.low, b.close, b.volume, b.open_oi, b.close_oi,
         case when b.open is null then 0 else 1 end as visible,
         b.open is null and exists (select 1 from {f_suspensions} s where s.symbol = b.symbol and b.ts_ms >= s.start_ms and b.ts_ms < s.end_ms) as confirmed
  from o_served a join o_walk w on w.request_id = a.request_id
  join {f_bars_tiers} b on b.symbol = w.symbol and b.dataset = w.dataset and b.tier = w.tier and b.ts_ms >= w.lo and b.ts_ms < w.hi),
o_seen as (
  select * from (select *, coalesce(sum(visible) over (partition by request_id order by ts_ms
     rows between unbounded preceding and 1 preceding), 0) as before from o_rows) x
  where before < max_rows)
"""

STATUS = """
o_status as (
  select a.*, e.frontier, coalesce(v.versions, 0) as versions,
    case when coalesce(v.versions, 0) > 1 then 'ERROR'
         when e.frontier < a.end_ms and (not a.allow_partial or e.frontier = a.start_ms) then 'MISS'
         when e.frontier < a.end_ms then 'PARTIAL' else 'HIT' end as status
  from o_asks a join o_end e on e.request_id = a.request_id left join o_versions v on v.request_id = a.request_id),
o_served as (select * from o_status where status in ('HIT', 'PARTIAL'))
"""

ANSWER = f"""
    with recursive {WALK}, {STATUS}, {SEEN},
    o_count as (
      select request_id, sum(visible) as n, count(*) filter (where confirmed) as omitted,
             count(*) filter (where visible = 0 and not confirmed) as bad,
             min(ts_ms) filter (where visible = 1) as first_ms, max(ts_ms) filter (where visible = 1) as last_ms
      from o_seen group by request_id),
    o_final as (
      select s.*, coalesce(c.n, 0) as n, coalesce(c.omitted, 0) as omitted, c.first_ms, c.last_ms, coalesce(c.bad, 0) > 0 as failed
      from o_status s left join o_count c on c.request_id = s.request_id)
"""

ANSWER_COLUMNS = """
      request_id, case when failed then 'ERROR' else status end as status,
      case when failed then 'invalid_request' when versions > 1 then 'read_failed' when status = 'MISS' then 'uncovered_range' end as reason,
      case when failed then 'unclassified_null' when versions > 1 then 'data_version' end as detail,
      case when status in ('HIT', 'PARTIAL') and not failed then cast(n as bigint) end as rows,
      case when status in ('HIT', 'PARTIAL') and not failed then first_ms end as first_ms,
      case when status in ('HIT', 'PARTIAL') and not failed then last_ms end as last_ms,
      case when status in ('HIT', 'PARTIAL') and not failed then cast(omitted as bigint) end as omitted_rows,
      case when status in ('HIT', 'PARTIAL') and not failed then frontier end as coverage_end_ms,
      case when status in ('PARTIAL', 'MISS') and not failed then frontier end as uncovered_from_ms,
      case when status in ('HIT', 'PARTIAL') and not failed then n = max_rows end as row_limit_reached
"""

REFUSED = """
    select request_id, 'ERROR' as status, 'invalid_request' as reason, case when end_ms <= start_ms then 'bounds' else 'native_only' end as detail,
      null as rows, null as first_ms, null as last_ms, null as omitted_rows, null as coverage_end_ms, null as uncovered_from_ms, null as row_limit_reached
    from {f_requests} where end_ms <= start_ms or (row_encoding <> 'le-ddb-native64-v1' and (allow_partial or include_intraday))
"""


def answers(f):
    return answer.answer_requests(
        f.f_requests, f.f_catalog_tiers, f.f_bars_tiers, f.f_suspensions
    )


@query("answer_requests", f"{ANSWER} select {ANSWER_COLUMNS} from o_final union all {REFUSED}")
def answer_requests(f):
    return answers(f).drop("sources")


@query(
    "answer_sources",
    f"""
    {ANSWER},
    o_parts as (
      select distinct f.request_id, c.tier, c.cov_start, concat(c.tier, '-', lower(replace(f.symbol, '.', '')), '-',
        case when c.tier = 'history' then strftime(make_timestamp((c.cov_start + 28800000) * 1000), '%Y%m') else strftime(make_timestamp((c.cov_start + 28800000) * 1000), '%Y%m%d') end, '-native64-001') as part
      from o_final f join o_walk w on w.request_id = f.request_id
      join o_cov c on c.symbol = w.symbol and c.tier = w.tier and c.cov_start < w.hi and c.cov_end > w.lo
      where f.status in ('HIT', 'PARTIAL') and not f.failed),
    o_first as (select request_id, part, min(cov_start) as cur from o_parts group by request_id, part)
    select request_id, string_agg(part, ',' order by cur, part) as sources from o_first group by request_id
    """,
)
def answer_sources(f):
    return answers(f).where("sources <> ''").select("request_id", "sources")


@query(
    "partial_prefix",
    f"""
    with recursive {WALK}
    select a.request_id, e.frontier, case when e.frontier < a.end_ms then 'PARTIAL' else 'HIT' end as status
    from o_asks a join o_end e on e.request_id = a.request_id left join o_versions v on v.request_id = a.request_id
    where a.allow_partial and e.frontier > a.start_ms and coalesce(v.versions, 0) <= 1
    """,
)
def partial_prefix(f):
    _, judged = answer.judge(f.f_requests, f.f_catalog_tiers)
    return judged.where("allow_partial and status in ('HIT', 'PARTIAL')").select(
        "request_id", "frontier", "status"
    )


@query(
    "visible_rows",
    f"""
    with recursive {WALK}, {STATUS}, {SEEN}
    select request_id, tier, ts_ms, visible, confirmed from o_seen
    """,
)
def visible_rows(f):
    _, judged = answer.judge(f.f_requests, f.f_catalog_tiers)
    return answer.selected_rows(judged, f.f_bars_tiers, f.f_suspensions).select(
        "request_id", "tier", "ts_ms", "visible", "confirmed"
    )


@query(
    "answer_digest",
    f"""
    with recursive {WALK}, {STATUS}, {SEEN},
    o_bad as (select distinct request_id from o_seen where visible = 0 and not confirmed),
    o_packed as (select request_id, ts_ms, {bits.record([n for n, _ in digest.RECORDS[fixed.ENCODING_NATIVE]])} as r from o_seen where visible = 1),
    o_found as (select request_id, count(*) as rows, sha256(unhex(string_agg(r, '' order by ts_ms))) as d from o_packed group by request_id)
    select s.request_id, coalesce(f.rows, 0) as rows, coalesce(f.d, sha256('')) as rows_sha256
    from o_served s left join o_found f on f.request_id = s.request_id
    where s.request_id not in (select request_id from o_bad)
    """,
)
def answer_digest(f):
    _, judged = answer.judge(f.f_requests, f.f_catalog_tiers)
    rows = answer.selected_rows(judged, f.f_bars_tiers, f.f_suspensions)
    return answer.answer_digests(judged, rows)


@query(
    "omitted_rows",
    f"""
    with recursive {WALK}, {STATUS}, {SEEN}
    select request_id, count(*) filter (where confirmed) as omitted,
           count(*) filter (where visible = 0 and not confirmed) as unclassified
    from o_seen group by request_id
    """,
)
def omitted_rows(f):
    _, judged = answer.judge(f.f_requests, f.f_catalog_tiers)
    rows = answer.selected_rows(judged, f.f_bars_tiers, f.f_suspensions)
    return rows.groupBy("request_id").agg(
        F.sum(F.col("confirmed").cast("int")).alias("omitted"),
        F.sum(((F.col("visible") == 0) & ~F.col("confirmed")).cast("int")).alias("unclassified"),
    )


@query(
    "first_n_rows",
    f"""
    with o_asks as ({ASKS})
    select request_id, ts_ms, close from (
      select a.request_id, a.max_rows, b.ts_ms, b.close, row_number() over (partition by a.request_id order by b.ts_ms) as rn
      from o_asks a join {{f_bars}} b on b.dataset = a.dataset and b.symbol = a.symbol and b.ts_ms >= a.start_ms and b.ts_ms < a.end_ms) x
    where rn <= max_rows
    """,
)
def first_n_rows(f):
    return scan.first_n(ranges(f), f.f_bars).select("request_id", "ts_ms", "close")


@query(
    "bounded_export",
    f"""
    with o_asks as ({ASKS}),
    o_top as (
      select a.request_id, b.ts_ms, b.close, row_number() over (partition by a.request_id order by b.ts_ms, b.open, b.high, b.low, b.close, b.volume) as rn
      from o_asks a join {{f_bars}} b on b.dataset = a.dataset and b.symbol = a.symbol and b.ts_ms >= a.start_ms and b.ts_ms < a.end_ms)
    select request_id, ts_ms, close, rn, max(rn) over (partition by request_id) > 40 as incomplete
    from o_top where rn <= 41
    """,
)
def bounded_export(f):
    from tidemark.operators.snapshot import bounded_export as run

    return run(f.f_bars, ranges(f), 40).select("request_id", "ts_ms", "close", "rn", "incomplete")


@query(
    "stitch_sources",
    """
    select b.symbol, b.ts_ms, b.volume, b.data_version, v.one_version from (
      select symbol, ts_ms, volume, sha256_text('v1') as data_version from {f_bars} where ts_ms < 1705276800000
      union all
      select symbol, ts_ms, volume, sha256_text(case when uid % 11 = 0 then 'v2' else 'v1' end) from {f_bars} where ts_ms >= 1705276800000) b
    join (select symbol, not (uid % 11 = 0 and min(ts_ms) < 1705276800000 and max(ts_ms) >= 1705276800000) as one_version from {f_bars} group by symbol, uid) v
      on v.symbol = b.symbol
    """,
)
def stitch_sources(f):
    split = F.col("ts_ms") < 1705276800000
    first = f.f_bars.where(split).withColumn("data_version", F.sha2(F.lit("v1"), 256))
    changed = F.when(F.col("uid") % 11 == 0, "v2").otherwise("v1")
    second = f.f_bars.where(~split).withColumn("data_version", F.sha2(changed, 256))
    return coverage.stitch_sources(first, second).select(
        "symbol", "ts_ms", "volume", "data_version", "one_version"
    )


@query(
    "catalog_violations",
    """
    with o_order as (select *, lag(data_version) over w as prev_version, lag(cov_start) over w as prev_start,
      max(cov_end) over (partition by series_id order by cov_start, cov_end rows between unbounded preceding and 1 preceding) as prev_end
      from {f_catalog_bad} window w as (partition by series_id order by cov_start, cov_end)),
    o_reasons as (select symbol, cov_start, concat_ws(',',
      case when uid % 19 = 0 or uid % 17 = 0 then 'series_id' end, case when adjust <> 'none' then 'unsupported_series' end,
      case when source_version <= 0 then 'version' end, case when prev_end > cov_start then 'overlap' end,
      case when prev_version <> data_version then 'mixed_data_version' end,
      case when (content_hash is not null) <> (row_count <> 0) then 'object' end) as reasons from o_order)
    select symbol, cov_start, reasons from o_reasons where reasons <> ''
    """,
)
def catalog_violations(f):
    from tidemark.operators.quality import catalog_violations as run

    return run(f.f_catalog_bad).select("symbol", "cov_start", "reasons")


@query(
    "catalog_order",
    "select series_id, cov_start, cov_end, row_count from {f_catalog} order by series_id, cov_start",
)
def catalog_order(f):
    from tidemark.operators.snapshot import catalog_order as run

    return run(f.f_catalog).select("series_id", "cov_start", "cov_end", "row_count")


@query(
    "plan_requests",
    f"""
    with recursive o_asks as ({ASKS}),
    o_walk as (
      select request_id, symbol, dataset, start_ms as cur, end_ms from o_asks
      union all
      select w.request_id, w.symbol, w.dataset, least(c.cov_end, w.end_ms), w.end_ms
      from o_walk w join {{f_catalog}} c on c.symbol = w.symbol and c.dataset = w.dataset and c.data_version = sha256_text('v1')
        and c.cov_start <= w.cur and w.cur < c.cov_end and w.cur < w.end_ms)
    select request_id, case when max(cur) = max(end_ms) then 'HIT' else 'MISS' end as result,
           case when max(cur) = max(end_ms) then 'complete_coverage' else 'uncovered_range_or_version' end as reason
    from o_walk group by request_id
    """,
)
def plan_requests(f):
    named = asks(f).withColumn("data_version", F.sha2(F.lit("v1"), 256))
    return answer.plan_requests(named, f.f_catalog.drop("uid")).select(
        "request_id", "result", "reason"
    )
