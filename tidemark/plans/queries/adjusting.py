"""Corporate-action adjustment."""

from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions import clock
from tidemark.operators import adjust
from tidemark.plans import adjusted
from tidemark.plans.queries.coverage import SEEN, WALK
from tidemark.plans.registry import query

DAY_OF = "cast(floor(({0} + 28800000) / 86400000) as integer)"


def with_day(bars):
    return bars.withColumn("local_day", clock.local_civil_day(F.col("ts_ms"), F.col("market")))


@query(
    "factor_asof",
    f"""
    select b.symbol, b.ts_ms, x.day as factor_day, x.cum
    from (select symbol, ts_ms, {DAY_OF.format('ts_ms')} as local_day from {{f_bars}}) b
    asof left join (select symbol, day, cum from {{f_factors}}) x on x.symbol = b.symbol and x.day <= b.local_day
    """,
)
def factor_asof(f):
    events = f.f_factors.withColumn("factor_day", F.col("day"))
    return adjust.bars_asof(with_day(f.f_bars), events, ["factor_day", "cum"]).select(
        "symbol", "ts_ms", "factor_day", "cum"
    )


@query(
    "latest_revision",
    """
    with o_rows as (select *, count(*) over (partition by symbol, day, update_ms) as ties,
      count(*) over (partition by symbol, day) as revisions from {f_factor_revisions}),
    o_last as (select symbol, day, max(update_ms) as update_ms, max(ties) > 1 as ambiguous, max(revisions) as revisions from o_rows group by symbol, day)
    select l.symbol, l.day, l.update_ms, l.ambiguous, l.revisions, (select min(r.cum) from o_rows r where r.symbol = l.symbol and r.day = l.day and r.update_ms = l.update_ms) as cum
    from o_last l
    """,
)
def latest_revision(f):
    return adjust.latest_revision(f.f_factor_revisions.select(
        "symbol", "market", "day", "cum", "ex_factor", "update_ms"
    )).select("symbol", "day", "update_ms", "ambiguous", "revisions", "cum")


@query(
    "affine_prefix_suffix",
    f"""
    with recursive o_events as (select *, row_number() over (partition by symbol order by day) as n, count(*) over (partition by symbol) as total from {{f_factors_affine}}),
    o_prefix as (
      select distinct symbol, cast(0 as bigint) as n, cast(1 as double) as a, cast(0 as double) as b from o_events
      union all
      select e.symbol, e.n, e.ba * p.a, e.bb * p.a + p.b from o_prefix p join o_events e on e.symbol = p.symbol and e.n = p.n + 1),
    o_suffix as (
      select distinct symbol, total as n, cast(1 as double) as a, cast(0 as double) as b from o_events
      union all
      select e.symbol, e.n - 1, e.fa * s.a, e.fb * s.a + s.b from o_suffix s join o_events e on e.symbol = s.symbol and e.n = s.n),
    o_place as (
      select b.symbol, b.ts_ms, (select count(*) from o_events e where e.symbol = b.symbol and e.day <= {DAY_OF.format('b.ts_ms')}) as n from {{f_bars}} b)
    select o.symbol, o.ts_ms, s.a as suffix_a, s.b as suffix_b, p.a as prefix_a, p.b as prefix_b
    from o_place o left join o_prefix p on p.symbol = o.symbol and p.n = o.n left join o_suffix s on s.symbol = o.symbol and s.n = o.n
    """,
)
def affine_prefix_suffix(f):
    names = ["suffix_a", "suffix_b", "prefix_a", "prefix_b"]
    maps = adjust.affine_maps(f.f_factors_affine)
    return adjust.bars_asof(with_day(f.f_bars), maps, names).select("symbol", "ts_ms", *names)


def windows(f):
    return f.sql(
        "select concat(symbol, '@', cast(w as varchar(5))) as request_id, symbol, cast(19723 + w * 7 as int) as first_day,"
        " cast(19730 + w * 10 as int) as end_day from (select symbol, each_of(0, 1, 2) as w from {f_series}) s"
    )


@query(
    "factor_window",
    """
    with o_windows as (select concat(symbol, '@', cast(w as varchar)) as request_id, symbol, 19723 + w * 7 as first_day, 19730 + w * 10 as end_day
      from (select symbol, each_of(0, 1, 2) as w from {f_series}) s)
    select w.request_id, x.day, x.cum from o_windows w join {f_factors} x on x.symbol = w.symbol and x.day < w.end_day
     and x.day >= coalesce((select max(y.day) from {f_factors} y where y.symbol = w.symbol and y.day < w.first_day), w.first_day)
    """,
)
def factor_window(f):
    events = f.f_factors.select("symbol", "day", "cum")
    return adjust.factor_window(events, windows(f), fixed.MODEL_CUMULATIVE).select(
        "request_id", "day", "cum"
    )


# Rows of one answer: the first bars of each symbol, one adjusted set per mode.
ROWS_SQL = """
select concat(symbol, '/', mode) as request_id, symbol, market, ts_ms, mode, open, high, low, close, volume
from (select *, case when uid % 2 = 0 then 'forward' else 'backward' end as mode from {f_bars_nullable}) b
"""


def request_rows(f):
    rows = with_day(f.sql(ROWS_SQL))
    return rows.withColumn("last_day", F.lit(19755))


@query(
    "forward_anchor",
    f"""
    with o_rows as (select b.symbol, b.ts_ms, coalesce(x.cum, 1) as factor
      from (select symbol, ts_ms, {DAY_OF.format('ts_ms')} as local_day from {{f_bars}}) b
      asof left join (select symbol, day, cum from {{f_factors}}) x on x.symbol = b.symbol and x.day <= b.local_day)
    select r.symbol, r.ts_ms, r.factor, (select arg_max(z.factor, z.ts_ms) from o_rows z where z.symbol = r.symbol) as anchor from o_rows r
    """,
)
def forward_anchor(f):
    rows = adjust.bars_asof(with_day(f.f_bars), f.f_factors, ["cum"])
    rows = rows.withColumn("factor", F.coalesce("cum", F.lit(1.0)))
    return adjust.forward_anchor(rows, ["symbol"]).select("symbol", "ts_ms", "factor", "anchor")


def cents(x: str) -> str:
    return f"round({x} * 100) / 100"


@query(
    "adjust_cumulative",
    f"""
    with o_rows as (select b.*, coalesce(x.cum, 1) as f, exists (select 1 from {{f_factors}} y where y.symbol = b.symbol and y.day <= 19755) as reach
      from (select *, {DAY_OF.format('ts_ms')} as local_day from ({ROWS_SQL}) r) b
      asof left join (select symbol, day, cum from {{f_factors}}) x on x.symbol = b.symbol and x.day <= b.local_day),
    o_anchor as (select request_id, arg_max(f, ts_ms) as anchor from o_rows group by request_id)
    select r.request_id, r.ts_ms, r.volume,
      case when not reach then open when mode = 'forward' then {cents('open * (f / anchor)')} else {cents('open * f')} end as open,
      case when not reach then high when mode = 'forward' then {cents('high * (f / anchor)')} else {cents('high * f')} end as high,
      case when not reach then close when mode = 'forward' then {cents('close * (f / anchor)')} else {cents('close * f')} end as close
    from o_rows r join o_anchor a on a.request_id = r.request_id
    """,
)
def adjust_cumulative(f):
    return adjust.adjust(
        request_rows(f), f.f_factors, fixed.MODEL_CUMULATIVE, ["request_id"]
    ).select("request_id", "ts_ms", "volume", "open", "high", "close")


AFFINE = f"""
    with recursive o_events as (select *, row_number() over (partition by symbol order by day) as n, count(*) over (partition by symbol) as total from {{f_factors_affine}}),
    o_prefix as (
      select distinct symbol, cast(0 as bigint) as n, cast(1 as double) as a, cast(0 as double) as b from o_events
      union all
      select e.symbol, e.n, e.ba * p.a, e.bb * p.a + p.b from o_prefix p join o_events e on e.symbol = p.symbol and e.n = p.n + 1),
    o_suffix as (
      select distinct symbol, total as n, cast(1 as double) as a, cast(0 as double) as b from o_events
      union all
      select e.symbol, e.n - 1, e.fa * s.a, e.fb * s.a + s.b from o_suffix s join o_events e on e.symbol = s.symbol and e.n = s.n),
    o_place as (
      select b.*, (select count(*) from o_events e where e.symbol = b.symbol and e.day <= {DAY_OF.format('b.ts_ms')}) as n from ({ROWS_SQL}) b)
    select o.request_id, o.ts_ms, o.volume,
      coalesce(case when mode = 'forward' then high * s.a + s.b else high * p.a + p.b end, high) as high,
      case when close is null then null else coalesce(case when mode = 'forward' then close * s.a + s.b else close * p.a + p.b end, close) end as close
    from o_place o left join o_prefix p on p.symbol = o.symbol and p.n = o.n left join o_suffix s on s.symbol = o.symbol and s.n = o.n
"""


@query("adjust_affine", AFFINE)
def adjust_affine(f):
    return adjust.adjust(
        request_rows(f), f.f_factors_affine, fixed.MODEL_AFFINE, ["request_id"]
    ).select("request_id", "ts_ms", "volume", "high", "close")


NOW = 1704067260000

ADJUSTED = f"""
    with recursive {WALK},
    o_adjusted as (select *, case when uid % 2 = 0 then 'forward' else 'backward' end as mode from o_asks where dataset = 'ddb-history-native64'),
    o_bound as (
      select a.*, e.frontier, coalesce(v.versions, 0) as versions, fs.allow_empty, fs.observed_at_ms, fs.valid_until_ms, fs.data_hash,
        {DAY_OF.format('a.start_ms')} as first_day, {DAY_OF.format('(a.end_ms - 1)')} as last_day, fs.first_day as set_first, fs.end_day as set_end
      from o_adjusted a join o_end e on e.request_id = a.request_id left join o_versions v on v.request_id = a.request_id
      left join {{f_factor_sets}} fs on fs.symbol = a.symbol),
    o_status as (
      select *, exists (select 1 from {{f_factors}} x where x.symbol = b.symbol and x.day <= b.last_day) as reach,
        case when versions > 1 then 'ERROR' when frontier < end_ms then 'MISS' else 'HIT' end as status from o_bound b),
    o_served as (select * from o_status where status = 'HIT'), {SEEN},
    o_bad as (select request_id, count(*) filter (where visible = 0 and not confirmed) as bad, sum(visible) as n, min(ts_ms) filter (where visible = 1) as first_ms from o_seen group by request_id),
    o_state as (
      select s.*, coalesce(b.bad, 0) > 0 as failed, coalesce(b.n, 0) as n, b.first_ms, case when observed_at_ms is null then 'factors_missing' when observed_at_ms > {NOW} then 'future_dated'
        when first_day < set_first or last_day >= set_end then 'factor_window' when not reach and not allow_empty then 'no_factors' end as problem
      from o_status s left join o_bad b on b.request_id = s.request_id)
"""


def adjusted_parts(f):
    f.keep("f_bars")
    f.keep("f_series")
    f.keep("f_factors")
    mode = F.when(F.col("uid") % 2 == 0, "forward").otherwise("backward")
    asked = f.f_requests.withColumn("adjust", mode)
    factors = f.f_factors.select(
        "symbol", "market", "model", "day", "cum",
        *[F.lit(None).cast("double").alias(c) for c in ["fa", "fb", "ba", "bb"]],
    )
    return adjusted.adjusted_query(
        asked,
        f.f_catalog_tiers,
        f.f_bars_tiers,
        f.f_suspensions,
        f.f_factor_sets,
        factors,
        F.lit(NOW).cast("bigint"),
    )


@query(
    "adjusted_query",
    f"""
    {ADJUSTED},
    o_days as (select s.request_id, max({DAY_OF.format('s.ts_ms')}) as anchor_day from o_seen s where visible = 1 group by s.request_id)
    select o.request_id,
      case when failed then 'ERROR' when status = 'HIT' and problem is not null then 'ERROR' else status end as status,
      case when failed then 'invalid_request' when status = 'HIT' and problem is not null then 'read_failed' when versions > 1 then 'read_failed' when status = 'MISS' then 'adjustment_requires_complete_range' end as reason,
      case when failed then 'unclassified_null' when status = 'HIT' and problem is not null then problem when versions > 1 then 'data_version' end as detail,
      case when status = 'HIT' and not failed and problem is null then cast(n as bigint) end as rows,
      case when status = 'HIT' and not failed and problem is null then first_ms end as first_ms,
      case when status = 'HIT' and not failed and problem is null then case when {NOW} < valid_until_ms then 'current' else 'overdue' end end as factor_check_status,
      case when status = 'HIT' and not failed and problem is null and mode = 'forward' then anchor_day end as anchor_day
    from o_state o left join o_days d on d.request_id = o.request_id
    union all
    select request_id, 'ERROR', 'invalid_request', 'bounds', null, null, null, null from {{f_requests}} where end_ms <= start_ms
    union all
    select request_id, 'MISS', 'unsupported_series', 'series', null, null, null, null from {{f_requests}} where end_ms > start_ms and row_encoding <> 'le-ddb-native64-v1'
    """,
)
def adjusted_query(f):
    result, _ = adjusted_parts(f)
    return result.select(
        "request_id", "status", "reason", "detail", "rows", "first_ms", "factor_check_status", "anchor_day"
    )


@query(
    "adjusted_prices",
    f"""
    {ADJUSTED},
    o_good as (select s.request_id, s.ts_ms, s.close, o.mode, o.reach, s.symbol, {DAY_OF.format('s.ts_ms')} as local_day
      from o_seen s join o_state o on o.request_id = s.request_id where s.visible = 1 and o.problem is null),
    o_factor as (select g.*, coalesce(x.cum, 1) as f from o_good g asof left join (select symbol, day, cum from {{f_factors}}) x on x.symbol = g.symbol and x.day <= g.local_day),
    o_anchor as (select request_id, arg_max(f, ts_ms) as anchor from o_factor group by request_id)
    select r.request_id, r.ts_ms, case when not reach then close when mode = 'forward' then {cents('close * (f / anchor)')} else {cents('close * f')} end as close
    from o_factor r join o_anchor a on a.request_id = r.request_id
    """,
)
def adjusted_prices(f):
    _, rows = adjusted_parts(f)
    return rows.select("request_id", "ts_ms", "close")


TERMS = """
select symbol as request_id, symbol, market, cast(1704067200000 as bigint) as start_ms, cast(1706832000000 as bigint) as end_ms,
       cast(1705276800000 as bigint) as split_ms, cast(n_prefix + case when uid % 9 = 4 then 1 else 0 end as bigint) as prefix_rows,
       case when uid % 2 = 0 then 'forward' else 'backward' end as mode, 19755 as last_day
from (select symbol, market, uid, sum(case when ts_ms < 1705276800000 then 1 else 0 end) as n_prefix from {f_bars} group by symbol, market, uid) t
"""
PREFIX = "select symbol as request_id, ts_ms, open, high, low, close, volume, open_oi, close_oi from {f_bars} where ts_ms < 1705276800000"
TAIL = """select symbol as request_id, case when uid % 7 = 5 and close_oi % 3 = 0 then ts_ms - 1209600000 else ts_ms end as ts_ms,
  case when uid % 8 = 3 then null else open end as open, high, low, close, volume, open_oi, close_oi from {f_bars} where ts_ms >= 1705276800000"""


@query(
    "prefix_tail_merge",
    f"""
    with o_terms as ({TERMS}), o_all as (select *, 0 as part from ({PREFIX}) p union all select *, 1 from ({TAIL}) t),
    o_bad as (
      select a.request_id, case when a.part = 1 and a.ts_ms < t.split_ms then 'tail_side' when a.open is null then 'null_price'
        when count(*) over (partition by a.request_id, a.ts_ms) > 1 then 'order' end as bad, a.part
      from o_all a join o_terms t on t.request_id = a.request_id),
    o_sum as (select b.request_id, min(bad) as bad, count(*) filter (where part = 0) as n, count(*) as rows from o_bad b group by b.request_id)
    select s.request_id, s.rows, coalesce(s.bad, case when s.n <> t.prefix_rows then 'prefix_rows' end) as problem
    from o_sum s join o_terms t on t.request_id = s.request_id
    """,
)
def prefix_tail_merge(f):
    merged = adjusted.merge_prefix_tail(f.sql(PREFIX), f.sql(TAIL), f.sql(TERMS))
    return merged.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("rows"), F.min("problem").alias("problem")
    )


@query(
    "adjust_composite",
    f"""
    with o_terms as ({TERMS}), o_all as (select *, 0 as part from ({PREFIX}) p union all select *, 1 from ({TAIL}) t),
    o_bad as (
      select a.request_id, max(case when a.part = 1 and a.ts_ms < t.split_ms then 1 when a.open is null then 1 else 0 end) as bad,
        count(*) filter (where a.part = 0) <> max(t.prefix_rows) as short
      from o_all a join o_terms t on t.request_id = a.request_id group by a.request_id),
    o_rows as (select a.request_id, a.ts_ms, a.close, t.mode, t.symbol, {DAY_OF.format('a.ts_ms')} as local_day
      from o_all a join o_terms t on t.request_id = a.request_id join o_bad b on b.request_id = a.request_id where b.bad = 0 and not b.short),
    o_factor as (select r.*, coalesce(x.cum, 1) as f, exists (select 1 from {{f_factors}} y where y.symbol = r.symbol) as reach
      from o_rows r asof left join (select symbol, day, cum from {{f_factors}}) x on x.symbol = r.symbol and x.day <= r.local_day),
    o_anchor as (select request_id, arg_max(f, ts_ms) as anchor from o_factor group by request_id)
    select r.request_id, r.ts_ms, case when not reach then close when mode = 'forward' then {cents('close * (f / anchor)')} else {cents('close * f')} end as close
    from o_factor r join o_anchor a on a.request_id = r.request_id
    """,
)
def adjust_composite(f):
    rows, _ = adjusted.adjust_composite(f.sql(PREFIX), f.sql(TAIL), f.sql(TERMS), f.f_factors)
    return rows.select("request_id", "ts_ms", "close")
