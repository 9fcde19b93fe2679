"""The given tables seen as bars, catalogs, requests, factors and logs.

Each shape is one SQL text used by both engines; ``{name}`` refers to a table or
to another shape. Only the few spellings in ``SPARK`` and ``DUCKDB`` differ.
"""

import functools
import re

from pyspark.sql import DataFrame, SparkSession

from tidemark.session import materialize

TABLES = ["events", "orders", "lineitem", "customer", "supplier", "part", "nation", "region"]

# Monday 2024-01-01 00:00 UTC and the length of a week.
T0 = 1704067200000
WEEK = 604800000
DAY = 86400000

SHAPES: dict[str, str] = {}

SHAPES["f_bars"] = """
select 'ddb-history-native64' as dataset,
       case when user_id % 2 = 0 then 'SZ' else 'SH' end as market,
       concat(lpad(cast(user_id as varchar(20)), 6, '0'),
              case when user_id % 2 = 0 then '.SZ' else '.SH' end) as symbol,
       user_id as uid,
       ms_of(ts) - ms_of(ts) % 60000 as ts_ms,
       min_by(value, event_id) as open, max(value) as high, min(value) as low,
       max_by(value, event_id) as close, count(*) as volume,
       max(value) * count(*) as turnover, min(event_id) as open_interest,
       min(event_id) as open_oi, max(event_id) as close_oi,
       min(case when event_type = 'error' then 1 else 0 end) as all_error
from {events}
group by user_id, ms_of(ts) - ms_of(ts) % 60000
"""

SHAPES["f_bars_nullable"] = """
select dataset, market, symbol, uid, ts_ms,
       case when all_error = 1 then null else open end as open,
       case when all_error = 1 then cast(0 as double) else high end as high,
       case when all_error = 1 then cast(0 as double) else low end as low,
       case when all_error = 1 then null else close end as close,
       case when all_error = 1 then 0 else volume end as volume,
       turnover, open_interest,
       case when all_error = 1 then 0 else open_oi end as open_oi,
       case when all_error = 1 then 0 else close_oi end as close_oi
from {f_bars}
"""

# Some placeholders lose their shape (volume 1), some rows break a rule.
SHAPES["f_bars_broken"] = """
select dataset, market, symbol, uid,
       case when close_oi % 41 = 0 then -ts_ms else ts_ms end as ts_ms,
       case when close_oi % 37 = 0 then cast('NaN' as double) else open end as open,
       case when close_oi % 43 = 0 then cast('Infinity' as double) else high end as high,
       low, close,
       case when open_oi % 31 = 0 and uid % 2 = 1 then -volume
            when uid % 7 = 3 and volume = 0 then 1 else volume end as volume,
       turnover, open_interest, open_oi,
       case when uid % 13 = 5 then -close_oi else close_oi end as close_oi
from {f_bars_nullable}
"""

SHAPES["f_suspensions"] = """
select distinct symbol,
       cast(floor((ts_ms + 28800000) / 86400000) as bigint) * 86400000 - 28800000 as start_ms,
       cast(floor((ts_ms + 28800000) / 86400000) as bigint) * 86400000 + 57600000 as end_ms,
       'fixture' as evidence
from {f_bars_nullable} where open is null and volume = 0 and uid % 3 = 0
"""

SHAPES["f_suspensions_raw"] = """
select symbol, start_ms, end_ms, evidence from {f_suspensions}
union all
select case when user_id % 2 = 0 then concat('X', cast(user_id as varchar(20)), '.SZ')
            else concat(lpad(cast(user_id as varchar(20)), 6, '0'), '.SH') end as symbol,
       case when user_id % 5 = 0 then 0 else ms_of(ts) end as start_ms,
       case when user_id % 7 = 0 then 0 else ms_of(ts) + 60000 end as end_ms,
       case when user_id % 3 = 0 then ' ' else 'notice' end as evidence
from {events} where event_type = 'signup'
"""

SHAPES["f_series"] = """
select distinct dataset, market, symbol, uid from {f_bars}
"""

SHAPES["f_weeks"] = """
select dataset, market, symbol, uid, each_of(0, 1, 2, 3) as week from {f_series}
"""

SHAPES["f_cov_rows"] = f"""
select symbol, cast(floor((ts_ms - {T0}) / {WEEK}) as int) as week, count(*) as n
from {{f_bars}} group by symbol, cast(floor((ts_ms - {T0}) / {WEEK}) as int)
"""

# Week 2 (0-based) is missing for every fifth symbol; every eleventh changes its
# data version there. The archive ends after week 3.
SHAPES["f_catalog"] = f"""
select s.dataset, s.market, s.symbol, s.uid, 60 as period_seconds, 'none' as adjust,
       substring(sha256_text(concat('history-series-v1', chr(10), '20:', s.dataset, chr(10), '2:', s.market,
         chr(10), '9:', s.symbol, chr(10), '2:60', chr(10), '4:none', chr(10))), 1, 32) as series_id,
       sha256_text(case when s.uid % 11 = 0 and s.week >= 2 then 'v2' else 'v1' end) as data_version,
       cast(1 + s.uid % 3 as decimal(20, 0)) as source_version,
       {T0} + cast(s.week as bigint) * {WEEK} as cov_start, {T0} + cast(s.week + 1 as bigint) * {WEEK} as cov_end,
       coalesce(n.n, 0) as row_count,
       case when n.n is null then null else
         sha256_text(concat(s.symbol, ':', cast(s.week as varchar(10)), ':', cast(n.n as varchar(20)))) end as content_hash,
       true as nullable_prices, 'epoch-1' as epoch, cast(1 as decimal(20, 0)) as generation,
       'history' as tier
from {{f_weeks}} s
left join {{f_cov_rows}} n on n.symbol = s.symbol and n.week = s.week
where not (s.week = 2 and s.uid % 5 = 0)
"""

SHAPES["f_catalog_bad"] = f"""
select dataset, market, symbol, uid, period_seconds,
       case when uid % 17 = 0 then 'forward' else adjust end as adjust,
       case when uid % 19 = 0 then concat('00', substring(series_id, 3, 30)) else series_id end as series_id,
       data_version, case when uid % 23 = 0 then cast(0 as decimal(20, 0)) else source_version end as source_version,
       cov_start, case when uid % 13 = 0 then cov_end + 1 else cov_end end as cov_end,
       case when uid % 29 = 0 then 0 else row_count end as row_count, content_hash, nullable_prices,
       epoch, generation, tier
from {{f_catalog}}
"""

# One entry per China day from week 3 on, so that it overlaps the archive's end.
SHAPES["f_days"] = """
select dataset, market, symbol, uid,
       each_of(19744, 19745, 19746, 19747, 19748, 19749, 19750, 19751, 19752, 19753) as day
from {f_series}
"""

SHAPES["f_catalog_tiers"] = f"""
select dataset, market, symbol, cov_start, cov_end, data_version, tier from {{f_catalog}}
union all
select dataset, market, symbol, cast(day as bigint) * {DAY} - 28800000 as cov_start, cast(day as bigint) * {DAY} + 57600000 as cov_end,
       sha256_text('v1') as data_version, 'intraday' as tier
from {{f_days}}
"""

SHAPES["f_bars_tiers"] = f"""
select dataset, market, symbol, ts_ms, open, high, low, close, volume, open_oi, close_oi,
       'history' as tier
from {{f_bars_nullable}} where ts_ms < {T0 + 4 * WEEK}
union all
select dataset, market, symbol, ts_ms, open, high, low, close, volume + 1000 as volume,
       open_oi, close_oi, 'intraday' as tier
from {{f_bars}} where ts_ms >= {T0 + 3 * WEEK}
"""

SHAPES["f_requests"] = f"""
select concat(symbol, '#', cast(k as varchar(5))) as request_id, symbol, uid,
       case when k = 0 then {T0 + WEEK + DAY} when k = 1 then {T0 + WEEK}
            when k = 2 then {T0} when k = 3 then {T0 + 24 * DAY} else {T0 + 17 * DAY} end as start_ms,
       case when k = 0 and uid % 10 = 0 then {T0} when k = 0 then {T0 + WEEK + 5 * DAY}
            when k = 1 then {T0 + 4 * WEEK} when k = 2 then {T0 + 32 * DAY}
            when k = 3 then {T0 + 29 * DAY + 3600000} else {T0 + 32 * DAY} end as end_ms,
       cast(case when k = 0 then 5 when k = 1 then 20 else 5000 end as bigint) as max_rows,
       60 as period_seconds, 'none' as adjust,
       case when uid % 13 = 0 and k = 1 then 'le-i64-f32x4-i64-v1' else 'le-ddb-native64-v1' end as row_encoding,
       k >= 3 as include_intraday, (k = 1 and uid % 2 = 0) or k = 2 or k = 4 as allow_partial
from (select symbol, uid, each_of(0, 1, 2, 3, 4) as k from {{f_series}}) s
"""

SHAPES["f_factor_rows"] = """
select p.symbol, p.market, p.uid, p.day, cast(r.k as int) as k, p.event_id, p.update_ms
from (select concat(lpad(cast(user_id as varchar(20)), 6, '0'),
                    case when user_id % 2 = 0 then '.SZ' else '.SH' end) as symbol,
             case when user_id % 2 = 0 then 'SZ' else 'SH' end as market, user_id as uid,
             cast(floor((ms_of(ts) + 28800000) / 86400000) as int) as day, event_id, ms_of(ts) as update_ms
      from {events} where event_type = 'purchase') p
join (select uid, day, row_number() over (partition by uid order by day) as k
      from (select distinct user_id as uid, cast(floor((ms_of(ts) + 28800000) / 86400000) as int) as day
            from {events} where event_type = 'purchase') d) r on r.uid = p.uid and r.day = p.day
"""

SHAPES["f_factor_revisions"] = """
select symbol, market, uid, 'cumulative' as model, day, 1 + k * cast(0.25 as double) as ex_factor,
       1 + k * cast(0.25 as double) + case when event_id % 2 = 0 then cast(0.5 as double) else cast(0 as double) end as cum,
       case when uid % 10 = 7 then update_ms - update_ms % 86400000 else update_ms end as update_ms
from {f_factor_rows}
"""

SHAPES["f_factors"] = """
select distinct symbol, market, uid, 'cumulative' as model, day, 1 + k * cast(0.25 as double) as cum
from {f_factor_rows}
"""

SHAPES["f_factors_affine"] = """
select distinct symbol, market, uid, 'futu_ab' as model, day,
       cast(0.5 as double) as fa, k * cast(0.125 as double) as fb,
       cast(2 as double) as ba, k * cast(-0.125 as double) as bb
from {f_factor_rows}
"""

SHAPES["f_factor_sets"] = """
select s.symbol, s.market, s.uid, 'cumulative' as model, 19700 as first_day, 19800 as end_day,
       true as complete, s.uid % 2 = 0 as allow_empty, cast('factor-epoch-1' as varchar(20)) as source_epoch,
       1704067200000 + s.uid * 1000 as observed_at_ms, 1704153600000 + s.uid * 1000 as valid_until_ms,
       1 + s.uid % 4 as source_revision, sha256_text(concat('receipt', s.symbol)) as source_receipt_sha256,
       sha256_text(concat('data', s.symbol)) as data_hash
from {f_series} s
"""

SHAPES["f_factor_sets_next"] = """
select symbol, market, uid, case when uid % 31 = 0 then 'futu_ab' else model end as model,
       case when uid % 7 = 0 then first_day + 1 else first_day end as first_day,
       case when uid % 11 = 0 then end_day - 1 else end_day end as end_day,
       complete, allow_empty, case when uid % 37 = 0 then 'factor-epoch-2' else source_epoch end as source_epoch,
       case when uid % 13 = 0 then observed_at_ms - 1 else observed_at_ms + 60000 end as observed_at_ms,
       case when uid % 17 = 0 then valid_until_ms - 1 else valid_until_ms + 60000 end as valid_until_ms,
       case when uid % 3 = 0 then source_revision when uid % 19 = 0 then source_revision - 1
            else source_revision + 1 end as source_revision,
       source_receipt_sha256, case when uid % 5 = 0 then sha256_text(concat('next', symbol)) else data_hash end as data_hash
from {f_factor_sets}
"""

SHAPES["f_catalog_next"] = """
select dataset, market, symbol, uid, period_seconds, adjust, series_id,
       case when uid % 14 = 3 then sha256_text('v3') else data_version end as data_version,
       case when uid % 7 = 0 then source_version - 1 when uid % 2 = 0 then source_version + 1
            else source_version end as source_version,
       cov_start, cov_end, case when uid % 9 = 1 then row_count + 1 else row_count end as row_count, content_hash, nullable_prices,
       epoch, cast(2 as decimal(20, 0)) as generation, tier
from {f_catalog}
"""

SHAPES["f_catalog_epoch"] = """
select dataset, market, symbol, uid, period_seconds, adjust, series_id, data_version,
       case when uid % 6 = 1 then source_version else source_version + 5 end as source_version,
       cov_start, case when uid % 7 = 2 then cov_end - 1 else cov_end end as cov_end,
       case when uid % 5 = 3 and row_count > 0 then row_count - 1 else row_count end as row_count, content_hash,
       nullable_prices, case when uid % 8 = 4 then epoch else 'epoch-2' end as epoch,
       cast(1 as decimal(20, 0)) as generation, tier
from {f_catalog}
"""

SHAPES["f_bars_rebuilt"] = """
select * from {f_bars} where not (uid % 4 = 1 and close_oi % 10 = 0)
"""

SHAPES["f_wall"] = """
select event_id, case when event_id % 2 = 0 then ms_of(ts) - 1705363200000 + 1772928000000
                      else ms_of(ts) - 1705363200000 + 1793491200000 end as ms
from {events}
"""

SHAPES["f_generations"] = """
select uid, obs, seq, sha256_text(concat(cast(uid as varchar(20)), ':',
         case when obs % 17 = 0 then 'changed' else cast(seq as varchar(20)) end)) as manifest
from (select user_id as uid, event_id as obs,
             cast(floor(event_id / 300) as bigint) + 10 - case when event_id % 23 = 0 then 3 else 0 end as seq
      from {events}) g
"""

# Four records per candidate; attempts and results alternate, with few orphans.
SHAPES["f_attempts"] = """
select candidate, idx, case when idx % 31 = 0 then 'conflict' when n % 2 = 1 then 'attempt'
       else case event_type when 'click' then 'attempt' when 'view' then 'not_applied' when 'error' then 'unknown'
            when 'purchase' then 'conflict' else 'committed' end end as kind
from (select cast(floor(event_id / 4) as bigint) as candidate, event_id as idx, event_type, event_id % 4 + 1 as n
      from {events}) a
"""

# Logs of 5 000 records each, some of them tampered with.
SHAPES["f_journal"] = """
select log, case when event_id % 23 = 0 then n + 1 else n end as idx, n, kind, cents,
       case when event_id % 17 = 0 then sha256_text('tampered')
            else coalesce(lag(good) over (partition by log order by n), sha256_text('intent')) end as prev_hash,
       case when event_id % 29 = 0 then sha256_text('altered') else good end as hash
from (
  select log, n, event_id, kind, cents,
         sha256_text(concat(cast(log as varchar(20)), '|', cast(n as varchar(20)), '|', kind, '|', cast(cents as varchar(20)))) as good
  from (select cast(floor(event_id / 5000) as bigint) as log, event_id, event_type as kind,
               cast(floor(value * 100) as bigint) as cents, event_id % 5000 + 1 as n from {events}) a) b
"""

SHAPES["f_health"] = """
select user_id as instance, event_id, cast(floor(ms_of(ts) / 1000) as bigint) as observed_s,
       case event_type when 'error' then 'agent_missing' when 'signup' then 'agent_restarted'
            when 'view' then 'deployment_archive_required' when 'purchase' then 'agent_unhealthy' end as code,
       event_id % 5 <> 0 as send_ok
from {events}
"""

SHAPES["f_usage_log"] = """
select l_returnflag as stage, cast(floor(l_quantity) as bigint) as requests,
       cast(floor(l_extendedprice) as bigint) as bytes,
       cast(floor(l_extendedprice * 10) as bigint) as elapsed_us,
       case when l_linestatus = 'F' then 1 else 0 end as failures
from {lineitem}
"""

SHAPES["f_results"] = """
select cast(o_orderkey as varchar(20)) as transaction_id, o_custkey as host,
       cast(floor(ms_of(o_orderdate) / 1000) as bigint) as updated_s,
       case o_orderstatus when 'O' then 'ACCEPTED' when 'F' then 'ROLLED_BACK' else 'STAGED' end as phase
from {orders}
"""

SHAPES["f_export"] = """
select 'ddb-history-snapshot' as dataset, 'SH' as market,
       concat(lpad(cast(o_custkey as varchar(20)), 6, '0'), '.SH') as symbol,
       o_orderkey as row_no, ms_of(o_orderdate) as ts_ms
from {orders}
"""

# Some proofs of f_proofs come twice.
SHAPES["f_day_proofs"] = f"""
select dataset, market, symbol, uid, cov_start as requested_start_ms, cov_end as requested_end_ms,
       data_version, case when uid % 9 = 4 then source_version + 1 else source_version end as source_version,
       sha256_text(concat('guard', symbol)) as guard_before,
       sha256_text(concat(case when uid % 12 = 5 then 'moved' else 'guard' end, symbol)) as guard_after,
       case when uid % 10 = 6 then row_count + 1 else row_count end as row_count,
       case when uid % 15 = 7 then 1 else 500000 end as max_rows,
       cast(row_count * 40 + 500 as bigint) as proof_bytes
from {{f_catalog}} where not (uid % 16 = 8)
"""

SHAPES["f_proofs"] = """
select * from {f_day_proofs}
union all
select dataset, market, symbol, uid, cov_start, cov_end, data_version, source_version,
       sha256_text(concat('guard', symbol)), sha256_text(concat('guard', symbol)), row_count, 500000,
       cast(row_count * 40 + 500 as bigint)
from {f_catalog} where uid % 14 = 9
"""

SHAPES["f_symbols"] = """
select event_id, case when event_id % 13 = 0 then 'CZC' when event_id % 7 = 0 then 'US' when user_id % 2 = 0 then 'SZ'
            when event_id % 11 = 0 then 'HK' else 'SHF' end as market,
       case event_id % 13 when 0 then concat('AP', lpad(cast(user_id % 1000 as varchar(20)), 3, '0'), 'C', cast(event_id as varchar(20)), '.CZC')
            when 1 then concat(lpad(cast(user_id as varchar(20)), 6, '0'), '.SZ')
            when 2 then concat(lpad(cast(user_id as varchar(20)), 5, '0'), '.HK')
            when 3 then concat('rb', cast(2400 + user_id % 13 as varchar(20)), '.SHF')
            when 4 then concat('rb', cast(user_id as varchar(20)), '.SHF')
            when 5 then concat(upper(substring(event_type, 1, 4)), '.', cast(user_id as varchar(20)))
            when 6 then concat(event_type, '_', cast(user_id as varchar(20)))
            when 7 then upper(event_type)
            when 8 then concat('0', cast(user_id as varchar(20)), '.SH')
            when 9 then 'm2409-C-3100.DCE' when 10 then '.' when 11 then '' else 'BRK-B' end as symbol
from {events}
"""

# Replies to a request log: same columns as f_requests, with bad values mixed in.
SHAPES["f_requests_raw"] = """
select concat('r', cast(event_id as varchar(20))) as request_id, symbol,
       case when event_id % 29 = 0 then 0 else ms_of(ts_) end as start_ms,
       case when event_id % 31 = 0 then ms_of(ts_) when event_id % 37 = 0 then ms_of(ts_) + 31708800000
            else ms_of(ts_) + 60000 * event_id end as end_ms,
       cast(case when event_id % 41 = 0 then 0 when event_id % 43 = 0 then 5001 else 10 end as bigint) as max_rows,
       case when event_id % 47 = 0 then 300 else 60 end as period_seconds,
       case event_id % 5 when 0 then 'forward' when 1 then 'backward' when 2 then 'sideways' else 'none' end as adjust,
       case event_id % 6 when 0 then 'le-i64-f32x4-i64-v1' when 1 then 'le-kline48-v1' when 2 then 'json'
            else 'le-ddb-native64-v1' end as row_encoding,
       event_id % 4 = 0 as include_intraday, event_id % 3 = 0 as allow_partial
from (select s.event_id, s.symbol, e.ts as ts_ from {f_symbols} s join {events} e on e.event_id = s.event_id) x
"""

SPARK = {
    "ms_of": "(cast(datediff(cast({0} as date), date'1970-01-01') as bigint) * 86400000L"
    " + hour({0}) * 3600000L + minute({0}) * 60000L"
    " + cast(floor(extract(second from {0}) * 1000) as bigint))",
    "sha256_text": "sha2({0}, 256)",
    "each_of": "explode(array({0}))",
}
DUCKDB = {
    "ms_of": "(epoch_us({0}) // 1000)",
    "sha256_text": "sha256({0})",
    "each_of": "unnest([{0}])",
}


def spell(text: str, names: dict[str, str]) -> str:
    """Replace the spelled functions, innermost call first."""
    for name, form in names.items():
        while True:
            at = re.search(r"\b" + name + r"\(", text)
            if not at:
                break
            depth, end = 1, at.end()
            while depth:
                depth += {"(": 1, ")": -1}.get(text[end], 0)
                end += 1
            text = text[: at.start()] + form.format(text[at.end() : end - 1]) + text[end:]
    return text


def _names(text: str) -> list[str]:
    return sorted(set(re.findall(r"\{([a-z]\w*)\}", text)))


class Shapes:
    """Shapes of one data folder as DataFrames, each built on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._built: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._built:
            if name in SHAPES:
                self._built[name] = self.sql(SHAPES[name])
            else:
                self._built[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._built[name]

    def keep(self, name: str) -> None:
        """Write a shape that several steps read; shapes that are built from it from now on read the stored table."""
        self._built[name] = materialize(getattr(self, name), name)

    def sql(self, text: str) -> DataFrame:
        parts = {name: getattr(self, name) for name in _names(text)}
        return self.spark.sql(spell(text, SPARK), **parts)


@functools.cache
def _ordered_shapes(name: str) -> tuple[str, ...]:
    """The shape and everything it is built from, dependencies first."""
    found: list[str] = []
    for part in _names(SHAPES[name]):
        if part in SHAPES:
            found += [p for p in _ordered_shapes(part) if p not in found]
    return (*found, name)


def duckdb_query(body: str) -> str:
    """``body`` with its ``{shape}`` references resolved to common table expressions."""
    wanted: list[str] = []
    for name in _names(body):
        if name in SHAPES:
            wanted += [p for p in _ordered_shapes(name) if p not in wanted]
    heads = [f"{n} as ({SHAPES[n].strip()})" for n in wanted]
    text = ",\n".join(heads)
    body = body.strip()
    own = re.match(r"with\s+(recursive\s+)?", body, re.I)
    if own:
        head = "with recursive " if own.group(1) else "with "
        joined = head + (text + ",\n" if text else "") + body[own.end() :]
    else:
        joined = ("with " + text + "\n" if text else "") + body
    return spell(re.sub(r"\{([a-z]\w*)\}", r"\1", joined), DUCKDB)
