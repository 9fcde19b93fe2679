"""Row quality, requests, order and simple scans."""

from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions import identity
from tidemark.operators import quality, requests, scan
from tidemark.plans.registry import query
from tidemark.session import materialize

# Requests that reach the catalog, written out for the checks.
ASKS = """
select request_id, case row_encoding when 'le-ddb-native64-v1' then 'ddb-history-native64' else 'ddb-history-snapshot' end as dataset,
       right(symbol, 2) as market, symbol, uid, start_ms, end_ms, max_rows, include_intraday, allow_partial
from {f_requests}
where end_ms > start_ms and not (row_encoding <> 'le-ddb-native64-v1' and (allow_partial or include_intraday))
"""


def asks(f):
    """Requests of the fixture that reach the catalog."""
    normal = materialize(requests.normalize_requests(f.f_requests), "requests")
    return normal.where("status is null")


def ranges(f):
    return asks(f).select(
        "request_id",
        "dataset",
        "market",
        "symbol",
        "max_rows",
        F.col("start_stored").alias("lo"),
        F.col("end_stored").alias("hi"),
    )


@query(
    "range_scan",
    f"""
    with o_asks as ({ASKS})
    select a.request_id, b.symbol, b.ts_ms, b.close, b.volume
    from o_asks a join {{f_bars}} b on b.dataset = a.dataset and b.symbol = a.symbol
     and b.ts_ms >= a.start_ms and b.ts_ms < a.end_ms
    """,
)
def range_scan(f):
    return scan.range_scan(f.f_bars, ranges(f)).select(
        "request_id", "symbol", "ts_ms", "close", "volume"
    )


@query(
    "half_open_filter",
    """
    select symbol, ts_ms, volume from {f_bars}
    where ts_ms >= 1704672000000 and ts_ms < 1705276800000
    """,
)
def half_open_filter(f):
    return f.f_bars.where(
        (F.col("ts_ms") >= 1704672000000) & (F.col("ts_ms") < 1705276800000)
    ).select("symbol", "ts_ms", "volume")


@query(
    "row_violations",
    """
    select symbol, ts_ms, open_oi, concat_ws(',', case when ts_ms < 0 then 'negative_ts' end,
      case when isnan(open) then 'nonfinite_open' end, case when open is null and volume <> 0 then 'null_open' end,
      case when isinf(high) then 'nonfinite_high' end, case when close is null and volume <> 0 then 'null_close' end,
      case when volume < 0 then 'negative_volume' end, case when close_oi < 0 then 'negative_close_oi' end) as reasons
    from {f_bars_broken}
    where ts_ms < 0 or isnan(open) or (open is null and volume <> 0) or isinf(high) or (close is null and volume <> 0)
       or volume < 0 or close_oi < 0
    """,
)
def row_violations(f):
    nullable = F.col("volume") == 0
    return quality.row_violations(f.f_bars_broken, nullable=nullable).select(
        "symbol", "ts_ms", "open_oi", "reasons"
    )


@query(
    "project_rows",
    """
    select symbol, ts_ms, open is null as open_nan, coalesce(cast(cast(open as float) as double), 0) as open,
           cast(cast(high as float) as double) as high, cast(cast(low as float) as double) as low,
           coalesce(cast(cast(close as float) as double), 0) as close, volume, turnover, open_interest
    from {f_bars_nullable}
    """,
)
def project_rows(f):
    rows = quality.project_rows(f.f_bars_nullable, fixed.ENCODING_COMPLETE)
    plain = [
        F.nanvl(F.col(p).cast("double"), F.lit(0.0)).alias(p)
        for p in ["open", "high", "low", "close"]
    ]
    return rows.select(
        "symbol", "ts_ms", F.isnan("open").alias("open_nan"), *plain, "volume", "turnover", "open_interest"
    )


@query(
    "null_price_class",
    """
    select symbol, ts_ms, open_oi, case when open is null and close is null and high = 0 and low = 0 and volume = 0
      and open_oi = 0 and close_oi = 0 then 'suspended'
      when open is null or high is null or low is null or close is null then 'unexpected_null' else 'normal' end as null_class
    from {f_bars_broken}
    """,
)
def null_price_class(f):
    return quality.null_price_class(f.f_bars_broken).select(
        "symbol", "ts_ms", "open_oi", "null_class"
    )


MARKET = r"""case when regexp_full_match(symbol, 'AP[0-9]{3}[CP][0-9]{1,8}\.CZC') then 'CZC'
  when regexp_full_match(symbol, '[0-9]{6}\.(SH|SZ)') or regexp_full_match(symbol, '[0-9]{5}\.HK')
    or regexp_full_match(symbol, '[A-Za-z]{1,3}[0-9]{3,4}\.(SHF|CFE|CZC|DCE|INE)')
    then regexp_extract(symbol, '\.([A-Z]+)$', 1)
  when regexp_matches(symbol, '(^|\.)(SHF|CFE|CZC|DCE|INE)$') then null
  when regexp_full_match(symbol, '[A-Za-z][A-Za-z0-9.\-]{0,15}') then 'US' end"""


@query("classify_market", f"select event_id, symbol, {MARKET} as market from {{f_symbols}}")
def classify_market(f):
    return f.f_symbols.select(
        "event_id", "symbol", identity.classify_market(F.col("symbol")).alias("market")
    )


@query(
    "validate_symbols",
    r"""
    select event_id, symbol, market, case
      when market = 'US' then case when not regexp_full_match(symbol, '[A-Za-z][A-Za-z0-9.\-]{0,15}') then 'us_symbol' end
      when not contains(symbol, '.') or regexp_extract(symbol, '([^.]*)$', 1) <> market then 'suffix'
      when market in ('SH', 'SZ', 'HK') then case when not regexp_full_match(symbol, '[0-9]{5,6}\.[A-Z]+') then 'stock_prefix' end
      when not regexp_full_match(symbol, '[A-Za-z]{1,3}[0-9]{3,4}((C|P|-C-|-P-)[0-9]{1,8})?\.[A-Z]+') then 'derivative_prefix' end as problem
    from {f_symbols}
    """,
)
def validate_symbols(f):
    return quality.validate_symbols(f.f_symbols).select("event_id", "symbol", "market", "problem")


@query(
    "validate_identity",
    """
    select event_id, case when event_id % 17 = 0 then 'dataset' when event_id % 19 = 0 then 'market'
      when symbol in ('.', '') then 'symbol' when event_id % 23 = 0 then 'period' when event_id % 29 = 0 then 'adjust' end as problem
    from {f_symbols}
    """,
)
def validate_identity(f):
    n = F.col("event_id")
    df = f.f_symbols.select(
        "event_id",
        "symbol",
        F.when(n % 17 == 0, "a b").otherwise("ddb-history-native64").alias("dataset"),
        F.when(n % 19 == 0, F.lower("market")).otherwise(F.col("market")).alias("market"),
        F.when(n % 23 == 0, 0).otherwise(60).alias("period_seconds"),
        F.when(n % 29 == 0, "both").otherwise("none").alias("adjust"),
    )
    return quality.validate_identity(df).select("event_id", "problem")


@query(
    "normalize_requests",
    f"""
    with o_market as (select *, {MARKET} as market from {{f_requests_raw}}),
    o_rules as (select *, start_ms > 0 and end_ms > start_ms and end_ms - start_ms <= 31622400000 and max_rows between 1 and 5000 as in_bounds,
        row_encoding = 'le-ddb-native64-v1' as native from o_market)
    select request_id, coalesce(market, '-') as market,
      case when row_encoding = 'json' then 'ERROR' when not in_bounds then 'ERROR'
        when period_seconds <> 60 or (adjust <> 'none' and not (native and adjust in ('forward', 'backward'))) then 'MISS'
        when market is null then 'ERROR' when adjust <> 'none' and market not in ('SH', 'SZ', 'HK', 'US') then 'MISS'
        when (include_intraday or allow_partial) and not native then 'ERROR' end as status,
      case when row_encoding = 'json' then 'row_encoding' when not in_bounds then 'bounds'
        when period_seconds <> 60 or (adjust <> 'none' and not (native and adjust in ('forward', 'backward'))) then 'series'
        when market is null then 'symbol' when adjust <> 'none' and market not in ('SH', 'SZ', 'HK', 'US') then 'market'
        when (include_intraday or allow_partial) and not native then 'native_only' end as detail,
      case when in_bounds then case when market = 'US' then start_ms - 18000000 else start_ms end end as start_stored
    from o_rules
    """,
)
def normalize_requests(f):
    return requests.normalize_requests(f.f_requests_raw).select(
        "request_id", F.coalesce("market", F.lit("-")).alias("market"), "status", "detail", "start_stored"
    )


@query(
    "partition_key",
    """
    select symbol, ts_ms, lower(replace(symbol, '.', '')) as slug,
           strftime(make_timestamp((ts_ms + 28800000) * 1000), '%Y%m') as month_key,
           strftime(make_timestamp((ts_ms + 28800000) * 1000), '%Y%m%d') as day_key
    from {f_bars}
    """,
)
def partition_key(f):
    return requests.partition_key(f.f_bars).select(
        "symbol", "ts_ms", "slug", "month_key", "day_key"
    )


@query(
    "read_summary",
    f"""
    with o_asks as ({ASKS})
    select a.request_id, count(*) as rows, min(b.ts_ms) as first_ms, max(b.ts_ms) as last_ms
    from o_asks a join {{f_bars}} b on b.dataset = a.dataset and b.symbol = a.symbol
     and b.ts_ms >= a.start_ms and b.ts_ms < a.end_ms
    group by a.request_id
    """,
)
def read_summary(f):
    return scan.read_summary(scan.range_scan(f.f_bars, ranges(f)), ["request_id"])


@query(
    "order_violations",
    """
    select symbol, row_no, ts_ms, prev_ts_ms from (
      select symbol, row_no, ts_ms, lag(ts_ms) over (partition by symbol order by row_no) as prev_ts_ms from {f_export}) x
    where ts_ms <= prev_ts_ms
    """,
)
def order_violations(f):
    return quality.order_violations(f.f_export, "row_no").select(
        "symbol", "row_no", "ts_ms", "prev_ts_ms"
    )


@query(
    "duplicate_timestamps",
    """
    select symbol, ts_ms, count(*) as copies from {f_export} group by symbol, ts_ms having count(*) > 1
    """,
)
def duplicate_timestamps(f):
    return quality.order_violations(f.f_export).select("symbol", "ts_ms", "copies")


@query(
    "gap_profile",
    """
    with o_steps as (select symbol, ts_ms, ts_ms - lag(ts_ms) over (partition by symbol order by ts_ms) as delta from {f_bars}),
    o_turns as (select delta, delta - lag(delta) over (partition by symbol order by ts_ms) as delta_of_delta from o_steps)
    select delta, delta_of_delta, count(*) as bars from o_turns where delta is not null group by delta, delta_of_delta
    """,
)
def gap_profile(f):
    return quality.gap_profile(f.f_bars)


@query(
    "ordered_rows",
    "select symbol, ts_ms, open, high, low, close, volume from {f_bars} order by symbol, ts_ms",
)
def ordered_rows(f):
    from tidemark.operators.snapshot import ordered_rows as run

    return run(f.f_bars).select("symbol", "ts_ms", "open", "high", "low", "close", "volume")
