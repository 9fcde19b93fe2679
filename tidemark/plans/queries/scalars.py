"""Scalar functions."""

from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions import clock, identity, numbers
from tidemark.functions.documents import strict_json_doc
from tidemark.plans.registry import query


@query(
    "series_id",
    """
    select symbol, substring(sha256(concat('history-series-v1', chr(10), length(dataset), ':', dataset, chr(10),
      length(market), ':', market, chr(10), length(symbol), ':', symbol, chr(10), '2:60', chr(10), '4:none', chr(10))), 1, 32) as series_id
    from {f_series}
    """,
)
def series_id(f):
    key = identity.series_id(F.col("dataset"), F.col("market"), F.col("symbol"))
    return f.f_series.select("symbol", key.alias("series_id"))


@query(
    "hex_digest",
    """
    select event_id, regexp_full_match(candidate, '[0-9a-f]{64}') as is_digest,
           lower(hex(encode(event_type))) as type_hex,
           case when regexp_full_match(candidate, '([0-9a-f][0-9a-f])*') then length(candidate) // 2 end as n_bytes
    from (select event_id, event_type, case event_id % 4 when 0 then sha256(props) when 1 then upper(sha256(props))
                 when 2 then substring(sha256(props), 1, 63) else substring(sha256(props), 1, 40) end as candidate
          from events) e
    """,
)
def hex_digest(f):
    text = F.sha2("props", 256)
    df = f.events.withColumn(
        "candidate",
        F.when(F.col("event_id") % 4 == 0, text)
        .when(F.col("event_id") % 4 == 1, F.upper(text))
        .when(F.col("event_id") % 4 == 2, F.substring(text, 1, 63))
        .otherwise(F.substring(text, 1, 40)),
    )
    return df.select(
        "event_id",
        identity.is_digest(F.col("candidate")).alias("is_digest"),
        identity.digest_hex(F.encode("event_type", "UTF-8")).alias("type_hex"),
        F.octet_length(identity.digest_bytes(F.col("candidate"))).cast("bigint").alias("n_bytes"),
    )


@query(
    "content_key",
    """
    select event_id, case when event_id % 3 <> 0 then concat('data/v1/', sha256(props), '.r2b') end as key,
           case when event_id % 3 <> 0 and event_id % 5 <> 0 then sha256(props) end as parsed
    from events
    """,
)
def content_key(f):
    digest = F.sha2("props", 256)
    df = f.events.withColumn(
        "digest", F.when(F.col("event_id") % 3 == 0, F.upper(digest)).otherwise(digest)
    ).withColumn("key", identity.content_key(F.col("digest")))
    shown = F.when(F.col("event_id") % 5 == 0, F.concat("key", F.lit("x"))).otherwise(
        F.col("key")
    )
    return df.select("event_id", "key", identity.parse_content_key(shown).alias("parsed"))


@query(
    "local_civil_day",
    """
    select event_id, cast(floor((ms_of(ts) + 28800000) / 86400000) as integer) as cn_day,
           cast(floor((ms_of(ts) - 18000000) / 86400000) as integer) as us_day,
           cast(floor((28800000 - ms_of(ts)) / 86400000) as integer) as before_1970
    from events
    """,
)
def local_civil_day(f):
    df = f.sql("select event_id, ms_of(ts) as ms from {events}")
    return df.select(
        "event_id",
        clock.local_civil_day(F.col("ms"), F.lit("SZ")).alias("cn_day"),
        clock.local_civil_day(F.col("ms"), F.lit("US")).alias("us_day"),
        clock.stored_day(-F.col("ms"), F.lit("HK")).alias("before_1970"),
    )


@query(
    "months_of",
    """
    select event_id, strftime(m, '%Y%m') as month_key from (
      select event_id, unnest(generate_series(date_trunc('month', make_timestamp(lo * 1000)),
             date_trunc('month', make_timestamp(hi * 1000)), interval 1 month)) as m
      from (select event_id, ms_of(ts) + 28800000 as lo, ms_of(ts) + 28800000 + event_id % 100 * 86400000 + 86399999 as hi
            from events) x) y
    """,
)
def months_of(f):
    df = f.sql(
        "select event_id, ms_of(ts) as lo, ms_of(ts) + event_id % 100 * 86400000 + 86400000 as hi from {events}"
    )
    months = clock.months_of(F.col("lo"), F.col("hi"), F.lit("SH"))
    return df.select("event_id", F.explode(months).alias("month_key"))


@query(
    "round2",
    """
    select l_orderkey, l_linenumber, l_partkey,
           round(l_extendedprice * (1 - l_discount) * 100) / 100 as net,
           round(-l_extendedprice * l_tax * 100) / 100 as tax
    from lineitem
    """,
)
def round2(f):
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    tax = -F.col("l_extendedprice") * F.col("l_tax")
    return f.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        numbers.round2(net).alias("net"),
        numbers.round2(tax).alias("tax"),
    )


@query(
    "sentinel_null",
    """
    select event_id, case when event_id % 4 = 0 then null else value end as price,
           case when event_id % 4 = 0 then cast(-1.7976931348623157e308 as double) else value end as stored
    from events
    """,
)
def sentinel_null(f):
    raw = F.when(F.col("event_id") % 4 == 0, F.lit(fixed.NULL_PRICE)).otherwise(F.col("value"))
    price = numbers.from_sentinel(raw)
    return f.events.select(
        "event_id", price.alias("price"), numbers.to_sentinel(price).alias("stored")
    )


@query(
    "float32_price",
    """
    select event_id, case when event_id % 9 = 0 then null
           else cast(cast(value as float) as double) end as price, event_id % 9 <> 0 as fits
    from events
    """,
)
def float32_price(f):
    price = F.when(F.col("event_id") % 9 == 0, F.lit(1e39)).otherwise(F.col("value"))
    return f.events.select(
        "event_id",
        numbers.float32_price(price).cast("double").alias("price"),
        numbers.fits_float(price).alias("fits"),
    )


@query(
    "strict_date",
    """
    select o_orderkey, case when o_orderkey % 5 = 0 then cast(o_orderdate as date) end as day
    from orders
    """,
)
def strict_date(f):
    text = F.date_format("o_orderdate", "yyyy-MM-dd")
    key = F.col("o_orderkey") % 5
    shown = (
        F.when(key == 1, F.concat(text, F.lit(" ")))
        .when(key == 2, F.concat(F.substring(text, 1, 8), F.lit("32")))
        .when(key == 3, F.regexp_replace(text, "-", "."))
        .when(key == 4, F.substring(text, 3, 8))
        .otherwise(text)
    )
    return f.orders.select("o_orderkey", clock.strict_date(shown).alias("day"))


# Factor checks of every kind, some of which break a rule.
FACTOR_CHECKS = """
select event_id, policy, market, check_minute, next_day, source_revision,
       next_day - 1 - case when event_id % 29 = 0 then 20 else 0 end as trading_day,
       case when event_id % 31 = 0 then 'XTKS' when market = 'US' then 'XNYS' when market = 'SZ' then 'XSHE' else 'XHKG' end as exchange,
       due + case when event_id % 37 = 0 then 1 else 0 end as until_ms, due - (1 + event_id % 60) * 3600000 as observed_ms,
       due - (1 + event_id % 60) * 3600000 - (event_id % 300) * 60000 as completed_ms
from (select *, next_day * 86400000 + check_minute * 60000 + case when policy = 'market-eod-check-v1' then 57600000
                    when market = 'US' then 18000000 else -28800000 end as due
      from (select event_id, policy, market, next_day, case when event_id % 41 = 0 then 0 else 1 end as source_revision,
              case when policy = 'market-eod-check-v1' and event_id % 5 <> 0 then case when market = 'US' then 600 else 60 end
                   else event_id % 240 end as check_minute
            from (select event_id, case event_id % 2 when 0 then 'market-eod-check-v1' else 'market-source-check-v1' end as policy,
                    case event_id % 3 when 0 then 'US' when 1 then 'SZ' else 'HK' end as market,
                    cast(floor(ms_of(ts) / 86400000) as bigint) as next_day from {events}) a) b) c
"""


@query(
    "next_check_deadline",
    f"""
    with o_checks as (select *, policy = 'market-eod-check-v1' as eod, market = 'US' as us,
        case when market = 'US' then 18000000 else -28800000 end as shift from ({FACTOR_CHECKS}) x),
    o_times as (select *, next_day * 86400000 + check_minute * 60000 + case when eod then 57600000 else shift end as deadline_ms,
        trading_day * 86400000 + case when eod and us then 86400000 when eod then 54000000 else shift end as earliest,
        trading_day * 86400000 + check_minute * 60000 + shift as turn from o_checks)
    select event_id, deadline_ms, case when exchange = 'XTKS' then 'exchange' when next_day - trading_day > 16 then 'calendar'
        when eod and check_minute <> (case when us then 600 else 60 end) then 'minute' when source_revision = 0 then 'revision'
        when deadline_ms <> until_ms then 'deadline'
        when completed_ms < earliest or completed_ms > observed_ms or (not eod and turn > observed_ms) then 'completion'
        when observed_ms >= until_ms or until_ms - observed_ms > 1382400000 then 'validity' end as problem
    from o_times
    """,
)
def next_check_deadline(f):
    df = f.sql(FACTOR_CHECKS)
    market = F.col("market")
    names = ["policy", "next_day", "check_minute"]
    return df.select(
        "event_id",
        clock.check_deadline(market, *[F.col(c) for c in names]).alias("deadline_ms"),
        clock.check_problem(F.col, market, F.col("observed_ms"), F.col("until_ms")).alias("problem"),
    )


@query(
    "factor_check_status",
    """
    select symbol, case when observed_at_ms > 1704067260000 then 'future-dated'
           when 1704067260000 < valid_until_ms - 86400000 then 'current' else 'overdue' end as status
    from {f_factor_sets}
    """,
)
def factor_check_status(f):
    status = clock.check_status(
        F.col("observed_at_ms"),
        F.col("valid_until_ms") - fixed.DAY_MS,
        F.lit(1704067260000).cast("bigint"),
    )
    return f.f_factor_sets.select("symbol", status.alias("status"))


@query(
    "request_bounds",
    """
    select request_id, start_ms > 0 and end_ms > start_ms and end_ms <= 32503680000000
           and end_ms - start_ms <= 31622400000 as in_bounds
    from {f_requests_raw}
    """,
)
def request_bounds(f):
    return f.f_requests_raw.select(
        "request_id", clock.request_bounds(F.col("start_ms"), F.col("end_ms")).alias("in_bounds")
    )


@query(
    "wall_utc_join",
    """
    with o_table as (
      select 1762063200000 as start_ms, 1772953200000 as end_ms, -18000000 as shift
      union all select 1772953200000, 1793512800000, -14400000
      union all select 1793512800000, 1805007600000, -18000000),
    o_hits as (
      select w.event_id, count(t.shift) as matches, min(w.ms - t.shift) as utc_ms
      from {f_wall} w left join o_table t on w.ms - t.shift >= t.start_ms and w.ms - t.shift < t.end_ms
      group by w.event_id),
    o_wall as (
      select w.event_id, w.ms + t.shift as wall_ms,
             (select count(*) from o_table u where w.ms + t.shift - u.shift >= u.start_ms
                and w.ms + t.shift - u.shift < u.end_ms) as back
      from {f_wall} w join o_table t on w.ms >= t.start_ms and w.ms < t.end_ms)
    select h.event_id, cast(h.matches as integer) as matches, case when h.matches = 1 then h.utc_ms end as utc_ms,
           case when o.back = 1 then o.wall_ms end as wall_of_instant
    from o_hits h join o_wall o on o.event_id = h.event_id
    """,
)
def wall_utc_join(f):
    ms = F.col("ms")
    return f.f_wall.select(
        "event_id",
        clock.wall_matches(ms).alias("matches"),
        clock.wall_to_utc(ms).alias("utc_ms"),
        clock.utc_to_wall(ms).alias("wall_of_instant"),
    )


DOC = "id BIGINT, name STRING, inner STRUCT<k: BIGINT>"


@query(
    "strict_json_doc",
    """
    select event_id, case event_id % 5 when 1 then 'duplicate_key' when 2 then 'unknown_field'
           when 3 then 'missing_field' when 4 then 'duplicate_key' end as problem,
           case when event_id % 5 = 0 then event_id end as id,
           case when event_id % 5 = 0 then event_type end as name
    from events
    """,
)
def strict_json_doc_query(f):
    inner = F.when(F.col("event_id") % 5 == 4, F.lit('{"k": 1, "k": 2}')).otherwise(
        F.col("props")
    )
    extra = (
        F.when(F.col("event_id") % 5 == 1, F.lit(', "id": 0'))
        .when(F.col("event_id") % 5 == 2, F.lit(', "spare": null'))
        .otherwise(F.lit(""))
    )
    name = F.when(F.col("event_id") % 5 == 3, F.lit("")).otherwise(
        F.concat(F.lit(', "name": "'), F.col("event_type"), F.lit('"'))
    )
    text = F.concat(
        F.lit('{"id": '), F.col("event_id").cast("string"), name,
        F.lit(', "inner": '), inner, extra, F.lit("}"),
    )
    docs = f.events.select("event_id", text.alias("value"))
    return strict_json_doc(docs, "value", DOC).select(
        "event_id", "problem", F.col("doc.id").alias("id"), F.col("doc.name").alias("name")
    )
