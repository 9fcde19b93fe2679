"""Generations, publication logs and operations."""

from pyspark.sql import functions as F

from tidemark.operators import generations, ops
from tidemark.plans import bits
from tidemark.plans.registry import query
from tidemark.session import materialize, scratch
from tidemark.streaming import alerts, guard, stale, tail


@query(
    "transition_violations",
    """
    select o.symbol, o.cov_start, case when n.source_version < o.source_version then 'stale_source_version'
      when n.source_version = o.source_version and (n.data_version <> o.data_version or n.row_count <> o.row_count) then 'changed_at_same_version' end as problem
    from {f_catalog} o join {f_catalog_next} n on n.symbol = o.symbol and n.cov_start = o.cov_start
    where n.source_version < o.source_version or (n.source_version = o.source_version and (n.data_version <> o.data_version or n.row_count <> o.row_count))
    """,
)
def transition_violations(f):
    return generations.transition_violations(f.f_catalog, f.f_catalog_next).select(
        "symbol", "cov_start", "problem"
    )


@query(
    "epoch_replacement_violations",
    """
    with o_floor as (select symbol, max(source_version) as top, count(distinct data_version) > 1 as mixed from {f_catalog} group by symbol)
    select o.symbol, o.cov_start, case when n.symbol is null then 'lost_coverage' else 'lost_rows' end as problem
    from {f_catalog} o left join {f_catalog_epoch} n on n.symbol = o.symbol and n.cov_start = o.cov_start and n.cov_end = o.cov_end
    where n.symbol is null or n.row_count < o.row_count
    union all
    select n.symbol, n.cov_start, case when n.epoch = 'epoch-1' then 'same_epoch' when f.mixed then 'mixed_source' else 'source_version' end
    from {f_catalog_epoch} n join o_floor f on f.symbol = n.symbol where n.epoch = 'epoch-1' or f.mixed or n.source_version <= f.top
    union all
    select o.symbol, min(o.ts_ms), 'lost_timestamps' from {f_bars} o
    where not exists (select 1 from {f_bars_rebuilt} r where r.symbol = o.symbol and r.ts_ms = o.ts_ms) group by o.symbol
    """,
)
def epoch_replacement_violations(f):
    return generations.epoch_replacement_violations(
        f.f_catalog, f.f_catalog_epoch, f.f_bars, f.f_bars_rebuilt
    ).select("symbol", "cov_start", "problem")


@query(
    "factor_regressions",
    """
    select symbol, reasons from (select symbol, concat_ws(',', case when uid % 37 = 0 then 'source_epoch' end, case when uid % 31 = 0 then 'model' end,
      case when uid % 7 = 0 or uid % 11 = 0 then 'window' end, case when uid % 13 = 0 or uid % 17 = 0 then 'freshness' end,
      case when uid % 3 <> 0 and uid % 19 = 0 then 'revision' end, case when uid % 3 = 0 and uid % 5 = 0 then 'changed_at_same_revision' end) as reasons
      from {f_factor_sets}) x where reasons <> ''
    """,
)
def factor_regressions(f):
    return generations.factor_regressions(f.f_factor_sets, f.f_factor_sets_next).select(
        "symbol", "reasons"
    )


@query(
    "sequence_regressions",
    """
    with o_top as (select *, max(seq) over (partition by uid order by obs rows between unbounded preceding and 1 preceding) as top from {f_generations})
    select t.uid, t.obs, t.seq, t.top as highest_seq, case when t.seq < t.top then 'regressed' else 'changed_at_same_sequence' end as problem
    from o_top t where t.seq < t.top or (t.seq = t.top and t.manifest <> (select arg_min(g.manifest, g.obs) from {f_generations} g where g.uid = t.uid and g.seq = t.top))
    """,
)
def sequence_regressions(f):
    return generations.sequence_regressions(f.f_generations, ["uid"], "obs").select(
        "uid", "obs", "seq", "highest_seq", "problem"
    )


TARGETS = "select uid, cast(max(seq) - 1 as bigint) as seq from {f_generations} group by uid"


@query(
    "rollback_generation",
    f"""
    select t.uid, (select max(seq) + 1 from {{f_generations}} g where g.uid = t.uid) as seq, t.seq as rolled_back_to, min(g.manifest) as manifest
    from ({TARGETS}) t join {{f_generations}} g on g.uid = t.uid and g.seq = t.seq group by t.uid, t.seq having count(distinct g.manifest) = 1
    """,
)
def rollback_generation(f):
    return generations.rollback_generation(f.f_generations, f.sql(TARGETS), ["uid"])


@query(
    "current_generation",
    """
    with o_top as (select uid, max(seq) as seq from {f_generations} group by uid)
    select t.uid, t.seq, arg_min(g.manifest, g.obs) as manifest, count(distinct g.manifest) > 1 as ambiguous, t.seq >= 43 as accepted
    from o_top t join {f_generations} g on g.uid = t.uid and g.seq = t.seq group by t.uid, t.seq
    """,
)
def current_generation(f):
    return generations.current_generation(f.f_generations, ["uid"], 43, "obs")


@query(
    "dedupe_factor_data",
    f"""
    with o_rows as (select symbol, string_agg(concat(cast(day as varchar), ':', {bits.little(bits.double("cum"))}), ';' order by day) as txt from {{f_factors}} group by symbol),
    o_hash as (select s.symbol, s.first_day, sha256(concat_ws('|', s.symbol, s.market, s.model, cast(s.first_day as varchar), cast(s.end_day as varchar), s.source_epoch, coalesce(r.txt, ''))) as data_hash
      from (select * from {{f_factor_sets}} union all select * from {{f_factor_sets_next}}) s left join o_rows r on r.symbol = s.symbol)
    select data_hash, symbol, cast(min(first_day) as integer) as first_day, count(*) as observations from o_hash group by data_hash, symbol
    """,
)
def dedupe_factor_data(f):
    cols = f.f_factor_sets.columns
    sets = f.f_factor_sets.unionByName(f.f_factor_sets_next.select(*cols)).drop("data_hash")
    data, _ = generations.dedupe_factor_data(sets, f.f_factors)
    return data.select("data_hash", "symbol", "first_day", "observations")


@query(
    "policy_extension",
    """
    with o_new as (select * from {f_suspensions} where not (cast(substring(symbol, 1, 6) as integer) % 4 = 1)
      union all select * from {f_suspensions} where cast(substring(symbol, 1, 6) as integer) % 5 = 3)
    select symbol, start_ms, 'dropped' as problem from {f_suspensions} o
    where not exists (select 1 from o_new n where n.symbol = o.symbol and n.start_ms = o.start_ms and n.end_ms = o.end_ms and n.evidence = o.evidence)
    union all select symbol, start_ms, 'repeated' from o_new group by symbol, start_ms, end_ms, evidence having count(*) > 1
    """,
)
def policy_extension(f):
    uid = F.substring("symbol", 1, 6).cast("int")
    old = f.f_suspensions.withColumn("uid", uid)
    new = old.where("uid % 4 <> 1").unionByName(old.where("uid % 5 = 3"))
    return generations.policy_extension(old, new).select("symbol", "start_ms", "problem")


CAPTURE = """
select symbol, case when uid % 6 = 1 then 'futu_ab' else 'cumulative' end as model, event_id as position, day, 19738 as first_day,
       case when day < 19738 and event_id % 20 <> 5 then 0 when event_id % 33 = 0 then 0 else 1 end as batch,
       concat('/db/', lpad(cast(case when event_id % 27 = 0 then 0 else event_id end as varchar(20)), 12, '0')) as path,
       event_id % 50 as chunk_version, case when event_id % 45 = 7 then 99 else event_id % 50 end as tablet_version
from {f_factor_rows}
"""


@query(
    "factor_source_check",
    f"""
    with o_rows as (select *, lag(path) over (partition by symbol order by position) as prev_path from ({CAPTURE}) c),
    o_problems as (
      select symbol, case when model = 'cumulative' and batch = 0 and day >= first_day then 'carry_date'
        when model = 'cumulative' and batch = 1 and day < first_day then 'range_date' when model = 'futu_ab' and batch <> 0 then 'batch'
        when chunk_version <> tablet_version then 'version' end as problem from o_rows
      union all select symbol, case when prev_path >= path then 'partition_order' end from o_rows)
    select symbol, problem, count(*) as rows from o_problems where problem is not null group by symbol, problem
    """,
)
def factor_source_check(f):
    return generations.factor_source_check(f.sql(CAPTURE))


@query(
    "transfer_usage",
    """
    select stage, count(*) as calls, cast(sum(requests) as bigint) as requests, cast(sum(bytes) as bigint) as bytes, cast(sum(elapsed_us) as bigint) as elapsed_us,
      cast(sum(failures) as bigint) as failures, stage <> 'R' and sum(requests) <= 1000000000 and sum(bytes) <= case stage when 'A' then 1000 else 100000000000 end as within_budget
    from {f_usage_log} group by stage
    """,
)
def transfer_usage(f):
    """Budgets per stage come from the log's own stages; stage R has none."""
    budgets = f.sql(
        "select distinct stage, cast(1000000000 as bigint) as max_requests,"
        " cast(case stage when 'A' then 1000 else 100000000000 end as bigint) as max_bytes"
        " from {f_usage_log} where stage <> 'R'"
    )
    return ops.transfer_usage(f.f_usage_log, budgets)


@query(
    "health_rollup",
    """
    select instance, day, count(*) as reports, coalesce(string_agg(distinct code, ',' order by code), '') as codes,
      case when bool_or(code in ('agent_missing', 'agent_unhealthy')) then 'critical' when count(code) > 0 then 'warning' else 'ok' end as severity
    from (select instance, code, cast(floor(observed_s / 86400) as integer) as day from {f_health}) h group by instance, day
    """,
)
def health_rollup(f):
    df = f.f_health.withColumn("day", F.floor(F.col("observed_s") / 86400).cast("int"))
    return ops.health_rollup(df, ["instance", "day"])


@query(
    "publication_audit",
    """
    with o_prev as (select *, lag(kind) over (partition by candidate order by idx) as prev from {f_attempts}),
    o_sum as (select candidate, count(*) as records, arg_max(kind, idx) as last_kind, bool_or(kind = 'committed' and prev = 'attempt') as committed,
      bool_or(kind = 'attempt' and prev = 'attempt' or kind = 'unknown') as unknown, bool_or(kind <> 'attempt' and (prev is null or prev <> 'attempt')) as orphan,
      max(idx) > min(idx) filter (where kind = 'committed') as late from o_prev group by candidate)
    select candidate, records, case when coalesce(orphan, false) or coalesce(late, false) then 'corrupt' when coalesce(committed, false) then 'committed' when last_kind = 'attempt' then 'pending'
      when coalesce(unknown, false) then 'historically_unknown' else 'not_applied' end as status, coalesce(unknown, false) and not coalesce(committed, false) as historical_unknown
    from o_sum
    """,
)
def publication_audit(f):
    return ops.publication_audit(f.f_attempts)


CHAIN_BREAKS = """
    with o_rows as (select *, row_number() over (partition by log order by n) as rn, lag(hash) over (partition by log order by n) as prior from {f_journal})
    select log, n, case when idx <> rn then 'index' when sha256(concat_ws('|', cast(log as varchar), cast(n as varchar), kind, cast(cents as varchar))) <> hash then 'hash'
      else 'link' end as problem
    from o_rows where idx <> rn or sha256(concat_ws('|', cast(log as varchar), cast(n as varchar), kind, cast(cents as varchar))) <> hash
      or prev_hash <> coalesce(prior, sha256('intent'))
    """


@query("hash_chain_breaks", CHAIN_BREAKS)
def hash_chain_breaks(f):
    payload = ["log", "n", "kind", "cents"]
    seed = F.sha2(F.lit("intent"), 256)
    return ops.hash_chain_breaks(f.f_journal, "log", "n", payload, seed).select(
        "log", "n", "problem"
    )


@query("hash_chain_suffix", CHAIN_BREAKS)
def hash_chain_suffix(f):
    """Every log is verified up to a record of its own, and from there on in a second run."""
    payload, seed = ["log", "n", "kind", "cents"], F.sha2(F.lit("intent"), 256)
    path = scratch(f.spark, "journal")
    f.f_journal.repartitionByRange("log", "n").sortWithinPartitions("log", "n").write.parquet(path)
    journal = f.spark.read.schema(f.f_journal.schema).parquet(path)
    first = journal.where(F.col("n") <= 1500 + 700 * F.col("log") % 2900)
    known = materialize(ops.hash_chain_breaks(first, "log", "n", payload, seed).select("log", "n", "problem"), "known")
    rest = ops.hash_chain_suffix(journal, ops.hash_chain_heads(first, "log", "n"), "log", "n", payload, seed, all_known=True)
    return known.unionByName(rest.select("log", "n", "problem"))


@query(
    "retention_select",
    """
    with o_done as (select *, row_number() over (partition by host order by updated_s desc, transaction_id desc) as rank from {f_results} where phase in ('ACCEPTED', 'ROLLED_BACK')),
    o_rest as (select *, row_number() over (partition by host order by updated_s desc, transaction_id desc) as turn from o_done
      where rank > 3 and 946684800 - updated_s >= 30 * 86400)
    select host, transaction_id from o_rest where turn <= 8
    """,
)
def retention_select(f):
    now = F.lit(946684800).cast("bigint")
    return ops.retention_select(f.f_results, ["host"], 3, 30 * 86400, now).select(
        "host", "transaction_id"
    )


@query(
    "stale_monitor",
    """
    with o_state as (select instance, observed_s, bool_or(coalesce(code in ('agent_missing', 'agent_unhealthy'), false)) as faulty, bool_or(not send_ok) as send_failed from {f_health} group by instance, observed_s),
    o_clear as (select instance, max(observed_s) as last_s, arg_max(faulty, observed_s) as now_faulty, arg_max(send_failed, observed_s) as now_failed,
      max(observed_s) filter (where not faulty) as clear_faulty, max(observed_s) filter (where not send_failed) as clear_failed from o_state group by instance),
    o_since as (select s.instance, min(s.observed_s) filter (where s.observed_s > coalesce(c.clear_faulty, -1)) as faulty_s, min(s.observed_s) filter (where s.observed_s > coalesce(c.clear_failed, -1)) as failed_s
      from o_state s join o_clear c on c.instance = s.instance group by s.instance)
    select c.instance, c.last_s, 1706659200 - c.last_s > 240 as stale, coalesce(c.now_faulty and 1706659200 - s.faulty_s >= 120, false) as operational_fault,
      coalesce(c.now_failed and 1706659200 - s.failed_s >= 300, false) as notification_failed
    from o_clear c join o_since s on s.instance = c.instance
    """,
)
def stale_monitor(f):
    bad = F.coalesce(F.col("code").isin("agent_missing", "agent_unhealthy"), F.lit(False))
    reports = f.f_health.withColumn("faulty", bad).withColumn("send_failed", ~F.col("send_ok"))
    return ops.stale_monitor(reports, F.lit(1706659200).cast("bigint"))


REPORTS = """
select concat('host-', cast(instance as varchar(20))) as instance, observed_s, event_id as seq, coalesce(code, '') as codes, send_ok,
       case when code is null then 'ok' when code in ('agent_missing', 'agent_unhealthy') then 'critical' else 'warning' end as severity
from {f_health}
"""


THROTTLED = f"""
    with recursive o_reports as (select *, row_number() over (partition by instance order by seq) as n from ({REPORTS}) r),
    o_run as (
      select instance, cast(0 as bigint) as n, cast(0 as bigint) as seq, cast(0 as bigint) as now, cast('' as varchar) as sig, cast('' as varchar) as delivered, true as was_ok, cast(0 as bigint) as sent, cast(-1000000 as bigint) as tried,
        cast(-1 as bigint) as day, cast(-1 as bigint) as hour, cast(0 as bigint) as daily, cast(0 as bigint) as hourly, false as failure, cast('none' as varchar) as delivery, cast('' as varchar) as severity
      from o_reports where n = 1
      union all
      select instance, n, seq, now, sig, case when try and send_ok then sig else delivered end, case when try and send_ok then severity = 'ok' else was_ok end,
        case when try and send_ok then now else sent end, case when try then now else tried end, day, hour,
        daily + case when try then 1 else 0 end, hourly + case when try then 1 else 0 end, case when try then not send_ok else failure end,
        case when try and send_ok then 'sent' when try then 'failed' else 'suppressed' end, severity
      from (select x.*, (sig <> delivered or now - sent >= 3600) and (severity <> 'ok' or not was_ok or failure) and now - tried >= 300 and daily < 48 and hourly < 4 as try
        from (select r.instance, r.n, r.seq, r.observed_s as now, concat(r.severity, ':', r.codes) as sig, r.severity, r.send_ok, s.delivered, s.was_ok, s.sent, s.tried, s.failure,
            r.observed_s // 86400 as day, r.observed_s // 3600 as hour, case when s.day = r.observed_s // 86400 then s.daily else 0 end as daily, case when s.hour = r.observed_s // 3600 then s.hourly else 0 end as hourly
          from o_run s join o_reports r on r.instance = s.instance and r.n = s.n + 1) x) y)
    select instance, seq, delivery, failure as notification_failed, case when delivery <> 'suppressed' then case when severity = 'ok' then 'recovery' else 'alert' end end as event
    from o_run where n > 0
"""


@query("alert_throttle", THROTTLED)
def alert_throttle(f):
    return alerts.alert_throttle_batch(f.sql(REPORTS)).select(
        "instance", "seq", "delivery", "notification_failed", "event"
    )


FILE_ROWS = 1 << 16  # of one file of a stream


def _parts(df):
    return -(-df.count() // FILE_ROWS) or 1


def _stream(f, df, label, order, files=None, at_once=None):
    """A file stream over rows in shared scratch, in ranges of ``order``, as many files a trigger as there are cores.

    All ranges are written by one job. The source takes files by their time, so the names, which follow the ranges,
    give the times.
    """
    path = scratch(f.spark, label)
    df.repartitionByRange(files or _parts(df), order).write.parquet(path)
    hadoop = f.spark._jvm.org.apache.hadoop.fs.Path(path)
    store = hadoop.getFileSystem(f.spark._jsc.hadoopConfiguration())
    names = sorted((s.getPath().toString(), s.getPath()) for s in store.listStatus(hadoop) if s.getPath().getName().startswith("part-"))
    base = max(s.getModificationTime() for s in store.listStatus(hadoop)) - 1000 * len(names)
    for i, (_, name) in enumerate(names):
        store.setTimes(name, base + 1000 * i, -1)
    taken = at_once or f.spark.sparkContext.defaultParallelism
    return f.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", taken).parquet(path)


def _drain(f, stream, label):
    """Run a stream over what is there and read its output back."""
    out = scratch(f.spark, label)
    run = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", f"{out}/checkpoint")
        .outputMode("append")
        .trigger(availableNow=True)
        .start(f"{out}/rows")
    )
    run.awaitTermination()
    return f.spark.read.schema(stream.schema).parquet(f"{out}/rows")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _with_rocksdb(f, run):
    """Stateful processors need RocksDB; the session keeps its own setting after."""
    before = f.spark.conf.get(PROVIDER)
    f.spark.conf.set(PROVIDER, ROCKSDB)
    try:
        return run()
    finally:
        f.spark.conf.set(PROVIDER, before)


@query(
    "generation_guard",
    """
    with o_top as (select *, max(seq) over (partition by uid order by obs rows between unbounded preceding and 1 preceding) as top from {f_generations})
    select concat('history-', cast(t.uid as varchar(20))) as namespace, t.obs, case when t.top is null or t.seq > t.top then 'newer' when t.seq < t.top then 'regressed'
      when t.manifest <> (select arg_min(g.manifest, g.obs) from {f_generations} g where g.uid = t.uid and g.seq = t.top) then 'changed_at_same_sequence' else 'unchanged' end as verdict
    from o_top t
    """,
)
def generation_guard(f):
    seen = f.f_generations.select(
        F.concat(F.lit("history-"), F.col("uid").cast("string")).alias("namespace"),
        F.col("obs").cast("bigint").alias("obs"), F.col("seq").cast("decimal(20,0)").alias("seq"), "manifest",
    )
    return guard.generation_guard_batch(seen).select("namespace", "obs", "verdict")


@query(
    "generation_guard_stream",
    """
    with o_top as (select *, max(seq) over (partition by uid order by obs rows between unbounded preceding and 1 preceding) as top from {f_generations})
    select concat('history-', cast(t.uid as varchar(20))) as namespace, t.obs, case when t.top is null or t.seq > t.top then 'newer' when t.seq < t.top then 'regressed'
      when t.manifest <> (select arg_min(g.manifest, g.obs) from {f_generations} g where g.uid = t.uid and g.seq = t.top) then 'changed_at_same_sequence' else 'unchanged' end as verdict
    from o_top t
    """,
)
def generation_guard_stream(f):
    seen = f.f_generations.select(
        F.concat(F.lit("history-"), F.col("uid").cast("string")).alias("namespace"),
        F.col("obs").cast("bigint").alias("obs"), F.col("seq").cast("decimal(20,0)").alias("seq"), "manifest",
    )

    def run():
        return _drain(f, guard.generation_guard(_stream(f, seen, "generations", "obs", 3, 1)), "verdicts")

    return _with_rocksdb(f, run).select("namespace", "obs", "verdict")


# Answers of the receiver to every report that might be sent; some come too late, some never.
OUTCOMES = """
select concat('host-', cast(instance as varchar(20))) as instance, observed_s + event_id % 13 as answered_s, event_id as seq, send_ok as accepted
from {f_health} where event_id % 6 <> 1
"""
DELIVERED = THROTTLED.replace(
    f"from ({REPORTS}) r)",
    f"from (select p.* exclude (send_ok), coalesce(o.answered_s <= p.observed_s + 10 and o.accepted, false) as send_ok"
    f" from ({REPORTS}) p left join ({OUTCOMES}) o on o.instance = p.instance and o.seq = p.seq) r)",
)
DELIVERED = DELIVERED[: DELIVERED.rindex("select instance, seq, delivery")] + f"""
    , o_ends as (select r.*, o.answered_s, o.accepted, case when severity = 'ok' then 'recovery' else 'alert' end as kind
      from o_run r left join ({OUTCOMES}) o on o.instance = r.instance and o.seq = r.seq and o.answered_s <= r.now + 10 where r.n > 0)
    select instance, seq, now as at_s, case when delivery = 'suppressed' then 'suppressed' else 'attempt' end as step,
      case when delivery <> 'suppressed' then kind end as event from o_ends
    union all
    select instance, seq, coalesce(answered_s, now + 10), case when answered_s is null then 'expired' when accepted then 'sent' else 'failed' end, kind
    from o_ends where delivery <> 'suppressed'
"""
END_S = 1708000000  # after every report; a last row with this time lets the watermark pass them all
CLOSING = "closing"


@query("alert_delivery_stream", DELIVERED)
def alert_delivery_stream(f):
    """Two streams, cut into files at other places, and a last row of each that closes it."""
    reports, outcomes = f.sql(REPORTS).drop("send_ok"), f.sql(OUTCOMES)
    reports = reports.unionByName(f.spark.sql(
        f"select '{CLOSING}' as instance, {END_S}L as observed_s, 0L as seq, '' as codes, 'ok' as severity"
    ).select(*reports.columns))
    outcomes = outcomes.unionByName(f.spark.sql(
        f"select '{CLOSING}' as instance, {END_S}L as answered_s, 0L as seq, true as accepted"
    ).select(*outcomes.columns))

    def run():
        streams = _stream(f, reports, "reports", "observed_s", 4, 1), _stream(f, outcomes, "outcomes", "answered_s", 3, 1)
        return _drain(f, alerts.alert_delivery(*streams), "deliveries")

    return _with_rocksdb(f, run).where(F.col("instance") != CLOSING)


HELD = f"""
    with o_state as (select instance, observed_s as at_s, bool_or(coalesce(code in ('agent_missing', 'agent_unhealthy'), false)) as faulty, bool_or(not send_ok) as failed from {{f_health}} group by instance, observed_s),
    o_flags as (
      select instance, 'operational_fault' as rule, 120 as hold, at_s, faulty as bad, lag(faulty) over (partition by instance order by at_s) as was from o_state
      union all select instance, 'notification_failed', 300, at_s, failed, lag(failed) over (partition by instance order by at_s) from o_state),
    o_turns as (select * from o_flags where bad <> coalesce(was, false)),
    o_spans as (select *, lead(at_s) over (partition by instance, rule order by at_s) as until_s from o_turns),
    o_silence as (select instance, at_s, lead(at_s) over (partition by instance order by at_s) as next_s from o_state)
    select cast(instance as varchar) as instance, rule, case when bad then 'started' else 'cleared' end as state, at_s from o_spans
    union all select cast(instance as varchar), rule, 'firing', at_s + hold from o_spans where bad and at_s + hold < coalesce(until_s, {END_S})
    union all select cast(instance as varchar), 'stale', 'started', at_s + 181 from o_silence where at_s + 181 < coalesce(next_s, {END_S})
    union all select cast(instance as varchar), 'stale', 'firing', at_s + 241 from o_silence where at_s + 241 < coalesce(next_s, {END_S})
    union all select cast(instance as varchar), 'stale', 'cleared', next_s from o_silence where at_s + 181 < next_s
"""


@query("stale_monitor_stream", HELD)
def stale_monitor_stream(f):
    bad = F.coalesce(F.col("code").isin("agent_missing", "agent_unhealthy"), F.lit(False))
    reports = f.f_health.select(
        F.col("instance").cast("string").alias("instance"), "observed_s", bad.alias("faulty"), (~F.col("send_ok")).alias("send_failed")
    )
    closing = f.spark.sql(f"select '{CLOSING}' as instance, {END_S}L as observed_s, false as faulty, false as send_failed")

    def run():
        stream = _stream(f, reports.unionByName(closing), "reports", "observed_s", 4, 1)
        return _drain(f, stale.hold_stream(stream), "holds")

    return _with_rocksdb(f, run).where(F.col("instance") != CLOSING)


@query("alert_throttle_stream", THROTTLED)
def alert_throttle_stream(f):
    reports = f.sql(REPORTS)

    def run():
        return _drain(f, alerts.alert_throttle(_stream(f, reports, "reports", "seq")), "alerts")

    return _with_rocksdb(f, run).select(
        "instance", "seq", "delivery", "notification_failed", "event"
    )


@query(
    "intraday_tail_stream",
    """
    select symbol, ts_ms, volume, close_oi % 17 = 0 as late from {f_bars}
    """,
)
def intraday_tail_stream(f):
    """Every bar arrives twice, in files of shuffled times; hours late, it goes to the late sink."""
    lag = F.when(F.col("close_oi") % 17 == 0, 10800000).otherwise(60000)
    arrivals = f.f_bars.select(
        "dataset", "market", "symbol", "ts_ms", "open", "high", "low", "close", "volume",
        "close_oi", (F.col("ts_ms") + lag).alias("arrived_ms"),
    )
    twice = arrivals.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("copy")
    path, out = scratch(f.spark, "arrivals"), scratch(f.spark, "tail")
    files = max(3, _parts(twice))
    twice.repartition(files, "ts_ms").write.parquet(path)
    # A third of the files a trigger, in any order.
    stream = f.spark.readStream.schema(twice.schema).option("maxFilesPerTrigger", -(-files // 3)).parquet(path)
    for run in tail.run_intraday_tail(stream, out, f"{out}/checkpoint"):
        run.awaitTermination()
    columns = ["symbol", "ts_ms", "volume"]
    read = f.spark.read.schema("symbol STRING, ts_ms BIGINT, volume BIGINT")
    read = read.option("recursiveFileLookup", "true")
    kept = read.parquet(f"{out}/bars").select(*columns, F.lit(False).alias("late"))
    late = read.parquet(f"{out}/late").select(*columns, F.lit(True).alias("late"))
    return kept.unionByName(late)
