"""Streams over several micro-batches agree with their batch forms."""

import random
from decimal import Decimal
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ops, snapshot
from tidemark.plans.queries import publishing
from tidemark.session import scratch
from tidemark.streaming import alerts, guard, stale, tail

T = 1704067200000


def files(spark, df, path, order):
    """Rows in four files that arrive one after the other."""
    cuts = df.approxQuantile(order, [0.25, 0.5, 0.75], 0.0)
    bounds = [None, *cuts, None]
    for lo, hi in zip(bounds, bounds[1:]):
        part = df
        part = part.where(F.col(order) > lo) if lo is not None else part
        part = part.where(F.col(order) <= hi) if hi is not None else part
        part.coalesce(1).write.mode("append").parquet(path)


def drain(spark, df, run, order):
    path, out = scratch(spark, "in"), scratch(spark, "out")
    files(spark, df, path, order)
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    result = run(source)
    q = (
        result.writeStream.format("parquet")
        .option("checkpointLocation", f"{out}/c")
        .trigger(availableNow=True)
        .start(f"{out}/rows")
    )
    q.awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{out}/rows")


def test_alert_stream_equals_batch(spark):
    rng = random.Random(11)
    rows, at = [], {0: 10000, 1: 20000, 2: 30000}
    for seq in range(400):
        i = rng.randrange(3)
        at[i] += rng.choice([1, 60, 200, 400, 1500, -5])
        severity, codes = rng.choice([("ok", ""), ("critical", "agent_missing"), ("warning", "agent_restarted")])
        rows.append((f"host-{i}", at[i], seq, severity, codes, rng.random() < 0.7))
    df = spark.createDataFrame(rows, "instance string, observed_s long, seq long, severity string, codes string, send_ok boolean")
    batch = alerts.alert_throttle_batch(df)
    stream = drain(spark, df, alerts.alert_throttle, "seq")
    assert snapshot.exact_rows_diff(batch, stream, batch.columns).count() == 0
    assert batch.where("delivery = 'sent'").count() > 0


def test_guard_over_batches(spark):
    big = 2**64 - 5
    rows = [("history-x", i, Decimal(big + s), m) for i, (s, m) in enumerate([(1, "a"), (3, "b"), (2, "c"), (3, "b"), (3, "x"), (4, "d"), (4, "d"), (1, "a")])]
    df = spark.createDataFrame(rows, "namespace string, obs long, seq decimal(20,0), manifest string")
    got = drain(spark, df, guard.generation_guard, "obs").orderBy("obs").collect()
    assert [r.verdict for r in got] == ["newer", "newer", "regressed", "unchanged", "changed_at_same_sequence", "newer", "unchanged", "regressed"]


def test_tail_keeps_each_bar_once_over_batches(spark):
    rows = []
    for i in range(200):
        ts = T + i * 60000
        rows += [("d", "SZ", "s", ts, i, ts + 60000), ("d", "SZ", "s", ts, i, ts + 90000)]
        if i % 50 == 0:
            rows.append(("d", "SZ", "s", ts, i + 1000, ts + 8 * 3600000))
    df = spark.createDataFrame(rows, "dataset string, market string, symbol string, ts_ms long, volume long, arrived_ms long")
    path, out = scratch(spark, "in"), scratch(spark, "tail")
    files(spark, df, path, "arrived_ms")
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    for q in tail.run_intraday_tail(source, out, f"{out}/c"):
        q.awaitTermination()
    kept = spark.read.parquet(f"{out}/bars")
    assert kept.count() == 200 and kept.where("volume >= 1000").count() == 0
    assert spark.read.parquet(f"{out}/late").count() == 4


def test_tail_loses_nothing_in_reverse_order_and_after_a_restart(spark):
    rows = [("d", "SZ", "s", T - i * 4 * 3600000, i, T - i * 4 * 3600000 + 60000) for i in range(6)]
    rows += [("d", "SZ", "s", T + 60000, 99, T + 9 * 3600000)] * 2
    schema = "dataset string, market string, symbol string, ts_ms long, volume long, arrived_ms long"
    path, out = scratch(spark, "in"), scratch(spark, "tail")

    def run():
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
        for q in tail.run_intraday_tail(source, out, f"{out}/c"):
            q.awaitTermination()

    for part in (rows[:3], rows[3:7], rows):
        for row in part:
            spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(path)
        run()
    kept = spark.read.parquet(f"{out}/bars")
    assert sorted(r.volume for r in kept.collect()) == list(range(6))
    assert [r.volume for r in spark.read.parquet(f"{out}/late").collect()] == [99]


def test_silent_instances_are_noticed(spark):
    df = spark.createDataFrame([("a", 100), ("a", 160), ("b", 130)], "instance string, observed_s long")
    path, out = scratch(spark, "in"), scratch(spark, "stale")
    df.write.parquet(path)
    source = spark.readStream.schema(df.schema).parquet(path)
    q = (
        stale.stale_stream(source, limit_s=1)
        .writeStream.format("memory")
        .queryName("stale_rows")
        .option("checkpointLocation", f"{out}/c")
        .trigger(processingTime="1 second")
        .start()
    )
    try:
        import time

        for _ in range(40):
            got = {r.instance: r.last_s for r in spark.table("stale_rows").collect()}
            if len(got) == 2:
                break
            time.sleep(1)
    finally:
        q.stop()
    assert got == {"a": 160, "b": 130}


def test_tail_reads_only_the_days_of_a_batch(spark, monkeypatch):
    """A month is stored; a late backfill of one day lists and reads that day alone."""
    schema = "dataset string, market string, symbol string, ts_ms long, volume long, arrived_ms long"
    path, out = scratch(spark, "in"), scratch(spark, "tail")
    asked = []
    exists = tail._exists
    monkeypatch.setattr(tail, "_exists", lambda s, folder: asked.append(folder) or exists(s, folder))

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
        for q in tail.run_intraday_tail(source, out, f"{out}/c"):
            q.awaitTermination()

    month = [("d", "SZ", "s", T + d * 86400000, d, T + d * 86400000 + 60000) for d in range(30)]
    run(month)
    asked.clear()
    again = [month[7], ("d", "SZ", "s", month[7][3] + 60000, 100, month[7][3] + 70000)]
    run(again)
    assert {f.split("/")[-1] for f in asked} == {"yyyymmdd=20240108"}
    kept = spark.read.parquet(f"{out}/bars")
    assert sorted(r.volume for r in kept.collect()) == [*range(30), 100]


def delivery_rows(seed):
    rng = random.Random(seed)
    reports, outcomes, at = [], [], {0: 10000, 1: 20000, 2: 30000}
    for seq in range(300):
        i = rng.randrange(3)
        at[i] += rng.choice([1, 5, 60, 200, 400, 1500])
        severity, codes = rng.choice([("ok", ""), ("critical", "agent_missing"), ("warning", "agent_restarted")])
        reports.append((f"host-{i}", at[i], seq, severity, codes))
        if rng.random() < 0.8:
            outcomes.append((f"host-{i}", at[i] + rng.randint(0, 14), seq, rng.random() < 0.7))
    return [*reports, ("end", 10**6, -1, "ok", "")], [*outcomes, ("end", 10**6, -1, True)]


def plain_deliveries(reports, outcomes):
    """One report after the other, each answer known when it is sent."""
    answers = {seq: (at, accepted) for _, at, seq, accepted in outcomes}
    out = []
    for name in ("host-0", "host-1", "host-2"):
        told, told_ok, told_s, tried, failing, counts = "", True, 0, -(10**9), False, {}
        for _, at, seq, severity, codes in sorted((r for r in reports if r[0] == name), key=lambda r: r[1]):
            sign, ok = f"{severity}:{codes}", severity == "ok"
            hour, day = ("h", at // 3600), ("d", at // 86400)
            due = (sign != told or at - told_s >= 3600) and (not ok or not told_ok or failing)
            if not (due and at - tried >= 300 and counts.get(hour, 0) < 4 and counts.get(day, 0) < 48):
                out.append((name, seq, at, "suppressed", None))
                continue
            event = "recovery" if ok else "alert"
            counts[hour], counts[day], tried, failing = counts.get(hour, 0) + 1, counts.get(day, 0) + 1, at, True
            out.append((name, seq, at, "attempt", event))
            answered, accepted = answers.get(seq, (10**9, False))
            if answered > at + 10:
                out.append((name, seq, at + 10, "expired", event))
            else:
                out.append((name, seq, answered, "sent" if accepted else "failed", event))
                if accepted:
                    told, told_ok, told_s, failing = sign, ok, at, False
    return sorted(out, key=str)


@pytest.mark.parametrize("cuts", [(1, 1), (5, 2), (2, 7)])
def test_deliveries_do_not_depend_on_micro_batches(spark, cuts):
    reports, outcomes = delivery_rows(3)
    sides = []
    for rows, schema, order, n in (
        (reports, "instance string, observed_s long, seq long, severity string, codes string", "observed_s", cuts[0]),
        (outcomes, "instance string, answered_s long, seq long, accepted boolean", "answered_s", cuts[1]),
    ):
        f = SimpleNamespace(spark=spark)
        sides.append(publishing._stream(f, spark.createDataFrame(rows, schema), "side", order, n, 1))
    got = publishing._drain(f, alerts.alert_delivery(*sides), "deliveries").where("instance <> 'end'")
    assert sorted(map(tuple, got.collect()), key=str) == plain_deliveries(reports, outcomes)
    steps = {r.step for r in got.collect()}
    assert steps == {"suppressed", "attempt", "sent", "failed", "expired"}


@pytest.mark.parametrize("n", [1, 6])
def test_holds_equal_the_batch_monitor_at_every_second(spark, n):
    rng = random.Random(5)
    rows = []
    for name in "abc":
        at = 1000
        for _ in range(60):
            at += rng.choice([0, 1, 20, 59, 60, 61, 119, 120, 181, 240, 241, 242, 300])
            rows.append((name, at, rng.random() < 0.6, rng.random() < 0.7))
    schema = "instance string, observed_s long, faulty boolean, send_failed boolean"
    closing = [("end", 10**6, False, False)]
    f = SimpleNamespace(spark=spark)
    stream = publishing._stream(f, spark.createDataFrame(rows + closing, schema), "reports", "observed_s", n, 1)
    changes = publishing._drain(f, stale.hold_stream(stream), "holds").where("instance <> 'end'").cache()
    for now in (1000, 1500, 2100, 2101, 3333, 4444, 5000, 6000, 8000):
        known = spark.createDataFrame([r for r in rows if r[1] <= now] or rows[:0], schema)
        want = {
            (r.instance, rule) for r in ops.stale_monitor(known, F.lit(now).cast("bigint")).collect()
            for rule in ("stale", "operational_fault", "notification_failed") if r[rule]
        }
        assert {(r.instance, r.rule) for r in stale.firing_at(changes, now).collect()} == want, now
    assert changes.where("state = 'firing'").count() > 10
