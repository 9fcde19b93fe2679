"""Instances of keyed streams share state rows: a micro-batch costs as many calls as buckets."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import snapshot
from tidemark.session import scratch
from tidemark.streaming import alerts, stale

SCHEMA = "instance string, observed_s long, seq long, severity string, codes string, send_ok boolean"


def drained(spark, df, run):
    """Rows of a stream over two files, and the most state rows that a micro-batch left."""
    path, out = scratch(spark, "in"), scratch(spark, "out")
    df.where("seq < 600").coalesce(1).write.parquet(path)
    df.where("seq >= 600").coalesce(1).write.mode("append").parquet(path)
    result = run(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path))
    q = result.writeStream.format("parquet").option("checkpointLocation", f"{out}/c").trigger(availableNow=True).start(f"{out}/rows")
    q.awaitTermination()
    states = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    return spark.read.schema(result.schema).parquet(f"{out}/rows"), max(states)


@pytest.fixture(scope="module")
def reports(spark):
    rng = random.Random(4)
    rows = [(f"host-{rng.randrange(250)}", 10000 + 97 * i, i, rng.choice(["ok", "critical"]), "", rng.random() < 0.7) for i in range(1200)]
    return spark.createDataFrame(rows + [(None, 10**6, 1200, "critical", "", None)], SCHEMA)


def test_throttle_keeps_many_instances_in_few_states(spark, reports):
    got, states = drained(spark, reports, lambda s: alerts.alert_throttle(s, 4))
    want = alerts.alert_throttle_batch(reports)
    assert states == 4 and snapshot.exact_rows_diff(want, got, want.columns).count() == 0


def test_holds_keep_many_instances_in_few_states(spark, reports, monkeypatch):
    monkeypatch.setattr(stale.Holds, "over", lambda self, rows, run=stale.Holds.over: run(self, rows, 4))
    source = reports.select("instance", "observed_s", "seq", (F.col("severity") != "ok").alias("faulty"), (~F.coalesce("send_ok", F.lit(True))).alias("send_failed"))
    got, states = drained(spark, source, stale.hold_stream)
    assert states == 4 and got.where("rule = 'operational_fault' and state = 'started'").select("instance").distinct().count() > 200
