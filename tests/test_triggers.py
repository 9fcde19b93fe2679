"""Registered streams take bounded files in turn; the guard of a table runs in slices."""

import random
from decimal import Decimal
from types import SimpleNamespace

import pytest

from tidemark.operators import snapshot
from tidemark.plans.queries import publishing
from tidemark.streaming import alerts, guard


def test_stream_query_takes_ranges_in_turn(spark, monkeypatch):
    monkeypatch.setattr(publishing, "FILE_ROWS", 20)
    batches = []
    drain = publishing._drain

    def spied(f, stream, label):
        out = drain(f, stream, label)
        path = out.inputFiles()[0].split("/rows/")[0]
        sources = spark.read.text(f"{path}/checkpoint/sources/0/*").where("value like '{%'")
        batches.append(sources.selectExpr("get_json_object(value, '$.batchId') as b").groupBy("b").count().collect())
        return out

    monkeypatch.setattr(publishing, "_drain", spied)
    rng = random.Random(2)
    rows = [("hot", 10000 + 90 * i, i, rng.choice(["ok", "critical"]), "", rng.random() < 0.7) for i in range(300)]
    rng.shuffle(rows)
    reports = spark.createDataFrame(rows, "instance string, observed_s long, seq long, severity string, codes string, send_ok boolean")
    got = publishing.alert_throttle_stream(SimpleNamespace(spark=spark, sql=lambda _: reports))
    want = alerts.alert_throttle_batch(reports).select(got.columns)
    assert snapshot.exact_rows_diff(want, got, got.columns).count() == 0
    counts = sorted(r["count"] for r in batches[0])
    assert len(counts) >= 2 and sum(counts) >= 12 and counts[-1] == spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("width", [1, 3, 1000])
def test_guard_of_a_table_runs_in_slices(spark, width):
    rng = random.Random(6)
    rows = [(n, i, Decimal(2**63 + rng.randint(i // 4, i // 3 + 2)), rng.choice("ab")) for n in "xy" for i in range(60)]
    df = spark.createDataFrame(rows, "namespace string, obs long, seq decimal(20,0), manifest string")
    want = []
    for n in "xy":
        top, content = 0, None
        for _, obs, seq, manifest in [r for r in rows if r[0] == n]:
            same = "unchanged" if manifest == content else "changed_at_same_sequence"
            want.append((n, obs, "newer" if seq > top else "regressed" if seq < top else same))
            if seq > top:
                top, content = seq, manifest
    got = guard.generation_guard_batch(df, width).select("namespace", "obs", "verdict").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len({v for *_, v in want}) == 4
