"""Sources and sinks: layout, pruning, strict documents, binary exports."""

import hashlib
import json
import struct

import pytest
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.operators import digest, snapshot
from tidemark.plans.fixtures import Shapes
from tidemark.session import materialize, scratch
from tidemark.sources import bars as bar_files
from tidemark.sources import catalog, exports, factors, suspensions

T = 1704067200000


def test_snapshot_round_trip_and_pruning(spark, small):
    f = Shapes(spark, small)
    path = scratch(spark, "test")
    bar_files.write_snapshot(f.f_bars_nullable, path)
    back = bar_files.scan_bars(spark, path)
    cols = ["symbol", "ts_ms", "open", "close", "volume", "close_oi"]
    assert snapshot.exact_rows_diff(back, f.f_bars_nullable, cols).count() == 0
    part = bar_files.scan_bars(spark, path, T + 10**9, T + 2 * 10**9, ["000001.SH"])
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "yyyymm" in plan.split("PartitionFilters")[1]
    assert "GreaterThanOrEqual(ts_ms" in plan and "EqualTo(symbol,000001.SH)" in plan


def test_files_hold_short_key_ranges(spark, small):
    f = Shapes(spark, small)
    path = scratch(spark, "test")
    bar_files.write_snapshot(f.f_bars, path, partitions=4)
    rows = spark.read.parquet(path).select(
        "market", "symbol", "ts_ms", F.input_file_name().alias("file")
    )
    spans = rows.groupBy("market", "file").agg(
        F.min(F.struct("symbol", "ts_ms")).alias("a"), F.max(F.struct("symbol", "ts_ms")).alias("b")
    )
    for market in ["SZ", "SH"]:
        found = sorted((r.a, r.b) for r in spans.where(F.col("market") == market).collect())
        assert all(x[1] < y[0] for x, y in zip(found, found[1:]))


def plan_of(spark, df):
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def test_few_requests_prune_the_months_they_need(spark, small):
    """Small batches are broadcast: bars are scanned by month and never shuffled."""
    from tidemark.operators import scan

    f = Shapes(spark, small)
    path = scratch(spark, "test")
    bar_files.write_snapshot(f.f_bars, path)
    ranges = f.f_series.select(
        "dataset", "market", "symbol", F.col("symbol").alias("request_id"),
        F.lit(T + 10**9).alias("lo"), F.lit(T + 10**9 + 86400000).alias("hi"),
    )
    stored = materialize(ranges, "ranges")
    rows = scan.range_scan(bar_files.scan_bars(spark, path), stored)
    plan = plan_of(spark, rows)
    assert "dynamicpruning" in plan.lower() and "BroadcastHashJoin" in plan
    assert "SortMergeJoin" not in plan
    want = scan.range_scan(f.f_bars, ranges)
    assert snapshot.exact_rows_diff(rows, want, ["request_id", "ts_ms", "close"]).count() == 0


def test_many_requests_are_merged(spark, small, monkeypatch):
    """Beyond the counted limit nothing that was exploded is broadcast."""
    from tidemark import session
    from tidemark.operators import scan

    f = Shapes(spark, small)
    ranges = f.f_series.select(
        "dataset", "market", "symbol", F.col("symbol").alias("request_id"),
        F.lit(T).alias("lo"), F.lit(T + 30 * 86400000).alias("hi"),
    )
    few = scan.range_scan(f.f_bars, ranges)
    monkeypatch.setattr(scan, "sized", lambda df: session.sized(df, 3))
    many = scan.range_scan(f.f_bars, ranges)
    assert "SortMergeJoin" in plan_of(spark, many)
    assert snapshot.exact_rows_diff(few, many, ["request_id", "ts_ms", "close"]).count() == 0


def pack(rows):
    return b"".join(struct.pack("<q4dqqq", *r) for r in rows)


def test_binary_export_files(spark, tmp_path):
    good = [(T + i * 60000, 1.0 + i, 2.0, 0.5, 1.5, 2**53 + i, i, -0 + i) for i in range(300)]
    good[3] = (T + 180000, fixed.NULL_PRICE, 0.0, 0.0, fixed.NULL_PRICE, 0, 0, 0)
    (tmp_path / "a.bin").write_bytes(pack(good))
    (tmp_path / "b.bin").write_bytes(pack(good)[:-1])
    (tmp_path / "c.bin").write_bytes(pack(good[:5]))
    entries = spark.createDataFrame(
        [(fixed.DATASET_NATIVE, "SZ", f"{n}.SZ", T, T + 10**8, 300, f"{n}.bin") for n in "abcd"],
        "dataset string, market string, symbol string, cov_start long, cov_end long, row_count long, file string",
    )
    files = exports.export_files(spark, str(tmp_path))
    problems = {r.file: r.problem for r in exports.export_problems(files, entries).collect()}
    assert problems == {"b.bin": "length", "c.bin": "row_count", "d.bin": "no_file"}
    rows = exports.ingest_exports(spark, str(tmp_path), entries, fixed.DATASET_NATIVE).orderBy("row_no").collect()
    assert len(rows) == 300 and {r.symbol for r in rows} == {"a.SZ"}
    assert rows[3].open is None and rows[3].close is None and rows[3].high == 0.0
    assert rows[7].volume == 2**53 + 7 and rows[7].open == 8.0 and rows[7].row_no == 7


def bars_to_export(spark, n):
    rows = [(f"{'ab'[i % 2]}.bin", i // 2, T + i * 30000, -0.0 if i == 4 else 1.5 * i, None if i % 7 == 3 else 2.0, 0.5, 1.25, i, 2**53 + i, 0) for i in range(n)]
    schema = "file string, row_no long, ts_ms long, open double, high double, low double, close double, volume long, open_oi long, close_oi long"
    return spark.createDataFrame(rows, schema)


def test_written_exports_hold_the_exact_records(spark, tmp_path):
    """One file per name, byte for byte the payload that digests cover."""
    rows = bars_to_export(spark, 1001)
    exports.write_exports(rows.orderBy(F.rand(1)), str(tmp_path / "x"), fixed.ENCODING_NATIVE)
    want = digest.rows_digest(rows, ["file"], fixed.ENCODING_NATIVE, payload=True).collect()
    assert {p.name: p.read_bytes() for p in (tmp_path / "x").iterdir() if not p.name.startswith(".")} == {r.file: bytes(r.data) for r in want}
    exports.write_exports(rows.where("row_no < 0"), str(tmp_path / "none"), fixed.ENCODING_NATIVE)


@pytest.mark.parametrize("pushed", ["true", "false"])
def test_exports_are_read_in_ranges(spark, tmp_path, pushed, monkeypatch):
    """One file over many tasks, columns and times chosen, nothing shuffled."""
    rows = bars_to_export(spark, 1001)
    folder = str(tmp_path / "x")
    exports.write_exports(rows, folder, fixed.ENCODING_NATIVE)
    spark.conf.set(exports.PUSHDOWN, pushed)
    try:
        found = exports.scan_exports(spark, folder, fixed.ENCODING_NATIVE, split=64 * 100 + 7)
        assert found.rdd.getNumPartitions() == 11 and "Exchange" not in plan_of(spark, found)
        assert snapshot.exact_rows_diff(found, rows, rows.columns).count() == 0
        some = exports.scan_exports(spark, folder, fixed.ENCODING_NATIVE, ["file", "ts_ms"], split=6400)
        low, high = T + 90000, T + 9000000
        cut = some.where((F.col("ts_ms") >= low) & (F.col("ts_ms") < high))
        assert some.columns == ["file", "ts_ms"]
        assert sorted(cut.collect()) == sorted(rows.where(f"ts_ms >= {low} and ts_ms < {high}").select("file", "ts_ms").collect())
        assert some.where(F.col("ts_ms") == low).count() == 1 and some.where("ts_ms > 5 and ts_ms < 5").count() == 0
        (tmp_path / "empty").mkdir()
        assert exports.scan_exports(spark, str(tmp_path / "empty"), fixed.ENCODING_NATIVE).count() == 0
    finally:
        spark.conf.unset(exports.PUSHDOWN)


def test_arriving_exports_are_read_once(spark, tmp_path):
    """Files that come between runs of a stream: each row once, long files cut."""
    folder, stored, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows = bars_to_export(spark, 1001)
    for name in ("a.bin", "b.bin"):
        exports.write_exports(rows.where(F.col("file") == name), folder, fixed.ENCODING_NATIVE)
        arriving = exports.stream_exports(spark, folder, fixed.ENCODING_NATIVE, split=6400, maxFilesPerTrigger=1)
        query = arriving.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True)
        query.start(stored).awaitTermination()
    assert snapshot.exact_rows_diff(spark.read.parquet(stored), rows, rows.columns).count() == 0


def test_listed_exports_are_read_once(spark, tmp_path):
    """Lists that come between runs of a stream; a list of a lost attempt has no name, and what it lists is not read."""
    folder, lists, stored, state = (str(tmp_path / n) for n in ("in", "lists", "out", "state"))
    rows = bars_to_export(spark, 1001)
    for name in ("a.bin", "b.bin"):
        exports.write_exports(rows.where(F.col("file") == name), folder, fixed.ENCODING_NATIVE, lists)
        (tmp_path / "lists" / f".lost-{name}.json").write_text('{"file":"none.bin","bytes":64}\n')
        arriving = exports.stream_listed(spark, folder, lists, fixed.ENCODING_NATIVE, split=6400, maxFilesPerTrigger=1)
        query = arriving.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True)
        query.start(stored).awaitTermination()
    assert snapshot.exact_rows_diff(spark.read.parquet(stored), rows, rows.columns).count() == 0
    lines = [json.loads(line) for p in (tmp_path / "lists").glob("[!.]*.json") for line in p.read_text().splitlines()]
    assert sorted((x["file"], x["bytes"]) for x in lines) == [("a.bin", 501 * 64), ("b.bin", 500 * 64)]


def test_a_failed_write_lists_nothing(spark, tmp_path):
    folder, lists = tmp_path / "in", tmp_path / "lists"
    rows = bars_to_export(spark, 101)
    broken = rows.withColumn("high", F.when((F.col("file") == "b.bin") & (F.col("row_no") == 40), F.raise_error("lost")).otherwise(F.col("high")))
    with pytest.raises(Exception, match="lost"):
        exports.write_exports(broken, str(folder), fixed.ENCODING_NATIVE, str(lists))
    assert not lists.exists() or not [p for p in lists.iterdir() if not p.name.startswith(".")]


def factor_doc(**changes):
    doc = {
        "schema_version": 1, "kind": "ddb-adjustment-snapshot-v1", "algorithm": "upcloud-adjustment-v1",
        "symbol": "000001.SZ", "market": "SZ", "model": "cumulative", "first_day": 10, "end_day": 40,
        "coverage_complete": True, "allow_empty": False, "observed_at_ms": 1000, "valid_until_ms": 61000,
        "source_epoch": "e", "source_proof_sha256": "ab" * 32, "date_encoding": "exchange-civil-days-since-1970",
        "rows": [{"code": "000001.SZ", "ex_date": 10, "ex_factor": 2.0, "cum_factor": 2.0, "update_time": 1}],
    }
    doc.update(changes)
    return json.dumps(doc)


def test_factor_documents(spark):
    row = {"code": "000001.SZ", "ex_date": 10, "ex_factor": 2.0, "cum_factor": 2.0, "update_time": 1}
    us = {"code": "AAPL", "ex_div_date": 20, "forward_adj_factorA": 0.5, "forward_adj_factorB": None,
          "backward_adj_factorA": 2.0, "backward_adj_factorB": -1.0, "update_time": 1}
    cases = {
        factor_doc(): None,
        factor_doc(symbol="AAPL", market="US", model="futu_ab", rows=[us]): None,
        factor_doc(market="US"): "model",
        factor_doc(coverage_complete=False): "incomplete",
        factor_doc(rows=[]): "empty",
        factor_doc(rows=[], allow_empty=True): None,
        factor_doc(valid_until_ms=999): "validity",
        factor_doc(end_day=99999): "window",
        factor_doc(source_proof_sha256="zz"): "proof",
        factor_doc(rows=[{**row, "cum_factor": 0.0}]): "row_value",
        factor_doc(rows=[{**row, "code": "X"}]): "row_value",
        factor_doc(rows=[{**row, "ex_date": 40}]): "row_window",
        factor_doc(rows=[{**row, "ex_date": 1}, {**row, "ex_date": 2}]): "row_window",
        factor_doc(rows=[row, {**row, "ex_date": 9}]): "row_order",
        factor_doc(rows=[row, row]): "row_order",
        factor_doc(rows=[row, {**row, "update_time": 2}]): None,
        factor_doc(rows=[{**row, "ex_date": None}]): "row_value",
        factor_doc(kind="other"): "unsupported",
        factor_doc(first_day="10"): "wrong_type",
        factor_doc(observed_at_ms=1000.5): "wrong_type",
        factor_doc(symbol=7): "wrong_type",
        factor_doc(rows=[{**row, "cum_factor": "2.0"}]): "wrong_type",
        factor_doc(extra=1): "unknown_field",
        factor_doc().replace('"market"', '"symbol"'): "duplicate_key",
        factor_doc().replace('"update_time": 1', '"update_time": 1, "code": "Y"'): "duplicate_key",
        "[]": "not_object",
    }
    docs = spark.createDataFrame([(i, d) for i, d in enumerate(cases)], "i int, value string")
    sets, events = factors.read_factors(docs)
    got = sorted(str(r.problem) for r in sets.collect())
    assert got == sorted(str(p) for p in cases.values())
    us_event = events.where("symbol = 'AAPL'").first()
    assert (us_event.fa, us_event.fb, us_event.bb, us_event.day) == (0.5, 0.0, -1.0, 20)


def test_last_revision_of_a_day_counts(spark):
    row = {"code": "000001.SZ", "ex_date": 10, "ex_factor": 2.0, "cum_factor": 2.0, "update_time": 1}
    later = [{**row, "cum_factor": 3.0, "update_time": 2}, {**row, "ex_date": 11}]
    docs = spark.createDataFrame([(factor_doc(rows=[row, *later]),)], "value string")
    _, events = factors.read_factors(docs)
    assert sorted((r.day, r.cum, r.update_ms) for r in events.collect()) == [(10, 3.0, 2), (11, 2.0, 1)]


def test_suspension_documents(spark, tmp_path):
    def doc(*intervals, policy="a-share-null-placeholder-v1"):
        return json.dumps({"schema_version": 1, "policy": policy, "intervals": list(intervals)})

    good = {"symbol": "000001.SZ", "start_ms": T, "end_ms": T + 1, "evidence": "notice"}
    lines = [
        doc(good, {**good, "evidence": " \t"}, {**good, "end_ms": T}, {**good, "symbol": "00700.HK"}),
        doc(good, policy="other"),
        doc({**good, "note": 1}),
    ]
    (tmp_path / "p.json").write_text("\n".join(lines))
    got = suspensions.scan_suspensions(spark, str(tmp_path)).collect()
    found = sorted(str(r.problem) for r in got)
    assert found == ["None", "bounds", "evidence", "policy", "symbol", "unknown_field"]


def test_manifest_golden_document(spark):
    entry = {
        "identity": {"dataset": "synthetic", "market": "TEST", "symbol": "FIXTURE", "period_seconds": 60, "adjust": "none"},
        "series_id": "2f7c6a5825f44f403af4460e38a6fd00", "data_version": "ab" * 32, "source_version": 2**64 - 1,
        "coverage_start_ms": 0, "coverage_end_ms": 60000, "coverage_complete": True, "rows": 0, "object": None,
    }
    manifest = {"schema_version": 1, "kind": "complete-interval-snapshot", "dataset_epoch": "e"}
    texts = [
        json.dumps({**manifest, "entries": [entry]}),
        json.dumps({**manifest, "entries": [{**entry, "series_id": "00" * 16}]}),
        json.dumps({**manifest, "entries": [{**entry, "identity": {**entry["identity"], "x": 1}}]}),
        json.dumps({**manifest, "entries": [{**entry, "coverage_complete": False}]}),
    ]
    docs = spark.createDataFrame([(t, 7) for t in texts], "value string, generation long")
    got = catalog.read_manifests(docs).collect()
    assert sorted(str(r.problem) for r in got) == ["None", "partial_coverage", "series_id", "unknown_field"]
    assert int([r for r in got if r.problem is None][0].source_version) == 2**64 - 1


def test_readers_stay_on_their_generation(spark):
    path = scratch(spark, "catalog")
    row = ("d", "SZ", "s", 60, "none", "id", "v", 1, 0, 10, 0, None, False, "e", "history")
    cols = "dataset string, market string, symbol string, period_seconds int, adjust string, series_id string, data_version string, source_version decimal(20,0), cov_start long, cov_end long, row_count long, content_hash string, nullable_prices boolean, epoch string, tier string"
    from decimal import Decimal

    df = spark.createDataFrame([(*row[:7], Decimal(1), *row[8:])], cols).withColumn("namespace", F.lit("n"))
    for g in [1, 2]:
        df.withColumn("generation", F.lit(g).cast("decimal(20,0)")).write.mode("append").parquet(path)
    assert [int(r.generation) for r in catalog.scan_catalog(spark, path).collect()] == [2]
    pinned = catalog.scan_catalog(spark, path, generation=1, min_seq=2).collect()
    assert [(int(r.generation), r.refused) for r in pinned] == [(1, True)]


def two_parts(**changes):
    """(reference, data document) of one set; ``changes`` alter the reference."""
    row = {"code": "000001.SZ", "ex_date": 10, "ex_factor": 2.0, "cum_factor": 2.0, "update_time": 1}
    shared = {"algorithm": "upcloud-adjustment-v1", "symbol": "000001.SZ", "market": "SZ", "model": "cumulative", "first_day": 5,
              "end_day": 30, "coverage_complete": True, "allow_empty": False, "source_epoch": "e",
              "date_encoding": "exchange-civil-days-since-1970"}
    data = json.dumps({"schema_version": 2, "kind": "ddb-adjustment-data-v2", **shared, "rows": [row]})
    reference = {"schema_version": 2, "kind": "ddb-adjustment-reference-v2", **shared, "observed_at_ms": 1000, "valid_until_ms": 2000,
                 "source_proof_sha256": "a" * 64, "factor_data_sha256": hashlib.sha256(data.encode()).hexdigest(),
                 "factor_data_bytes": len(data.encode())}
    return reference | changes, data


def test_factor_documents_in_two_parts(spark):
    good, data = two_parts()
    day = 86400000
    check = {"policy": "market-eod-check-v1", "exchange": "XSHE", "calendar_sha256": "b" * 64, "trading_day": 19722,
             "next_trading_day": 19723, "check_minute": 60, "source_revision": 3, "source_completed_at_ms": 19723 * day,
             "next_check_ms": 19724 * day + 3600000 - 28800000, "config_sha256": "c" * 64, "workload_sha256": "d" * 64,
             "source_receipt_sha256": "e" * 64}
    scheduled = {"schema_version": 3, "kind": "ddb-adjustment-reference-v3", "observed_at_ms": 19723 * day + 1,
                 "valid_until_ms": check["next_check_ms"], "verification": check}
    other, other_data = two_parts(end_day=31)
    cases = {
        json.dumps(good): None,
        json.dumps(good | {"observed_at_ms": 1500}): None,
        json.dumps(good | scheduled): None,
        json.dumps(good | {"factor_data_sha256": "f" * 64}): "data_missing",
        json.dumps(good | {"factor_data_bytes": 7}): "data_length",
        json.dumps(good | {"factor_data_bytes": 0}): "data_reference",
        json.dumps(other): "data_differs_end_day",
        json.dumps(good | {"source_epoch": "f"}): "data_differs_source_epoch",
        json.dumps(good)[:-1] + ', "symbol": "X"}': "duplicate_key",
        json.dumps(good | {"rows": []}): "unknown_field",
        json.dumps(good | {"verification": check}): "check",
        json.dumps(good | scheduled | {"valid_until_ms": 19724 * day}): "check_deadline",
        json.dumps(good | scheduled | {"verification": check | {"exchange": "XNYS"}}): "check_exchange",
        json.dumps(good | scheduled | {"verification": check | {"config_sha256": "0"}}): "check_digest",
        json.dumps({k: v for k, v in (good | scheduled).items() if k != "verification"}): "check",
        json.dumps(good | {"schema_version": 3}): "unsupported",
        json.dumps(good | {"kind": "ddb-adjustment-snapshot-v1"}): "unsupported",
        json.dumps(good | {"observed_at_ms": 19725 * day, "valid_until_ms": 19725 * day + 1}): "future-dated",
    }
    docs = spark.createDataFrame([(t, hashlib.sha256(t.encode()).hexdigest()) for t in cases], "value string, sha256 string")
    stored = spark.createDataFrame([(data,), (data,), (other_data.replace("30", "32"),)], "value string")
    sets, events = factors.resolve_factors(docs, stored, 19725 * day - 1)
    got = {r.reference: r for r in sets.collect()}
    assert {t: got[hashlib.sha256(t.encode()).hexdigest()].problem for t in cases} == cases
    assert [(r.symbol, r.day, r.cum) for r in events.where(f"data_hash = '{good['factor_data_sha256']}'").collect()] == [("000001.SZ", 10, 2.0)]
    hashes = [hashlib.sha256(json.dumps(d).encode()).hexdigest() for d in (good, good | scheduled)]
    assert got[hashes[0]].version == hashes[0] and got[hashes[1]].version == good["factor_data_sha256"]
    assert got[hashes[1]].source_revision == 3
    listed = spark.createDataFrame([(json.dumps(good), "0" * 64)], "value string, sha256 string")
    assert [r.problem for r in factors.resolve_factors(listed, stored)[0].collect()] == ["digest"]
    late = factors.resolve_factors(docs.limit(1), stored, 5000, fresh=True)[0]
    assert [r.problem for r in late.collect()] == ["expired"]
    whole = json.dumps({k: v for k, v in (good | scheduled).items() if not k.startswith("factor_data")}
                       | {"kind": "ddb-adjustment-snapshot-v3", "rows": json.loads(data)["rows"]})
    sets, events = factors.read_factors(spark.createDataFrame([(whole,)], "value string"))
    assert [r.problem for r in sets.collect()] == [None] and events.count() == 1
