"""Results kept up to date equal those of a full run: coverage chains and verified logs."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import coverage, ops
from tidemark.session import scratch

DAY = 86400000


@pytest.mark.parametrize("seed", [1, 2])
def test_chains_after_appends_equal_those_of_the_catalog(spark, seed):
    rng = random.Random(seed)
    schema = "dataset string, market string, symbol string, cov_start long, cov_end long"
    entries = []
    for s in "abc":
        for _ in range(60):
            start = rng.randrange(0, 400) * DAY // 2
            entries.append(("d", "SZ", s, start, start + rng.choice([0, 1, DAY // 2, DAY, 40 * DAY])))
    stored = spark.createDataFrame([], schema)
    for k in range(4):
        part = spark.createDataFrame(entries[k::4], schema)
        gone, new = coverage.extend_chains(stored, part)
        # Only intervals that a new entry meets are taken out.
        met = {tuple(r) for r in gone.collect()}
        assert all(any(e[2] == g[2] and e[3] <= g[4] and g[3] <= e[4] for e in entries[k::4]) for g in met)
        stored = coverage.with_chains(stored, part).cache()
        want = coverage.coverage_chains(spark.createDataFrame([e for i in range(k + 1) for e in entries[i::4]], schema))
        assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, want.collect()))
    assert coverage.with_chains(stored, spark.createDataFrame([], schema)).count() == stored.count()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def log(name, n, wrong=()):
    rows, before = [], sha("seed")
    for i in range(1, n + 1):
        own = sha(f"{name}|{i}|{i * 7}")
        rows.append([name, i, i, i * 7, before, own])
        before = own
    for i, field, value in wrong:
        rows[i - 1][field] = value
    return [tuple(r) for r in rows]


def test_suffix_and_known_breaks_are_all_breaks(spark):
    schema = "log string, idx long, n long, cents long, prev_hash string, hash string"
    rows = log("a", 300, [(20, 5, "x"), (180, 4, "y"), (250, 1, 9)]) + log("b", 90, [(90, 3, 0)]) + log("c", 50)
    path = scratch(spark, "log")
    spark.createDataFrame(rows, schema).repartitionByRange(8, "log", "n").sortWithinPartitions("log", "n").write.parquet(path)
    events = spark.read.schema(schema).parquet(path)
    args = ("log", "n", ["log", "n", "cents"], F.sha2(F.lit("seed"), 256))
    want = {(r.log, r.n, r.problem) for r in ops.hash_chain_breaks(events, *args).collect()}
    assert {p for *_, p in want} == {"index", "hash", "link"}
    first = events.where("n <= 60 or (log = 'b' and n <= 89)").where("log <> 'c'")
    known = {(r.log, r.n, r.problem) for r in ops.hash_chain_breaks(first, *args).collect()}
    heads = ops.hash_chain_heads(first, "log", "n")
    found = {(r.log, r.n, r.problem) for r in ops.hash_chain_suffix(events, heads, *args).collect()}
    assert known | found == want and not known & found
    two = events.where("log <> 'c'")
    told = ops.hash_chain_suffix(two, heads, *args, all_known=True)
    assert {(r.log, r.n, r.problem) for r in told.collect()} == found
    # A head that was altered or lost shows that the verified part is not what it was.
    altered = two.withColumn("hash", F.when(F.expr("log = 'a' and n = 60"), F.lit("z")).otherwise(F.col("hash"))).where("not (log = 'b' and n = 89)")
    got = {(r.log, r.n, r.problem) for r in ops.hash_chain_suffix(altered, heads, *args).collect()}
    assert {("a", 60, "prefix"), ("b", 89, "prefix")} <= got
