"""Mixing: budgets and nested thresholds against a sort, on odd and skewed tables."""

import random
import re
from collections import defaultdict
from fractions import Fraction

import brute
import pytest

from tidemark.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def budgets(sizes: dict, weights, share, most) -> dict:
    """Targets in exact arithmetic: what is above its limit is cut and shared again, one round after the other."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, free = {}, set(order)
    left = Fraction(share) * sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        above = {s for s in free if level * weight[s] > most * sizes[s]}
        if not above:
            return target | {s: level * weight[s] for s in free}
        for s in above:
            target[s] = Fraction(most * sizes[s])
            left -= target[s]
        free -= above
    return target


def check(rows, got, weights=mixing.WEIGHTS, share=1.5, most=2):
    sizes, words, taken, largest = defaultdict(int), {}, defaultdict(int), defaultdict(int)
    for d, t, s in rows:
        n = len(brute.WORD.findall(t or ""))
        sizes[s] += n
        largest[s] = max(largest[s], n)
        words[d, t, s] = n
    want = budgets(dict(sizes), weights, share, most)
    assert len(got) == len(rows)
    for r in got:
        assert r["size"] == words[r.doc_id, r.text, r.source] and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(float(want[r.source])) and 0 <= r.taken <= most * r["size"]
        assert r["size"] == 0 or r.taken % r["size"] == 0
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6, s


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_budgets_are_met(spark, seed):
    rng = random.Random(seed)
    names = ["a", "b", "B", "é", "", None, "long tail", "z"]
    odds = [rng.random() ** 3 for _ in names]
    rows = [
        (i, "w " * rng.choice([0, 1, 3, 10, 60]), rng.choices(names, odds)[0]) for i in range(400)
    ] + [(None, None, "a"), (5000, "one\x1ctwo three", "only one"), (5001, "", "no words")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = mixing.mixed(df).collect()
    check(rows, got)
    assert sorted(map(str, mixing.mixed(df.repartition(2)).collect())) == sorted(map(str, got))
    check(rows, mixing.mixed(df, (1.0, 3.0), 0.25, 1).collect(), (1, 3), 0.25, 1)


def test_rows_that_repeat_are_split(spark):
    rows = [(None, "the same text", "hot")] * 300 + [(i, "some other text here", "b") for i in range(100)] + [(7, "x", "c")] * 40
    for parts in (1, 6):
        check(rows, mixing.mixed(spark.createDataFrame(rows, SCHEMA).repartition(parts)).collect())


def test_larger_mixes_hold_smaller_ones(spark):
    rows = [(i, "w " * (i % 17), "ab"[i % 2]) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    mixes = [{r.doc_id: r.taken for r in mixing.mixed(df, share=s).collect()} for s in (0.2, 0.5, 0.9, 1.7)]
    for small, large in zip(mixes, mixes[1:]):
        assert all(small[d] <= large[d] for d in small) and sum(small.values()) < sum(large.values())


def test_every_step_finds_the_same_cut(spark):
    rows = [(i, "w " * (i % 5 + 1), "ab"[i % 2]) for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    narrow = mixing._sized(df, 0).selectExpr("_source as source", "_size as size", "_key as key").cache()
    plan = mixing.targets(narrow)
    cuts = [sorted((r.source, r.cut, r.takes) for r in mixing.thresholds(narrow, plan, k).collect()) for k in (1, 5, 10, 60)]
    assert cuts.count(cuts[0]) == len(cuts)


def test_many_sources_are_ordered_in_slices(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 20)
    rows = [(i, "w " * (i % 7), None if i == 5 else f"s{i % 150:03}") for i in range(300)]
    check(rows, mixing.mixed(spark.createDataFrame(rows, SCHEMA)).collect())


def test_word_count(spark, pairs):
    df = spark.createDataFrame(pairs, "doc_id long, text string")
    got = {r.doc_id: r.n for r in df.select("doc_id", mixing.word_count(df.text).alias("n")).collect()}
    assert got == {d: len(re.findall(brute.WORD, t or "")) for d, t in pairs}
