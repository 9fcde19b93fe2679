"""Line removal against the alignment of every overlapping pair."""

import random

import brute
import pytest

from tidemark.llm import lines


def left(spark, rows, rare=lines.RARE):
    done = lines.without_lines(spark.createDataFrame(rows, "doc_id long, text string"), rare)
    return {r.doc_id: [x for x in r.kept_text.split("\n") if x] for r in done.collect()}


def test_copy_behind_a_document_in_another_order(spark):
    ten = [f"line {i}" for i in range(10)]
    passages = [["p 1", "p 2", "p 3"], ["q 1", "q 2", "q 3"]]
    rows = [(1, ten), (2, ten[::-1]), (3, ten + ["own line"])]
    rows += [(4, passages[0] + passages[1]), (5, passages[1] + passages[0]), (6, passages[0] + passages[1])]
    got = left(spark, [(d, "\n".join(x)) for d, x in rows])
    assert got[3] == ["own line"] and got[6] == []
    assert len(got[2]) == 9 and len(got[5]) == 3


@pytest.mark.parametrize("seed", [1, 2])
def test_every_overlapping_pair_is_aligned(spark, seed):
    rng = random.Random(seed)
    names = [f"line {i}" for i in range(60)]
    rows = [(d, "\n".join(rng.sample(names, rng.randint(2, 12)))) for d in range(40)]
    assert left(spark, rows) == brute.aligned_lines(rows, lines.RARE, lines.patience)


@pytest.mark.parametrize("holders", [64, 65, 80])
def test_common_lines_follow_the_same_rule(spark, holders):
    """A line that only stands in many documents stays; in an aligned pair its repetitions stay."""
    rows = [(d, f"own {d} a\nshare this\nown {d} b") for d in range(2, holders)]
    rows += [(1, "share this\nx 1\nx 2"), (holders, "x 1\nx 2\nshare this\nshare this\nshare this")]
    got = left(spark, rows, 3)
    assert got[2] == ["own 2 a", "share this", "own 2 b"]
    assert got[holders] == ["share this"] * 3
    rows[-1] = (holders, "share this\nx 1\nx 2\nshare this\nshare this")
    assert left(spark, rows)[holders] == ["share this"] * 2


def test_many_copies_and_near_copies(spark):
    body = [f"line {i}" for i in range(8)]
    rows = [(d, "\n".join([*body[:4], f"own {d}", *body[4:]])) for d in range(100)]
    rows += [(d, "\n".join(["head", *body[::-1]])) for d in range(100, 200)]
    got = left(spark, rows)
    assert got == brute.aligned_lines(rows, lines.RARE, lines.patience)
    assert got[99] == ["own 99"] and got[199] == []


@pytest.mark.parametrize("rare", [1, 3, 8])
def test_common_lines_in_aligned_pairs(spark, rare):
    rng = random.Random(rare)
    names = [f"line {i}" for i in range(60)]
    rows = [(d, "\n".join(rng.choices(names, k=rng.randint(2, 12)))) for d in range(40)]
    rows += [(d + 50, t) for d, t in rows[:5]]
    rows += [(d + 70, t + "\nlast") for d, t in rows[:9]]
    assert left(spark, rows, rare) == brute.aligned_lines(rows, rare, lines.patience)
