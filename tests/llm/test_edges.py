"""Null columns, odd texts, repeated rows, empty tables and clashing column names."""

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import (
    bpe,
    divergence,
    exact,
    language,
    lines,
    mixing,
    packing,
    quality_model,
    quality_rules,
    sharding,
    similar,
    simhash,
    substring,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}" for i in range(60_000))
SAME = " ".join(f"v{i}" for i in range(50))
ODD = [
    (5, None, None, None, None),
    (None, "a text without an id, of a few words", "en", "s", 1),
    (None, None, None, None, None),
    (7, "", "en", None, 0),
    (8, " \n\t ", None, "s", 4),
    (9, SAME, "en", "s", 3),
    (9, SAME, "en", "s", 3),
    (9, SAME + " other text under the same id", "en", "s", 3),
    (10, SAME, None, None, None),
    (11, LONG, "de", "s", len(LONG)),
    (12, "12345 !!! ???", "en", "s", 9),
]
CLASHES = [
    "doc", "tie", "rest", "spans", "places", "fp", "root", "component_id", "share", "digest", "content", "kept", "n_words",
    "n_removed", "kept_text", "n_lines", "slot", "shard", "ids", "length", "offset", "score", "_id", "_measures",
    "size", "source_size", "target", "taken", "term", "part", "item", "value", "rank", "n",
]

OPERATORS = {
    "language": (language.predictions, "doc_id held_out lang_pred score accepted"),
    "simhash": (simhash.near_duplicates, "doc_id fingerprint component_id"),
    "exact": (exact.content_groups, "doc_id keep_id group_size kept text_sha256"),
    "rules": (quality_rules.judged, None),
    "sharding": (sharding.assignments, "doc_id slot shard"),
    "lines": (lines.line_digests, "doc_id n_lines n_removed kept_sha256"),
    "model": (lambda d: quality_model.predictions(d, d.select("doc_id", F.lit(1).alias("quality"))), "doc_id held_out score predicted"),
    "substring": (substring.passage_digests, "doc_id n_words n_removed kept_sha256"),
    "packing": (packing.pack_documents, None),
    "bpe": (bpe.digests, "doc_id n_tokens ids_sha256 decoded_sha256"),
    "mixing": (mixing.mixture, "doc_id size source_size target taken"),
    "divergence": (divergence.audit, "lang source part item value rank"),
}


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def clashing(odd):
    return odd.select("*", *[F.lit(f"old {c}").alias(c) for c in CLASHES])


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows(odd, clashing, name):
    operator, columns = OPERATORS[name]
    got = operator(odd)
    if columns:
        assert got.columns == columns.split()
    rows = sorted(map(str, got.collect()))
    if name == "divergence":
        assert sorted(map(str, operator(clashing).select(got.columns).collect())) == rows
    elif name != "packing":
        assert len(rows) == len(ODD)
        assert sorted(map(str, operator(clashing).select(got.columns).collect())) == rows
    else:
        assert {r.doc_id for r in got.collect()} == {r[0] for r in ODD}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(spark, name):
    operator, columns = OPERATORS[name]
    got = operator(spark.createDataFrame([], SCHEMA))
    assert got.count() == 0 and (not columns or got.columns == columns.split())


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES])
def test_stages(spark, odd, clashing, stage):
    run = dict(corpus_pipeline.STAGES)[stage]
    assert run(spark, spark.createDataFrame([], SCHEMA), "").count() == 0
    plain, wide = run(spark, odd, ""), run(spark, clashing, "")
    if stage != "packing":
        assert plain.columns == odd.columns and wide.columns == clashing.columns
        assert dict(plain.dtypes) == dict(odd.dtypes)
        assert sorted(map(str, plain.collect())) == sorted(map(str, wide.select(odd.columns).collect()))
        kept = wide.select(*CLASHES).distinct().collect()
        assert all(r[c] == f"old {c}" for r in kept for c in CLASHES)


def test_defined_results_of_odd_rows(odd):
    groups = exact.content_groups(odd).collect()
    empty = [r for r in groups if r.text_sha256 == brute.sha("")]
    assert {(r.doc_id, r.keep_id, r.group_size) for r in empty} == {(d, 8, 4) for d in (5, None, 7, 8)}
    # Repeated rows: one of them stays, and ids stay distinct from their other texts.
    assert sum(r.kept for r in groups if r.text_sha256 == brute.sha(SAME.replace(" ", ""))) == 1
    left = exact.drop_copies(odd).collect()
    assert sorted(r.text for r in left if r.doc_id == 9) == [SAME, SAME + " other text under the same id"]
    assert not [r for r in left if r.doc_id == 10]
    cut = {(r.doc_id, r.n_words): r.n_removed for r in substring.passage_digests(odd).collect()}
    assert cut[9, 50] == 50 and cut[10, 50] == 50 and cut[9, 56] == 50
    assert cut[11, 60_000] == 60_000  # its words come in cycles
    for module in (simhash, similar):
        assert not [r for r in module.keep_first(odd).collect() if r.doc_id == 10]


def test_sharding_keeps_other_columns(odd):
    placed = sharding.placed(odd.withColumn("slot", F.lit("old")))
    assert placed.columns == [*odd.columns, "slot", "shard"] and placed.count() == len(ODD)
    assert placed.where("doc_id is null").select("shard").distinct().count() == 1


def test_hot_repeated_rows(spark, monkeypatch):
    """Rows equal in id and text are dealt over shares too, and one of them stays."""
    monkeypatch.setattr(exact, "SHARE_ROWS", 16)
    rows = [(None, SAME, "en", "s", 1)] * 900 + [(i, f"{SAME} {i}", "en", "s", 1) for i in range(50)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    groups = exact.content_groups(df, 16).collect()
    assert sum(r.kept for r in groups) == 51 and {r.group_size for r in groups if r.doc_id is None} == {900}
    left = exact.drop_copies(df, 16)
    assert left.count() == 51 and left.where("doc_id is null").count() == 1
    near = {r.doc_id: r.component_id for r in simhash.near_groups(df).collect()}
    assert near[None] is None or near[None] >= 0
