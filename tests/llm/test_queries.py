"""Registered queries: against SQL where there is one, the pipeline against a plain one."""

import brute
import compare
import pytest

import corpus_pipeline
from tidemark.llm import bpe, queries, quality_rules, similar

CHECKS = queries.checks()


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_matches_sql(spark, small, name):
    con = compare.connect(small)
    assert compare.difference(queries.queries()[name](spark, small), con, CHECKS[name]) is None


def test_names():
    assert sorted(queries.queries()) == sorted(
        ["op1_language", "op2_simhash", "op3_exact", "op4_quality_rules", "op5_sharding", "op6_lines",
         "op7_quality_model", "op8_substring", "op9_packing", "op10_bpe", "op11_mixing", "op12_negatives",
         "op13_divergence", "pipeline"]
    )
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_pipeline_matches_plain_version(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    judged = quality_rules.judged(spark.createDataFrame(rows, "doc_id long, text string"))
    good = {r.doc_id for r in judged.where("kept").collect()}
    rows = [r for r in rows if r[0] in good]
    keep = {d: k for d, k, _, _ in brute.content_groups(rows)}
    rows = [r for r in rows if keep[r[0]] == r[0]]
    near = similar.near_groups(spark.createDataFrame(rows, "doc_id long, text string"))  # compared in test_similar
    first = {r.doc_id: r.component_id for r in near.collect()}
    rows = [r for r in rows if first[r[0]] == r[0]]
    assert 0 < len(rows) < len(good)
    texts = dict(rows)
    cut = [(d, " ".join(k) if len(k) < len(w) else texts[d]) for d, w, k in brute.passages(rows, 35)]
    want = brute.pieces(cut, bpe.tokenizer(bpe.default_path()), 2048)
    got = corpus_pipeline.run(spark, small).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    brute.check_packing(got, 2048)
