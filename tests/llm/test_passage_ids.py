"""A null id beside id 0: both have key 0 and are told apart by their hash."""

from tidemark.llm import substring


def test_null_id_beside_zero(spark):
    run = " ".join(f"v{i}" for i in range(40))
    apart = " ".join(f"w{i}" for i in range(60))
    rows = [(None, f"{run} end"), (0, apart), (1, f"head {run}")]
    done = substring.without_passages(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: (r.n_words, r.n_removed) for r in done.collect()} == {None: (41, 40), 0: (60, 0), 1: (41, 40)}
