"""Each operator against a plain version of it."""

import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import (
    bpe,
    exact,
    language,
    lines,
    packing,
    quality_model,
    quality_rules,
    sharding,
    simhash,
    substring,
    texts,
)
from tidemark.llm.tables import components


def as_set(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_words_are_runs_between_spaces(pairs):
    w = texts.words(pa.array([t for _, t in pairs]))
    got = [[bytes(w.raw[a:b]).decode() for a, b in zip(w.start[i:j], w.stop[i:j])] for i, j in zip(w.first, w.first[1:])]
    assert got == [brute.WORD.findall(t or "") for _, t in pairs]
    flat = [x for g in got for x in g]
    assert len({(x, int(h)) for x, h in zip(flat, w.hashes())}) == len(set(flat)) == len(set(w.hashes().tolist()))


@pytest.mark.parametrize("seed", [0, 1])
def test_hashes_of_very_long_words(seed):
    a, b, c = "a" * 4096, "b" * 4096, "c" * 100
    drawn = [a + b, b + a, a + b + c, b + a + c, c + a + b, a + a, a, b, a + a + b, a + b + a, b + a + a]
    assert len(set(texts.words(pa.array(drawn)).hashes(seed).tolist())) == len(drawn)


def test_very_long_words_are_told_apart(spark):
    a, b = "a" * 4096, "b" * 4096
    filler = [f"w{i}" for i in range(40)]
    one = " ".join([*filler[:7], a + b, *filler[:7], b + a])
    rows = [(1, one), (2, " ".join([*filler[:34], a + b])), (3, " ".join([*filler[:34], b + a]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in quality_rules.judged(df).collect()}
    assert got[1].n_repeat_words == brute.measures(one)["n_repeat_words"] == 0
    assert {r.n_removed for r in substring.passage_digests(df).collect()} == {0}


@pytest.mark.parametrize("width", [1, 2, 7, 15, 35])
def test_windows_tell_sequences_apart(width):
    values = np.random.default_rng(1).integers(0, 3, 3000).astype(np.uint64)
    runs = {}
    for i, h in enumerate(texts.windows(values, width).tolist()):
        runs.setdefault(tuple(values[i : i + width].tolist()), set()).add(h)
    assert all(len(v) == 1 for v in runs.values())
    assert len({next(iter(v)) for v in runs.values()}) == len(runs)


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 400)]
    edges += [(rng.randint(500, 800), rng.randint(500, 800)) for _ in range(200)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}


def test_near_groups(docs, pairs):
    assert as_set(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == sorted(
        brute.near_groups(pairs), key=str
    )


@pytest.mark.parametrize(("blocks", "home_rows"), [(3, 2048), (2, 2048), (3, 3)])
def test_every_link_is_found(spark, monkeypatch, blocks, home_rows):
    """Both codes, and anchors so crowded that they are split."""
    monkeypatch.setattr(simhash, "HOME_ROWS", home_rows)
    rng = random.Random(blocks)
    values = set()
    for _ in range(40):
        centre = rng.getrandbits(64)
        for _ in range(12):
            v = centre
            for b in rng.sample(range(64), rng.randint(0, 7)):
                v ^= 1 << b
            values.add(v)
    values = sorted(values)
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= 4:
                parent[find(i)] = find(j)
    want = {}
    for i, v in enumerate(values):
        want.setdefault(find(i), set()).add(v)
    signed = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    roots = {r.node % (1 << 64): r.root for r in components(simhash.links(signed, 4, blocks)).collect()}
    got = {}
    for v in values:
        got.setdefault(roots.get(v, f"own {v}"), set()).add(v)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_dense_links_become_a_forest():
    values = np.arange(300, dtype=np.uint64)
    a, b = np.meshgrid(values, values)
    x, y = simhash.forest(a[a < b], b[a < b])
    assert len(x) == 299 and set(y.tolist()) == {0}


@pytest.mark.parametrize("share_rows", [256, 1])
def test_content_groups(docs, pairs, share_rows):
    got = exact.content_groups(docs, share_rows)
    assert as_set(got, "doc_id", "keep_id", "group_size", "text_sha256") == sorted(brute.content_groups(pairs), key=str)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got.collect())


def test_rules(docs, pairs):
    got = {r.doc_id: r for r in quality_rules.judged(docs).collect()}
    for d, t in pairs:
        want, row = brute.measures(t), got[d]
        assert {k: row[k] for k in want} == want, d
        failed = want["n_words"] < 20 or 100 * want["n_repeat_words"] > 30 * want["n_words"]
        assert row.base_failed == failed and not (failed and row.kept)


def test_policies_and_ablations(docs):
    rows = quality_rules.ledger(docs).cache()
    first = rows.where(quality_rules.passes(1)).count()
    assert rows.where(quality_rules.passes(2)).count() <= first
    failed = [r.failed for r in rows.collect()]
    for r in quality_rules.ablations(rows, 2).collect():
        bit = quality_rules.BIT[r.rule]
        assert (r.failed, r.only) == (sum(f & bit > 0 for f in failed), sum(f == bit for f in failed))


def test_lookup_table():
    shards = [f"s{i}" for i in range(7)]
    table = sharding.lookup_table(shards, 101)
    assert max(table.count(k) for k in range(7)) - min(table.count(k) for k in range(7)) <= 1
    # Turn by turn, as a literal reading of the method.
    import hashlib

    order = []
    for s in shards:
        d = hashlib.md5(s.encode()).digest()
        at, step = int.from_bytes(d[:8], "big") % 101, int.from_bytes(d[8:], "big") % 100 + 1
        order.append([(at + j * step) % 101 for j in range(101)])
    want = {}
    while len(want) < 101:
        for k in range(7):
            free = next((s for s in order[k] if s not in want), None)
            if free is not None:
                want[free] = k
    assert table == [want[s] for s in range(101)]
    fewer = shards[:-1]
    moved = sharding.moved(table, sharding.lookup_table(fewer, 101), shards, fewer)
    assert 1 / 7 - 0.02 <= moved < 0.4
    with pytest.raises(ValueError):
        sharding.lookup_table(shards, 100)


def test_placement(docs):
    import hashlib

    table = sharding.lookup_table()
    for r in sharding.assignments(docs).collect():
        slot = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16) % sharding.SLOTS
        assert (r.slot, r.shard) == (slot, sharding.SHARDS[table[slot]])


def test_shards_are_written_apart(spark, docs, tmp_path):
    names = ["a", "b", "c"]
    sharding.write_shards(docs, str(tmp_path / "out"), names, 101)
    back = spark.read.parquet(str(tmp_path / "out"))
    want = {(r.doc_id, r.shard) for r in sharding.placed(docs, names, 101).collect()}
    assert {(r.doc_id, r.shard) for r in back.collect()} == want and back.count() == docs.count()


@pytest.mark.parametrize("rare", [64, 2])
def test_lines(docs, pairs, rare):
    got = {r.doc_id: r for r in lines.without_lines(docs, rare).collect()}
    left = brute.aligned_lines([p for p in pairs if p[1] is not None], rare, lines.patience)
    for d, t in pairs:
        each = [] if t is None else t.split("\n")
        assert got[d].n_lines == len(each)
        assert got[d].n_removed == len(each) - len(left.get(d, [])), d
        assert got[d].kept_text == (None if t is None else "\n".join(left[d]) if got[d].n_removed else t)


def test_patience_alignment():
    assert lines.patience([1, 2, 3, 4], [1, 2, 3, 4]) == [(i, i) for i in range(4)]
    assert lines.patience([], [1]) == []
    rng = random.Random(5)
    for _ in range(200):
        a = [rng.randint(0, 8) for _ in range(rng.randint(0, 14))]
        b = [rng.randint(0, 8) for _ in range(rng.randint(0, 14))]
        found = lines.patience(a, b)
        assert all(a[i] == b[j] for i, j in found)
        assert all(p < q and r < s for (p, r), (q, s) in zip(found, found[1:]))


@pytest.mark.parametrize("width", [35, 5, 1])
def test_passages(docs, pairs, width):
    done = substring.without_passages(docs, width)
    want = [(d, len(w), len(w) - len(k), " ".join(k)) for d, w, k in brute.passages(pairs, width)]
    assert as_set(done, "doc_id", "n_words", "n_removed", "kept_text") == sorted(want, key=str)


def test_passages_in_small_batches(docs, pairs, monkeypatch):
    """Settled in many batches, as a large partition would be."""
    spark = docs.sparkSession
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        done = as_set(substring.passage_digests(docs), "doc_id", "n_words", "n_removed", "kept_sha256")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = [(d, len(w), len(w) - len(k), brute.sha(" ".join(k))) for d, w, k in brute.passages(pairs, 35)]
    assert done == sorted(want, key=str)


@pytest.mark.parametrize("period", sorted(substring.COVERS))
def test_difference_covers(period):
    cover = substring.COVERS[period]
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))


@pytest.mark.parametrize("capacity", [2048, 64])
def test_packing(docs, pairs, capacity):
    got = packing.pack_documents(docs, capacity=capacity).collect()
    want = brute.pieces(pairs, bpe.tokenizer(bpe.default_path()), capacity)
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    used = brute.check_packing(got, capacity)
    assert used <= -(-sum(r.length for r in got) // capacity) + 2


def test_plan_uses_every_piece_once():
    rng = random.Random(1)
    counts = {rng.randint(1, 2048): rng.randint(1, 400) for _ in range(300)}
    used = {}
    patterns = packing.plan(counts)
    for copies, fill in patterns:
        assert sum(fill) <= 2048
        for length in fill:
            used[length] = used.get(length, 0) + copies
    assert used == counts
    total = sum(k * v for k, v in counts.items())
    assert sum(c for c, _ in patterns) <= 1.05 * total / 2048


def test_two_pieces_replace_the_smallest():
    # 60 + 30 leaves 10 of 100; 20 + 19 in the place of 30 leaves 1.
    assert packing.plan({60: 1, 30: 1, 20: 1, 19: 1}, 100)[0] == (1, [60, 20, 19])


def test_encoding_and_decoding(docs, pairs):
    tokenizer = bpe.tokenizer(bpe.default_path())
    encoded = bpe.encode(docs).cache()
    got = {r.doc_id: r.ids for r in encoded.collect()}
    assert got == {d: tokenizer.encode(t or "", add_special_tokens=False).ids for d, t in pairs}
    back = {r.doc_id: r.text for r in bpe.decode(encoded).collect()}
    assert back == {d: tokenizer.decode(ids, skip_special_tokens=False) for d, ids in got.items()}
    rows = {r.doc_id: r for r in bpe.digests(docs).collect()}
    for d, ids in got.items():
        assert rows[d].n_tokens == len(ids)
        assert rows[d].ids_sha256 == brute.sha(" ".join(map(str, ids)))
        assert rows[d].decoded_sha256 == brute.sha(back[d])


def test_piece_table_decodes_by_a_join(spark, docs):
    encoded = bpe.encode(docs)
    each = encoded.select("doc_id", F.posexplode("ids").alias("at", "id"))
    joined = each.join(F.broadcast(bpe.piece_table(spark)), "id").groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("p")
    )
    got = {r.doc_id: " ".join(p.piece for p in r.p) for r in joined.collect()}
    assert got == {r.doc_id: r.text for r in bpe.decode(encoded).where("text <> ''").collect()}


def test_encoding_of_odd_characters():
    path = bpe.default_path()
    tokenizer = bpe.tokenizer(path)
    rng = random.Random(6)
    parts = ["a", "B", "é", "e", "́", "'s", "'", "1", "٣", " ", "  ", "\n", "\x0b", " ", " ", "\x1c",
             "\x85", "<|endoftext|>", "<|", "|>", "日", "İ", "Σ", "ﬁ", ".", "!", "_", "ᄒ", "ᅡ", "😀", "‍", "\x00"]
    drawn = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    ids, first = bpe.Encoder(path)(pa.array(drawn))
    for t, a, b in zip(drawn, first, first[1:]):
        assert ids[a:b].tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_cache_and_table_change_nothing(monkeypatch, pairs):
    path = bpe.default_path()
    column = pa.array([t for _, t in pairs])
    plain = bpe.Encoder(path)(column)
    monkeypatch.setattr(bpe, "CACHE_WORDS", 5)
    small = bpe.Encoder(path, {"the": bpe.encode_words(path, ["the"])[0]})
    for _ in range(2):
        again = small(column)
        assert np.array_equal(plain[0], again[0]) and np.array_equal(plain[1], again[1])


def test_table_holds_words_as_they_are_looked_up(spark):
    """Every entry of the table is hit: no word of it is encoded again."""
    path = bpe.default_path()
    texts = ["Over, over OVER; the well-known É. É, Well-known", "over! é the the well-known well-known , ,", None, ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    table = bpe.word_table(docs, path)
    assert set(table) == {"over", "the", "é", "well-known", ","}
    encoder = bpe.Encoder(path, table)
    encoder(pa.array(texts))
    assert set(encoder.known) - set(table) == {"", ",", ";", "!", ".", "Well-known"} - set(table)
    assert all(encoder.known[w] == bpe.encode_words(path, [w])[0] for w in table)


def test_languages_are_learned(spark):
    rng = random.Random(8)
    stems = {"aa": ["tion", "the", "ing", "ent"], "bb": ["ung", "sch", "ein", "keit"], "cc": ["ñar", "ción", "los", "que"]}
    rows = [
        (i, " ".join("".join(rng.choice(stems[lang]) for _ in range(rng.randint(1, 3))) for _ in range(30)), lang)
        for i in range(600) for lang in [rng.choice("abc") * 2]
    ]
    rows += [(9001, None, "aa"), (9002, "123 !?", "bb"), (9003, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.predictions(df).collect()}
    import zlib

    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in got.items())
    held = [(got[d].lang_pred, lang) for d, _, lang in rows[:600] if got[d].held_out]
    assert sum(a == b for a, b in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in got.values())
    for d in (9001, 9002, 9003):
        assert (got[d].lang_pred, got[d].score, got[d].accepted) == ("und", 0.0, False)


def test_sums_of_subwords_do_not_cross_texts():
    model = language.Model(["a", "b"], np.random.default_rng(2).normal(size=(language.BUCKETS, 2)).astype(np.float32), np.zeros(2))
    drawn = ["abc def", "x", "", "über alles", "abc"]
    together = model.logits(*language.spaced(pa.array(drawn)))
    apart = np.concatenate([model.logits(*language.spaced(pa.array([t]))) for t in drawn])
    assert np.allclose(together, apart)


def test_additive_model_learns_interactions():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6000, len(quality_model.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0)).astype(int)
    model = quality_model.train(x[:4000], y[:4000])
    assert (0, 3) in model.pairs or (3, 0) in model.pairs
    right = (model.scores(x[4000:]) > 0.5) == y[4000:]
    assert right.mean() > 0.9
    assert quality_model.train(x[:0], y[:0]).scores(x[:2]).tolist() == [0.5, 0.5]


def test_quality_of_held_out_rows(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(600):
        good = rng.random() < 0.7
        text = " ".join(rng.choice("alpha beta gamma delta eps zeta".split()) for _ in range(80)) if good else "BUY!! NOW!! " * 30
        rows.append((i, text))
        labels.append((i, int(good), 0))
    rows += [(9001, None), (9002, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (9001, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_model.predictions(df, marks).collect()}
    assert len(got) == 602 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    held = [(got[i].predicted, q) for i, q, _ in labels if got[i].held_out]
    assert held and all(p == q for p, q in held)


def test_language_scores_match_a_plain_scorer(spark, docs, pairs):
    model = language.train(language.sample(docs, F.lit(True)))
    got = {r.doc_id: r for r in language.identified(docs, model).collect()}
    checked = 0
    for d, t in pairs:
        if not t or not any(c.isalpha() for c in t) or not t.replace("\u0130", "").isascii() and len(t) > 3000:
            continue
        best, score = brute.language(model, t.lower())
        assert abs(got[d].score - score) < 1e-5, d
        assert got[d].best == best or abs(score - 0.5) < 1e-5, d
        checked += 1
    assert checked > 60


def test_quality_scores_match_a_plain_scorer(spark, docs, pairs):
    labels = docs.select("doc_id", (F.length("text") % 3 > 0).cast("int").alias("quality"))
    x, y = quality_model.sample(docs, labels, F.lit(True))
    model = quality_model.train(x, y)
    assert model.pairs
    got = {r.doc_id: r.score for r in quality_model.scored(docs, model).collect()}
    for d, t in pairs:
        assert np.allclose(quality_model.features(pa.array([t], pa.string()))[0], brute.quality_features(t)), d
        assert abs(got[d] - brute.quality(model, t)) < 1e-9, d
