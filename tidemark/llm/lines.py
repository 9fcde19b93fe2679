"""Line deduplication by pairwise alignment of overlapping documents.

Documents that hold one rare line (in at most ``RARE`` documents) overlap; ordered by id, each
is paired with every holder before it, at most ``RARE - 1`` for each of its lines. A pair
carries all lines that both documents hold. Patience diff aligns these: lines unique on both sides
anchor the longest run of anchors in equal order, and the gaps between anchors are aligned in
the same way. Lines aligned in any pair are deleted from the later document; a line that stands
in another order than in each earlier one stays.

Lines in more than ``RARE`` documents are too common to show an overlap, and go only where they
are aligned. Two kinds of pairs are found without a rare line: copies of one text, which lose
all lines, and documents of which over half of the lines are common ones with one first holder; these
are paired with it.
"""

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.texts import slices
from tidemark.session import materialize, sized

RARE = 64
IDS = ["doc", "tie"]
COPY_SHARES = 32
WHOLE = -1  # in place of line numbers: all lines with a word
WORD = re.compile(r"[^ \t-\r]")


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places of two sequences, increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        anchors = _increasing(_unique(a, a0, a1, b, b0, b1))
        if not anchors:
            continue
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        out += anchors
        todo += [(p + 1, q, r + 1, s) for (p, r), (q, s) in zip(edges, edges[1:]) if p + 1 < q and r + 1 < s]
    return sorted(out)


def _unique(a, a0, a1, b, b0, b1) -> list[tuple[int, int]]:
    """Places of values that occur once in either range, by place in ``a``."""
    def once(values, lo, hi):
        at: dict[int, int] = {}
        for i in range(lo, hi):
            at[values[i]] = -1 if values[i] in at else i
        return at

    right = once(b, b0, b1)
    return [(i, right[v]) for v, i in once(a, a0, a1).items() if i >= 0 and right.get(v, -1) >= 0]


def _increasing(places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of ``places`` that increases on the right, by patience sorting."""
    tops: list[int] = []
    last: list[int] = []
    before: list[int] = []
    for n, (_, j) in enumerate(places):
        pile = bisect_left(tops, j)
        before.append(last[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(j)
            last.append(n)
        else:
            tops[pile], last[pile] = j, n
    out, n = [], last[-1] if last else -1
    while n >= 0:
        out.append(places[n])
        n = before[n]
    return out[::-1]


def _aligned(pairs: DataFrame) -> DataFrame:
    """Line numbers of the later document that are aligned: ids and ``gone``."""
    schema = "doc long, tie long, gone array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = []
            for links in batch.column("links").to_pylist():
                earlier = sorted((i, k) for k, link in enumerate(links) for i in link["theirs"])
                later = sorted((i, k) for k, link in enumerate(links) for i in link["own"])
                found = patience([k for _, k in earlier], [k for _, k in later])
                gone.append([later[j][0] for _, j in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("tie"), pa.array(gone, pa.list_(pa.int32()))],
                ["doc", "tie", "gone"],
            )

    return pairs.select(*IDS, "links").mapInArrow(run, schema)


def _copies(keyed: DataFrame) -> DataFrame:
    """Ids of the documents whose text an earlier document has in full."""
    text = F.col("text")
    hashed = keyed.where(text.isNotNull()).select(
        *IDS, F.xxhash64(F.lit(1), text).alias("more"), F.char_length(text).alias("n_points")
    )
    same = ["tie", "more", "n_points"]
    # A group may hold a third of all texts: its rows are dealt over shares.
    groups = (
        hashed.groupBy(*same).agg(F.min("doc").alias("lead"), F.max("doc").alias("last")).where("lead < last")
        .withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(COPY_SHARES - 1))))
    )
    shared = hashed.withColumn("share", F.pmod(F.xxhash64("doc"), F.lit(COPY_SHARES)).cast("int"))
    return shared.join(groups, [*same, "share"]).where(F.col("doc") > F.col("lead")).select(*IDS).distinct()


def _rare_links(holders: DataFrame, line: list[str]) -> DataFrame:
    """Places of every rare line in each of its documents and in each earlier one, ``before``."""
    listed = (
        holders.groupBy(*line).agg(F.array_sort(F.collect_list(F.struct(*IDS, "own"))).alias("every"))
        .where(F.size("every") > 1)
    )
    return (
        listed.select("every", F.posexplode("every").alias("nth", "later"))
        .where("nth > 0")
        .select("later", F.explode(F.slice("every", F.lit(1), F.col("nth"))).alias("earlier"))
        .select(
            *[F.col("later")[i].alias(i) for i in IDS],
            F.struct(*[F.col("earlier")[i].alias(i) for i in IDS]).alias("before"),
            F.col("later")["own"].alias("own"), F.col("earlier")["own"].alias("theirs"),
        )
    )


def _common_links(pairs: DataFrame, later: DataFrame, earlier: DataFrame, line: list[str]) -> DataFrame:
    """Places of the common lines that both documents of a pair hold."""
    theirs = earlier.select(F.struct(*IDS).alias("before"), *line, F.col("own").alias("theirs"))
    return (
        pairs.join(later.select(*IDS, *line, "own"), IDS)
        .join(theirs, ["before", *line])
        .select(*IDS, "before", "own", "theirs")
    )


def without_lines(docs: DataFrame, rare: int = RARE) -> DataFrame:
    """``docs`` without the lines that an earlier document has too.

    Adds ``n_lines`` (all lines, blank ones included), ``n_removed`` and ``kept_text``, the other lines
    joined by a line break. Documents are ordered by ``doc_id``, nulls as zero, then by the hash of
    their text; rows equal in both are one document and come out alike. Lines without a word
    are never removed, and no line for a repetition within its own document. Null
    texts have no lines and stay null; empty texts have one blank line. Other columns
    are carried; those of the names above are replaced.
    """
    keyed = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc"),
        F.xxhash64(F.col("text").cast("string")).alias("tie"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("rest"),
        F.col("text").cast("string").alias("text"),
    )
    each = (
        keyed.select(*IDS, F.posexplode(F.split("text", "\n")).alias("at", "line"))
        .where(F.col("line").rlike(WORD.pattern))
        .select(*IDS, "at", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g"))
    )
    line = ["h", "g"]
    copies = materialize(_copies(keyed), "copies")
    each = each.join(sized(copies), IDS, "left_anti")
    holders = materialize(each.groupBy(*line, *IDS).agg(F.array_sort(F.collect_set("at")).alias("own")), "holders")
    counted = (
        holders.groupBy(*line)
        .agg(F.count("*").alias("n"), F.min(F.struct(*IDS)).alias("lead"))
        .where(F.col("n") > rare)
    )
    # Common lines are few; joined by counted size, their holders need not meet in one task.
    known = sized(materialize(counted, "common").select(*line, "lead"))
    held = materialize(holders.join(known, line), "held")
    by_rare = materialize(_rare_links(holders.join(known, line, "left_anti"), line), "links")
    found = by_rare.select(*IDS, "before").distinct()
    leading = (
        held.where(F.struct(*IDS) != F.col("lead"))
        .groupBy(*IDS, F.col("lead").alias("before")).agg(F.count("*").alias("n"))
        .join(holders.groupBy(*IDS).agg(F.count("*").alias("total")), IDS)
        .where(2 * F.col("n") > F.col("total"))
        .select(*IDS, "before")
        .join(found, [*IDS, "before"], "left_anti")
    )
    # A first holder may lead very many documents; its own lines are few and need no shuffle.
    leads = held.join(sized(held.select(F.col("lead.*")).distinct()), IDS, "left_semi")
    leads = sized(materialize(leads, "leads").select(*IDS, *line, "own"))
    links = (
        by_rare.unionByName(_common_links(found, held, held, line))
        .unionByName(_common_links(leading, held, leads, line))
    )
    pairs = links.groupBy(*IDS, "before").agg(F.collect_list(F.struct("own", "theirs")).alias("links"))
    whole = copies.select(*IDS, F.array(F.lit(WHOLE)).alias("gone"))
    gone = (
        _aligned(pairs).unionByName(whole)
        .groupBy(*IDS).agg(F.flatten(F.collect_list("gone")).alias("gone"))
    )
    joined = keyed.join(gone, IDS, "left").select("rest", "text", "gone")
    rest = joined.schema["rest"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                kept, count, removed = [], [], []
                for text, cut in zip(part.column("text").to_pylist(), part.column("gone").to_pylist()):
                    lines = [] if text is None else text.split("\n")
                    out = set(cut or ())
                    if WHOLE in out:
                        out = {i for i, x in enumerate(lines) if WORD.search(x)}
                    count.append(len(lines))
                    removed.append(len(out))
                    kept.append("\n".join(x for i, x in enumerate(lines) if i not in out) if out else text)
                yield pa.RecordBatch.from_arrays(
                    [part.column("rest"), pa.array(count, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                    ["rest", "n_lines", "n_removed", "kept_text"],
                )

    done = joined.mapInArrow(run, f"rest {rest}, n_lines long, n_removed long, kept_text string")
    taken = ("n_lines", "n_removed", "kept_text")
    carried = [F.col("rest")[c].alias(c) for c in docs.columns if c != "text" and c.lower() not in taken]
    return done.select(*carried, *taken)


def line_digests(docs: DataFrame) -> DataFrame:
    """Registered query: lines removed from every document and the digest of the rest."""
    done = without_lines(docs.select("doc_id", "text"))
    return done.select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256")
    )
