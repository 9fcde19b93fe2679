"""Quality rules as a ledger: every rule once, one failure bit each, policies afterwards.

``ledger`` reads each text once and stores measurements and one bit per failed rule. A policy
is a named, versioned set of bits; applying or changing one, and counting what each rule alone rejects, are
bitwise operations on the ledger and never read texts again.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tables import replaced, unused
from tidemark.llm.texts import slices, windows, words

REPEAT_WINDOW = 8
MIN_WORDS = 20

MEASURES = {
    "n_words": "long",
    "word_chars": "long",
    "n_symbols": "long",
    "n_lines": "long",
    "n_dup_lines": "long",
    "n_repeat_words": "long",
    "n_upper": "long",
    "n_lower": "long",
    "n_bang_words": "long",
}

# Rules by bit: what holds, given the measurements as columns, when a text fails.
RULES: dict[str, Callable[[Callable[[str], Column]], Column]] = {
    "few_words": lambda m: m("n_words") < MIN_WORDS,
    "repeated_windows": lambda m: 100 * m("n_repeat_words") > 30 * m("n_words"),
    "symbols": lambda m: 4 * m("n_symbols") > m("n_words"),
    "repeated_lines": lambda m: (m("n_lines") >= 4) & (2 * m("n_dup_lines") > m("n_lines")),
    "word_length": lambda m: (m("word_chars") < 2 * m("n_words")) | (m("word_chars") > 20 * m("n_words")),
    "capitals": lambda m: (m("n_upper") + m("n_lower") >= 50) & (m("n_upper") > m("n_lower")),
    "exclamations": lambda m: 2 * m("n_bang_words") > m("n_words"),
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_windows"]

# Policies by version: bits that reject.
POLICIES = {
    1: BASE,
    2: sum(BIT.values()),
}
CURRENT = 2

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """The measurements of every text of a column; a null text counts as empty."""
    w = words(column)
    n = len(w.first) - 1
    count = w.counts

    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[w.texts[1:]] - total[w.texts[:-1]]

    # Code points: bytes that don't continue a character, outside of white space.
    white = (w.raw == 0x20) | ((w.raw >= 0x09) & (w.raw <= 0x0D))
    points = per_text(((w.raw & 0xC0) != 0x80) & ~white)
    upper = per_text((w.raw >= 65) & (w.raw <= 90))
    lower = per_text((w.raw >= 97) & (w.raw <= 122))

    hashes = w.hashes(0)
    text_of, left = w.text_of(), w.left()
    # Windows that occur twice or more in their own text cover words.
    starts = np.flatnonzero(left >= REPEAT_WINDOW)
    run = windows(hashes, REPEAT_WINDOW)[starts]
    twice = repeated(text_of[starts], run)
    cover = np.zeros(len(hashes) + REPEAT_WINDOW, np.int64)
    np.add.at(cover, starts[twice], 1)
    cover[REPEAT_WINDOW:] -= cover[:-REPEAT_WINDOW].copy()
    covered = np.cumsum(cover[: len(hashes)]) > 0
    repeats = np.bincount(text_of[covered], minlength=n)

    lines, dups = _lines(w, n)
    bang = np.zeros(n, np.int64)
    if len(w.start):
        bang = np.bincount(text_of[w.raw[w.stop - 1] == 0x21], minlength=n)
    return {
        "n_words": count.astype(np.int64),
        "word_chars": points,
        "n_symbols": per_text(_SYMBOL[w.raw]),
        "n_lines": lines,
        "n_dup_lines": dups,
        "n_repeat_words": repeats.astype(np.int64),
        "n_upper": upper,
        "n_lower": lower,
        "n_bang_words": bang.astype(np.int64),
    }


def repeated(text_of: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """True where the same text has the same hash at another place too."""
    order = np.lexsort((hashes, text_of))
    t, h = text_of[order], hashes[order]
    same = (t[1:] == t[:-1]) & (h[1:] == h[:-1])
    out = np.zeros(len(hashes), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _lines(w, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Lines that hold a word, and those equal to an earlier one, of every text."""
    if not len(w.raw):
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    breaks = np.flatnonzero(w.raw == 10)
    start = np.unique(np.concatenate([w.texts[:-1], breaks + 1]))
    start = start[start < len(w.raw)]
    word_line = np.searchsorted(start, w.start, side="right") - 1
    used = np.unique(word_line)
    begin = start[used]
    text = np.searchsorted(w.texts, begin, side="right") - 1
    stop = np.minimum(np.concatenate([start[1:], [len(w.raw)]])[used], w.texts[text + 1])
    stop = stop - (w.raw[stop - 1] == 10)
    dup = np.zeros(n, np.int64)
    seen: set[tuple[int, bytes]] = set()
    raw = w.raw.tobytes()
    for t, a, b in zip(text.tolist(), begin.tolist(), stop.tolist()):
        key = (t, raw[a:b])
        if key in seen:
            dup[t] += 1
        else:
            seen.add(key)
    return np.bincount(text, minlength=n).astype(np.int64), dup


def failures(measurement: Callable[[str], Column] = F.col) -> Column:
    """Failure bits; ``measurement`` gives the column of a measurement."""
    bits = F.lit(0)
    for name, fails in RULES.items():
        bits = bits.bitwiseOR(F.when(fails(measurement), BIT[name]).otherwise(0))
    return bits.cast("long")


def _measured(docs: DataFrame, texts: bool) -> DataFrame:
    """``docs`` with its measurements as a last, struct column; ``text`` is dropped unless ``texts``."""
    carried = [f for f in docs.schema if texts or f.name != "text"]
    struct = pa.struct([(k, pa.int64()) for k in MEASURES])
    inner = ", ".join(f"{k}: {v}" for k, v in MEASURES.items())
    added = unused(docs, "_measures")
    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in carried]
    schema = ", ".join([*columns, f"`{added}` struct<{inner}>"])
    names = [f.name for f in carried]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = measure(part.column("text"))
                values = pa.StructArray.from_arrays([pa.array(found[k]) for k in MEASURES], fields=list(struct))
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(n) for n in names], values], [*names, added]
                )

    return docs.mapInArrow(run, schema)


def ledger(docs: DataFrame) -> DataFrame:
    """Measurements and ``failed`` (one bit per rule of ``RULES``) of every row.

    Null and empty texts have no words and fail ``few_words`` alone. Rows keep their
    ``doc_id``, repeated or null; no other input column is carried.
    """
    read = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return _measured(read, texts=False).select("doc_id", "_measures.*").withColumn("failed", failures())


def passes(policy: int = CURRENT) -> Column:
    """True on ledger rows that no rule of the policy rejects."""
    return F.col("failed").bitwiseAND(F.lit(POLICIES[policy])) == 0


def ablations(rows: DataFrame, policy: int = CURRENT) -> DataFrame:
    """Per rule of a policy: rows that fail it, and rows that only it rejects."""
    mask = F.col("failed").bitwiseAND(F.lit(POLICIES[policy]))
    counted = rows.groupBy(mask.alias("bits")).count()
    rules = [(n, b) for n, b in BIT.items() if POLICIES[policy] & b]
    sums = []
    for name, bit in rules:
        sums += [
            F.sum(F.when(F.col("bits").bitwiseAND(F.lit(bit)) != 0, F.col("count")).otherwise(0)).alias(f"{name}_any"),
            F.sum(F.when(F.col("bits") == bit, F.col("count")).otherwise(0)).alias(f"{name}_only"),
        ]
    row = counted.agg(*sums)
    return row.select(F.explode(F.array(*[
        F.struct(
            F.lit(n).alias("rule"),
            F.coalesce(F.col(f"{n}_any"), F.lit(0)).alias("failed"),
            F.coalesce(F.col(f"{n}_only"), F.lit(0)).alias("only"),
        )
        for n, _ in rules
    ])).alias("r")).select("r.*")


def judged(docs: DataFrame, policy: int = CURRENT) -> DataFrame:
    """Contract of the registered query: measurements, ``base_failed`` and ``kept`` per row."""
    rows = ledger(docs)
    base = F.col("failed").bitwiseAND(F.lit(BASE)) != 0
    return replaced(rows, base_failed=base, kept=~base & passes(policy)).select(
        "doc_id", *MEASURES, F.col("failed").alias("failed_rules"), "base_failed", "kept"
    )


def keep_good(docs: DataFrame, policy: int = CURRENT) -> DataFrame:
    """``docs`` without the rows that a policy or the base rules reject; columns unchanged."""
    rows = _measured(docs, texts=True)
    measured = rows.columns[-1]
    bits = failures(lambda name: F.col(f"`{measured}`")[name])
    good = bits.bitwiseAND(F.lit(POLICIES[policy] | BASE)) == 0
    return rows.where(good).drop(measured)


# The base columns and the verdict of policy 2, as SQL on the same table.
RULES_SQL = r"""
with words as (
  select doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), lines as (
  select doc_id, l, row_number() over (partition by doc_id, l) as nth
  from (select doc_id, unnest(string_split(text, chr(10))) as l from documents)
  where regexp_matches(l, '[^\x20\x09-\x0D]')
), line_counts as (
  select doc_id, count(*) as n_lines, count(*) filter (where nth > 1) as n_dup_lines from lines group by doc_id
), runs as (
  select doc_id, i, array_to_string(w[i:i + 7], ' ') as run
  from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from words where len(w) >= 8)
), twice as (
  select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, run) as n from runs) where n > 1
), covered as (
  select doc_id, count(distinct i + k) as n_repeat_words
  from twice, (select unnest(range(0, 8)) as k) group by doc_id
), m as (
  select doc_id, len(w) as n_words, coalesce(length(array_to_string(w, '')), 0) as word_chars,
         len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) as n_symbols,
         coalesce(n_lines, 0) as n_lines, coalesce(n_dup_lines, 0) as n_dup_lines,
         coalesce(n_repeat_words, 0) as n_repeat_words,
         len(regexp_extract_all(coalesce(text, ''), '[A-Z]')) as n_upper,
         len(regexp_extract_all(coalesce(text, ''), '[a-z]')) as n_lower,
         len(list_filter(w, lambda x: suffix(x, '!'))) as n_bang_words
  from words left join line_counts using (doc_id) left join covered using (doc_id)
), f as (
  select *,
    (case when n_words < 20 then 1 else 0 end)
    + (case when 100 * n_repeat_words > 30 * n_words then 2 else 0 end)
    + (case when 4 * n_symbols > n_words then 4 else 0 end)
    + (case when n_lines >= 4 and 2 * n_dup_lines > n_lines then 8 else 0 end)
    + (case when word_chars < 2 * n_words or word_chars > 20 * n_words then 16 else 0 end)
    + (case when n_upper + n_lower >= 50 and n_upper > n_lower then 32 else 0 end)
    + (case when 2 * n_bang_words > n_words then 64 else 0 end) as failed_rules
  from m
)
select doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_upper, n_lower,
       n_bang_words, failed_rules, (failed_rules & 3) <> 0 as base_failed, failed_rules = 0 as kept
from f
"""
