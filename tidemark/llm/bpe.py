"""BPE encoding and decoding by a distinct-word table.

White space never joins or changes the ids around it in tokenizers that drop it, so a text's ids
are the ids of its words in order. Words are split and counted in Spark; the
most frequent ones are encoded once for the whole corpus and sent to all tasks as
a table of bounded size. The other words, of which a corpus has ever more (four million
in 0.5 GB of the test tables), are encoded once per slice of texts. Ids are joined
back by the position of each word, and decoding is a join of ids with the table
of pieces, whose size is the vocabulary's.
"""

import hashlib
import json
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm.texts import slices, words
from tidemark.session import materialize

VOCABULARY = "word_bpe_49k.json"
TABLE_WORDS = 65_536  # words of the broadcast table
TABLE_CHARS = 64  # a longer word is never in it, which bounds its bytes
CACHE_WORDS = 300_000  # encoded words that a worker holds on to
SLICE = 8 << 20
# Letters whose lower case and composition depend on no neighbour, then marks.
LETTERS, MARKS = "[A-Za-zÀ-ÖØ-öø-ÿ]+", ".,!?;:"
PLAIN = f"^(?P<letters>{LETTERS})(?P<marks>[{MARKS}]*)$"
LINE_WORDS = 2_000

Table = dict[str, bytes]


def default_path() -> str:
    return public_tokenizers.path(VOCABULARY)


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    loaded = Tokenizer.from_file(path)
    loaded.no_truncation()
    loaded.no_padding()
    return loaded


@lru_cache(maxsize=2)
def pieces(path: str) -> pa.Array:
    """Piece of every id, in id order; null where an id is unused."""
    vocabulary = tokenizer(path).get_vocab(with_added_tokens=True)
    out: list[str | None] = [None] * (max(vocabulary.values()) + 1)
    for piece, number in vocabulary.items():
        out[number] = piece
    return pa.array(out, pa.string())


@lru_cache(maxsize=2)
def decimals(size: int) -> pa.Array:
    return pa.array(np.arange(size)).cast(pa.string())


def encode_words(path: str, distinct: list[str]) -> list[bytes]:
    """Ids of each word as little-endian 32-bit numbers.

    Words are encoded in lines, one space apart, and each id goes to the word in which it starts.
    """
    out: list[bytes] = []
    lines = [distinct[i : i + LINE_WORDS] for i in range(0, len(distinct), LINE_WORDS)]
    for line in lines:
        found = tokenizer(path).encode(" ".join(line), add_special_tokens=False)
        length = np.fromiter(map(len, line), np.int64, len(line)) + 1
        stop = np.cumsum(length)
        start = np.fromiter((a for a, _ in found.offsets), np.int64, len(found.ids))
        ids = np.array(found.ids, "<i4").tobytes()
        edge = (4 * np.searchsorted(start, np.concatenate([[0], stop]))).tolist()
        out += [ids[a:b] for a, b in zip(edge, edge[1:])]
    return out


@lru_cache(maxsize=2)
def closes(path: str) -> np.ndarray:
    """True for ids whose piece ends a run of letters, digits or marks."""
    suffix = json.loads(tokenizer(path).to_str())["model"].get("end_of_word_suffix")
    return np.array([bool(suffix) and p is not None and p.endswith(suffix) for p in pieces(path).to_pylist()])


def encode_runs(path: str, runs: list[str]) -> list[bytes]:
    """As ``encode_words`` for runs that the tokenizer does not split: the end of each shows in its ids."""
    lines = [" ".join(runs[i : i + LINE_WORDS]) for i in range(0, len(runs), LINE_WORDS)]
    found = tokenizer(path).encode_batch_fast(lines, add_special_tokens=False)
    ids = np.array([i for e in found for i in e.ids], "<i4")
    edge = 4 * (np.flatnonzero(closes(path)[ids]) + 1)
    if len(edge) != len(runs):
        return encode_words(path, runs)
    raw = ids.tobytes()
    return [raw[a:b] for a, b in zip([0, *edge[:-1].tolist()], edge.tolist())]


class Encoder:
    """Encodes slices of texts; keeps encoded words up to a bound.

    A plain word, of ASCII and Latin-1 letters with marks behind them, is the lower-case letters and
    the marks to the tokenizer: both are looked up apart, so a word costs nothing more
    when a comma follows it or a sentence starts with it. Other words are looked up whole.
    """

    def __init__(self, path: str, table: Table | None = None):
        self.path, self.table = path, table or {}
        self.known = {"": b""} | self.table

    def ids_of(self, units: list[str], encode: Callable[[str, list[str]], list[bytes]]) -> list[bytes]:
        known = self.known
        new = [x for x in units if x not in known]
        if len(known) + len(new) > CACHE_WORDS:
            known = self.known = {"": b""} | self.table
            new = [x for x in units if x not in known]
        known.update(zip(new, encode(self.path, new)))
        return [known[x] for x in units]

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the first id of each text (one more than texts)."""
        w = words(column)
        spans = np.concatenate([[0], np.cumsum(w.stop - w.start)])
        if not spans[-1]:
            return np.zeros(0, "<i4"), np.zeros(len(w.first), np.int64)
        chars = w.joined()
        flat = pa.LargeStringArray.from_buffers(len(w.start), pa.py_buffer(spans), pa.py_buffer(chars))
        coded = flat.dictionary_encode()
        code = np.asarray(coded.indices)
        found = pc.extract_regex(coded.dictionary, PLAIN)
        plain = np.asarray(found.is_valid())
        letters = pc.utf8_lower(found.field("letters").filter(pa.array(plain))).dictionary_encode()
        marks = found.field("marks").filter(pa.array(plain)).dictionary_encode()
        whole = coded.dictionary.filter(pa.array(~plain))
        # Units: letters and marks, then whole words; every distinct word is a pair of them.
        runs = [*letters.dictionary.to_pylist(), *marks.dictionary.to_pylist()]
        ids = self.ids_of(runs, encode_runs) + self.ids_of(whole.to_pylist(), encode_words) + [b""]
        pair = np.full((len(plain), 2), len(runs) + len(whole))
        pair[plain, 0] = np.asarray(letters.indices)
        pair[plain, 1] = np.asarray(marks.indices) + len(letters.dictionary)
        pair[~plain, 0] = np.arange(len(whole)) + len(runs)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        first = np.cumsum(size) - size
        flat_ids = np.frombuffer(b"".join(ids), "<i4")
        # Ids of the distinct words, one after the other, and from there those of all words.
        flat_ids, ends = _gather(flat_ids, first[pair.ravel()], size[pair.ravel()])
        ends = ends[::2]
        flat_ids, ends = _gather(flat_ids, ends[:-1][code], np.diff(ends)[code])
        return flat_ids, ends[w.first]


def _gather(values: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``values`` one after the other, and where each begins (one more than runs)."""
    ends = np.concatenate([[0], np.cumsum(size)])
    return values[np.repeat(first - ends[:-1], size) + np.arange(ends[-1])], ends


def word_table(docs: DataFrame, path: str, size: int = TABLE_WORDS) -> Table:
    """The frequent words of all texts with their ids, each encoded once.

    Words are counted as ``Encoder`` looks them up: plain ones in lower case without the marks behind them, others
    whole. A word is frequent if it makes up at least one in ``size`` of the counted words, so
    there are at most ``size`` of them, of at most ``TABLE_CHARS`` characters; what reaches the
    driver and the tasks has a bound that doesn't grow with the corpus, and nothing is sorted.
    """
    split = docs.select(F.explode(F.split(F.col("text").cast("string"), "[ \\t-\\r]+")).alias("raw"))
    plain = F.col("raw").rlike(f"^{LETTERS}[{MARKS}]*\\z")
    counted = materialize(
        split.where(F.char_length("raw").between(1, TABLE_CHARS))
        .select(F.when(plain, F.lower(F.rtrim("raw", F.lit(MARKS)))).otherwise(F.col("raw")).alias("word"))
        .groupBy("word").count()
        .where(F.col("count") > 1),
        "words",
    )
    total = counted.agg(F.sum("count")).first()[0] or 0
    frequent = counted.where(F.col("count") * size >= total).select("word")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("word")
            ids = encode_words(path, column.to_pylist())
            yield pa.RecordBatch.from_arrays([column, pa.array(ids, pa.binary())], ["word", "ids"])

    found = frequent.mapInArrow(run, "word string, ids binary").toArrow()
    return dict(zip(found.column("word").to_pylist(), found.column("ids").to_pylist()))


Emit = Callable[[pa.RecordBatch, np.ndarray, np.ndarray], pa.RecordBatch]


def map_encoded(
    docs: DataFrame, path: str, emit: Emit, schema: str, table: Broadcast | None = None
) -> DataFrame:
    """Encode ``docs(doc_id, text)`` slice by slice and pass (rows, ids, first ids) to ``emit``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, table.value if table else None)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                yield emit(part, *encoder(part.column("text")))

    read = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return read.mapInArrow(run, schema)


def shared_table(docs: DataFrame, path: str) -> Broadcast:
    return docs.sparkSession.sparkContext.broadcast(word_table(docs, path))


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id`` and ``ids`` of every row, as the tokenizer without special tokens gives them.

    Null and empty texts have no ids. Strings of special tokens inside a text become their ids.
    Repeated rows and null ids come back as often as they come in; other columns are not carried.
    """
    path = path or default_path()

    def emit(part, ids, first):
        lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids))
        return pa.RecordBatch.from_arrays([part.column("doc_id"), lists], ["doc_id", "ids"])

    return map_encoded(docs, path, emit, "doc_id long, ids array<int>", shared_table(docs, path))


def piece_table(spark: SparkSession, path: str | None = None) -> DataFrame:
    """``id`` and ``piece`` of the whole vocabulary."""
    listed = pieces(path or default_path())
    return spark.createDataFrame(
        pa.table({"id": pa.array(np.arange(len(listed)), pa.int32()), "piece": listed})
    ).where("piece is not null")


def decode_ids(path: str, ids: np.ndarray, first: np.ndarray) -> pa.Array:
    """Texts of consecutive runs of ids: each id joined with its piece, one space apart."""
    listed = pieces(path)
    inside = (ids >= 0) & (ids < len(listed))
    joined = listed.take(pa.array(np.where(inside, ids, 0)))
    known = inside & np.asarray(joined.is_valid())
    if not known.all():
        kept = np.concatenate([[0], np.cumsum(known)])
        joined, first = joined.filter(pa.array(known)), kept[first]
    lists = pa.LargeListArray.from_arrays(pa.array(first, pa.int64()), joined)
    return pc.binary_join(lists, " ")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id`` and ``text`` from ``doc_id`` and ``ids``; special tokens stay, unknown ids are left out.

    Null and empty lists give empty texts.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            count = np.asarray(ids.value_lengths().fill_null(0)).astype(np.int64)
            first = np.concatenate([[0], np.cumsum(count)])
            flat = np.asarray(ids.flatten().fill_null(-1))
            text = decode_ids(path, flat, first).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), text], ["doc_id", "text"])

    return encoded.select("doc_id", F.col("ids").cast("array<int>")).mapInArrow(
        run, "doc_id long, text string"
    )


def _digest(texts: pa.Array) -> pa.Array:
    return pa.array([hashlib.sha256(t).hexdigest() for t in texts.cast(pa.large_binary()).to_pylist()], pa.string())


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Contract of the registered query: token counts and digests of ids and of the decoded text."""
    path = path or default_path()

    def emit(part, ids, first):
        numbers = decimals(len(pieces(path))).take(pa.array(ids))
        lists = pa.LargeListArray.from_arrays(pa.array(first, pa.int64()), numbers)
        written = pc.binary_join(lists, " ")
        return pa.RecordBatch.from_arrays(
            [
                part.column("doc_id"),
                pa.array(np.diff(first)),
                _digest(written),
                _digest(decode_ids(path, ids, first)),
            ],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_encoded(docs, path, emit, schema, shared_table(docs, path))
