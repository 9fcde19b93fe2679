import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = "the a of and stone water river over under light Night green été niño Straße 日本 don't x1 , . !".split()


def prose(rng: random.Random, words: int) -> str:
    return "".join(rng.choice(VOCABULARY) + rng.choice([" ", " ", " ", "  ", "\n", "\t"]) for _ in range(words))


@pytest.fixture(scope="session")
def rows():
    """Documents with copies, near copies, shared passages and lines, junk and odd texts."""
    rng = random.Random(4)
    texts = [prose(rng, rng.randint(1, 160)) for _ in range(60)]
    texts += [texts[3], texts[3].replace(" ", "\n"), texts[7] + " \t", texts[7], texts[9]]
    for i in range(10, 18):  # near copies: one word changed
        words = texts[i].split(" ")
        words[len(words) // 2] = "changed"
        texts.append(" ".join(words))
    passage = prose(rng, 60)
    texts += [prose(rng, 30) + passage + prose(rng, 20) for _ in range(12)]
    texts += [passage + " " + passage, passage, "one two " * 90, "ab\n" * 12, "# * $ %" * 40]
    texts += ["", " \n\t", None, "word", "\x1c\x85  x", "<|endoftext|> a<|startoftext|>", "x" * 5000]
    texts += [prose(rng, 4000)]
    return [(i * 3 + 1, t, rng.choice(["en", "de", None]), "s", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def pairs(rows):
    return [(r[0], r[1]) for r in rows]
