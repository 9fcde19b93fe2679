"""Plain single-process versions of the operators, to compare with."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = re.compile(r"[\x20\x09-\x0D]")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def fingerprint(text: str | None) -> int:
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(lowered)
    if not words:
        return 0
    shingles = [words[i : i + 4] for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(" ".join(s).encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_groups(rows: list[tuple]) -> list[tuple]:
    """(doc_id, fingerprint, component_id) of (doc_id, text) rows."""
    prints = [fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                parent[find(i)] = find(j)
    low: dict[int, int | None] = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        known = [x for x in (low.get(r), d) if x is not None]
        low[r] = min(known) if known else None
    return [(d, f"{p:016x}", low[find(i)]) for i, ((d, _), p) in enumerate(zip(rows, prints))]


def content_groups(rows: list[tuple]) -> list[tuple]:
    """(doc_id, keep_id, group_size, text_sha256)."""
    groups = defaultdict(list)
    for d, t in rows:
        groups[SPACE.sub("", t or "")].append((-len(t or ""), d is None, d))
    return [
        (d, min(groups[k])[2], len(groups[k]), sha(k))
        for d, t in rows
        for k in [SPACE.sub("", t or "")]
    ]


def measures(text: str | None) -> dict:
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    runs = defaultdict(list)
    for i in range(len(words) - 7):
        runs[tuple(words[i : i + 8])].append(i)
    covered = {i + k for at in runs.values() if len(at) > 1 for i in at for k in range(8)}
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
    }


def passages(rows: list[tuple], width: int) -> list[tuple]:
    """(doc_id, words, kept words) of every row."""
    split = [WORD.findall(t or "") for _, t in rows]
    starts = defaultdict(int)
    for w in split:
        for i in range(len(w) - width + 1):
            starts[tuple(w[i : i + width])] += 1
    out = []
    for (d, _), w in zip(rows, split):
        cut = set()
        for i in range(len(w) - width + 1):
            if starts[tuple(w[i : i + width])] > 1:
                cut.update(range(i, i + width))
        out.append((d, w, [x for i, x in enumerate(w) if i not in cut]))
    return out


def pieces(rows: list[tuple], tokenizer, capacity: int) -> list[tuple]:
    """(doc_id, piece, start, length, crc) of every piece."""
    out = []
    for d, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        for n, a in enumerate(range(0, len(ids), capacity)):
            part = ids[a : a + capacity]
            crc = zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))
            out.append((d, n, a, len(part), crc))
    return out


def check_packing(rows, capacity: int) -> int:
    """Assert that sequences are gapless and within capacity; their number."""
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def aligned_lines(rows: list[tuple], rare: int, patience) -> dict[int, list[str]]:
    """Lines left of each document after every overlapping pair is aligned; ids must be distinct."""
    split = {d: t.split("\n") for d, t in sorted(rows)}
    first = {}
    for d, each in split.items():
        first.setdefault(tuple(each), d)
    lead, count = {}, Counter()
    for d in first.values():
        count.update(set(split[d]))
        for line in split[d]:
            lead.setdefault(line, d)
    left = {}
    for b, later in split.items():
        gone = set()
        worded = {x for x in later if WORD.search(x)}
        led = Counter(lead[x] for x in worded if count[x] > rare)
        for a in first.values():
            both = {*split[a]} & worded
            if a >= b or not (any(count[x] <= rare for x in both) or 2 * led[a] > len(worded) or split[a] == later):
                continue
            here, there = ([j for j, x in enumerate(split[d]) if x in both] for d in (b, a))
            gone.update(here[j] for _, j in patience([split[a][i] for i in there], [later[j] for j in here]))
        left[b] = [x for j, x in enumerate(later) if j not in gone]
    return left


def language(model, text: str) -> tuple[str, float]:
    """Best language of one lower-case text, by a mean over its subwords, one after the other."""
    raw = f" {text} ".encode()
    chars = [b if b > 127 or 97 <= b <= 122 else 32 for b in raw]
    total, n = [0.0] * len(model.languages), 0
    for size in (2, 3, 4):
        for i in range(len(chars) - size + 1):
            part = chars[i : i + size]
            if part == [32, 32] or 32 in part[1:-1]:
                continue
            code = sum(b << 8 * k for k, b in enumerate(part))
            mixed = (code + size) * 2654435761 % 2**32
            mixed ^= mixed >> 15
            row = model.scores[(mixed * 2246822519 % 2**32) >> 16]
            total, n = [t + float(x) for t, x in zip(total, row)], n + 1
    z = [(t / max(n, 1) + float(b)) / model.temperature for t, b in zip(total, model.bias)]
    e = [math.exp(x - max(z)) for x in z]
    best = max(range(len(e)), key=lambda k: e[k])
    return model.languages[best], e[best] / sum(e)


def quality_features(text: str | None) -> list[float]:
    raw, m = (text or "").encode(), measures(text)
    each = raw.split()
    n, size = max(len(each), 1), max(len(raw), 1)
    lengths = [len(w) for w in each]
    mean = sum(lengths) / n
    upper, lower = sum(65 <= b <= 90 for b in raw), sum(97 <= b <= 122 for b in raw)
    digits, foreign = sum(48 <= b <= 57 for b in raw), sum(b > 127 for b in raw)
    marks = sum(32 < b < 127 for b in raw) - upper - lower - digits
    lines = sum(bool(WORD.search(x)) for x in (text or "").split("\n"))
    return [
        math.log1p(len(each)), m["word_chars"] / n, math.sqrt(max(sum(x * x for x in lengths) / n - mean**2, 0)),
        math.log1p(max(lengths, default=0)), m["n_symbols"] / n, m["n_dup_lines"] / max(lines, 1),
        m["n_repeat_words"] / n, upper / max(upper + lower, 1), sum(w.endswith(b"!") for w in each) / n,
        digits / size, marks / size, foreign / size, len(set(each)) / n,
        sum(a == b for a, b in zip(each, each[1:])) / n, len(each) / max(lines, 1),
        sum(x == 1 for x in lengths) / n, sum(w[-1:] in b".!?" for w in each) / n, raw.count(b"|") / n,
    ]


def quality(model, text: str | None) -> float:
    """Score of one text: its table entries, one feature and one pair after the other."""
    at = [sum(float(cut) <= x for cut in cuts) for cuts, x in zip(model.edges, quality_features(text))]
    odds = model.base + sum(float(table[b]) for table, b in zip(model.tables, at))
    for (i, j), grid in zip(model.pairs, model.grids):
        odds += float(grid[at[i] * 8 // 32 * 8 + at[j] * 8 // 32])
    return 1 / (1 + math.exp(-min(max(odds, -30), 30)))
