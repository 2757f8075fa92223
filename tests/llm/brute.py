"""Plain Python statements of what the operators must return, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WHITE = " \t\n\x0b\x0c\r"
FOLD = {k: k + 32 for k in range(65, 91)}


def fold(text: str | None) -> str:
    return (text or "").translate(FOLD)


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def quality_counts(text: str | None) -> tuple:
    words = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit), failed


def shingles(text: str | None, n: int) -> frozenset:
    words = WORD.findall(fold(text))
    return frozenset([tuple(words)] if 0 < len(words) < n else [tuple(words[i : i + n]) for i in range(len(words) - n + 1)])


def classes(rows: list[tuple], n: int, percent: int) -> list[tuple]:
    """(doc_id, set size, smallest reachable doc_id) per row."""
    sets = [(i, shingles(t, n)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(k: int) -> int:
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and sets[a][0] is not None and sets[b][0] is not None and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                parent[find(a)] = find(b)
    least: dict[int, int] = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(i, len(s), None if i is None else least[find(k)]) for k, (i, s) in enumerate(sets)]


def lines(rows: list[tuple], least_docs: int = 3, least_chars: int = 20) -> list[tuple]:
    """(doc_id, lines, dropped, text left) per row."""
    key = lambda line: fold(line.strip(WHITE))
    low = lambda i: -(1 << 63) if i is None else i
    where = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least_chars:
                where[key(line)].add(low(i))
    out = []
    for i, t in rows:
        own = (t or "").split("\n")
        stay = [x for x in own if not (len(where.get(key(x), ())) >= least_docs and low(i) != max(where[key(x)]))]
        out.append((i, len(own), len(own) - len(stay), "\n".join(stay)))
    return out


def contamination(rows: list[tuple], items: list[tuple], span: int = 10) -> list[tuple]:
    windows = defaultdict(set)
    for item, text in items:
        w = TOKEN.findall(fold(text))
        m = min(span, len(w))
        for s in range(len(w) - m + 1 if w else 0):
            windows[tuple(w[s : s + m])].add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for i, text in rows:
        w = TOKEN.findall(fold(text))
        hit, found = set(), set()
        for m in sizes:
            for s in range(len(w) - m + 1):
                if x := windows.get(tuple(w[s : s + m])):
                    hit |= set(range(s, s + m))
                    found |= x
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def unigram(rows: list[tuple]) -> list[tuple]:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score) per row."""
    tokens = [[*WORD.findall(fold(t)), None] for _, t in rows]
    counts = Counter(x for (i, _), ts in zip(rows, tokens, strict=True) if not held_out(i) for x in ts)
    total, distinct = sum(counts.values()), len(counts)
    return [(i, held_out(i), len(ts), sum(counts[x] > 0 for x in ts), total, sum(math.log10((counts[x] + 1) / (total + distinct + 1)) for x in ts)) for (i, _), ts in zip(rows, tokens, strict=True)]


def repeated_bytes(texts: list[str | None], length: int) -> list[tuple]:
    """(bytes, removed, runs, bytes left) per text."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        runs = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(r)))
        out.append((len(r), sum(gone), runs, bytes(c for c, g in zip(r, gone, strict=True) if not g)))
    return out


class Ppm:
    """Prediction by partial matching over symbols, method D, with exclusion."""

    def __init__(self, texts: list, order: int):
        self.order, self.counts = order, defaultdict(Counter)
        for t in texts:
            s = self.symbols(t)
            for i, x in enumerate(s):
                for n in range(order + 1):
                    self.counts[s[i - n : i] if i >= n else (0,) * (n - i) + s[:i]][x] += 1

    @staticmethod
    def symbols(text: str | None) -> tuple:
        return (*(b + 1 for b in b" ".join(w.encode() for w in WORD.findall(fold(text)))), 0)

    def probability(self, before: tuple, x: int) -> float:
        padded, out, gone = (0,) * self.order + before, 1.0, set()
        for n in range(self.order, -1, -1):
            c = self.counts.get(padded[len(padded) - n :] if n else ())
            if c is None:
                continue
            open_ = {y: k for y, k in c.items() if y not in gone}
            full, distinct = sum(2 * k - 1 for k in open_.values()), len(c) - len(gone & set(c))
            if x in open_:
                return out * (2 * open_[x] - 1) / (full + distinct)
            if open_:
                out *= distinct / (full + distinct)
            gone |= set(c)
        return out / (257 - len(gone))

    def score(self, text: str | None) -> float:
        s = self.symbols(text)
        return sum(math.log10(self.probability(s[:i], x)) for i, x in enumerate(s))
