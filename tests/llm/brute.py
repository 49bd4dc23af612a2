"""Plain versions of the contracts, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANKS = " \t\n\x0b\x0c\r"
FOLD = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def crc(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def roots(ids, links) -> dict:
    root = {k: k for k in ids}

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {k: find(k) for k in ids}


def tokens(rows, tokenizer) -> list[tuple]:
    out, start = [], 0
    for doc, text in sorted(rows):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc, start, len(ids), crc(ids)))
        start += len(ids)
    return out


def shingle_set(text) -> frozenset:
    words = WORD.findall((text or "").translate(FOLD))
    if 0 < len(words) < 5:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4))


def near(rows, percent: int = 85) -> list[tuple]:
    sets = {doc: shingle_set(text) for doc, text in rows}
    holders = defaultdict(list)
    for doc, s in sets.items():
        for x in s:
            holders[x].append(doc)
    both = Counter()
    for docs in holders.values():
        for k, a in enumerate(docs):
            for b in docs[k + 1 :]:
                both[a, b] += 1
    links = [(a, b) for (a, b), n in both.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]
    root = roots(sets, links)
    return [(doc, len(s), root[doc], root[doc] == doc) for doc, s in sets.items()]


def substrings(rows, window: int = 35) -> list[tuple]:
    words = [(doc, WORD.findall(text or "")) for doc, text in rows]
    seen = Counter(tuple(w[k : k + window]) for _, w in words for k in range(len(w) - window + 1))
    out = []
    for doc, w in words:
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        out.append((doc, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


def vectors(rows, least: float = 0.93) -> list[tuple]:
    good = []
    for k, (_, v, label) in enumerate(rows):
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, dtype=np.float64)
            good.append((k, label, x / np.linalg.norm(x)))
    links, n = [], Counter()
    for i, (a, la, x) in enumerate(good):
        for b, lb, y in good[i + 1 :]:
            if la == lb and len(x) == len(y) and x @ y >= least:
                links.append((rows[a][0], rows[b][0]))
                n[a] += 1
                n[b] += 1
    root = roots([r[0] for r in rows], links)
    return [(r[0], n[k], root[r[0]], root[r[0]] == r[0]) for k, r in enumerate(rows)]


def signals(text) -> tuple:
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    again = {k + i for k in range(len(words) - 2) if seen[tuple(words[k : k + 3])] > 1 for i in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again)


def lines(rows) -> list[tuple]:
    split = [(doc, (text or "").split("\n")) for doc, text in rows]
    key = lambda x: x.strip(BLANKS).translate(FOLD)
    docs = defaultdict(set)
    for doc, x in split:
        for line in x:
            if len(key(line)) >= 40:
                docs[key(line)].add(doc)
    common = {k: max(v) for k, v in docs.items() if len(v) >= 5}
    out = []
    for doc, x in split:
        kept = [line for line in x if common.get(key(line), doc) == doc]
        out.append((doc, len(x), len(x) - len(kept), sha("\n".join(kept))))
    return out
