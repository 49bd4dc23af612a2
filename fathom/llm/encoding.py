"""Token ids of whole texts, by a public tokenizer, with a cache of pieces.

Texts are cut, many at a time, into parts at places where the tokenizer's
pre-tokenizer cuts too, so that each part can be encoded by itself. Parts seen
before are found by their bytes; only new ones go to the tokenizer.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Kinds of bytes: beyond ASCII, blanks, letters and digits, the apostrophe (which may start a contraction), all others.
BEYOND, BLANK, PLAIN, QUOTE, MARK = range(5)
_KIND = np.full(256, MARK, dtype=np.uint8)
_KIND[128:] = BEYOND
_KIND[[32, *range(9, 14)]] = BLANK
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123)]] = PLAIN
_KIND[39] = QUOTE
#: Blanks beyond ASCII: beside an ASCII blank they belong to one run of blanks, which isn't cut here.
_WIDE = "[" + "".join(map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))) + "]"
_MIXED_RUN = re.compile(rf"[ \t-\r]{_WIDE}|{_WIDE}[ \t-\r]").search
#: Parts of letters are one pre-token each: these go to the tokenizer's model at once.
_LETTERS = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
#: What becomes of blanks: one goes with the word that follows it, or none is kept.
MODES = ("blank before word", "blanks dropped")
_SHORT = 15  # bytes of a part that fit, with their number, into two 64-bit words
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(8)] + [2**64 - 1], dtype=np.uint64)
_SLICE = 1 << 20


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (x for x in range(256) if x not in printable)
    return {x: chr(x) for x in printable} | {x: chr(256 + k) for k, x in enumerate(others)}


def kinds_of(data: np.ndarray) -> np.ndarray:
    """The kind of each byte; both bytes of Latin letters from À to ɏ count as letters."""
    kind = _KIND[data]
    lead = np.flatnonzero((data[:-1] >= 0xC3) & (data[:-1] <= 0xC9))
    if len(lead):
        first, second = data[lead], data[lead + 1]
        lead = lead[~((first == 0xC3) & ((second == 0x97) | (second == 0xB7))) & ((first < 0xC9) | (second < 0x90))]
        kind[lead] = kind[lead + 1] = PLAIN
    return kind


def cuts(data: np.ndarray, edges: np.ndarray, keep_blanks: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the parts of the texts that `edges` part.

    A part ends where letters and marks meet (but an apostrophe goes with the
    letters behind it), and at blanks. Kept blanks: the last of a run is by
    itself or, if a space, goes with the word behind it; those before it are one part.
    """
    kind = kinds_of(data)
    first = np.zeros(len(data), dtype=bool)
    inner = edges[edges < len(data)]
    first[inner] = True
    before = np.concatenate([[BLANK], kind[:-1]]).astype(np.uint8)
    blank, was_blank = kind == BLANK, before == BLANK
    turn = ((before == PLAIN) & (kind >= QUOTE)) | ((before == MARK) & (kind == PLAIN))
    if not keep_blanks:
        starts = ~blank & (first | was_blank | turn)
        ends = ~was_blank & (blank | starts)
        ends[inner] |= ~was_blank[inner]
        found = np.flatnonzero(ends[1:]) + 1
        return np.flatnonzero(starts), found if blank[-1] else np.append(found, len(data))
    last_blank = blank.copy()  # a blank before a word of its text
    last_blank[:-1] &= ~blank[1:]
    last_blank[edges[edges > 0] - 1] = False
    after_space = np.zeros(len(data), dtype=bool)
    after_space[1:] = data[:-1] == 32
    starts = np.flatnonzero(first | (blank & (~was_blank | last_blank)) | (~blank & was_blank & ~after_space) | turn)
    return starts, np.append(starts[1:], len(data))


class Parts:
    """Byte strings of up to _SHORT bytes -> their ids: a hash table in arrays, exact, of at most `limit` entries."""

    def __init__(self, limit: int):
        self.limit, size = limit, 1 << (limit + 2 * _SLICE // 5).bit_length()  # more different parts don't fit into a slice
        self.shift = np.uint64(64 - size.bit_length() + 1)
        self.low, self.high, self.entry = np.zeros(size, np.uint64), np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        self.forget()

    def forget(self) -> None:
        self.entry.fill(-1)
        self.n, self.used = 0, 0
        self.at, self.size, self.ids = np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int32), np.zeros(1 << 14, np.uint32)

    def add(self, lists: list[list[int]]) -> np.ndarray:
        """The numbers of new entries with these ids."""
        sizes = np.array([len(x) for x in lists], dtype=np.int32)
        while self.n + len(lists) > len(self.at):
            self.at, self.size = np.append(self.at, np.zeros_like(self.at)), np.append(self.size, np.zeros_like(self.size))
        while self.used + sizes.sum() > len(self.ids):
            self.ids = np.append(self.ids, np.zeros_like(self.ids))
        made = np.arange(self.n, self.n + len(lists))
        self.at[made], self.size[made] = self.used + np.cumsum(sizes) - sizes, sizes
        self.ids[self.used : self.used + sizes.sum()] = [i for x in lists for i in x]
        self.n, self.used = self.n + len(lists), self.used + int(sizes.sum())
        return made

    def _slots(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        x = (low ^ (high * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
        return ((x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> self.shift).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Each key's entry; -1 if there is none."""
        slot = self._slots(low, high)
        found = self.entry[slot]
        open_ = np.flatnonzero((found >= 0) & ((self.low[slot] != low) | (self.high[slot] != high)))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.entry) - 1)
            at = slot[open_]
            found[open_] = self.entry[at]
            open_ = open_[(found[open_] >= 0) & ((self.low[at] != low[open_]) | (self.high[at] != high[open_]))]
        return found

    def put(self, low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> None:
        """New, distinct keys."""
        slot, left = self._slots(low, high), np.arange(len(low))
        while len(left):
            free = left[self.entry[slot[left]] < 0]
            _, one = np.unique(slot[free], return_index=True)
            won = free[one]
            self.low[slot[won]], self.high[slot[won]], self.entry[slot[won]] = low[won], high[won], entries[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            slot[left] = (slot[left] + 1) & (len(self.entry) - 1)


class Encoder:
    """Texts -> ids, as the tokenizer alone would give them, for byte-level vocabularies.

    The cache holds at most `limit` parts and starts anew beyond that, which
    brings back what is frequent. Texts with the start of a special token's
    string are encoded in one piece.
    """

    def __init__(self, path: str, mode: str, limit: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        self.tokenizer, self.keep_blanks = Tokenizer.from_file(path), mode == MODES[0]
        self.letters, self.parts, self.long = byte_letters(), Parts(limit), {}

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, parts: list[str]) -> list[list[int]]:
        """Ids of parts."""
        out: list[list[int] | None] = [None] * len(parts)
        tokenize = self.tokenizer.model.tokenize
        for k, p in enumerate(parts):
            if _LETTERS(p):
                p = p if self.keep_blanks else p.lower()
                out[k] = [t.id for t in tokenize(p.encode().decode("latin-1").translate(self.letters))]
        rest = [k for k, x in enumerate(out) if x is None]
        for k, ids in zip(rest, self.whole([parts[k] for k in rest]), strict=True):
            out[k] = ids
        return out

    def encode(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of several texts, and where each begins and the last ends -> all ids, and where each text's begin and end."""
        if edges[-1] == edges[0]:
            return np.zeros(0, np.uint32), np.zeros(len(edges), np.int64)
        starts, ends = cuts(data, edges, self.keep_blanks)
        n = ends - starts
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        eight = np.ndarray(len(data) + 8, "<u8", padded, strides=(1,))  # the eight bytes from each place on
        low, high = eight[starts] & _MASKS[np.minimum(n, 8)], eight[np.minimum(starts + 8, len(data))] & _MASKS[np.clip(n - 8, 0, 8)]
        short = n <= _SHORT
        high = np.where(short, high | (n.astype(np.uint64) << np.uint64(56)), high)
        entry = self.parts.find(low, high)
        entry[~short] = [self.long.get(data[a:b].tobytes(), -1) for a, b in zip(starts[~short].tolist(), ends[~short].tolist(), strict=True)]
        missing = np.flatnonzero(entry < 0)
        if len(missing):
            if self.parts.n + len(missing) > self.parts.limit:
                self.parts.forget()
                self.long.clear()
                entry[:] = -1
                missing = np.arange(len(entry))
            own = missing[short[missing]]
            order = np.lexsort((low[own], high[own]))
            own = own[order]
            change = np.flatnonzero(np.concatenate([[True], (low[own][1:] != low[own][:-1]) | (high[own][1:] != high[own][:-1])]))[: len(own)]
            ones = own[change]
            strings = [data[starts[k] : ends[k]].tobytes().decode() for k in ones]
            made = self.parts.add(self._new(strings)) if strings else np.zeros(0, np.int64)
            self.parts.put(low[ones], high[ones], made)
            entry[own] = np.repeat(made, np.diff(np.append(change, len(own))))
            others = missing[~short[missing]]
            if len(others):
                keys = [data[starts[k] : ends[k]].tobytes() for k in others]
                once = list(dict.fromkeys(keys))
                self.long.update(zip(once, self.parts.add(self._new([k.decode() for k in once])).tolist(), strict=True))
                entry[others] = [self.long[k] for k in keys]
        size = self.parts.size[entry].astype(np.int64)
        upto = np.concatenate([[0], np.cumsum(size)])
        ids = self.parts.ids[np.repeat(self.parts.at[entry] - upto[:-1], size) + np.arange(upto[-1])]
        return ids, upto[np.searchsorted(starts, edges)]

    def _odd(self, data: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Numbers of the texts that may hold a special token, or blanks beyond ASCII beside ASCII ones."""
        hits = [np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))]
        if self.keep_blanks and len(data) > 3:
            blank = _KIND[data] == BLANK
            wide = (data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3))
            near = np.flatnonzero((blank[:-1] & wide[1:]) | (np.concatenate([[False] * 2, wide[:-3]]) & blank[1:]) | (np.concatenate([[False], wide[:-2]]) & blank[1:]))
            own = np.unique(np.searchsorted(edges, near, side="right") - 1)
            hits.append(edges[[k for k in own if _MIXED_RUN(data[edges[k] : edges[k + 1]].tobytes().decode())]])
        return np.unique(np.searchsorted(edges, np.concatenate(hits), side="right") - 1).astype(np.int64)

    def __call__(self, col: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text; none for null."""
        col = col.cast(pa.large_string())
        _, ends, data = col.buffers()
        at = np.frombuffer(ends, dtype=np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
        data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
        k = 0
        while k < len(col):
            upto = max(k + 1, int(np.searchsorted(at, at[k] + _SLICE, side="right")) - 1)
            edges, own = at[k : upto + 1] - at[k], data[at[k] : at[upto]]
            odd = set(self._odd(own, edges).tolist()) if len(own) else set()
            if upto == k + 1 and len(own) > 2 * _SLICE and not odd:
                yield np.concatenate([self.encode(x, np.array([0, len(x)]))[0] for x in pieces(own)])
            else:
                ids, places = self.encode(own, edges)
                for j in range(upto - k):
                    yield np.array(self.whole([own[edges[j] : edges[j + 1]].tobytes().decode()])[0], np.uint32) if j in odd else ids[places[j] : places[j + 1]]
            k = upto


def pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    """A long text, cut at single spaces between letters about every _SLICE bytes."""
    plain = _KIND[data] == PLAIN
    places = np.flatnonzero((data[1:-1] == 32) & plain[:-2] & plain[2:]) + 1
    a = 0
    while len(data) - a > 2 * _SLICE:
        k = np.searchsorted(places, a + _SLICE)
        if k == len(places):
            break
        yield data[a : places[k]]
        a = int(places[k])
    yield data[a:]


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, mode: str, limit: int = 500_000) -> Encoder:
    """One per Python worker, kept from task to task."""
    if (path, mode) not in _ENCODERS:
        _ENCODERS[path, mode] = Encoder(path, mode, limit)
    return _ENCODERS[path, mode]
