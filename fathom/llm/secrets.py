"""Secret scans: patterns of credentials, and random strings that a tokenizer can't shorten."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

#: The kinds in their order, the patterns, and the least length of what counts (of the value for "assign").
KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
LEAST = {"assign": 12, "access": 18, "hex": 16}

#: What may be a random string: a run of the characters of keys and of base64, not within a longer word.
_RUN = re.compile(r"(?<![\w+/=-])[A-Za-z0-9+/_-]{16,}={0,2}(?!\w)")
#: Places and addresses: what stands before a run in a path, a name of a host, an address of mail.
_PLACE = re.compile(r"(?:://|www\.|@)[^\s\"'<>]*$")
#: Known digests: hex of the usual lengths, and named ones in hex or base64; identifiers: UUIDs, numbers, names made of words.
_DIGEST = re.compile(r"(?i)(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|(?:md5|sha(?:1|224|256|384|512))[-=:_][A-Za-z0-9+/_=-]+)")
_NAMED = re.compile(r"(?i)(?:md5|sha-?(?:1|224|256|384|512))[\"']?[ :=-]{1,3}[\"']?$")
_UUID = re.compile(r"(?i)[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}")
_NUMBER = re.compile(r"[0-9+/_=-]+")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


@lru_cache(maxsize=4)
def tokenizer(path: str, pattern: str):
    """A byte-level vocabulary given as ranks; one for each Python worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """start, end, kind of what the patterns find, by start, then kind; leftmost, without overlaps within a kind."""
    found = []
    low = text.lower()
    if any(name in low for name in _NAMES):
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def is_identifier(run: str, before: str) -> bool:
    """Digests, UUIDs, numbers, places, and names: parts of letters that are words, joined by case, blanks or digits.

    A part is a word if it has a vowel and no run of more than five consonants;
    a name is words for at least three letters in four, in parts of four letters
    on average or more.
    """
    if _DIGEST.fullmatch(run) or _UUID.fullmatch(run) or _NUMBER.fullmatch(run) or _NAMED.search(before) or _PLACE.search(before):
        return True
    parts = [p for p in _PART.findall(run) if p.isalpha()]
    letters = sum(map(len, parts))
    words = [p for p in parts if len(p) > 2 and re.search("[aeiouy]", p.lower()) and not re.search("[^aeiouy]{6}", p.lower())]
    return letters > 0 and sum(map(len, words)) >= 0.75 * letters and letters >= 4 * len(parts) and letters >= 0.6 * len(run)


def variety(run: str) -> int:
    """How many of lower case, upper case (behind the first letter, which prose may write large) and digits it has."""
    return any("a" <= c <= "z" for c in run) + any("A" <= c <= "Z" for c in run[1:]) + any("0" <= c <= "9" for c in run)


def random_spans(text: str, base: list[tuple[int, int, str]], encoding, most: float, known: frozenset[str]) -> list[tuple[int, int, str]]:
    """Runs of at most `most` characters per token that no pattern touches and that aren't known digests or identifiers."""
    found = []
    for m in _RUN.finditer(text):
        (start, end), run = m.span(), m.group()
        if variety(run) < 2 or run in known or any(a < end and start < b for a, b, _ in base):
            continue
        if not is_identifier(run, text[max(0, start - 200) : start]) and len(run) <= most * len(encoding.encode_ordinary(run)):
            found.append((start, end, "random"))
    return found


def scan_secrets(docs: DataFrame, ranks: str, pattern: str, most: float = 2.0, known: frozenset[str] = frozenset()) -> DataFrame:
    """docs(doc_id, text) -> doc_id, secrets array<(kind, start, end)>: code points, end exclusive, by start, then kind.

    Kinds: "assign" (a name of a credential with a value), "access" (AKIA...),
    "hex" (16 lower-case hex digits or more), and "random", the token-efficiency
    test: a run of 16 or more characters of keys, with at least two of lower case,
    upper case and digits, which the vocabulary `ranks` (byte-level ranks, with
    its `pattern`) can't bring below one token for `most` characters. Prose has
    about four characters per token, random letters and digits below two. The
    last kind leaves out what a span of another kind touches, strings in `known`
    (a small set, for digests of one's own), digests of the usual lengths or with
    their name, UUIDs, numbers, addresses, and names made of words.

    Whole texts are scanned, row by row, with no shuffle; null and empty texts
    have no secrets, repeated rows are scanned each, other columns are ignored.
    """
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = tokenizer(ranks, pattern)
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                text = text.as_py() or ""
                base = base_spans(text)
                every = sorted([*base, *random_spans(text, base, encoding, most, known)], key=lambda x: (x[0], KINDS.index(x[2])))
                rows.append([{"kind": k, "start": a, "end": b} for a, b, k in every])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, span)], ["doc_id", "secrets"])

    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, secrets array<struct<kind string, start long, end long>>")
