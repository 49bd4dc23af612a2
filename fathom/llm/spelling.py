"""Spelling variants: words one edit apart, found through reduced alphabets.

Letters are hashed to a few symbols, so that many words share a reduced word.
Words that are one edit apart have reduced words that are at most one edit
apart: every reduced word asks for its full one-edit neighbourhood among the
reduced words there are, and only words of neighbours are compared letter by letter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, discard, mix, signed, spool

#: Letters of words; all of them are one byte in Latin-1.
_RUNS = re.compile("[a-zÀ-ÿ]+").findall
#: Sizes of the reduced alphabet; with the last one each letter is its own symbol.
ALPHABETS = (4, 6, 8, 12, 16, 24, 256)
_BASE = 0x9E3779B97F4A7C15
_BACK = np.uint64(pow(_BASE, -1, 2**64))
_LENGTH = 0xD6E8FEB86659FD93
#: Words counted before they are handed on, keys of a block, pairs compared at once.
_HELD, _KEYS, _PAIRS = 100_000, 1 << 19, 1 << 17


def altered(word: str, doc: int, modulus: int) -> str:
    """The word with the letter taken out that doc, the hash of its document's id, chooses for one in `modulus` words."""
    h = zlib.crc32(word.encode(), doc)
    if modulus and h % modulus == 0:
        k = h % len(word)
        return word[:k] + word[k + 1 :]
    return word


def word_counts(docs: DataFrame, modulus: int = 97) -> DataFrame:
    """docs(doc_id, text) -> word, n: runs of letters (A-Z and À to ÿ), only A-Z in lower case, of whole texts.

    With a modulus, a word whose crc32 of `doc_id:word` it divides loses the
    letter that the hash chooses, which makes typing errors to find. A null
    doc_id counts as an empty string.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), bytes_of(batch.column("text")), strict=True):
                if text is None:
                    continue
                of = zlib.crc32(b":" if doc is None else b"%d:" % doc)
                for word, n in Counter(_RUNS(text.tobytes().lower().decode())).items():  # bytes have ASCII case only
                    word = altered(word, of, modulus)
                    held[word] = held.get(word, 0) + n
                if len(held) > _HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return docs.select("doc_id", "text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# ------------------------------------------------------------ reduced words


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words -> for each length their numbers, and their letters as rows of bytes."""
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    data, at = np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8), np.cumsum(sizes) - sizes
    for n in np.unique(sizes):
        own = np.flatnonzero(sizes == n)
        yield own, data[at[own][:, None] + np.arange(n)]


def symbols(letters: np.ndarray, alphabet: int) -> np.ndarray:
    """A symbol from 1 to `alphabet` for each letter."""
    if alphabet >= 256:
        return letters.astype(np.uint64) + np.uint64(1)
    return ((letters * np.uint32(0x9E3779B1)) >> np.uint32(16)) % np.uint32(alphabet) + np.uint64(1)


def powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.array([1, *[_BASE] * n], dtype=np.uint64))


def hashed(sums: np.ndarray, length: int) -> np.ndarray:
    return mix(sums + np.uint64(length * _LENGTH % 2**64))


def reduced(words: list[str], alphabet: int) -> np.ndarray:
    """A 64-bit hash of each word's reduced word."""
    out = np.zeros(len(words), dtype=np.uint64)
    for own, letters in by_length(words):
        n = letters.shape[1]
        out[own] = hashed((symbols(letters, alphabet) * powers(n)[:n]).sum(1, dtype=np.uint64), n)
    return out


def used(alphabet: int) -> np.ndarray:
    """The symbols that letters have."""
    letters = np.array([*range(97, 123), *range(0xC0, 0x100)], dtype=np.uint8)
    return np.unique(symbols(letters, alphabet)).astype(np.uint64)


def neighbourhood(letters: np.ndarray, alphabet: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of one length -> (their numbers, hashes): each reduced word itself, and all that one edit makes of it.

    Edits that give the same reduced word, such as taking out one of two equal neighbours, come once.
    """
    n, size = letters.shape[1], len(letters)
    s, up = symbols(letters, alphabet), powers(n + 1)
    before = np.concatenate([np.zeros((size, 1), np.uint64), np.cumsum(s * up[:n], axis=1, dtype=np.uint64)], axis=1)
    whole = before[:, -1:]
    after = whole - before
    yield np.arange(size), hashed(whole[:, 0], n)
    fresh = np.ones(s.shape, dtype=bool)
    fresh[:, 1:] = s[:, 1:] != s[:, :-1]
    which = np.nonzero(fresh)
    yield which[0], hashed((before[:, :-1] + after[:, 1:] * _BACK)[which], n - 1)
    shifted, open_ = after * np.uint64(_BASE), np.ones((size, n + 1), dtype=bool)
    for x in used(alphabet):
        other = s != x
        which = np.nonzero(other)
        yield which[0], hashed((whole + (x - s) * up[:n])[which], n)
        open_[:, :-1] = other  # before its like, a symbol makes the same as behind it
        which = np.nonzero(open_)
        yield which[0], hashed((before + x * up[: n + 1] + shifted)[which], n + 1)


def neighbours(reps: DataFrame, alphabet: int, shards: int) -> DataFrame:
    """reps(r, word): each reduced word's hash and one of its words -> r, r2: reduced words at most one edit apart, r <= r2.

    Words are taken in chunks; a chunk's hashes go to the shards that hold them,
    a sorted block for each. A task holds one shard of the reduced words, and one
    block after the other. Neighbours ask for each other, so of each two only the
    one with the smaller hash asks.
    """

    def shard_of(keys: np.ndarray) -> np.ndarray:
        return (((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int32)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            r, words = batch.column("r").to_numpy().view(np.uint64), batch.column("word").to_pylist()
            for own, letters in by_length(words):
                step = max(1, _KEYS // (2 * len(used(alphabet)) * (letters.shape[1] + 1)))
                for lo in range(0, len(own), step):
                    mine = r[own[lo : lo + step]]
                    who, keys = (np.concatenate(x) for x in zip(*neighbourhood(letters[lo : lo + step], alphabet), strict=True))
                    asked = keys >= mine[who]
                    who, keys = mine[who[asked]], keys[asked]
                    order = np.argsort(keys, kind="stable")
                    who, keys = who[order], keys[order]
                    shard = shard_of(keys)
                    edges = np.flatnonzero(np.diff(shard)) + 1
                    blocks = [pack(np.diff(k, prepend=np.uint64(0)).tobytes() + w.tobytes()) for k, w in zip(np.split(keys, edges), np.split(who, edges), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(shard[np.concatenate([[0], edges])]), pa.array(blocks, pa.binary())], ["shard", "data"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r = batch.column("r").to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(shard_of(r)), batch.column("r")], ["shard", "r"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        shard, parts, held = None, [], None
        for batch in batches:
            shards_, is_key = batch.column("shard").to_numpy(), batch.column("r").is_valid().to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((shards_[1:] != shards_[:-1]) | (is_key[1:] != is_key[:-1])) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
                if a == b:
                    continue
                if shards_[a] != shard:
                    shard, parts, held = shards_[a], [], None
                if is_key[a]:
                    parts.append(batch.column("r").slice(a, b - a).to_numpy().view(np.uint64))
                    continue
                if held is None:
                    held = np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
                for data in batch.column("data").slice(a, b - a).to_pylist():
                    if not len(held):
                        continue
                    keys, who = np.frombuffer(unpack(data), np.uint64).reshape(2, -1)
                    keys = np.cumsum(keys, dtype=np.uint64)
                    hit = held[np.minimum(np.searchsorted(held, keys), len(held) - 1)] == keys
                    found = np.unique(np.stack([who[hit], keys[hit]]), axis=1)
                    yield pa.RecordBatch.from_arrays([signed(np.ascontiguousarray(x)) for x in found], ["r", "r2"])

    blocks = reps.select("r", "word").mapInArrow(ask, "shard int, data binary").select("shard", F.lit(None).cast("long").alias("r"), "data")
    held = reps.select("r").mapInArrow(place, "shard int, r long").select("shard", "r", F.lit(None).cast("binary").alias("data"))
    both = held.union(blocks).repartition("shard").sortWithinPartitions("shard", F.col("r").isNull())
    return both.mapInArrow(answer, "r long, r2 long")


# ------------------------------------------------------------------ words


def one_edit(data: np.ndarray, at: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether words i and j, of data[at : at + size], differ by exactly one letter put in, taken out or replaced."""
    short = np.where(size[i] <= size[j], i, j)
    long = np.where(size[i] <= size[j], j, i)
    gap, out = size[long] - size[short], np.zeros(len(i), dtype=bool)
    for n in np.unique(size[short]):
        for more in (0, 1):
            own = np.flatnonzero((size[short] == n) & (gap == more))
            step = max(1, 8 * _PAIRS // (n + 1))
            for lo in range(0, len(own), step):
                part = own[lo : lo + step]
                a = data[at[short[part]][:, None] + np.arange(n)]
                b = data[at[long[part]][:, None] + np.arange(n + more)]
                differ = a != b[:, :n]
                if more:  # equal up to some place, from there on one letter further
                    later = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1)[:, ::-1]
                    upto = np.where(differ.any(1), differ.argmax(1), n)
                    out[part] = (upto == n) | later[np.arange(len(part)), np.minimum(upto, n - 1)]
                else:
                    out[part] = differ.sum(1) == 1
    return out


def near_words(pairs: DataFrame, buckets: DataFrame) -> DataFrame:
    """neighbours(), buckets(r, part, words array<(word, n)>) -> word, near, near_n: words one edit apart, both ways.

    All words of two neighbours' buckets are compared where the buckets meet; only those that are near are rows.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for name in ("words", "words2"):
                col = batch.column(name)
                flat = col.flatten()
                sides.append((np.diff(col.offsets.to_numpy()), flat.field("word"), flat.field("n").to_numpy()))
            (na, wa, ca), (nb, wb, cb) = sides
            words = [*wa.to_pylist(), *wb.to_pylist()]
            size = np.array([len(w) for w in words], dtype=np.int64)
            data, at = np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8), np.cumsum(size) - size
            count = np.concatenate([ca, cb])
            first_a, first_b = np.cumsum(na) - na, len(wa) + np.cumsum(nb) - nb
            own = (batch.column("r").to_numpy() == batch.column("r2").to_numpy()) & (batch.column("part").to_numpy() == batch.column("part2").to_numpy())
            total = na.astype(np.int64) * nb
            upto = np.cumsum(total)
            row = 0
            while row < len(total):
                end = max(row + 1, int(np.searchsorted(upto, (upto[row - 1] if row else 0) + _PAIRS, side="right")))
                which = np.repeat(np.arange(row, end), total[row:end])
                k = np.arange(len(which)) - np.repeat(upto[row:end] - total[row:end] - (upto[row - 1] if row else 0), total[row:end])
                i, j = k // nb[which], k % nb[which]
                ok = ~own[which] | (i < j)
                i, j = (first_a[which] + i)[ok], (first_b[which] + j)[ok]
                ok = np.abs(size[i] - size[j]) <= 1
                i, j = i[ok], j[ok]
                ok = one_edit(data, at, size, i, j)
                i, j = np.concatenate([i[ok], j[ok]]), np.concatenate([j[ok], i[ok]])
                yield pa.RecordBatch.from_arrays([pa.array([words[x] for x in i.tolist()], pa.string()), pa.array([words[x] for x in j.tolist()], pa.string()), pa.array(count[j], pa.int64())], ["word", "near", "near_n"])
                row = end

    two = buckets.select(F.col("r").alias("r2"), F.col("part").alias("part2"), F.col("words").alias("words2"))
    met = pairs.join(buckets, "r").join(two, "r2").where("r <> r2 or part <= part2").select("r", "r2", "part", "part2", "words", "words2")
    return met.mapInArrow(compare, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """forms(word, form) -> word, root: the end of the way along forms, which has no cycle. Ways double in length each round."""
    now = spool(forms.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = spool(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        discard(now)
        now = further
        if now.where("moved").isEmpty():
            return now.select("word", "root")


def spelling_variants(docs: DataFrame, modulus: int = 97, min_chars: int = 5, min_n: int = 3, factor: int = 2, alphabet: int | None = None, crowd: int = 6, most: int = 1000) -> DataFrame:
    """docs(doc_id, text) -> word, n, n_near, form, form_n, root; one row for each word.

    Words are word_counts() of at least min_chars letters that occur min_n times
    or more. Two are near if one letter put in, taken out or replaced makes one
    of the other. A word's form is its near word with the largest n, the first by
    code points of equals, if that is at least factor times its own n. root: where
    forms lead to, the word itself if it has none. n_near: near words. Null texts
    have no words, repeated rows count each, other columns are ignored; an empty
    table, or one without such words, gives no rows.

    1. Words are counted in each task, then by key.
    2. Letters become one of `alphabet` symbols. Unless given, that is the least
       of ALPHABETS with which a word shares its reduced word with at most
       `crowd` others on average, so buckets stay small however many words there are.
    3. neighbours(): full one-edit neighbourhoods of the reduced words, looked up in shards.
    4. near_words(): the words of neighbours are compared. A bucket has at most
       about `most` words in a row, larger ones are split into parts.
    5. Near words are summed up for each word, and forms followed in rounds.
    """
    words = spool(word_counts(docs, modulus).where((F.char_length("word") >= min_chars) & (F.col("n") >= min_n)))
    sizes = [alphabet] if alphabet else list(ALPHABETS)

    def reduce(batches: Iterator[pa.RecordBatch], of: list[int]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("word").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), *(signed(reduced(own, q)) for q in of)], ["word", "n", *(f"r{q}" for q in of)])

    keyed = words.mapInArrow(lambda b: reduce(b, sizes), f"word string, n long, {', '.join(f'r{q} long' for q in sizes)}")
    # one row for each size: how many words a word shares its reduced word with
    each = keyed.select(F.explode(F.array(*(F.struct(F.lit(q).alias("q"), F.col(f"r{q}").alias("r")) for q in sizes))).alias("x")).groupBy("x.q", "x.r").agg(F.count("*").alias("c"))
    crowds = {row.q: row for row in each.groupBy("q").agg((F.sum(F.col("c") * F.col("c")) / F.sum("c")).alias("mean"), F.max("c").alias("top")).collect()}
    chosen = next((q for q in sizes if q in crowds and crowds[q]["mean"] <= 1 + crowd), sizes[-1])
    parts = -(-crowds[chosen].top // most) if chosen in crowds else 1
    keyed = spool(words.mapInArrow(lambda b: reduce(b, [chosen]), f"word string, n long, r{chosen} long").withColumnRenamed(f"r{chosen}", "r"))
    reps = keyed.groupBy("r").agg(F.min("word").alias("word"))
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), keyed.count() >> 18)
    pairs = neighbours(spool(reps), chosen, shards)
    part = F.pmod(F.xxhash64("word"), F.lit(parts)).cast("int")
    buckets = keyed.groupBy("r", part.alias("part")).agg(F.array_sort(F.collect_list(F.struct("word", "n"))).alias("words"))
    near = near_words(pairs, buckets).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("form"))).alias("best"))
    with_forms = words.join(near, "word", "left").withColumn("_ok", -F.col("best.m") >= factor * F.col("n"))
    found = spool(with_forms.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("_ok"), F.col("best.form")).alias("form"), F.when(F.col("_ok"), -F.col("best.m")).alias("form_n")))
    discard(words, keyed)
    ends = roots(found.where("form is not null"))
    return found.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
