"""Substring dedup: factors of documents that occur elsewhere in the corpus."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, mix, row_key, run_hashes, signed, spool, window_hashes, word_hashes

_WORDS = re.compile(rb"[^\x20\x09-\x0D]+").findall


def blocks_of(words: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """The reference blocks of a document, given its words' hashes.

    Each window of `window` words belongs to the leftmost of its least grams of
    `gram` words, its anchor. Consecutive windows with one anchor are a block:
    its anchor's hash, the hash of all its words, its first window, its number
    of windows. Equal windows have equal anchors wherever they are.
    """
    n = len(words) - window + 1
    if n <= 0:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
    grams = window_hashes(words, gram)
    span = window - gram + 1
    at = np.concatenate([k + sliding_window_view(grams[k : k + 4096 + span - 1], span).argmin(1) + np.arange(min(4096, n - k)) for k in range(0, n, 4096)])
    first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
    count = np.diff(np.concatenate([first, [n]]))
    whole = run_hashes(words, first, first + count + window - 1)
    return grams[at[first]], mix(whole + (at[first] - first).astype(np.uint64)), first, count


def reference_blocks(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """docs(doc_id, text) -> doc_id, _row, anchor, block, first, n: the blocks of all documents."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, found = [], []
            for k, text in enumerate(bytes_of(batch.column("text"))):
                if text is not None:
                    found.append(blocks_of(word_hashes(text), window, gram))
                    which.append(np.full(len(found[-1][0]), k))
            if not found:
                continue
            anchor, block, first, n = (np.concatenate(x) for x in zip(*found, strict=True))
            take = pa.array(np.concatenate(which))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), batch.column("_row").take(take), signed(anchor), signed(block), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32))], ["doc_id", "_row", "anchor", "block", "first", "n"])

    return docs.select("doc_id", "text", row_key().alias("_row")).mapInArrow(cut, "doc_id long, _row long, anchor long, block long, first int, n int")


def window_rows(texts: DataFrame, window: int) -> DataFrame:
    """texts(text, blocks array<(block, first, n, weight)>) -> block, nth, hash, weight: each window of these blocks."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for text, own in zip(bytes_of(batch.column("text")), batch.column("blocks").to_pylist(), strict=True):
                hashes = window_hashes(word_hashes(text), window)
                for b in own:
                    out[0].append(np.full(b["n"], b["block"], dtype=np.int64))
                    out[1].append(np.arange(b["n"], dtype=np.int32))
                    out[2].append(hashes[b["first"] : b["first"] + b["n"]].view(np.int64))
                    out[3].append(np.full(b["n"], b["weight"], dtype=np.int32))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["block", "nth", "hash", "weight"])

    return texts.select("text", "blocks").mapInArrow(cut, "block long, nth int, hash long, weight int")


def parsed(texts: DataFrame, window: int) -> DataFrame:
    """texts(doc_id, text, found array<(first, mask)>) -> doc_id, n_words, n_removed, spans, kept_text.

    A mask's bit k says that window first + k occurs elsewhere. Overlapping
    windows make a span: (first word, words).
    """
    span = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, spans, kept = [], [], [], []
            for text, found in zip(bytes_of(batch.column("text")), batch.column("found").to_pylist(), strict=True):
                words = _WORDS(text.tobytes()) if text is not None else []
                own, gone = [], 0
                if found:
                    turn = np.zeros(len(words) + 1, dtype=np.int32)
                    first, mask = (np.array([x[k] for x in found], dtype=np.int64) for k in ("first", "mask"))
                    for k in range(window):
                        hit = first[(mask >> k) & 1 == 1] + k
                        np.add.at(turn, hit, 1)
                        np.add.at(turn, hit + window, -1)
                    covered = np.cumsum(turn[:-1]) > 0
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
                    own = [{"start": int(a), "length": int(b - a)} for a, b in zip(edge[::2], edge[1::2], strict=True)]
                    gone = int(covered.sum())
                    words = [w for w, c in zip(words, covered, strict=True) if not c]
                sizes.append(len(words) + gone)
                removed.append(gone)
                spans.append(own)
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, span), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "spans", "kept_text"])

    return texts.select("doc_id", "text", "found").mapInArrow(cut, "doc_id long, n_words long, n_removed long, spans array<struct<start int, length int>>, kept_text string")


def dedup_substrings(docs: DataFrame, window: int = 35, gram: int = 8) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_words, n_removed, spans, kept_text; one row per document.

    Every word in a window of `window` consecutive words (at most 60) that also
    starts anywhere else, in any document, is removed: spans lists what goes,
    kept_text joins the rest by one space. Windows are judged on the input. All
    occurrences go, the first too. Nulls and texts of fewer words lose nothing.
    Repeated rows are each other's copies; a null doc_id is like any other.
    Other columns are ignored. Words and windows are told apart by 64-bit hashes.

    Relative Lempel-Ziv over the whole corpus: documents are parsed against an
    index of reference blocks, which are cut by content, so that a passage's
    blocks are the same wherever it stands, and sharded by anchor.

    1. Blocks whose anchor occurs once have no copy of any window; they go.
    2. Blocks that occur twice or more are factors as they are.
    3. Where blocks share an anchor but differ, a factor may end inside: their
       windows are checked one by one, once for each different block.
    4. Each document gets its factors back, which merge where they touch.
    """
    if not gram < window <= 60:
        raise ValueError("window must be above gram and at most 60")
    every = spool(reference_blocks(docs, window, gram))
    shared = every.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor")
    found = spool(every.join(shared, "anchor", "left_semi"))

    kinds = found.groupBy("anchor", "block").agg(F.count("*").alias("c"), F.first("n").alias("n"), F.min(F.struct("doc_id", "_row", "first")).alias("at"))
    kinds = spool(kinds)
    mixed = kinds.groupBy("anchor").agg(F.count("*").alias("k"), F.min("c").alias("c")).where("k > 1 and c = 1").select("anchor")
    checked = kinds.join(mixed, "anchor", "left_semi").groupBy(F.col("at.doc_id").alias("_doc"), F.col("at._row").alias("_key")).agg(F.collect_list(F.struct("block", F.col("at.first").alias("first"), "n", F.least("c", F.lit(2)).cast("int").alias("weight"))).alias("blocks"))
    texts = docs.select("doc_id", "text", row_key().alias("_row"))
    # repeated rows have one key: their windows are taken once, as their blocks are
    once = texts.join(checked, F.expr("doc_id <=> _doc and _row = _key")).groupBy("_doc", "_key").agg(F.first("text").alias("text"), F.first("blocks").alias("blocks"))
    windows = spool(window_rows(once, window))
    again = windows.groupBy("hash").agg(F.sum("weight").alias("w")).where("w > 1").select("hash")
    partial = windows.where("weight = 1").join(again, "hash", "left_semi").groupBy("block").agg(F.bit_or(F.expr("shiftleft(1L, nth)")).alias("some"))

    # a block of n windows: all n bits, or those found one by one
    masks = kinds.join(partial, "block", "left").select("anchor", "block", F.when(F.col("c") > 1, F.expr("shiftleft(1L, n) - 1")).otherwise(F.col("some")).alias("mask")).where("mask is not null")
    factors = found.join(masks, ["anchor", "block"]).groupBy(F.col("doc_id").alias("_doc"), F.col("_row").alias("_key")).agg(F.collect_set(F.struct("first", "mask")).alias("found"))
    return parsed(texts.join(factors, F.expr("doc_id <=> _doc and _row = _key"), "left").select("doc_id", "text", "found"), window)
