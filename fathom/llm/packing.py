"""Best-fit packing of documents into sequences of one length."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import row_key, spool
from .encoding import encoder


def plan(counts: np.ndarray, capacity: int) -> np.ndarray:
    """How many pieces of each length go where, by large-item matching and best fit.

    counts[n]: pieces of length n. Rows of the result: length, first rank, one
    past the last rank, first bin, pieces in each bin, offset of the first in
    its bin. Pieces of one length are alike, so bins with the same contents are
    handled together: time and size depend on the capacity, not on the counts.

    Pieces above a third of the capacity fit at most twice into a bin: the
    longest goes with the longest that still fits beside it. The shorter ones,
    longest first, go to the smallest gap that takes them.
    """
    left, rank, steps, bins = counts.astype(np.int64), defaultdict(int), [], 0
    gaps: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # gap -> first bin, bins, filled
    third = capacity // 3

    def place(size: int, n: int, first: int, each: int, offset: int) -> None:
        steps.append((size, rank[size], rank[size] + n, first, each, offset))
        rank[size] += n
        left[size] -= n

    def leave(first: int, n: int, filled: int) -> None:
        if n and filled < capacity:
            gaps[capacity - filled].append((first, n, filled))

    for size in range(capacity, third, -1):
        while left[size]:
            most = min(size, capacity - size)
            fits = np.flatnonzero(left[third + 1 : most + 1]) + third + 1
            if len(fits) and fits[-1] == size and left[size] < 2:
                fits = fits[:-1]
            if not len(fits):
                n = int(left[size])
                place(size, n, bins, 1, 0)
                leave(bins, n, size)
            elif fits[-1] == size:
                n = int(left[size]) // 2
                place(size, 2 * n, bins, 2, 0)
                leave(bins, n, 2 * size)
            else:
                other = int(fits[-1])
                n = int(min(left[size], left[other]))
                place(size, n, bins, 1, 0)
                place(other, n, bins, 1, size)
                leave(bins, n, size + other)
            bins += n
    for size in range(third, 0, -1):
        while left[size]:
            gap = min((g for g, x in gaps.items() if g >= size and x), default=None)
            first, n, filled = gaps[gap].pop() if gap else (bins, -(-int(left[size]) // (capacity // size)), 0)
            bins += 0 if gap else n
            each = (capacity - filled) // size
            most = int(min(left[size], n * each))
            full, over = divmod(most, each)
            place(size, most, first, each, filled)
            leave(first, full, filled + each * size)
            leave(first + full, int(over > 0), filled + over * size)
            leave(first + full + (over > 0), n - full - (over > 0), filled)
    return np.array(steps, dtype=np.int64).reshape(-1, 6)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, mode: str = "blanks dropped", deal: int = 256) -> DataFrame:
    """docs(doc_id, text) -> doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Each document is its ids and the end id; null or empty texts are the end id
    alone. Documents longer than capacity are cut into pieces of that length,
    the last may be shorter; others stay whole. A sequence's pieces follow each
    other without gaps from offset 0. Repeated rows are packed as often as they
    come, null doc_ids like any other; other columns are ignored. An empty table
    gives no rows.

    Only the number of pieces of each length, at most `capacity` numbers,
    reaches the driver, which plans on them. A piece finds its place by its
    rank among those of its length. Ranks are counted in hashed ranges of each
    length, at least `deal` and more for many pieces, so that a length that many
    documents have is spread out.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, mode)
        for batch in batches:
            which, piece, start, length, crc = [], [], [], [], []
            for k, own in enumerate(encode(batch.column("text"))):
                ids = np.append(own, np.uint32(end_id)).tobytes()
                for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    which.append(k)
                    piece.append(i)
                    start.append(at // 4)
                    length.append(len(own) // 4)
                    crc.append(zlib.crc32(own))
            take = pa.array(which, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), batch.column("_row").take(take), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "_row", "piece", "start", "length", "ids_crc32"])

    cut = docs.select("doc_id", "text", row_key().alias("_row")).mapInArrow(pieces, "doc_id long, _row long, piece int, start long, length long, ids_crc32 long")
    cut = spool(cut)
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for size, n in cut.groupBy("length").count().collect():  # at most `capacity` rows
        counts[size] = n
    ranges = max(deal, -(-int(counts.max()) >> 18))
    cut = cut.withColumn("_deal", F.pmod(F.xxhash64("doc_id", "_row", "piece"), F.lit(ranges)).cast("int"))
    dealt = cut.groupBy("length", "_deal").count()
    steps = plan(counts, capacity)
    steps = steps[np.lexsort((steps[:, 1], steps[:, 0]))]
    firsts = (steps[:, 0] << 44) + steps[:, 1]

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = (batch.column(c).to_numpy() for c in ("length", "_rank"))
            at = steps[np.searchsorted(firsts, (size << 44) + rank, side="right") - 1]
            nth = rank - at[:, 1]
            found = {"sequence_id": at[:, 3] + nth // at[:, 4], "offset": at[:, 5] + nth % at[:, 4] * size}
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *map(pa.array, found.values())], [*names, *found])

    before = Window.partitionBy("length").orderBy("_deal").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.select("length", "_deal", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))
    nth = F.row_number().over(Window.partitionBy("length", "_deal").orderBy("doc_id", "_row", "piece"))
    ranked = cut.withColumn("_nth", nth - 1).join(starts, ["length", "_deal"]).withColumn("_rank", F.col("_first") + F.col("_nth"))
    return ranked.mapInArrow(places, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
