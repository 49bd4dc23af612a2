"""Near-duplicate documents by min-max hashing, confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, discard, groups, mix, rooted, row_key, run_hashes, signed, spool, window_hashes, word_hashes
from .components import components

_SEED = 20240611


def shingles(text: np.ndarray | None, words: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct runs of `words` words, A-Z in lower case; of the whole, if it has fewer."""
    if text is None:
        return np.zeros(0, dtype=np.uint64)
    all_words = word_hashes(text, fold=True)
    n = len(all_words)
    if 0 < n < words:
        return run_hashes(all_words, np.array([0]), np.array([n]))
    return np.unique(window_hashes(all_words, words))


def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(_SEED)
    odd, add = (rng.integers(0, 2**64, n, dtype=np.uint64) for _ in range(2))
    return odd | np.uint64(1), add


def min_max(found: np.ndarray, odd: np.ndarray, add: np.ndarray) -> np.ndarray:
    """The minimum and the maximum of the set under each permutation, two values for one evaluation."""
    low, high = np.full(len(odd), 2**64 - 1, dtype=np.uint64), np.zeros(len(odd), dtype=np.uint64)
    for at in range(0, len(found), 1024):
        x = found[at : at + 1024, None] * odd + add
        np.minimum(low, x.min(0), out=low)
        np.maximum(high, x.max(0), out=high)
    return np.concatenate([low, high])


def dealt(bands: int, rows: int) -> np.ndarray:
    """Which values go into each band: minima of some permutations, maxima of others half-way round."""
    hashes, half = bands * rows // 2, rows // 2
    if rows % 2 or hashes < 2 * rows:
        raise ValueError("a band needs an even number of rows, and there must be four bands or more")
    at = np.arange(hashes).reshape(bands, half)
    return np.concatenate([at, hashes + (at + hashes // 2) % hashes], axis=1)


def signatures(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """docs(doc_id, text) -> doc_id, _row, n_shingles, s1, s2 (a hash of the set), keys (one for each band).

    Half of a band's values are minima, half are maxima, all of different permutations.
    """
    deal = dealt(bands, rows)
    odd, add = permutations(bands * rows // 2)
    salt = mix(np.arange(1, bands * rows + 1, dtype=np.uint64)).reshape(bands, rows) | np.uint64(1)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, sums, others, keys = [], [], [], []
            for text in bytes_of(batch.column("text")):
                found = shingles(text, words)
                sizes.append(len(found))
                sums.append(found.sum(dtype=np.uint64))
                others.append(mix(found ^ np.uint64(_SEED)).sum(dtype=np.uint64))
                keys.append(mix((mix(min_max(found, odd, add)[deal]) * salt).sum(1, dtype=np.uint64)) if len(found) else np.zeros(bands, dtype=np.uint64))
            flat = signed(np.concatenate(keys)) if keys else pa.array([], pa.int64())
            at = pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * bands)
            as_long = lambda x: signed(np.array(x, dtype=np.uint64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_row"), pa.array(sizes, pa.int64()), as_long(sums), as_long(others), pa.ListArray.from_arrays(at, flat)], ["doc_id", "_row", "n_shingles", "s1", "s2", "keys"])

    return docs.select("doc_id", "text", row_key().alias("_row")).mapInArrow(sign, "doc_id long, _row long, n_shingles long, s1 long, s2 long, keys array<long>")


def overlaps(left: list[np.ndarray], right: list[np.ndarray], most: int = 1 << 13) -> np.ndarray:
    """Sizes of the intersections of all sets on the left with all on the right."""
    if len(left) * len(right) <= 16:
        return np.array([[len(np.intersect1d(a, b, assume_unique=True)) for b in right] for a in left])
    ids, inverse = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    cut = sum(map(len, left))
    rows = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right)]
    cols = [inverse[:cut], inverse[cut:]]
    both = np.intersect1d(cols[0], cols[1])
    place = np.full(len(ids), -1)
    place[both] = np.arange(len(both))
    total = np.zeros((len(left), len(right)), dtype=np.float32)
    marks = []
    for r, c in zip(rows, cols, strict=True):
        keep = place[c] >= 0
        order = np.argsort(place[c[keep]], kind="stable")
        marks.append((r[keep][order], place[c[keep]][order]))
    for at in range(0, len(both), most):
        x = [np.zeros((len(s), min(most, len(both) - at)), dtype=np.float32) for s in (left, right)]
        for m, (r, p) in zip(x, marks, strict=True):
            a, b = np.searchsorted(p, [at, at + most])
            m[r[a:b], p[a:b] - at] = 1
        total += x[0] @ x[1].T
    return np.rint(total).astype(np.int64)


def _sets(t: pa.Table, words: int) -> tuple[list[np.ndarray], np.ndarray]:
    text = t.column("text")
    sets = [shingles(x, words) for x in bytes_of(text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text)]
    return sets, np.array([len(s) for s in sets])


def with_hub(members: DataFrame, words: int, percent: int) -> DataFrame:
    """members(grp, lo, side, node, text) -> grp, node, linked: whether each document is similar to the one on side 0 of its (grp, lo)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["grp", "lo"]):
            side = t.column("side").to_numpy()
            sets, sizes = _sets(t, words)
            hub, others = int(np.flatnonzero(side == 0)[0]), np.flatnonzero(side == 1)
            both = np.array([len(np.intersect1d(sets[hub], sets[k], assume_unique=True)) for k in others], dtype=np.int64)
            linked = 100 * both >= percent * (sizes[hub] + sizes[others] - both)
            take = pa.array(others)
            yield pa.RecordBatch.from_arrays([*(pa.array(t.column(c).to_numpy()).take(take) for c in ("grp", "node")), pa.array(linked)], ["grp", "node", "linked"])

    by = ["grp", "lo"]
    return members.repartition(*by).sortWithinPartitions(*by).mapInArrow(compare, "grp long, node long, linked boolean")


def confirmed(members: DataFrame, words: int, percent: int) -> DataFrame:
    """members(grp, lo, hi, side, node, text) -> links (u, v) that join what is similar across the sides of each (grp, lo, hi).

    All pairs of one side with the other are compared on full sets; what is
    returned is a link from each document to the smallest that it is joined to
    here, not all pairs.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, vs = [], []
        for t in groups(batches, ["grp", "lo", "hi"]):
            side, node = (t.column(c).to_numpy() for c in ("side", "node"))
            one, two = (np.flatnonzero(side == k) for k in (0, 1))
            if not len(one) or not len(two):
                continue
            sets, sizes = _sets(t, words)
            both = overlaps([sets[k] for k in one], [sets[k] for k in two])
            union = sizes[one][:, None] + sizes[two][None, :] - both
            a, b = np.nonzero((100 * both >= percent * union) & (both > 0))
            order = np.argsort(node, kind="stable")
            rank = np.empty(len(node), dtype=np.int64)
            rank[order] = np.arange(len(node))
            root = rooted(len(node), np.stack([rank[one[a]], rank[two[b]]], axis=1))
            for k in np.flatnonzero(root != np.arange(len(node))):
                us.append(int(node[order[k]]))
                vs.append(int(node[order[root[k]]]))
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    by = ["grp", "lo", "hi"]
    return members.repartition(*by).sortWithinPartitions(*by).mapInArrow(compare, "u long, v long")


def near_duplicates(docs: DataFrame, percent: int = 85, words: int = 5, bands: int = 20, rows: int = 8, block_shingles: int = 200_000) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id, kept, row_key; one row per document.

    Documents are linked if the intersection of their sets of word shingles is
    at least percent of the union; component_id is the smallest doc_id that
    links reach, and kept marks the documents that have it themselves. Texts
    without words and nulls have an empty set and no link. Documents with a
    null doc_id are linked with nothing, have no component and are kept.
    Repeated rows are one document. Rows with one doc_id and different texts are
    judged text by text: row_key, a hash of doc_id and text, tells them apart.
    Other columns are ignored.

    1. Equal sets form a class; only its smallest doc_id goes on.
    2. Classes that agree in a band of min-max values share a bucket. Bands of 8
       of 160 values find a pair at 85 % with probability 0.998, more above.
       Buckets with the same members count once.
    3. All of a bucket are compared in full with its smallest, so a group of near
       copies takes one comparison each, however large it is. What isn't similar
       to that one is compared with all others of the bucket, in pairs of blocks
       of about block_shingles shingles.
    4. Components of the confirmed links.
    """
    signed_docs = spool(signatures(docs, words, bands, rows))
    set_of = ["n_shingles", "s1", "s2"]
    classes = signed_docs.where("n_shingles > 0 and doc_id is not null").groupBy(*set_of).agg(F.min(F.struct("doc_id", "_row")).alias("first"), F.first("keys").alias("keys"))
    # a class is named by its smallest doc_id; where several classes have the same, by the hash of its row, too
    classes = spool(classes.select(*set_of, F.col("first.doc_id").alias("doc"), F.col("first._row").alias("row"), "keys"))
    twice = classes.groupBy("doc").agg(F.count("*").alias("c"), F.min("row").alias("lowest")).where("c > 1").select("doc", "lowest")
    odd = classes.select("doc", "row").join(twice, "doc").where("row <> lowest").select("doc", "row", F.shiftrightunsigned("row", 2).bitwiseOR(F.lit(1 << 62)).alias("other"))
    classes = spool(classes.join(odd, ["doc", "row"], "left").withColumn("node", F.coalesce("other", "doc")).drop("other"))

    placed = classes.select("node", "n_shingles", F.posexplode("keys").alias("band", "key"))
    buckets = placed.groupBy("band", "key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("who"), F.min("node").alias("hub"), F.sum("n_shingles").alias("weight")).where("n > 1")
    once = buckets.groupBy("n", "who", "hub").agg(F.min(F.struct("band", "key")).alias("b"), F.first("weight").alias("weight")).select("b.band", "b.key", "hub", "weight")
    members = spool(placed.join(once, ["band", "key"]).select(F.xxhash64("band", "key").alias("grp"), "hub", "node", "n_shingles", "weight"))
    wanted = members.select("node").distinct().join(classes.select("node", "doc", "row"), "node").select("node", F.col("doc").alias("_doc"), F.col("row").alias("_key"))
    texts = docs.where("doc_id is not null").select("doc_id", "text", row_key().alias("_row"))
    texts = spool(texts.join(wanted, F.expr("doc_id = _doc and _row = _key")).select("node", "text").dropDuplicates(["node"]))

    parts = lambda weight: F.greatest(F.ceil(weight / block_shingles), F.lit(1)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    mine = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    pairs = members.where("node <> hub").select(F.col("hub").alias("grp"), "node", "n_shingles").distinct()
    hubs = pairs.groupBy("grp").agg(parts(F.sum("n_shingles")).alias("k"))
    star = pairs.join(hubs, "grp").select("grp", mine(F.col("k")).alias("lo"), F.lit(1).alias("side"), "node").union(hubs.select("grp", every(F.col("k")).alias("lo"), F.lit(0).alias("side"), F.col("grp").alias("node")))
    star = spool(with_hub(star.join(texts, "node"), words, percent))

    rest = members.join(star.where("not linked").select(F.col("grp").alias("hub"), "node"), ["hub", "node"], "left_semi").select("grp", "node", "n_shingles")
    sizes = rest.groupBy("grp").agg(parts(F.sum("n_shingles")).alias("i"))
    all_ = members.where("node <> hub").join(sizes, "grp").withColumn("j", parts(F.col("weight"))).select("grp", "node", "i", "j")
    left = rest.join(all_.select("grp", "node", "i", "j"), ["grp", "node"]).select("grp", mine(F.col("i")).alias("lo"), every(F.col("j")).alias("hi"), F.lit(0).alias("side"), "node")
    right = all_.select("grp", every(F.col("i")).alias("lo"), mine(F.col("j")).alias("hi"), F.lit(1).alias("side"), "node")
    more = confirmed(left.union(right).join(texts, "node"), words, percent)
    joined = components(star.where("linked").select(F.col("node").alias("u"), F.col("grp").alias("v")).union(more))
    discard(texts, members, star)

    named = classes.select(*set_of, "node", "doc").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("doc").alias("_least"))
    named = named.join(least, "component").select(*set_of, "_least")
    found = signed_docs.select("doc_id", F.col("_row").alias("row_key"), *set_of).join(named, set_of, "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("_least", "doc_id")))
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "row_key")
