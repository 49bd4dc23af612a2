"""Near-duplicate vectors by Euclidean p-stable hashing, confirmed by cosine."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, groups, mix, rooted, spool
from .components import components

_SEED = 20240613


def hashed(vectors: DataFrame, tables: int, projections: int, width: float) -> DataFrame:
    """vectors(node, vector) -> the same and keys: in each table the cells of `projections` quantised random projections."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, sizes = batch.column("vector").flatten().to_numpy().astype(np.float64), np.diff(batch.column("vector").offsets.to_numpy())
            keys = np.zeros((len(sizes), tables), dtype=np.uint64)
            starts = np.concatenate([[0], np.cumsum(sizes)])
            for dims in np.unique(sizes):
                rows = np.flatnonzero(sizes == dims)
                rng = np.random.default_rng([_SEED, int(dims)])
                towards, shift = rng.standard_normal((int(dims), tables * projections)), rng.uniform(0, width, tables * projections)
                salt = mix(np.arange(1, tables * projections + 1, dtype=np.uint64)) | np.uint64(1)
                for at in range(0, len(rows), 512):
                    own = rows[at : at + 512]
                    x = np.stack([flat[starts[k] : starts[k + 1]] for k in own])
                    x /= np.abs(x).max(1, keepdims=True)  # so that squares neither vanish nor overflow
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    cell = np.floor((x @ towards + shift) / width).astype(np.int64).view(np.uint64)
                    keys[own] = mix((mix(cell) * salt).reshape(len(own), tables, projections).sum(2, dtype=np.uint64))
            at = pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * tables)
            short = pa.array((keys.reshape(-1) >> np.uint64(32)).astype(np.uint32).view(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(at, short)], [*batch.schema.names, "keys"])

    return vectors.mapInArrow(cells, vectors.withColumn("keys", F.array().cast("array<int>")).schema)


def same_cell(distance: float, width: float) -> float:
    """The probability that vectors at a distance share the cell of one projection."""
    t = width / distance
    return math.erf(t / math.sqrt(2)) - math.sqrt(2 / math.pi) / t * (1 - math.exp(-t * t / 2))


def tables_for(n: int, least: float, width: float, recall: float, mates: float = 64.0) -> tuple[int, int]:
    """How many tables of how many projections find a pair at the least cosine with this probability.

    Of n vectors of a label about `mates` that are at right angles share a bucket with each.
    """
    far, near = same_cell(math.sqrt(2), width), same_cell(math.sqrt(2 - 2 * least), width)
    projections = max(8, math.ceil(math.log(max(n, 1) / mates) / -math.log(far))) if n > mates else 8
    return math.ceil(math.log(1 - recall) / math.log1p(-(near**projections))), projections


def compared(buckets: DataFrame, least: float) -> DataFrame:
    """buckets(band, label, dims, key, lo, hi, side, node, class, size, vector, keys) -> node, class, links, root.

    All vectors of a bucket have `dims` components; keys are those of the bands before.

    links: vectors that the node is linked to here; root: the smallest node that
    it is joined to here. A pair counts in the first table that both share, so
    over all buckets it counts once.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, list, list, list] = ([], [], [], [])
        for t in groups(batches, ["band", "label", "dims", "key", "lo", "hi"]):
            t = t.combine_chunks()
            side, node, size = (t.column(c).to_numpy() for c in ("side", "node", "size"))
            same = t.column("lo")[0].as_py() == t.column("hi")[0].as_py()
            if t.num_rows < 2:
                continue
            matrix = lambda name: t.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
            keys = matrix("keys")
            one = np.flatnonzero(side == 0)
            two = one if same else np.flatnonzero(side == 1)
            if not len(one) or not len(two):
                continue
            unit = matrix("vector").astype(np.float64)
            unit /= np.abs(unit).max(1, keepdims=True)
            unit /= np.linalg.norm(unit, axis=1, keepdims=True)
            i, j = np.nonzero(unit[one] @ unit[two].T >= least)
            first = (i < j) if same else np.ones(len(i), dtype=bool)
            i, j = one[i[first]], two[j[first]]
            pairs = []
            for lo in range(0, len(i), 1 << 16):
                p, q = i[lo : lo + (1 << 16)], j[lo : lo + (1 << 16)]
                new = ~(keys[p] == keys[q]).any(1)
                pairs.append(np.stack([p[new], q[new]], axis=1))
            if not pairs or not sum(map(len, pairs)):
                continue
            pairs = np.concatenate(pairs)
            links = np.zeros(len(node), dtype=np.int64)
            np.add.at(links, pairs[:, 0], size[pairs[:, 1]])
            np.add.at(links, pairs[:, 1], size[pairs[:, 0]])
            order = np.argsort(node, kind="stable")
            rank = np.empty(len(node), dtype=np.int64)
            rank[order] = np.arange(len(node))
            root = rooted(len(node), rank[pairs])
            hit = np.flatnonzero(links)
            out[0].extend(node[hit].tolist())
            out[1].extend(t.column("class").to_numpy()[hit].tolist())
            out[2].extend(links[hit].tolist())
            out[3].extend(node[order[root[rank[hit]]]].tolist())
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["node", "class", "links", "root"])

    by = ["band", "label", "dims", "key", "lo", "hi"]
    return buckets.repartition(*by).sortWithinPartitions(*by).mapInArrow(compare, "node long, class long, links long, root long")


def near_vectors(vectors: DataFrame, least: float = 0.93, recall: float = 0.99, width: float = 3.0, tables: int | None = None, projections: int | None = None, block: int = 500) -> DataFrame:
    """vectors(vec_id, embedding, label) -> vec_id, n_links, component_id, kept; one row per vector.

    Vectors of one label whose cosine, in double precision, is at least `least`
    are linked. n_links: other vectors linked directly; component_id: the
    smallest vec_id that links reach; kept: it is the vector's own. Vectors that
    are null, empty or zero, or have null or non-finite components, and those
    with a null label or vec_id, are linked with nothing. Vectors of different
    lengths aren't linked. Rows with equal vec_ids count as several vectors, each
    with its own links, and share their component and whether they are kept, rows
    that link with nothing among them. Other columns are ignored.

    Equal vectors of a label form a class, of which one goes on. Random
    projections onto cells of the given width put the normalised vectors into
    sets of buckets; what shares a bucket and label is compared, large buckets in
    pairs of blocks. At the least cosine a pair shares a bucket with probability
    `recall`, more above. Unless they are given, the number of projections grows
    with the logarithm of the largest label, so that buckets stay small, and that
    of tables as the recall then needs. A bucket gives each vector's number of
    links and one joined to it, never its pairs.
    """
    fine = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    whole = vectors.where("vec_id is not null and label is not null").where(fine).select("vec_id", "label", F.col("embedding").alias("vector"))
    # -0.0 and 0.0 are one number
    whole = whole.withColumn("vector", F.transform("vector", lambda x: F.when(x == 0, F.lit(0).cast(vectors.schema["embedding"].dataType.elementType)).otherwise(x)))
    classes = spool(whole.groupBy("label", "vector").agg(F.min("vec_id").alias("node"), F.count("*").alias("size"), F.min(F.xxhash64("label", "vector")).alias("class")))
    if tables is None or projections is None:
        most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
        tables, projections = tables_for(most, least, width, recall)
    keyed = spool(hashed(classes, tables, projections, width))
    places = keyed.select("node", "class", "label", F.size("vector").alias("dims"), F.posexplode("keys").alias("band", "key"))
    at = ["band", "label", "dims", "key"]
    shared = places.groupBy(*at).agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).drop("n")
    mine = F.pmod("class", F.col("blocks")).cast("int")
    dealt = places.join(shared, at).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(*at, "node", "class", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), (F.col("mine") > F.col("other")).cast("int").alias("side"))
    # only vectors that share a bucket travel, each with the keys of the bands before, which say whether a pair has been met
    joined = dealt.join(keyed.drop("label"), ["node", "class"]).withColumn("keys", F.slice("keys", 1, F.col("band")))
    found = spool(compared(joined, least))
    discard(keyed)

    links = found.groupBy("node", "class").agg(F.sum("links").alias("links"))
    # a vec_id of several classes joins them
    of = whole.join(classes.select("label", "vector", "node", "class"), ["label", "vector"]).select("vec_id", "label", "node", "class")
    several = of.groupBy("vec_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("vec_id").join(of, "vec_id").select(F.col("vec_id").alias("u"), F.col("node").alias("v"))
    joined = components(found.where("root <> node").select(F.col("node").alias("u"), F.col("root").alias("v")).union(several).distinct())
    named = classes.select("node", "class", "label", "size").join(links, ["node", "class"], "left").join(joined, "node", "left")
    named = named.select("node", "class", "label", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    mine = of.join(named, ["node", "class", "label"]).select("vec_id", "n_links", "component_id")
    rest = vectors.where(~F.coalesce(fine & F.col("vec_id").isNotNull() & F.col("label").isNotNull(), F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    # rows that link with nothing may have the id of others
    both = mine.withColumn("_c", F.col("component_id")).union(rest.withColumn("_c", F.lit(None).cast("long")))
    least_of = both.where("_c is not null").groupBy(F.col("vec_id").alias("_v")).agg(F.min("_c").alias("_least"))
    out = both.join(least_of, F.expr("vec_id = _v"), "left").select("vec_id", "n_links", F.coalesce("_least", "component_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
