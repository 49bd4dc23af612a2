"""Prefix trie of conversations, named and summed up by van Emde Boas recursion.

A block is the part of the trie between two depths a and a + 2m, below one node
at depth a. The recursion cuts every block in the middle, names what the
sequences have in common up to the cut, and goes on with the upper trie (each
name once) and the forests below the names, all blocks of one size in the same
jobs. A name is the smallest conversation that starts so, so that a node is
(name, depth). Blocks halve, so a trie of depth D takes log2(D) rounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, spool

#: Two hashes of a turn, together 128 bits, and its length.
LABEL = ("h1", "h2", "chars")


@dataclass
class Trie:
    """nodes(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved), ends(conv_id, depth, member): who ends at a node."""

    nodes: DataFrame
    ends: DataFrame


def numbered(conversations: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """conversations(conv_id, turn, role, text) -> conv_id, pos, LABEL and the columns `keep`: turns in their order, from 0.

    Null turns come first, equal turns go by role and text; null roles and texts
    are empty. Rows with a null conv_id belong to no conversation and are left out.

    Rows are put in order by ranges, so that a conversation of any length is
    spread over tasks, each of which numbers its own; what a conversation has in
    the ranges before is added from one row for each range that it is in.
    """
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = conversations.where("conv_id is not null").select("conv_id", F.col("turn").cast("long").alias("turn"), empty("role"), empty("text"))
    dealt = rows.repartitionByRange(F.col("conv_id"), F.col("turn").asc_nulls_first(), "role", "text").sortWithinPartitions(F.col("conv_id"), F.col("turn").asc_nulls_first(), "role", "text")
    label = [*(F.xxhash64(F.lit(k), "role", "text").alias(f"h{k}") for k in (1, 2)), F.char_length("text").cast("long").alias("chars")]
    placed = spool(dealt.select("conv_id", F.monotonically_increasing_id().alias("at"), *label, *keep))
    placed = placed.withColumn("range", F.shiftright("at", 33))
    firsts = placed.groupBy("conv_id", "range").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    firsts = firsts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return placed.join(firsts, ["conv_id", "range"]).select("conv_id", (F.col("at") - F.col("first") + F.col("before")).alias("pos"), *LABEL, *keep)


def rebuilt(turns: DataFrame, group: int = 100, lend: int = 6) -> tuple[DataFrame, DataFrame]:
    """turns(conv_id, pos, ...) -> (conv_id) of all conversations, and their turns, rebuilt.

    With h = crc32(decimal conv_id) % lend, a conversation starts with the first
    h turns of the first one of its group (conv_id - conv_id % group), all if it
    has fewer, none if there is no such conversation, and goes on with its own
    turns after its first h. So it may be left without any. At most lend - 1
    turns are lent to each.
    """
    rest = [c for c in turns.columns if c not in ("conv_id", "pos")]
    base = F.col("conv_id") - F.col("conv_id") % group
    lengths = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % lend).alias("h")
    bases = lengths.where(base == F.col("conv_id")).select(F.col("conv_id").alias("base"), "n")
    plan = lengths.select("conv_id", base.alias("base"), h).join(bases, "base", "left")
    plan = spool(plan.select("conv_id", "base", "h", F.least("h", F.coalesce("n", F.lit(0))).alias("lent")))
    own = turns.join(plan, "conv_id").where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("lent")).alias("pos"), *rest)
    first = turns.where(f"pos < {lend - 1}").where(base == F.col("conv_id")).withColumnRenamed("conv_id", "base")
    lent = plan.where("lent > 0").join(first, "base").where("pos < lent").select("conv_id", "pos", *rest)
    return plan.select("conv_id"), own.union(lent)


def _sum(x: Column, seed: int) -> Column:
    """A hash of a set of rows, in which each task's rows are summed before the shuffle."""
    return F.bit_xor(F.when(x, F.xxhash64(F.lit(seed), "pos", "h1", "h2")))


def prefix_trie(convs: DataFrame, turns: DataFrame) -> Trie:
    """convs(conv_id), turns(conv_id, pos, LABEL) -> the trie of all prefixes of the turns, with the root at depth 0.

    For each node: conv_id, the smallest of its members (the conversations that
    start so); parent_conv_id, the parent's; n_convs, members; n_children;
    n_leaves, nodes without children in its subtree (itself included); saved,
    over its subtree the sum of (n_convs - 1) * chars of the last turn. The last
    turn of a node is turn number depth of its conv_id. Conversations without
    turns are members of the root only; without conversations there is no node.
    Turns are told apart by 128-bit hashes.

    1. Equal conversations are one sequence with their number as weight.
    2. Down: a round for each block size 2m names the sequences that reach a
       block's middle by the hash of their turns up to there. The upper trie keeps
       the named one of each group, with the group's weight; the forests below
       keep the rest of each sequence. A sequence joins in at the first block
       that it reaches the middle of, so short ones take few rounds.
    3. Up: sums over blocks, the forest of each named node added to its block's top.
    4. Down again: what is below a node is its forest, and what is grafted at
       the forest's lower end, known from the rounds before.

    Sums and names are aggregates that each task makes first, so a turn or a
    conversation that a third of all share is no burden; no sequence, group or
    member list is ever in one row.
    """
    seqs = turns.groupBy("conv_id").agg(_sum(F.lit(True), 1).alias("k1"), _sum(F.lit(True), 2).alias("k2"), F.count("*").alias("len"))
    seqs = spool(convs.join(seqs, "conv_id", "left").na.fill(0, ["k1", "k2", "len"]))
    classes = spool(seqs.groupBy("k1", "k2", "len").agg(F.min("conv_id").alias("s"), F.count("*").alias("n")))
    members = seqs.join(classes, ["k1", "k2", "len"]).select("s", F.col("conv_id").alias("member"))
    total = classes.agg(F.min("s").alias("root"), F.sum("n").alias("n"), F.max("len").alias("depth")).first()  # one row
    if total.root is None:
        nodes = classes.select(*(F.lit(0).cast("long").alias(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved"))).where("false")
        return Trie(nodes, members.select(F.col("s").alias("conv_id"), F.lit(0).cast("long").alias("depth"), "member"))
    long = lambda x: F.lit(x).cast("long")
    rows = classes.where("len > 0").join(turns, F.col("s") == F.col("conv_id")).select(long(0).alias("a"), "s", long(total.root).alias("g"), "n", "pos", *LABEL, F.floor(F.log2("len")).cast("int").alias("k"))
    rows = spool(rows)
    rounds = (total.depth or 0).bit_length()

    # down: k, m = 2**k: blocks [a, a + 2m) are cut at a + m
    named: list[DataFrame] = []
    carried, old = None, []
    for k in reversed(range(rounds)):
        m = 1 << k
        active = rows.where(F.col("k") == k).drop("k")
        active = active if carried is None else carried.union(active)
        above = F.col("pos") < F.col("a") + m
        blocks = active.groupBy("a", "s").agg(F.first("g").alias("g"), F.first("n").alias("n"), F.count_if(above).alias("up"), F.count("*").alias("total"), _sum(above, 1).alias("k1"), _sum(above, 2).alias("k2"), F.max(F.when(F.col("pos") == F.col("a") + m - 1, F.col("chars"))).alias("chars"))
        reach = blocks.where(F.col("up") == m)
        names = reach.groupBy("a", "g", "k1", "k2").agg(F.min("s").alias("name"), F.sum("n").alias("n_all"))
        named.append(spool(reach.join(names, ["a", "g", "k1", "k2"]).select("a", "s", "g", "n", "total", "chars", "name", "n_all")))
        if not k:
            break
        cut = named[-1].select("a", "s", "name", "n_all")
        mine = active.join(cut, ["a", "s"], "left")
        is_above = F.col("pos") < F.col("a") + m
        kept = mine.where(~is_above | F.col("name").isNull() | (F.col("name") == F.col("s")))
        carried = spool(kept.select(F.when(is_above, F.col("a")).otherwise(F.col("a") + m).alias("a"), "s", F.when(is_above, F.col("g")).otherwise(F.col("name")).alias("g"), F.when(is_above, F.coalesce("n_all", "n")).otherwise(F.col("n")).alias("n"), "pos", *LABEL))
        old.append(carried)
    discard(*old)

    def cuts(k: int) -> DataFrame:
        """The nodes that round k named: conv_id, depth, g (the name of their block's top), n_convs, chars."""
        return named[rounds - 1 - k].where("s = name").select(F.col("name").alias("conv_id"), (F.col("a") + (1 << k)).alias("depth"), "g", F.col("n_all").alias("n_convs"), "chars")

    def through(k: int) -> DataFrame:
        """The nodes at the lower end of round k's blocks: conv_id, depth, and the name at the middle above them."""
        return named[rounds - 1 - k].where(F.col("total") == 2 << k).select(F.col("s").alias("conv_id"), (F.col("a") + (2 << k)).alias("depth"), "name")

    union = lambda frames: frames[0] if len(frames) == 1 else frames[0].union(union(frames[1:]))
    root = classes.limit(1).select(long(total.root).alias("conv_id"), long(0).alias("depth"), long(total.root).alias("g"), long(total.n).alias("n_convs"), long(0).alias("chars"))
    every = union([root, *map(cuts, range(rounds))]).drop("g")
    ends_at = [classes.where("len = 0").select("s", long(total.root).alias("conv_id"), long(0).alias("depth"))]
    ends_at += [t.where(F.col("total") == 1 << k).select("s", F.col("name").alias("conv_id"), (F.col("a") + (1 << k)).alias("depth")) for t, k in zip(named, reversed(range(rounds)), strict=True)]
    ends = members.join(union(ends_at), "s").select("conv_id", "depth", "member")
    if rounds:
        parents = cuts(0).select("conv_id", "depth", F.col("g").alias("parent")).union(through(0).select("conv_id", "depth", F.col("name").alias("parent")))
    else:
        parents = every.where("false").select("conv_id", "depth", F.col("conv_id").alias("parent"))
    children = parents.groupBy(F.col("parent").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = every.join(parents, ["conv_id", "depth"], "left").join(children, ["conv_id", "depth"], "left").na.fill(0, ["n_children"])
    nodes = spool(nodes.select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("chars")).alias("own")))

    # up: sums over the blocks of each size, by their tops
    at = ["conv_id", "depth"]
    summed = lambda df: df.groupBy(*at).agg(F.sum("leaf").alias("leaf"), F.sum("own").alias("own"))
    below = [spool(summed(nodes.where("depth > 0").select(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"), "leaf", "own")))]
    for k in range(rounds):
        m = 1 << k
        tops = below[-1].where(F.col("depth") % (2 * m) == 0)
        grafts = below[-1].join(cuts(k).select(*at, "g"), at).select(F.col("g").alias("conv_id"), (F.col("depth") - m).alias("depth"), "leaf", "own")
        below.append(spool(summed(tops.union(grafts))))
    # down: all that is below each named node
    found = [below[rounds]]
    for k in reversed(range(rounds)):
        m = 1 << k
        forests = below[k].where(F.col("depth") % (2 * m) == m)
        grafts = union(found).where("depth > 0").join(through(k), at).select(F.col("name").alias("conv_id"), (F.col("depth") - m).alias("depth"), "leaf", "own")
        found.append(spool(summed(forests.union(grafts))))
    totals = union(found).withColumnRenamed("leaf", "leaves").withColumnRenamed("own", "saved_below")
    out = nodes.join(totals, at, "left").na.fill(0, ["leaves", "saved_below"])
    out = out.select(*at, "parent_conv_id", "n_convs", "n_children", (F.col("leaf") + F.col("leaves")).alias("n_leaves"), (F.col("own") + F.col("saved_below")).alias("saved"))
    return Trie(out, ends)


def listed(ends: DataFrame, width: int = 4096) -> DataFrame:
    """ends(conv_id, depth, member) -> conv_id, depth, members_sha256: the hash of the node's members, ascending, joined by commas.

    Members are joined in pieces of at most `width` ids, since they are
    different integers. A hash runs over its whole list, so a node's pieces meet
    in one task, which reads them one after the other and holds one.
    """
    pieces = ends.groupBy("conv_id", "depth", F.floor(F.col("member") / width).alias("piece")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("member")), lambda x: x.cast("string")), ",").alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, hashed = None, None
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for *at, ids in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "depth", "ids")), strict=True):
                if at == key:
                    hashed.update(b",")
                else:
                    if key is not None:
                        for col, x in zip(out, (*key, hashed.hexdigest()), strict=True):
                            col.append(x)
                    key, hashed = at, hashlib.sha256()
                hashed.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], names)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([hashed.hexdigest()])], names)

    names = ["conv_id", "depth", "members_sha256"]
    return pieces.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "piece").mapInArrow(digest, "conv_id long, depth long, members_sha256 string")
