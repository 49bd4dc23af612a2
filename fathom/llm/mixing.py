"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Carried, row_key, spool


def n_words(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float, epochs: float) -> DataFrame:
    """(source, weight, source_size) -> the same with target.

    Sources stop at epochs times their size; what they don't take goes to the
    others by weight, until none is above. With the sources in order of cap by
    weight, those that stop are a prefix, so one pass over running sums finds
    the level that the repeated clamping ends at.
    """
    sizes = sizes.withColumn("cap", epochs * F.col("source_size"))
    by_ratio = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_last())
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    filled = sizes.withColumn("level", level)
    rank = F.row_number().over(by_ratio)
    ranked = filled.withColumn("_rank", rank)
    water = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("_rank", "level"))).over(everything)["level"]
    return ranked.withColumn("_water", water).select("source", "weight", "source_size", F.coalesce(F.least("cap", F.col("_water") * F.col("weight")), "cap").alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, epochs: float = 2.0, seed: int = 17, steps: int = 1024) -> DataFrame:
    """docs(doc_id, source, text, ...) -> docs with size, source_size, target, repeats, taken.

    Sources, by code point and null last, get the weights in turn. The mix has
    share times the words of all documents. Each document is taken the whole
    number of times that its source repeats, and once more if its place in the
    source's seeded order is before the point where the rest of the target is
    reached: repeats says how often, taken how many words.

    That point is found without sorting a source: the words of each of `steps`
    ranges (more for very many documents) of a document's seeded hash are summed,
    and only the range in which the target falls is put in order. Sources miss their target by one document
    at most, whatever the size. The order depends on doc_id and text alone, so
    reruns agree. Null or empty texts have no words and are never taken; equal
    rows are equal neighbours in the order. An empty table gives no rows. Other
    columns pass through.
    """
    made = ["size", "source_size", "target", "repeats", "taken"]
    carried = Carried(docs, ["doc_id", "source", "text"], made)
    docs = carried.docs
    hashed = F.xxhash64(F.lit(seed), "doc_id", "text")
    sized = docs.select("doc_id", "source", row_key().alias("_row"), n_words("text").alias("size"), hashed.alias("_h")).where("size > 0")
    sized = spool(sized)
    steps = max(steps, sized.count() >> 17)
    sized = sized.withColumn("_step", F.pmod("_h", F.lit(steps)).cast("int"))
    per_step = spool(sized.groupBy("source", "_step").agg(F.sum("size").alias("words")))
    every = docs.select("source").distinct()
    sums = per_step.groupBy(F.col("source").alias("s")).agg(F.sum("words").alias("words"))
    sources = every.join(sums, F.expr("source <=> s"), "left").select("source", F.coalesce("words", F.lit(0)).alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int"))
    plan = spool(targets(sources.withColumn("weight", weight), share, epochs).withColumn("whole", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.floor(F.lit(epochs)))).otherwise(0)).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")))

    upto = Window.partitionBy("source").orderBy("_step")
    cut = per_step.withColumn("upto", F.sum("words").over(upto)).join(plan.select(F.col("source").alias("s"), "rest"), F.expr("source <=> s"))
    cut = cut.where("upto - words <= rest and rest < upto").select("source", F.col("_step").alias("cut"), (F.col("rest") - F.col("upto") + F.col("words")).alias("room"))
    plan = plan.join(cut.withColumnRenamed("source", "s"), F.expr("source <=> s"), "left").drop("s")
    edge = sized.join(cut.withColumnRenamed("source", "s"), F.expr("source <=> s and _step = cut")).withColumn("upto", F.sum("size").over(Window.partitionBy("source").orderBy("_h", "doc_id", "_row").rowsBetween(Window.unboundedPreceding, 0)))
    # the document that crosses the target is taken if that brings the sum nearer
    edge = edge.where("upto - size / 2.0 <= room").groupBy("source").agg(F.max(F.struct("_h", "doc_id", "_row")).alias("mark"))
    plan = spool(plan.join(edge.withColumnRenamed("source", "s"), F.expr("source <=> s"), "left").drop("s"))

    mine = docs.withColumn("size", n_words("text")).withColumn("_h", hashed).withColumn("_row", row_key())
    joined = mine.join(plan.withColumnRenamed("source", "_s"), F.expr("source <=> _s"))
    step, here = F.pmod("_h", F.lit(steps)), F.struct("_h", "doc_id", "_row")
    extra = F.coalesce((step < F.col("cut")) | ((step == F.col("cut")) & (here <= F.col("mark"))), F.lit(False))
    repeats = F.when(F.col("size") == 0, 0).otherwise(F.col("whole") + extra.cast("long")).cast("long")
    return joined.withColumn("repeats", repeats).withColumn("taken", F.col("size") * F.col("repeats")).select(*carried.columns(), *made)
