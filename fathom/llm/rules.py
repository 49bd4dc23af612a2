"""Quality rules whose cutoffs bound false rejection, stratum by stratum."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bytes_of, spool, window_hashes, word_hashes

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_BLANKS = b" \t\n\x0b\x0c\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lines")

#: Rule -> its signal, all shares or lengths that are high in poor texts.
RULES = {
    "symbols": "n_symbols / n_words",
    "dup_lines": "n_dup_lines / n_lines",
    "repeats": "n_repeat_words / n_words",
    "capitals": "n_upper / word_chars",
    "long_words": "word_chars / n_words",
}
#: The path of cutoffs, from lenient to strict: beyond the highest signal of good documents by a factor and a bit, then at quantiles of theirs.
BEYOND = ((2.0, 0.05), (1.5, 0.02), (1.2, 0.01), (1.0, 0.0))
QUANTILES = (0.9975, 0.995, 0.9925, 0.99, 0.985, 0.98, 0.975, 0.97, 0.96, 0.95)
STEPS = len(BEYOND) + len(QUANTILES)
#: Signals are counted in steps of a thousandth.
_UNIT = 1000


def counts_of(text: np.ndarray | None) -> tuple[int, ...]:
    """COUNTS of one text, given as UTF-8 bytes."""
    if text is None or not len(text):
        return (0,) * len(COUNTS)
    words = word_hashes(text)
    n = len(words)
    whole = text.tobytes()
    chars = int(np.count_nonzero((text & 0xC0) != 0x80)) - sum(whole.count(bytes([b])) for b in _BLANKS)
    lines = [x for x in whole.split(b"\n") if x.strip(_BLANKS)]
    repeated = 0
    if n >= 3:
        _, which, found = np.unique(window_hashes(words, 3), return_inverse=True, return_counts=True)
        starts = np.flatnonzero(found[which] > 1)
        covered = np.zeros(n, dtype=bool)
        for k in range(3):
            covered[starts + k] = True
        repeated = int(covered.sum())
    return n, chars, int(_SYMBOL[text].sum()), len(lines) - len(set(lines)), repeated, int(_UPPER[text].sum()), len(lines)


def count_signals(docs: DataFrame) -> DataFrame:
    """docs(doc_id, lang, text) -> doc_id, lang and COUNTS of the whole text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([counts_of(x) for x in bytes_of(batch.column("text"))], dtype=np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), *(pa.array(np.ascontiguousarray(x)) for x in rows.T)], ["doc_id", "lang", *COUNTS])

    return docs.select("doc_id", "lang", "text").mapInArrow(count, f"doc_id long, lang string, {', '.join(f'{c} long' for c in COUNTS)}")


def binomial_tail(k: int, n: int, rate: float) -> float:
    """P(X <= k) for X ~ Binomial(n, rate): the exact test that the true rate is below `rate`.

    It is at most d if and only if the exact (Clopper-Pearson) upper bound of
    level 1 - d on the rate, after k of n, is at most `rate`.
    """
    if k >= n * rate:
        return 1.0
    term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(rate) + (n - k) * math.log1p(-rate))
    total = 0.0
    while k >= 0 and term > total * 1e-17:
        total += term
        term *= k * (1 - rate) / ((n - k + 1) * rate)
        k -= 1
    return min(1.0, total)


def half_of(doc_id: str = "doc_id") -> Column:
    """Labelled documents of half 0 shape the cutoffs, those of half 1 test them."""
    return F.pmod(F.xxhash64(F.lit("half"), doc_id), F.lit(2)).cast("int")


def signal(rule: str) -> Column:
    return F.ceil(F.try_divide(*map(F.col, RULES[rule].split(" / "))) * _UNIT) / _UNIT


def paths(good: DataFrame) -> DataFrame:
    """good(lang, COUNTS) -> lang, rule, cutoffs: STEPS cutoffs of each rule, from lenient to strict.

    Made of exact counts of each thousandth of a signal, which are summed before they are shuffled.
    """
    each = F.explode(F.array(*(F.struct(F.lit(rule).alias("rule"), signal(rule).alias("at")) for rule in RULES))).alias("x")
    counts = good.select("lang", each).where("x.at is not null").groupBy("lang", "x.rule", "x.at").count()
    one = Window.partitionBy("lang", "rule")
    upto = counts.withColumn("upto", F.sum("count").over(one.orderBy("at"))).withColumn("total", F.sum("count").over(one))
    top = F.max("at")
    cutoffs = [*(top * k + more for k, more in BEYOND), *(F.min(F.when(F.col("upto") >= q * F.col("total"), F.col("at"))) for q in QUANTILES)]
    return upto.groupBy("lang", "rule").agg(F.array(*cutoffs).alias("cutoffs"))


def certified_cutoffs(signals: DataFrame, labels: DataFrame, limit: float = 0.05, risk: float = 0.05) -> DataFrame:
    """signals(doc_id, lang, COUNTS), labels(doc_id, quality) -> lang, rule, cutoff.

    A document of quality 1 is good. In each stratum (language; null is one of
    its own) all rules together may reject `limit` of the good documents. The
    rules become stricter together, step by step along paths() that one half of
    the good labelled documents gives: the other half tests each step, with all
    rules at once. A step counts as safe if the exact binomial test shows the
    limit at level risk / strata. Steps are tested from lenient to strict up to
    the first that fails (a fixed sequence), so their number needs no further
    correction. Of the safe ones the one that rejects the most poor documents,
    net of good ones, is chosen, and the more lenient of equals; strata in which
    none is safe, or none helps, stay out. A doc_id with several labels has the
    lowest. With probability 1 - risk all chosen steps keep the limit.
    """
    labels = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    labelled = signals.where("n_words > 0").join(labels, "doc_id").withColumn("_half", half_of())
    of = spool(paths(labelled.where("_half = 0 and quality = 1"))).withColumnRenamed("lang", "_lang")
    by_lang = of.groupBy("_lang").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoffs"))).alias("_of"))  # a row for each language
    # the number of steps that reject it: the strictest ones
    def rejecting(rule: str) -> Column:
        return F.size(F.filter(F.coalesce(F.col("_of")[rule], F.array().cast("array<double>")), lambda c: signal(rule) > c))

    level = F.greatest(F.lit(0), *map(rejecting, RULES))
    tested = labelled.where("_half = 1").join(by_lang, F.expr("lang <=> _lang")).select("lang", "quality", level.alias("level"))
    counted = tested.groupBy("lang", "level").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("poor"))
    strata = labelled.agg(F.count_distinct(F.coalesce("lang", F.lit("")), F.col("lang").isNull()).alias("strata"))  # one row

    def choose(key: tuple, rows: pa.Table) -> pa.Table:
        step = chosen_step(*(rows.column(c).to_numpy() for c in ("level", "good", "poor")), limit, risk / rows.column("strata")[0].as_py())
        found = [] if step is None else [{"lang": key[0].as_py(), "step": step}]
        return pa.Table.from_pylist(found, pa.schema([("lang", pa.string()), ("step", pa.int32())]))

    steps = counted.join(F.broadcast(strata)).groupBy("lang").applyInArrow(choose, "lang string, step int")
    return steps.join(of, F.expr("lang <=> _lang")).select("lang", "rule", F.get("cutoffs", F.col("step")).alias("cutoff"))


def chosen_step(level: np.ndarray, good: np.ndarray, poor: np.ndarray, limit: float, risk: float) -> int | None:
    """good and poor documents by the number of steps that reject them -> the best safe step."""
    best, goods, poors = None, int(good.sum()), int(poor.sum())
    for step in range(STEPS):
        gone = level >= STEPS - step
        lost = int(good[gone].sum())
        if not goods or binomial_tail(lost, goods, limit) > risk:
            break
        gain = int(poor[gone].sum()) / max(poors, 1) - lost / goods
        if gain > (best[0] if best else 0):
            best = gain, step
    return best[1] if best else None


def apply_rules(docs: DataFrame, labels: DataFrame, limit: float = 0.05, risk: float = 0.05, min_words: int = 50, max_repeats: float = 0.5) -> DataFrame:
    """docs(doc_id, lang, text), labels(doc_id, quality) -> one row per document with its counts and verdict.

    base_failed: fewer than min_words words, or more than max_repeats of them
    in three-word windows that the text holds twice or more. kept: not
    base_failed, and within its stratum's certified cutoffs. failed_rules names
    those that it exceeds. Null and empty texts have no words. Repeated rows
    give repeated rows; without labels only the base rules decide.
    """
    signals = spool(count_signals(docs))
    cutoffs = certified_cutoffs(signals, labels, limit, risk).groupBy(F.col("lang").alias("_lang")).agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("_cutoffs"))
    exceeds = [F.when((F.col("n_words") > 0) & (signal(rule) > F.col("_cutoffs")[rule]), F.lit(rule)) for rule in RULES]
    base = (F.col("n_words") < min_words) | (F.col("n_repeat_words") > max_repeats * F.col("n_words"))
    judged = signals.join(cutoffs, F.expr("lang <=> _lang"), "left").withColumn("failed_rules", F.array_compact(F.array(*exceeds))).withColumn("base_failed", base)
    return judged.select("doc_id", "lang", *COUNTS, "base_failed", "failed_rules", (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"))
