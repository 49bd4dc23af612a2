"""TF-IDF vectors, sparse similarity joins, blended scores."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, stem
from ..session import cut


def rounded(value: Column, places: int = 3) -> Column:
    """Half up, in double arithmetic: scaled, rounded and scaled back, as SQL engines do.

    Spark's round() goes by the decimal that a double is shown as: 0.5115 is
    0.512 by that, though scaled it is 511.49999999999994, which is 0.511 elsewhere.
    """
    return F.round(value * float(10**places)) / float(10**places)


def term_counts(docs: DataFrame, key: str = "doc_id", text: str | Column = "text", stop_words=STOP_WORDS) -> DataFrame:
    """(key, text) -> key, term, tf."""
    text = F.col(text) if isinstance(text, str) else text
    words = docs.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z_][a-z0-9_]+"), F.lit(0))).alias("w")).select(key, F.btrim("w", F.lit("_")).alias("w"))
    kept = words.where((F.char_length("w") >= 3) & ~F.col("w").isin(*stop_words))
    return kept.select(key, stem(F.col("w")).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def weighted_text(*fields: tuple[str, int]) -> Column:
    """Fields joined by a blank, each as often as its weight says; nulls are left out."""
    return F.concat_ws(" ", *(F.col(name) for name, times in fields for _ in range(times)))


def idf(counts: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """term, idf = ln((1 + documents) / (1 + documents with the term)) + 1; documents without terms count."""
    total = docs.agg(F.count_distinct(key).alias("_n"))  # one row
    df = counts.groupBy("term").agg(F.count("*").alias("_df"))
    return df.join(F.broadcast(total)).select("term", (F.log((1 + F.col("_n")) / (1 + F.col("_df"))) + 1).alias("idf"))


def tfidf(counts: DataFrame, weights: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, term, weight = (1 + ln tf) * idf, of length 1 for each key; terms without an idf are left out.

    Squares are summed in the shuffle by key, not in a window over a document.
    """
    raw = counts.join(weights, "term").select(key, "term", ((1 + F.log("tf")) * F.col("idf")).alias("w"))
    norms = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_norm"))
    return raw.join(norms, key).select(key, "term", (F.col("w") / F.col("_norm")).alias("weight"))


class TfIdf:
    """The index of a corpus: docs(doc_id, text)."""

    def __init__(self, docs: DataFrame, key: str = "doc_id", text: str | Column = "text", stop_words=STOP_WORDS):
        self.docs, self.key, self.stop_words = docs, key, stop_words
        self._of(term_counts(docs, key, text, stop_words))

    def _of(self, counts: DataFrame) -> None:
        self.counts = counts
        self.idf = idf(counts, self.docs, self.key)
        self.vectors = tfidf(counts, self.idf, self.key)

    def counted_once(self) -> TfIdf:
        """Write counts, idf and vectors, each once: what is joined several times isn't worked out again."""
        self._of(cut(self.counts, "terms"))
        self.idf = cut(self.idf, "idf")
        self.vectors = cut(tfidf(self.counts, self.idf, self.key), "vectors")
        return self

    def query_vectors(self, inputs: DataFrame, key: str = "input_id", text: str | Column = "text") -> DataFrame:
        return tfidf(term_counts(inputs, key, text, self.stop_words), self.idf, key)

    def products(self, inputs: DataFrame, key: str = "input_id", text: str | Column = "text") -> DataFrame:
        """key, doc_id, term, product for all terms that an input and a document share."""
        return self.products_of(self.query_vectors(inputs, key, text), key)

    def products_of(self, queries: DataFrame, key: str = "input_id", pairs: DataFrame | None = None) -> DataFrame:
        """query_vectors() -> products; with pairs(key, doc_id) for these only."""
        q = queries.withColumnRenamed("weight", "_q")
        joined = q.join(self.vectors, "term") if pairs is None else pairs.select(key, self.key).distinct().join(q, key).join(self.vectors, [self.key, "term"])
        return joined.select(key, self.key, "term", (F.col("_q") * F.col("weight")).alias("product"))


def pair_cosines(index: TfIdf, queries: DataFrame, pairs: DataFrame, key: str = "input_id") -> DataFrame:
    """query_vectors(), pairs(key, doc_id) -> the pairs with cosine; those without a common term are left out."""
    return index.products_of(queries, key, pairs).groupBy(key, index.key).agg(F.sum("product").alias("cosine"))


def prefixes(vectors: DataFrame, weights: DataFrame, least: float, key: str) -> DataFrame:
    """vectors(key, term, weight) of length 1, weights(term, idf) -> key, term, rest: each vector's rarest terms, and how long it is from each on.

    A vector ends where it is shorter than `least`. Of the terms that two vectors
    share, in order of rarity, from the first one on their lengths times each
    other aren't less than their cosine; so a pair with a cosine of at least
    `least` has a common term in both prefixes at which the product is no less.
    """
    upto = F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy(key).orderBy("idf", F.desc("term")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return vectors.join(weights, "term").withColumn("rest", F.sqrt(upto)).where(F.col("rest") >= least - 1e-9).select(key, "term", "rest")


def levelled(left: DataFrame, right: DataFrame, least: float, base: float = 1.2) -> tuple[DataFrame, DataFrame]:
    """prefixes() of both sides, each with a level that they can be joined by, besides the term: what can't reach `least` doesn't meet.

    A row's level is the power of 1 / base that its length is at most. On the
    left a row comes for each level that, with its own, leaves `least` in reach.
    """
    level = F.floor(F.greatest(-F.log("rest"), F.lit(0.0)) / math.log(base)).cast("int")
    top = math.floor(math.log(1 / least) / math.log(base) + 1e-9)
    return left.where(level <= top).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(top) - level))).drop("rest"), right.withColumn("level", level).drop("rest")


def similar_pairs(left: DataFrame, right: DataFrame, by: list[str], since: str, until: str, most: int = 1000, ranges: int = 16) -> DataFrame:
    """left(by, since, ...), right(by, until, ...) -> the rows that meet by the columns `by`, with since < until (dates).

    A key with more than `most` rows on the right is dealt out by ranges of
    until; rows on the left go to the ranges that hold later dates only. So a
    key that everyone has is spread over tasks, and the pairs before the date
    are never made.
    """
    days = F.datediff(F.col(until), F.lit("1970-01-01").cast("date")).cast("double")
    bounds = right.select(days.alias("d")).stat.approxQuantile("d", [k / ranges for k in range(1, ranges)], 0.01)
    bucket = lambda d: sum((F.datediff(F.col(d), F.lit("1970-01-01").cast("date")) >= b).cast("int") for b in sorted(set(bounds))) if bounds else F.lit(0)
    hot = right.groupBy(*by).agg(F.count("*").alias("_c")).where(F.col("_c") > most).select(*by, F.lit(True).alias("_hot"))
    some = lambda df: df.join(hot, by, "left").withColumn("_hot", F.coalesce("_hot", F.lit(False)))
    from_ = F.when(F.col("_hot"), F.sequence(bucket(since), F.lit(len(set(bounds))))).otherwise(F.array(F.lit(0)))
    a = some(left).withColumn("_range", F.explode(from_)).drop("_hot")
    b = some(right).withColumn("_range", F.when(F.col("_hot"), bucket(until)).otherwise(0)).drop("_hot")
    return a.join(b, [*by, "_range"]).where(F.col(since) < F.col(until)).drop("_range")


def cosines(products: DataFrame, keys: list[str]) -> DataFrame:
    """Sum and largest single product for each pair."""
    return products.groupBy(*keys).agg(F.sum("product").alias("cosine"), F.max("product").alias("top_product"))


def top_k(scored: DataFrame, k: int, by: str, order: list[Column], rank: str = "rank") -> DataFrame:
    """The first k rows of each `by`; Spark cuts to k in each task before the shuffle."""
    return scored.withColumn(rank, F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col(rank) <= k)


def search(index: TfIdf, inputs: DataFrame, k: int, key: str = "input_id", text: str | Column = "text") -> DataFrame:
    """key, doc_id, cosine, rank: the k closest documents of each input, ties by id."""
    found = cosines(index.products(inputs, key, text), [key, index.key]).withColumn("cosine", F.round("cosine", 6)).where("cosine > 0")
    return top_k(found, k, key, [F.desc("cosine"), F.asc(index.key)]).select(key, index.key, "cosine", "rank")


def shared_terms(products: DataFrame, keys: list[str], k: int = 5) -> DataFrame:
    """keys, terms: the k terms with the largest products, ties by term descending."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(F.round("product", 9)), F.desc("term")))
    kept = products.withColumn("_n", nth).where(F.col("_n") <= k)
    terms = F.transform(F.array_sort(F.collect_list(F.struct("_n", "term"))), lambda x: x["term"])
    return kept.groupBy(*keys).agg(terms.alias("terms"))


def relation_strength(kind: Column | str, weight: Column | str) -> Column:
    """How much a document stands for a concept: introduces and proposes 1, extends 0.8, mentions up to 0.3."""
    k = F.col(kind) if isinstance(kind, str) else kind
    w = F.col(weight) if isinstance(weight, str) else weight
    return F.when(k.isin("INTRODUCES", "PROPOSES"), 1.0).when(k == "EXTENDS", 0.8).when(k == "MENTIONS", 0.3 * F.least(F.lit(1.0), 2 * w))


def specificity(strengths: DataFrame, concepts: DataFrame) -> DataFrame:
    """(concept, doc_id, strength), (concept) -> concept, linked, specificity; concepts without documents have 1."""
    counts = strengths.groupBy("concept").agg(F.count("*").alias("linked"), F.count_if(F.col("strength") >= 0.8).alias("_focus"))
    joined = concepts.select("concept").join(counts, "concept", "left").na.fill(0, ["linked", "_focus"])
    return joined.select("concept", "linked", (1 / (1 + F.log(1 + F.col("_focus") + 0.25 * F.col("linked")))).alias("specificity"))


def profile(matched: DataFrame, named: DataFrame, focus: DataFrame, specific: DataFrame) -> DataFrame:
    """Weights of each input's concepts.

    matched(input_id, concept), named(input_id, doc_id), focus(doc_id, concept)
    and specific(concept, linked, specificity) -> input_id, concept, weight. A
    concept that the text shows weighs its specificity, if any document is linked
    with it; one that a named document focuses on half of it, if the text doesn't
    show it.
    """
    own = matched.join(specific, "concept").where("linked > 0").select("input_id", "concept", F.col("specificity").alias("weight"), F.lit(0).alias("_o"))
    lent = named.join(focus, "doc_id").join(specific, "concept").select("input_id", "concept", (0.5 * F.col("specificity")).alias("weight"), F.lit(1).alias("_o"))
    return own.union(lent).groupBy("input_id", "concept").agg(F.min_by("weight", "_o").alias("weight"))


def concept_scores(weights: DataFrame, links: DataFrame, least: float = 0.6, key: str = "doc_id") -> DataFrame:
    """(input_id, concept, weight), (concept, key, strength) -> input_id, key, concept_score, via."""
    totals = weights.groupBy("input_id").agg(F.greatest(F.sum("weight"), F.lit(least)).alias("_total"))
    joined = weights.join(links, "concept").groupBy("input_id", key).agg(F.sum(F.col("weight") * F.col("strength")).alias("_s"), F.array_sort(F.collect_set("concept")).alias("via"))
    return joined.join(totals, "input_id").select("input_id", key, (F.col("_s") / F.col("_total")).alias("concept_score"), "via")


def blended(concept: DataFrame, cosine: DataFrame, weights: DataFrame, named: DataFrame | None = None, w_concept: float = 0.55, w_text: float = 0.45, saturation: float = 0.4, boost: float = 0.25, key: str = "doc_id") -> DataFrame:
    """Concept and wording scores of each (input, document) that has either, or is named: score unrounded.

    Inputs without weighted concepts go by wording alone. A named document gets the boost.
    """
    both = concept.select("input_id", key, "concept_score", "via").join(cosine.select("input_id", key, "cosine", "top_product"), ["input_id", key], "full_outer")
    if named is not None:
        both = both.join(named.select("input_id", key).distinct().withColumn("_named", F.lit(True)), ["input_id", key], "full_outer")
    else:
        both = both.withColumn("_named", F.lit(None).cast("boolean"))
    any_weight = weights.select("input_id").distinct().withColumn("_weighted", F.lit(True))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    wording = F.least(F.lit(1.0), zero("cosine") / saturation)
    score = F.when(F.col("_weighted"), w_concept * zero("concept_score") + w_text * wording).otherwise(wording) + F.when(F.col("_named"), F.lit(boost)).otherwise(0.0)
    out = both.join(any_weight, "input_id", "left")
    return out.select("input_id", key, score.alias("raw_score"), zero("concept_score").alias("concept_score"), zero("cosine").alias("cosine"), zero("top_product").alias("top_product"), F.coalesce("via", F.array().cast("array<string>")).alias("via"), F.coalesce("_weighted", F.lit(False)).alias("weighted"))


def score_documents(mixed: DataFrame, k: int | None = 10, above: float = 0.05, exclude: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """blended -> input_id, key, score, concept_score, cosine, via, rank: above the floor, rounded, then ranked; k = None: all, unranked."""
    if exclude is not None:
        mixed = mixed.join(exclude.select("input_id", key), ["input_id", key], "left_anti")
    kept = mixed.where(F.col("raw_score") > above).withColumn("score", F.round("raw_score", 3)).withColumn("concept_score", F.round("concept_score", 3)).withColumn("cosine", F.round("cosine", 3)).drop("raw_score")
    return top_k(kept, k, "input_id", [F.desc("score"), F.asc(key)]) if k else kept


def propagated(scored: DataFrame, edges: DataFrame, k: int | None = None, seeds: int = 5, spread: float = 0.25, key: str = "doc_id") -> DataFrame:
    """Each input's first `seeds` documents pass a share of their score along their edges(src, dst); parallel edges count each. k = None: all, unranked."""
    first = top_k(scored, seeds, "input_id", [F.desc("score"), F.asc(key)]).select("input_id", F.col(key).alias("src"), "score")
    passed = first.join(edges.select("src", "dst"), "src").groupBy("input_id", F.col("dst").alias(key)).agg(F.sum(spread * F.col("score")).alias("propagated"))
    joined = scored.select("input_id", key, "score").join(passed, ["input_id", key], "full_outer").na.fill(0.0, ["score", "propagated"])
    out = joined.withColumn("score", F.round(F.col("score") + F.col("propagated"), 3)).withColumn("propagated", F.round("propagated", 6))
    return top_k(out, k, "input_id", [F.desc("score"), F.asc(key)]) if k else out


def broad_wording(cosine: Column | str, top_product: Column | str, least: float = 0.25, share: float = 0.75) -> Column:
    """Wording alone counts if it is strong and no single term makes most of it."""
    c, t = (F.col(x) if isinstance(x, str) else x for x in (cosine, top_product))
    return (c >= least) & (t <= share * c)


def score_ideas(mixed: DataFrame, k: int = 6, least: float = 0.2, floor: float = 0.5, key: str = "idea_id") -> DataFrame:
    """blended (on ideas) -> ranked ideas: enough score, a shared concept or broad wording, not far below the best."""
    fits = (F.col("raw_score") >= least) & (~F.col("weighted") | (F.size("via") > 0) | broad_wording("cosine", "top_product"))
    kept = mixed.where(fits).withColumn("score", F.round("raw_score", 3)).withColumn("cosine", F.round("cosine", 3))
    first = top_k(kept, k, "input_id", [F.desc("score"), F.asc(key)])
    best = F.max("score").over(Window.partitionBy("input_id"))
    return first.withColumn("_best", best).where(F.col("score") >= floor * F.col("_best")).select("input_id", key, "score", "cosine", F.col("via").alias("shared_concepts"), "rank")
