"""Retrieval, relations, expansion, evaluation and summaries, run over the given tables.

Orders stand for documents (created, outcome), parts for concepts, suppliers and
customers for people; benchmark items are inputs to the corpus of documents.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluate, expand, relations, retrieval, summary
from .registry import ORACLES, query, table
from .text_queries import WORDS, scratch, terms_sql

# ---------------------------------------------------------------- TF-IDF

TFIDF = f"""dtf AS (SELECT doc_id, term, count(*) AS tf FROM ({terms_sql(WORDS, "doc_id")}) GROUP BY doc_id, term),
total AS (SELECT count(DISTINCT doc_id) AS n FROM documents),
idf AS (SELECT term, ln((1.0 + n) / (1 + count(*))) + 1 AS idf FROM dtf, total GROUP BY term, n),
dw AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS w FROM dtf JOIN idf USING (term)),
dvec AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM dw),
qtf AS (SELECT item_id, term, count(*) AS tf FROM ({terms_sql(WORDS.replace("doc_id", "item_id").replace("documents", "benchmark"), "item_id")}) GROUP BY item_id, term),
qw AS (SELECT item_id, term, (1 + ln(tf)) * idf AS w FROM qtf JOIN idf USING (term)),
qvec AS (SELECT item_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS w FROM qw),
prod AS (SELECT item_id, doc_id, term, q.w * d.w AS product FROM qvec q JOIN dvec d USING (term)),
cos AS (SELECT item_id, doc_id, sum(product) AS cosine, max(product) AS top_product FROM prod GROUP BY item_id, doc_id)"""


def _index(spark, sf_dir):
    return retrieval.TfIdf(table(spark, sf_dir, "documents")).counted_once()


def _inputs(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("input_id"), "text")


@query(f"WITH {TFIDF} SELECT doc_id, term, round(w, 6) AS weight FROM dvec")
def e1_tfidf_vectors(spark, sf_dir):
    return retrieval.TfIdf(table(spark, sf_dir, "documents")).vectors.withColumn("weight", F.round("weight", 6))


@query(f"""WITH {TFIDF}, ranked AS (SELECT item_id, doc_id, round(cosine, 6) AS cosine, row_number() OVER (PARTITION BY item_id ORDER BY round(cosine, 6) DESC, doc_id) AS rank FROM cos WHERE round(cosine, 6) > 0)
SELECT item_id, doc_id, cosine, rank FROM ranked WHERE rank <= 10""")
def e2_closest_documents(spark, sf_dir):
    found = retrieval.search(_index(spark, sf_dir), _inputs(spark, sf_dir), 10)
    return found.withColumnRenamed("input_id", "item_id")


@query(f"""WITH {TFIDF}, ranked AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY round(cosine, 6) DESC, doc_id) AS rank FROM cos),
nth AS (SELECT p.*, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY round(product, 9) DESC, term DESC) AS n FROM prod p JOIN ranked USING (item_id, doc_id) WHERE rank <= 3)
SELECT item_id, doc_id, string_agg(term, ',' ORDER BY n) AS terms FROM nth WHERE n <= 5 GROUP BY item_id, doc_id""")
def e3_shared_terms(spark, sf_dir):
    index, pair = _index(spark, sf_dir), ["input_id", "doc_id"]
    queries = expand.cut(index.query_vectors(_inputs(spark, sf_dir)), "queries")
    found = retrieval.cosines(index.products_of(queries), pair).withColumn("c", F.round("cosine", 6))
    top = retrieval.top_k(found, 3, "input_id", [F.desc("c"), F.asc("doc_id")]).select(*pair)
    shared = retrieval.shared_terms(index.products_of(queries, pairs=top), pair)
    return shared.select(F.col("input_id").alias("item_id"), "doc_id", F.array_join("terms", ",").alias("terms"))


@query(f"""SELECT p_partkey, term, count(*) AS tf FROM ({terms_sql("SELECT p_partkey, trim(unnest(regexp_extract_all(lower(p_name || ' ' || p_name || ' ' || p_name || ' ' || p_brand || ' ' || p_type || ' ' || p_type), '[a-z_][a-z0-9_]+')), '_') AS w FROM part", "p_partkey")}) GROUP BY p_partkey, term""")
def e4_weighted_fields(spark, sf_dir):
    text = retrieval.weighted_text(("p_name", 3), ("p_brand", 1), ("p_type", 2))
    return retrieval.term_counts(table(spark, sf_dir, "part"), "p_partkey", text)


# ------------------------------------------------------- orders as documents

META = """meta AS (SELECT o_orderkey AS doc_id, o_orderdate::DATE AS created, year(o_orderdate) AS year, CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'P' THEN 'failed' ELSE 'open' END AS outcome FROM orders)"""
SCORES = """scores AS (SELECT l_orderkey AS doc_id, p_type AS concept, round(sum(l_extendedprice), 2) AS weight, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
focused AS (SELECT *, weight >= 0.35 * top AND weight >= 6 AND nth <= 4 AS focus, round(weight / top, 3) AS share FROM (SELECT *, max(weight) OVER (PARTITION BY doc_id) AS top, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, concept) AS nth FROM scores))"""
LINEAGE = f"""{META}, {SCORES}, firsts AS (SELECT concept, doc_id AS first FROM (SELECT concept, doc_id, row_number() OVER (PARTITION BY concept ORDER BY created NULLS FIRST, doc_id) AS k FROM focused JOIN meta USING (doc_id) WHERE focus AND outcome = 'accepted') WHERE k = 1),
lineage AS (SELECT * FROM (SELECT doc_id, concept, share, n, CASE WHEN focus AND outcome = 'accepted' AND doc_id = first THEN 'INTRODUCES' WHEN focus AND outcome = 'accepted' THEN 'EXTENDS' WHEN focus THEN 'PROPOSES' WHEN n >= 2 OR weight >= 3 THEN 'MENTIONS' END AS relation
 FROM focused JOIN meta USING (doc_id) LEFT JOIN firsts USING (concept)) WHERE relation IS NOT NULL),
strengths AS (SELECT concept, doc_id, strength FROM (SELECT *, CASE relation WHEN 'EXTENDS' THEN 0.8 WHEN 'MENTIONS' THEN 0.3 * least(1.0, 2 * share) ELSE 1.0 END AS strength FROM lineage) WHERE strength > 0),
spec AS (SELECT concept, linked, 1 / (1 + ln(1 + focus + 0.25 * linked)) AS specificity FROM (SELECT c.concept, count(doc_id) AS linked, count(*) FILTER (WHERE strength >= 0.8) AS focus FROM (SELECT DISTINCT p_type AS concept FROM part) c LEFT JOIN strengths USING (concept) GROUP BY c.concept))"""


def _meta(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    outcome = F.when(F.col("o_orderstatus") == "F", "accepted").when(F.col("o_orderstatus") == "P", "failed").otherwise("open")
    return o.select(F.col("o_orderkey").alias("doc_id"), F.to_date("o_orderdate").alias("created"), F.year("o_orderdate").alias("year"), outcome.alias("outcome"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("customer"), F.col("o_totalprice").alias("price"), "o_orderpriority")


def _focused(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    scores = lines.groupBy(F.col("l_orderkey").alias("doc_id"), F.col("p_type").alias("concept")).agg(F.round(F.sum("l_extendedprice"), 2).alias("weight"), F.count("*").alias("n"))
    return _focus_of(scores.withColumn("headed", F.lit(False)).withColumn("titled", F.lit(False)))


def _focus_of(scores):
    return relations.focus(scores)


def _lineage(spark, sf_dir):
    return relations.lineage(_focused(spark, sf_dir), _meta(spark, sf_dir))


def _strengths(lineage):
    return lineage.withColumn("strength", retrieval.relation_strength("relation", "share")).where("strength > 0").select("concept", "doc_id", "strength")


@query(f"WITH {LINEAGE} SELECT concept, doc_id, round(strength, 6) AS strength FROM strengths")
def e5_relation_strength(spark, sf_dir):
    return _strengths(_lineage(spark, sf_dir)).withColumn("strength", F.round("strength", 6))


@query(f"WITH {LINEAGE} SELECT concept, linked, round(specificity, 6) AS specificity FROM spec")
def e6_specificity(spark, sf_dir):
    concepts = table(spark, sf_dir, "part").select(F.col("p_type").alias("concept")).distinct()
    return retrieval.specificity(_strengths(_lineage(spark, sf_dir)), concepts).withColumn("specificity", F.round("specificity", 6))


#: Customers are inputs: the parts of the segment's letter are what they name, and their largest order is named by id.
PROFILE = f"""{LINEAGE}, matched AS (SELECT DISTINCT c_custkey AS input_id, p_type AS concept FROM customer JOIN part ON left(p_type, 1) = chr(65 + (c_custkey % 26)::INT)),
named AS (SELECT o_custkey AS input_id, max(o_orderkey) AS doc_id FROM orders GROUP BY o_custkey),
weights AS (SELECT input_id, concept, first(weight ORDER BY o) AS weight FROM (
 SELECT input_id, concept, specificity AS weight, 0 AS o FROM matched JOIN spec USING (concept) WHERE linked > 0
 UNION ALL SELECT input_id, concept, 0.5 * specificity, 1 FROM named JOIN focused USING (doc_id) JOIN spec USING (concept) WHERE focus) GROUP BY input_id, concept)"""


def _profile(spark, sf_dir, focused, lineage):
    customers, parts = table(spark, sf_dir, "customer"), table(spark, sf_dir, "part").select(F.col("p_type").alias("concept")).distinct()
    letter = F.char(65 + F.col("c_custkey") % 26)
    matched = customers.select(F.col("c_custkey").alias("input_id"), letter.alias("l")).join(parts, F.col("l") == F.substring("concept", 1, 1)).select("input_id", "concept")
    named = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("input_id")).agg(F.max("o_orderkey").alias("doc_id"))
    weights = retrieval.profile(matched, named, focused.where("focus").select("doc_id", "concept"), retrieval.specificity(_strengths(lineage), parts))
    return matched, named, weights


@query(f"WITH {PROFILE} SELECT input_id, concept, round(weight, 6) AS weight FROM weights")
def e7_profile(spark, sf_dir):
    focused = _focused(spark, sf_dir)
    weights = _profile(spark, sf_dir, focused, relations.lineage(focused, _meta(spark, sf_dir)))[2]
    return weights.withColumn("weight", F.round("weight", 6))


#: Documents by language and source: two concepts each; inputs weigh languages by their id.
BLEND = f"""{TFIDF}, weights AS (SELECT item_id, lang AS concept, 1.0 / (1 + item_id % 3) AS weight FROM benchmark JOIN (SELECT DISTINCT lang FROM documents) ON item_id % 4 <> length(lang) % 4 + 1 AND ascii(lang) % 5 = item_id % 5),
conc AS (SELECT item_id, doc_id, sum(weight * strength) / greatest(any_value(total), 0.6) AS concept_score FROM weights JOIN (SELECT lang AS concept, doc_id, CASE WHEN doc_id % 3 = 0 THEN 1.0 ELSE 0.8 END AS strength FROM documents) USING (concept) JOIN (SELECT item_id, sum(weight) AS total FROM weights GROUP BY item_id) USING (item_id) GROUP BY item_id, doc_id),
mixed AS (SELECT item_id, doc_id, CASE WHEN EXISTS (SELECT 1 FROM weights w WHERE w.item_id = b.item_id) THEN 0.55 * concept + 0.45 * wording ELSE wording END + CASE WHEN doc_id = 7 * item_id THEN 0.25 ELSE 0 END AS raw, concept, cosine, top_product FROM (
 SELECT item_id, doc_id, coalesce(concept_score, 0) AS concept, coalesce(cosine, 0) AS cosine, coalesce(top_product, 0) AS top_product, least(1.0, coalesce(cosine, 0) / 0.4) AS wording FROM conc FULL JOIN cos USING (item_id, doc_id) FULL JOIN (SELECT item_id, 7 * item_id AS doc_id FROM benchmark) USING (item_id, doc_id)) b),
scored AS (SELECT item_id, doc_id, round(raw, 3) AS score, round(concept, 3) AS concept_score, round(cosine, 3) AS cosine, row_number() OVER (PARTITION BY item_id ORDER BY round(raw, 3) DESC, doc_id) AS rank FROM mixed WHERE raw > 0.05)"""


def _blended(spark, sf_dir):
    docs, inputs = table(spark, sf_dir, "documents"), _inputs(spark, sf_dir)
    langs = docs.select(F.col("lang").alias("concept")).distinct()
    i = F.col("input_id")
    weights = expand.cut(inputs.select("input_id").join(langs, (i % 4 != F.char_length("concept") % 4 + 1) & (F.ascii("concept") % 5 == i % 5)).select("input_id", "concept", (1.0 / (1 + i % 3)).alias("weight")), "weights")
    links = docs.select(F.col("lang").alias("concept"), "doc_id", F.when(F.col("doc_id") % 3 == 0, 1.0).otherwise(0.8).alias("strength"))
    cosine = retrieval.cosines(_index(spark, sf_dir).products(inputs), ["input_id", "doc_id"])
    named = inputs.select("input_id", (7 * i).alias("doc_id"))
    return retrieval.blended(retrieval.concept_scores(weights, links), cosine, weights, named)


@query(f"WITH {BLEND} SELECT item_id, doc_id, score, concept_score, cosine, rank FROM scored WHERE rank <= 10")
def e8_score_documents(spark, sf_dir):
    return retrieval.score_documents(_blended(spark, sf_dir)).select(F.col("input_id").alias("item_id"), "doc_id", "score", "concept_score", "cosine", "rank")


@query(f"""WITH {BLEND}, steps AS (SELECT doc_id AS src, doc_id // 2 AS dst FROM documents UNION ALL SELECT doc_id, doc_id // 3 FROM documents),
passed AS (SELECT item_id, dst AS doc_id, sum(0.25 * score) AS propagated FROM scored JOIN steps ON doc_id = src WHERE rank <= 5 GROUP BY item_id, dst),
both_ AS (SELECT item_id, doc_id, round(coalesce(score, 0) + coalesce(propagated, 0), 3) AS score, round(coalesce(propagated, 0), 6) AS propagated FROM scored FULL JOIN passed USING (item_id, doc_id))
SELECT * FROM (SELECT item_id, doc_id, score, propagated, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM both_) WHERE rank <= 10""")
def e9_propagation(spark, sf_dir):
    ids = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("src"))
    steps = ids.select("src", F.floor(F.col("src") / 2).alias("dst")).union(ids.select("src", F.floor(F.col("src") / 3).alias("dst")))
    scored = expand.cut(retrieval.score_documents(_blended(spark, sf_dir), k=None), "scored")
    return retrieval.propagated(scored, steps, k=10).select(F.col("input_id").alias("item_id"), "doc_id", "score", "propagated", "rank")


@query(f"""WITH {BLEND}, kept AS (SELECT item_id, doc_id, round(raw, 3) AS score, round(cosine, 3) AS cosine FROM mixed WHERE raw >= 0.2 AND (concept > 0 OR NOT EXISTS (SELECT 1 FROM weights w WHERE w.item_id = mixed.item_id) OR (cosine >= 0.25 AND top_product <= 0.75 * cosine))),
nth AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, max(score) OVER (PARTITION BY item_id) AS best FROM kept)
SELECT item_id, doc_id, score, cosine, rank FROM nth WHERE rank <= 6 AND score >= 0.5 * best""")
def e10_score_ideas(spark, sf_dir):
    return retrieval.score_ideas(_blended(spark, sf_dir), key="doc_id").select(F.col("input_id").alias("item_id"), "doc_id", "score", "cosine", "rank")


@query(f"WITH {TFIDF} SELECT item_id, doc_id, cosine >= 0.1 AND top_product <= 0.75 * cosine AS broad FROM cos WHERE cosine >= 0.05")
def e11_broad_wording(spark, sf_dir):
    found = retrieval.cosines(_index(spark, sf_dir).products(_inputs(spark, sf_dir)), ["input_id", "doc_id"]).where("cosine >= 0.05")
    return found.select(F.col("input_id").alias("item_id"), "doc_id", retrieval.broad_wording("cosine", "top_product", 0.1).alias("broad"))


# ---------------------------------------------------------------- relations

_KINDS = {"A": 3.0, "N": 1.0, "R": 0.3, "title": 6.0, "body": 0.8, "heading": 8.0}
KINDED = """kinded AS (SELECT doc_id, concept, round(sum(weight), 6) AS weight, sum(n)::BIGINT AS n, max(headed) AS headed, max(titled) AS titled FROM (
SELECT l_orderkey AS doc_id, p_brand AS concept, CASE WHEN l_linenumber = 1 THEN 6.0 * l_quantity ELSE CASE l_returnflag WHEN 'A' THEN 3.0 WHEN 'N' THEN 1.0 ELSE 0.3 END * least(l_quantity, 8) END AS weight, l_quantity::BIGINT AS n, false AS headed, l_linenumber = 1 AS titled FROM lineitem JOIN part ON l_partkey = p_partkey
UNION ALL SELECT l_orderkey, p_brand, 8.0, 0, true, false FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linestatus = 'F') GROUP BY doc_id, concept)"""


def _kinded(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("doc_id"), F.col("p_brand").alias("concept"), F.when(F.col("l_linenumber") == 1, "title").otherwise(F.col("l_returnflag")).alias("kind"), F.col("l_quantity").cast("long").alias("n"), "l_linestatus")
    return relations.concept_scores(lines.select("doc_id", "kind", "concept", "n"), lines.where("l_linestatus = 'F'").select("doc_id", "concept"), _KINDS).withColumn("weight", F.round("weight", 6))


@query(f"WITH {KINDED} SELECT * FROM kinded")
def d6_concept_scores(spark, sf_dir):
    return _kinded(spark, sf_dir)


@query("""SELECT doc_id, concept, round(sum(weight), 6) AS weight, sum(n)::BIGINT AS n, max(headed) AS headed, max(titled) AS titled FROM (
SELECT l_orderkey AS doc_id, p_brand AS concept, CASE WHEN l_linenumber = 1 THEN 6.0 * l_quantity ELSE CASE l_linenumber WHEN 2 THEN 3.0 WHEN 3 THEN 0.5 WHEN 4 THEN 0.0 ELSE CASE l_returnflag WHEN 'A' THEN 0.5 WHEN 'N' THEN 0.8 ELSE 0.3 END END * least(l_quantity, 8) END AS weight, l_quantity::BIGINT AS n, false AS headed, l_linenumber = 1 AS titled FROM lineitem JOIN part ON l_partkey = p_partkey
UNION ALL SELECT l_orderkey, p_brand, 8.0, 0, true, false FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linestatus = 'F') GROUP BY doc_id, concept""")
def d6_default_scores(spark, sf_dir):
    """With the library's own weights; a kind that has none counts as body."""
    number = F.col("l_linenumber")
    kind = F.when(number == 1, "title").when(number == 2, "abstract").when(number == 3, "decision").when(number == 4, "meta").when(F.col("l_returnflag") == "A", "compat").when(F.col("l_returnflag") == "N", "reference_impl").otherwise("rejected")
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("doc_id"), F.col("p_brand").alias("concept"), kind.alias("kind"), F.col("l_quantity").cast("long").alias("n"), "l_linestatus")
    return relations.concept_scores(lines.select("doc_id", "kind", "concept", "n"), lines.where("l_linestatus = 'F'").select("doc_id", "concept")).withColumn("weight", F.round("weight", 6))


@query(f"""WITH {KINDED} SELECT doc_id, concept, round(weight / top, 3) AS share, (weight >= 0.35 * top AND weight >= 6 AND nth <= 4) OR titled OR (h >= 3 AND headed) AS focus FROM (
SELECT *, max(weight) OVER (PARTITION BY doc_id) AS top, count(*) FILTER (WHERE headed) OVER (PARTITION BY doc_id) AS h, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, concept) AS nth FROM kinded)""")
def d7_focus(spark, sf_dir):
    return relations.focus(_kinded(spark, sf_dir), umbrella=3).select("doc_id", "concept", "share", "focus")


@query(f"WITH {LINEAGE} SELECT doc_id, concept, relation, share, n FROM lineage")
def d8_lineage(spark, sf_dir):
    return _lineage(spark, sf_dir)


#: Suppliers cite parts; ids of suppliers start at a million.
CITED = """cited AS (SELECT 1000000 + l_suppkey AS src, l_partkey AS dst, CASE l_returnflag WHEN 'A' THEN 'rejected' WHEN 'N' THEN 'body' ELSE 'meta' END AS kind, l_linestatus AS section, l_orderkey || '/' || l_linenumber AS evidence, l_orderkey * 10 + l_linenumber AS ord FROM lineitem),
dated AS (SELECT p_partkey AS doc_id, DATE '2000-01-01' + p_size AS created, CASE p_partkey % 3 WHEN 0 THEN 'accepted' WHEN 1 THEN 'failed' ELSE 'open' END AS outcome FROM part UNION ALL SELECT 1000000 + s_suppkey, DATE '2000-01-20', 'open' FROM supplier),
typed AS (SELECT src, dst, n, rejected, foundational, section, evidence, CASE WHEN rejected > 0 AND rejected >= foundational THEN 'CONTRASTS_WITH' WHEN d.outcome = 'accepted' AND d.created < s.created AND foundational > 0 THEN 'BUILDS_ON' ELSE 'REFERENCES' END AS type FROM (
 SELECT src, dst, count(*) AS n, count(*) FILTER (WHERE kind = 'rejected') AS rejected, count(*) FILTER (WHERE kind = 'body') AS foundational, first(section ORDER BY kind = 'meta', ord) AS section, first(evidence ORDER BY kind = 'meta', ord) AS evidence FROM cited GROUP BY src, dst) JOIN dated s ON src = s.doc_id LEFT JOIN dated d ON dst = d.doc_id)"""


def _cited(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select((1_000_000 + F.col("l_suppkey")).alias("src"), F.col("l_partkey").alias("dst"), F.when(F.col("l_returnflag") == "A", "rejected").when(F.col("l_returnflag") == "N", "body").otherwise("meta").alias("kind"), F.col("l_linestatus").alias("section"), F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("evidence"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))


def _dated(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.date_add(F.lit("2000-01-01").cast("date"), F.col("p_size").cast("int")).alias("created"), F.when(F.col("p_partkey") % 3 == 0, "accepted").when(F.col("p_partkey") % 3 == 1, "failed").otherwise("open").alias("outcome"))
    return parts.union(table(spark, sf_dir, "supplier").select(1_000_000 + F.col("s_suppkey"), F.lit("2000-01-20").cast("date"), F.lit("open")))


@query(f"WITH {CITED} SELECT src, dst, type, n, rejected, foundational, section, evidence, by_section FROM typed JOIN (SELECT src, dst, string_agg(kind || '=' || c, ',' ORDER BY kind) AS by_section FROM (SELECT src, dst, kind, count(*) AS c FROM cited GROUP BY src, dst, kind) GROUP BY src, dst) USING (src, dst)")
def d9_typed_references(spark, sf_dir):
    found = _typed(spark, sf_dir)
    return found.withColumn("by_section", F.array_join(F.array_sort(F.transform(F.map_entries("by_section"), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string")))), ","))


def _typed(spark, sf_dir):
    return relations.typed_references(relations.citation_counts(_cited(spark, sf_dir)), _dated(spark, sf_dir))


@query("""SELECT l_orderkey AS idea_id, p_brand AS concept, weight::BIGINT AS weight, CASE WHEN weight >= 4 THEN 0.8 ELSE 0.6 END AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY weight DESC, h > 0 DESC, p_brand) AS nth FROM (
SELECT l_orderkey, p_brand, h, 4 * h + least(t, 5) AS weight FROM (SELECT l_orderkey, p_brand, count(*) FILTER (WHERE l_returnflag = 'A') AS h, sum(l_quantity::BIGINT) FILTER (WHERE l_returnflag <> 'A') AS t0, coalesce(t0, 0) AS t FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey, p_brand))) WHERE nth <= 3 AND weight >= 2""")
def d12_idea_about(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    heading = F.col("l_returnflag") == "A"
    counts = lines.groupBy(F.col("l_orderkey").alias("idea_id"), F.col("p_brand").alias("concept")).agg(F.count_if(heading).alias("in_heading"), F.coalesce(F.sum(F.when(~heading, F.col("l_quantity").cast("long"))), F.lit(0)).alias("in_text"))
    return relations.about(counts)


@query("""SELECT l_orderkey AS doc_id, l_linestatus AS tool, CASE WHEN bool_or(l_returnflag = 'A') THEN 'IMPLEMENTED_IN' ELSE 'MENTIONS_TOOL' END AS type, sum(l_quantity::BIGINT)::BIGINT AS n, first(l_linenumber || ' ' || l_partkey ORDER BY l_returnflag <> 'A', l_linenumber, l_linenumber || ' ' || l_partkey) AS section FROM lineitem GROUP BY l_orderkey, l_linestatus""")
def d14_tool_relations(spark, sf_dir):
    section = F.concat_ws(" ", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"))
    hits = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linestatus").alias("tool"), F.col("l_quantity").cast("long").alias("n"), F.when(F.col("l_returnflag") == "A", "reference_impl").otherwise("body").alias("kind"), section.alias("section"), F.struct("l_linenumber", section.alias("s")).alias("ord"))
    return relations.tool_relations(hits)


#: Failed orders are ideas; later accepted orders of the same customer are close to them by a rule on the ids.
REVISITS = f"""{LINEAGE}, ideas AS (SELECT 'idea:' || doc_id AS idea_id, doc_id AS origin, concept, n + 1 AS weight FROM scores JOIN meta USING (doc_id) WHERE outcome = 'failed'),
near AS (SELECT 'idea:' || a.o_orderkey AS idea_id, b.o_orderkey AS doc_id, 0.1 + 0.05 * ((a.o_orderkey + b.o_orderkey) % 7) AS cosine FROM orders a JOIN orders b USING (o_custkey) WHERE a.o_orderstatus = 'P'),
aware AS (SELECT DISTINCT b.o_orderkey AS doc_id, a.o_orderkey AS origin FROM orders a JOIN orders b USING (o_custkey) WHERE (a.o_orderkey + b.o_orderkey) % 2 = 0),
pairs AS (SELECT i.idea_id, f.doc_id, max(n.cosine) AS cosine, string_agg(DISTINCT i.concept, ',' ORDER BY i.concept) AS shared FROM ideas i JOIN meta o ON i.origin = o.doc_id JOIN focused f ON f.concept = i.concept AND f.focus JOIN meta m ON f.doc_id = m.doc_id JOIN near n ON n.idea_id = i.idea_id AND n.doc_id = f.doc_id LEFT JOIN aware a ON a.doc_id = f.doc_id AND a.origin = i.origin
 WHERE i.weight >= 3 AND m.outcome = 'accepted' AND m.created > o.created AND n.cosine >= 0.15 AND (n.cosine >= 0.3 OR a.origin IS NOT NULL) GROUP BY i.idea_id, f.doc_id)"""


def _revisits(spark, sf_dir):
    meta, focused = _meta(spark, sf_dir), _focused(spark, sf_dir)
    failed = meta.where("outcome = 'failed'").select("doc_id", F.concat(F.lit("idea:"), F.col("doc_id").cast("string")).alias("idea_id"), "customer")
    subjects = focused.join(failed, "doc_id").select("idea_id", F.col("doc_id").alias("origin"), "concept", (F.col("n") + 1).alias("weight"))
    others = meta.select(F.col("doc_id").alias("other"), "customer")
    near = failed.join(others, "customer").select("idea_id", F.col("other").alias("doc_id"), (0.1 + 0.05 * ((F.col("doc_id") + F.col("other")) % 7)).alias("cosine"))
    cited = meta.select("doc_id", "customer").join(others, "customer").where((F.col("doc_id") + F.col("other")) % 2 == 0).select(F.col("other").alias("src"), F.col("doc_id").alias("dst"))
    # few concepts, and many orders of each: those of one customer meet first
    pairs = relations.revisit_pairs(subjects, focused.where("focus").select("doc_id", "concept"), meta, near=near.where("cosine >= 0.15"))
    return relations.revisits(pairs, near, cited)


@query(f"WITH {REVISITS} SELECT idea_id, doc_id, round(cosine, 3) AS cosine, shared, round(least(0.9, 0.4 + cosine), 3) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY idea_id ORDER BY round(cosine, 9) DESC, doc_id) AS k FROM pairs) WHERE k = 1")
def d15_revisits(spark, sf_dir):
    return _revisits(spark, sf_dir).withColumn("shared", F.array_join("shared", ","))


@query("""SELECT user_id, arg_max(event_type, (ts, event_id)) FILTER (WHERE event_type <> 'error') AS event_type, arg_max(props, (ts, event_id)) FILTER (WHERE props <> '') AS props, arg_max(value, (ts, event_id)) FILTER (WHERE value > 20) AS value FROM events GROUP BY user_id""")
def d16_upsert(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type")).alias("event_type"), "props", F.when(F.col("value") > 20, F.col("value")).alias("value"))
    return relations.upsert(rows, "user_id", ["ts", "event_id"], ["event_type", "props", "value"])


BROKEN = f"""WITH {CITED}, es AS (SELECT 'doc:' || src AS src, 'doc:' || dst AS dst, CASE WHEN n = 3 THEN 'NEAR' ELSE 'BUILDS_ON' END AS type, CASE WHEN rejected = 0 THEN 0.9 WHEN rejected = 1 THEN 1.5 END AS confidence, CASE WHEN foundational > 2 THEN '' ELSE 'doc' END AS source FROM typed),
ns AS (SELECT 'doc:' || doc_id AS id, created FROM dated WHERE doc_id % 50 <> 3)"""


@query(f"""{BROKEN} SELECT src, dst, type, 'no source node' AS problem FROM es WHERE src NOT IN (SELECT id FROM ns)
UNION ALL SELECT src, dst, type, 'no target node' FROM es WHERE dst NOT IN (SELECT id FROM ns)
UNION ALL SELECT src, dst, type, 'unknown type' FROM es WHERE type <> 'BUILDS_ON'
UNION ALL SELECT src, dst, type, 'confidence' FROM es WHERE confidence IS NULL OR confidence > 1
UNION ALL SELECT src, dst, type, 'no provenance' FROM es WHERE source = ''
UNION ALL SELECT es.src, es.dst, type, 'order in time' FROM es JOIN ns a ON es.src = a.id JOIN ns b ON es.dst = b.id WHERE type = 'BUILDS_ON' AND b.created >= a.created""")
def d17_violations(spark, sf_dir):
    typed = _typed(spark, sf_dir)
    rows = typed.select(relations.key("doc", "src").alias("src"), relations.key("doc", "dst").alias("dst"), F.when(F.col("n") == 3, "NEAR").otherwise("BUILDS_ON").alias("type"), F.when(F.col("rejected") == 0, 0.9).when(F.col("rejected") == 1, 1.5).alias("confidence"), F.when(F.col("foundational") > 2, "").otherwise("doc").alias("source"))
    nodes = _dated(spark, sf_dir).where("doc_id % 50 <> 3").select(relations.key("doc", "doc_id").alias("id"), "created")
    return relations.violations(rows, nodes, ["BUILDS_ON"])


@query("""SELECT o.o_custkey AS doc_id, coalesce(any_value(n_name), '?') AS title FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey AND c.c_acctbal > 0 LEFT JOIN nation ON n_nationkey = o.o_custkey % 50 WHERE c.c_custkey IS NULL GROUP BY o.o_custkey""")
def d2_stubs(spark, sf_dir):
    """Customers that orders cite but the list of those in credit lacks."""
    cited = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"))
    known = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("doc_id"))
    titles = cited.distinct().join(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("title")), F.col("doc_id") % 50 == F.col("k")).select("doc_id", "title")
    return relations.stubs(cited, known, titles)


# ---------------------------------------------------------------- expansion

LINKS = """links AS (SELECT * FROM (SELECT o_orderkey AS src, lag(o_orderkey) OVER w AS dst, 'BUILDS_ON' AS type FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
UNION ALL SELECT o_orderkey, lag(o_orderkey, 3) OVER w, 'REQUIRES' FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
UNION ALL SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN lead(o_orderkey) OVER w END, 'SUPERSEDED_BY' FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
UNION ALL SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 4 = 0 THEN lag(o_orderkey, 2) OVER w END, 'REPLACES' FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) WHERE dst IS NOT NULL)"""
VERSIONS = "versions AS (SELECT src AS doc_id, dst AS next FROM links WHERE type = 'SUPERSEDED_BY' UNION SELECT dst, src FROM links WHERE type = 'REPLACES')"
RANKED = "ranked AS (SELECT o_custkey AS input_id, o_orderkey AS doc_id, round(o_totalprice / 600000, 3) AS score, row_number() OVER (PARTITION BY o_custkey ORDER BY round(o_totalprice / 600000, 3) DESC, o_orderkey) AS rank FROM orders)"


def _links(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf_dir, "orders")
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    kinds = [("BUILDS_ON", F.lag(key).over(w)), ("REQUIRES", F.lag(key, 3).over(w)), ("SUPERSEDED_BY", F.when(status == "P", F.lead(key).over(w))), ("REPLACES", F.when((status == "F") & (key % 4 == 0), F.lag(key, 2).over(w)))]
    each = o.select(key.alias("src"), F.array(*(F.struct(dst.alias("dst"), F.lit(kind).alias("type")) for kind, dst in kinds)).alias("x"))
    return each.select("src", F.explode("x").alias("x")).select("src", "x.dst", "x.type").where("dst is not null")


def _ranked(spark, sf_dir, k):
    scored = _meta(spark, sf_dir).select(F.col("customer").alias("input_id"), "doc_id", retrieval.rounded(F.col("price") / 600000).alias("score"))
    return retrieval.top_k(scored, k, "input_id", [F.desc("score"), F.asc("doc_id")])


@query(f"WITH {LINKS}, {VERSIONS} SELECT doc_id, next FROM versions")
def f1_current_version(spark, sf_dir):
    return expand.current_versions(_links(spark, sf_dir))


@query(f"WITH RECURSIVE {LINKS}, {VERSIONS}, later AS (SELECT doc_id, next AS successor FROM versions UNION SELECT l.doc_id, v.next FROM later l JOIN versions v ON l.successor = v.doc_id) SELECT doc_id, successor FROM later")
def f2_successors(spark, sf_dir):
    return expand.successors(expand.current_versions(_links(spark, sf_dir)))


@query(f"WITH RECURSIVE {LINKS}, {VERSIONS}, later AS (SELECT doc_id, next AS successor FROM versions WHERE doc_id % 50 = 0 UNION SELECT l.doc_id, v.next FROM later l JOIN versions v ON l.successor = v.doc_id) SELECT doc_id, successor FROM later")
def f2_successors_of_some(spark, sf_dir):
    """Of every fiftieth order: only what these lead to is followed."""
    seeds = table(spark, sf_dir, "orders").where("o_orderkey % 50 = 0").select(F.col("o_orderkey").alias("doc_id"))
    return expand.reached(expand.current_versions(_links(spark, sf_dir)), seeds)


FOUND = f"""{META}, {LINKS}, {RANKED}, seeds AS (SELECT input_id, doc_id AS seed FROM ranked JOIN meta USING (doc_id) WHERE rank <= 3 AND outcome = 'accepted'), steps AS (SELECT DISTINCT src, dst FROM links WHERE type IN ('BUILDS_ON', 'REQUIRES')),
one AS (SELECT input_id, seed, dst, seed AS via, 1 AS depth FROM seeds JOIN steps ON seed = src WHERE NOT EXISTS (SELECT 1 FROM seeds x WHERE x.input_id = seeds.input_id AND x.seed = dst)),
ways AS (SELECT * FROM one UNION ALL SELECT input_id, seed, steps.dst, one.dst, 2 FROM one JOIN steps ON one.dst = src WHERE NOT EXISTS (SELECT 1 FROM seeds x WHERE x.input_id = one.input_id AND x.seed = steps.dst)),
best AS (SELECT input_id, dst AS doc_id, min(depth) AS depth, count(DISTINCT seed) AS reach, first(via ORDER BY depth, seed, via) AS via, first(seed ORDER BY depth, seed, via) AS seed FROM ways GROUP BY input_id, dst),
foundations AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY input_id ORDER BY depth, reach DESC, doc_id) AS rank FROM best) WHERE rank <= 5)"""


def _foundations(spark, sf_dir):
    meta = _meta(spark, sf_dir)
    seeds = _ranked(spark, sf_dir, 3).join(meta.where("outcome = 'accepted'").select("doc_id"), "doc_id", "left_semi").select("input_id", "doc_id")
    return expand.foundations(expand.cut(seeds, "seeds"), _links(spark, sf_dir), meta)


@query(f"WITH {FOUND} SELECT input_id, doc_id, depth, reach, via, seed || CASE WHEN depth = 2 THEN '>' || via ELSE '' END || '>' || doc_id AS path, rank FROM foundations")
def f3_foundations(spark, sf_dir):
    return _foundations(spark, sf_dir).withColumn("path", F.array_join(F.transform("path", lambda d: d.cast("string")), ">"))


@query(f"""WITH {RANKED}, sums AS (SELECT input_id, l_suppkey AS person, sum(CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'N' THEN 0.8 ELSE 0.6 END * score) AS s, max(year(l_shipdate)) AS last_year, string_agg(DISTINCT doc_id::VARCHAR, ',' ORDER BY doc_id::VARCHAR) AS docs FROM ranked JOIN lineitem ON l_orderkey = doc_id WHERE rank <= 6 GROUP BY input_id, l_suppkey),
each AS (SELECT input_id, l_suppkey AS person, l_returnflag AS role, string_agg(DISTINCT doc_id::VARCHAR, '+' ORDER BY doc_id::VARCHAR) AS d FROM ranked JOIN lineitem ON l_orderkey = doc_id WHERE rank <= 6 GROUP BY ALL)
SELECT f.*, (SELECT string_agg(role || ':' || d, ',' ORDER BY role) FROM each e WHERE e.input_id = f.input_id AND e.person = f.person) AS roles FROM (SELECT input_id, person, score, last_year, docs, row_number() OVER (PARTITION BY input_id ORDER BY score DESC, person) AS rank FROM (SELECT *, round(s / (1 + (max(last_year) OVER (PARTITION BY input_id) - last_year) / 6.0), 3) AS score FROM sums)) f WHERE rank <= 5""")
def f4_people(spark, sf_dir):
    weight = F.when(F.col("l_returnflag") == "A", 1.0).when(F.col("l_returnflag") == "N", 0.8).otherwise(0.6)
    roles = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_suppkey").alias("person"), F.col("l_returnflag").alias("role"), weight.alias("weight"), F.year("l_shipdate").alias("year"))
    found = expand.people_ranking(_ranked(spark, sf_dir, 6), roles)
    joined = lambda ids, by: F.array_join(F.array_sort(F.transform(ids, lambda d: d.cast("string"))), by)
    by_role = F.array_join(F.transform("roles", lambda r: F.concat_ws(":", r["role"], joined(r["docs"], "+"))), ",")
    return found.withColumn("docs", joined("docs", ",")).withColumn("roles", by_role)


@query(f"""WITH {LINEAGE}, asked AS (SELECT n_nationkey AS input_id, p_type AS concept FROM nation JOIN (SELECT DISTINCT p_type FROM part) ON n_nationkey % 7 = length(p_type) % 7), found AS (SELECT DISTINCT input_id, doc_id FROM asked JOIN strengths USING (concept) WHERE strength >= 0.8)
SELECT input_id, count(*) FILTER (WHERE outcome = 'accepted') AS accepted, count(*) FILTER (WHERE outcome = 'failed') AS failed, count(*) FILTER (WHERE outcome = 'open') AS open FROM found JOIN meta USING (doc_id) GROUP BY input_id""")
def f5_track_record(spark, sf_dir):
    meta = _meta(spark, sf_dir)
    concepts = table(spark, sf_dir, "part").select(F.col("p_type").alias("concept")).distinct()
    asked = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("input_id")).join(concepts, F.col("input_id") % 7 == F.char_length("concept") % 7)
    return expand.area_record(asked, _strengths(_lineage(spark, sf_dir)), meta)


@query("""WITH every AS (SELECT user_id AS input_id, event_type AS concern, value / 100 AS w, props AS evidence, 'i' || (event_id % 5) AS origin, 0 AS o FROM events WHERE event_id % 3 = 0
UNION ALL SELECT user_id, event_type, CASE WHEN event_id % 2 = 0 THEN 0.6 ELSE 0.25 END, props, 'a' || (event_id % 7), 1 FROM events WHERE event_id % 3 = 1
UNION ALL SELECT user_id, event_type, 0.15, NULL, NULL, 2 FROM events WHERE event_id % 3 = 2),
meant AS (SELECT user_id AS input_id, event_type AS concern, string_agg(DISTINCT 'n' || (event_id % 4), ',' ORDER BY 'n' || (event_id % 4)) AS from_intent FROM events WHERE event_id % 3 = 2 GROUP BY ALL),
shares AS (SELECT input_id, concern, round(w / t, 3) AS weight FROM (SELECT input_id, concern, sum(w) AS w, sum(sum(w)) OVER (PARTITION BY input_id) AS t FROM every GROUP BY input_id, concern) WHERE w >= 0.04 * t),
tops AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY input_id ORDER BY weight DESC, concern) AS rank FROM shares) WHERE rank <= 6),
said AS (SELECT input_id, concern, e.o, e.evidence || '@' || e.section AS evidence, origin, row_number() OVER (PARTITION BY input_id, concern ORDER BY e.o, origin) AS n FROM (SELECT input_id, concern, origin, min({'o': o, 'evidence': evidence, 'section': 's' || o}) AS e FROM every WHERE evidence <> '' GROUP BY input_id, concern, origin))
SELECT input_id, concern, weight, rank, coalesce((SELECT string_agg(evidence, '|' ORDER BY n) FROM said s WHERE s.input_id = tops.input_id AND s.concern = tops.concern AND n <= 2), '') AS quotes, coalesce(from_intent, '') AS from_intent FROM tops LEFT JOIN meant USING (input_id, concern)""")
def f6_objections(spark, sf_dir):
    e = expand.cut(table(spark, sf_dir, "events").select(F.col("user_id").alias("input_id"), F.col("event_type").alias("concern"), "event_id", "value", F.col("props").alias("evidence")), "events")
    k = F.col("event_id")
    ideas = e.where(k % 3 == 0).select("input_id", "concern", (F.col("value") / 100).alias("score"), "evidence", F.concat(F.lit("i"), (k % 5).cast("string")).alias("origin"), F.lit("s0").alias("section"))
    area = e.where(k % 3 == 1).select("input_id", "concern", F.when(k % 2 == 0, "decision").otherwise("compat").alias("context"), "evidence", F.concat(F.lit("a"), (k % 7).cast("string")).alias("origin"), F.lit("s1").alias("section"))
    found = expand.objections(ideas, area, e.where(k % 3 == 2).select("input_id", "concern", F.concat(F.lit("n"), (k % 4).cast("string")).alias("intent")))
    return found.withColumn("quotes", F.array_join(F.transform("quotes", lambda q: F.concat_ws("@", q["quote"], q["section"])), "|")).withColumn("from_intent", F.array_join("from_intent", ","))


@query(f"""WITH {RANKED} SELECT input_id, first(o_orderpriority ORDER BY year(o_orderdate) DESC, rank) AS venue, first(doc_id ORDER BY year(o_orderdate) DESC, rank) AS doc_id FROM ranked JOIN orders ON o_orderkey = doc_id WHERE rank <= 6 AND o_orderpriority <> '5-LOW' GROUP BY input_id""")
def f8_venue(spark, sf_dir):
    meta = _meta(spark, sf_dir)
    venues = meta.where("o_orderpriority <> '5-LOW'").select("doc_id", F.col("o_orderpriority").alias("venue"))
    return expand.venue(_ranked(spark, sf_dir, 6), venues, meta)


@query(f"""WITH {FOUND}, every AS (SELECT input_id, doc_id, 'doc ' || via || ' rests on it' AS why, 0 AS o FROM foundations UNION ALL SELECT input_id, doc_id, 'among the nearest' || CASE WHEN outcome = 'failed' THEN ', and turned down' ELSE '' END, 1 FROM ranked JOIN meta USING (doc_id) WHERE rank <= 3)
SELECT input_id, doc_id, why, row_number() OVER (PARTITION BY input_id ORDER BY created, doc_id) AS pos FROM (SELECT input_id, doc_id, first(why ORDER BY o) AS why FROM every GROUP BY input_id, doc_id) JOIN meta USING (doc_id)""")
def f9_reading_list(spark, sf_dir):
    return expand.reading_list(_ranked(spark, sf_dir, 3), _foundations(spark, sf_dir), _meta(spark, sf_dir))


VERDICTS = f"""{META}, tops AS (SELECT o_custkey AS input_id, o_orderkey AS doc_id, round(o_totalprice / 600000, 3) AS score, (o_orderkey % 50) / 100.0 AS cosine, (o_orderkey % 10) / 10.0 AS concept_score, row_number() OVER (PARTITION BY o_custkey ORDER BY round(o_totalprice / 600000, 3) DESC, o_orderkey) AS rank FROM orders),
rows_ AS (SELECT c_custkey AS input_id, t.doc_id, coalesce(score, 0) AS s, cosine, concept_score, outcome, CASE WHEN c_custkey % 4 = 0 THEN round(abs(c_acctbal) / 10000, 3) END AS si, c_custkey % 3 = 0 AS m, c_custkey % 5 = 0 AS w FROM customer LEFT JOIN (SELECT * FROM tops WHERE rank = 1) t ON input_id = c_custkey LEFT JOIN meta USING (doc_id)),
labelled AS (SELECT *, CASE WHEN (NOT m AND s < 0.3) OR (NOT m AND NOT w) THEN 'outside_known_territory' WHEN s >= 0.62 AND (cosine >= 0.22 OR concept_score >= 0.8) THEN CASE outcome WHEN 'accepted' THEN 'already_exists' WHEN 'failed' THEN 'previously_rejected' ELSE 'in_progress' END
 WHEN coalesce(si, 0) >= 0.55 THEN 'previously_rejected_alternative' WHEN m OR w THEN 'extends_existing_area' ELSE 'outside_known_territory' END AS label FROM rows_),
verdicts AS (SELECT input_id, label, CASE WHEN label IN ('already_exists', 'previously_rejected', 'in_progress') AND s >= 0.75 THEN 'high' WHEN label = 'outside_known_territory' THEN 'low' ELSE 'medium' END AS confidence, CASE WHEN label IN ('already_exists', 'previously_rejected', 'in_progress') THEN doc_id END AS basis_doc, CASE WHEN label = 'previously_rejected_alternative' THEN 'idea:' || input_id END AS basis_idea, s AS top_score FROM labelled)"""


def _verdicts(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("input_id"), "c_acctbal")
    i = F.col("input_id")
    ranked = _ranked(spark, sf_dir, 1).withColumn("cosine", F.col("doc_id") % 50 / 100).withColumn("concept_score", F.col("doc_id") % 10 / 10)
    best = customers.where(i % 4 == 0).select("input_id", F.concat(F.lit("idea:"), i.cast("string")).alias("idea_id"), retrieval.rounded(F.abs("c_acctbal") / 10000).alias("score"), F.lit(1).alias("rank"))
    return expand.verdicts(customers, ranked, best, _meta(spark, sf_dir), customers.where(i % 3 == 0), customers.where(i % 5 == 0))


@query(f"WITH {VERDICTS} SELECT * FROM verdicts")
def f10_verdicts(spark, sf_dir):
    return _verdicts(spark, sf_dir)


@query(f"""WITH RECURSIVE {LINEAGE}, {LINKS}, {VERSIONS}, later AS (SELECT doc_id, next AS successor FROM versions UNION SELECT l.doc_id, v.next FROM later l JOIN versions v ON l.successor = v.doc_id),
weights AS (SELECT n_nationkey AS input_id, p_type AS concept, length(p_type) % 4 + n_nationkey AS weight FROM nation JOIN (SELECT DISTINCT p_type FROM part) ON n_nationkey % 7 = length(p_type) % 7 WHERE n_nationkey % 5 > 0),
tops AS (SELECT input_id, concept FROM (SELECT *, row_number() OVER (PARTITION BY input_id ORDER BY weight DESC, concept) AS k FROM weights) WHERE k <= 3),
chosen AS (SELECT * FROM tops UNION ALL SELECT n_nationkey, p_type FROM nation JOIN (SELECT DISTINCT p_type FROM part) ON (n_nationkey + 1) % 7 = length(p_type) % 7 WHERE n_nationkey NOT IN (SELECT input_id FROM tops)),
added AS (SELECT DISTINCT input_id, i.concept FROM chosen JOIN strengths s USING (concept) JOIN later l ON l.doc_id = s.doc_id JOIN lineage i ON i.doc_id = l.successor AND i.relation = 'INTRODUCES' WHERE strength >= 0.8),
every AS (SELECT input_id, concept FROM chosen UNION SELECT input_id, concept FROM added)
SELECT input_id, doc_id, string_agg(concept, ', ' ORDER BY concept) AS concepts, string_agg(DISTINCT relation, ', ' ORDER BY relation) AS relations, row_number() OVER (PARTITION BY input_id ORDER BY any_value(created), doc_id) AS pos
FROM every JOIN strengths USING (concept) JOIN lineage USING (concept, doc_id) JOIN meta USING (doc_id) WHERE strength >= 0.8 AND relation <> 'MENTIONS' GROUP BY input_id, doc_id""")
def f14_timeline(spark, sf_dir):
    """The first three concepts by weight, others for inputs without any, and those that successors introduced."""
    lineage = expand.cut(_lineage(spark, sf_dir), "lineage")
    concepts = table(spark, sf_dir, "part").select(F.col("p_type").alias("concept")).distinct()
    nations, i = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("input_id")), F.col("input_id")
    weights = nations.where(i % 5 > 0).join(concepts, i % 7 == F.char_length("concept") % 7).withColumn("weight", F.char_length("concept") % 4 + i)
    fallback = nations.join(concepts, (i + 1) % 7 == F.char_length("concept") % 7)
    later = expand.successors(expand.current_versions(_links(spark, sf_dir)))
    _, line = expand.timeline(weights, fallback, _strengths(lineage), lineage, later, _meta(spark, sf_dir))
    return line.select("input_id", "doc_id", "concepts", "relations", "pos")


@query(f"""WITH {REVISITS}, asked AS (SELECT n_nationkey AS input_id, p_type AS concept FROM nation JOIN (SELECT DISTINCT p_type FROM part) ON n_nationkey % 7 = length(p_type) % 7),
found AS (SELECT DISTINCT a.input_id, i.idea_id, CASE WHEN i.origin % 11 = a.input_id % 11 THEN (i.origin % 97) / 97.0 ELSE 0 END AS c FROM asked a JOIN ideas i USING (concept))
SELECT * FROM (SELECT input_id, idea_id, round(c, 6) AS cosine, row_number() OVER (PARTITION BY input_id ORDER BY round(c, 6) DESC, idea_id) AS rank FROM found) WHERE rank <= 6""")
def f15_turned_down(spark, sf_dir):
    failed = _meta(spark, sf_dir).where("outcome = 'failed'").select("doc_id", F.concat(F.lit("idea:"), F.col("doc_id").cast("string")).alias("idea_id"))
    subjects = _focused(spark, sf_dir).join(failed, "doc_id").select("idea_id", "concept")
    concepts = table(spark, sf_dir, "part").select(F.col("p_type").alias("concept")).distinct()
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("input_id"))
    asked = nations.join(concepts, F.col("input_id") % 7 == F.char_length("concept") % 7)
    cosine = nations.withColumn("r", F.col("input_id") % 11).join(failed.withColumn("r", F.col("doc_id") % 11), "r").select("input_id", "idea_id", (F.col("doc_id") % 97 / 97).alias("cosine"))
    return expand.turned_down(asked, subjects, cosine)


@query(f"""WITH {LINKS} SELECT 'out' AS direction, type, 'doc:' || dst AS other, 'Order ' || dst AS label FROM links WHERE src = 123 UNION ALL SELECT 'in', type, 'doc:' || src, 'Order ' || src FROM links WHERE dst = 123""")
def f16_neighbourhood(spark, sf_dir):
    nodes = _meta(spark, sf_dir).select(relations.key("doc", "doc_id").alias("id"), F.col("title").alias("label"))
    every = _links(spark, sf_dir).select(relations.key("doc", "src").alias("src"), relations.key("doc", "dst").alias("dst"), "type")
    return expand.neighbourhood(nodes, every, "doc:123")


@query(f"""WITH {LINKS} SELECT 'out' AS direction, type, 'node:' || dst AS other, 'Order ' || dst AS label FROM links WHERE src = (SELECT max(o_orderkey) FROM orders) UNION ALL SELECT 'in', type, 'node:' || src, 'Order ' || src FROM links WHERE dst = (SELECT max(o_orderkey) FROM orders)""")
def f16_neighbourhood_by_prefix(spark, sf_dir):
    """The last order's node alone has an id that starts as asked."""
    last = table(spark, sf_dir, "orders").agg(F.max("o_orderkey").alias("_last"))  # one row
    name = lambda c: F.when(F.col(c) == F.col("_last"), F.concat(F.lit("last:"), F.col(c).cast("string"))).otherwise(F.concat(F.lit("node:"), F.col(c).cast("string")))
    nodes = _meta(spark, sf_dir).join(F.broadcast(last)).select(name("doc_id").alias("id"), F.col("title").alias("label"))
    every = _links(spark, sf_dir).join(F.broadcast(last)).select(name("src").alias("src"), name("dst").alias("dst"), "type")
    return expand.neighbourhood(nodes, every, "last:")


@query(f"""WITH {RANKED}, hits AS (SELECT input_id, doc_id, rank, 'left out by ' || doc_id || ': ' || CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderpriority ELSE 'Order ' || doc_id END AS w FROM ranked JOIN orders ON o_orderkey = doc_id WHERE rank <= 6 AND score >= 0.35 AND o_orderstatus = 'O')
SELECT input_id, string_agg(w, '|' ORDER BY rank) AS warnings FROM hits GROUP BY input_id""")
def f11_non_goal_warnings(spark, sf_dir):
    """Open orders are non-goals of their own; urgent ones have a reason, others a summary only."""
    meta = _meta(spark, sf_dir)
    ideas = meta.select(F.concat(F.lit("idea:"), F.col("doc_id").cast("string")).alias("idea_id"), "doc_id", F.when(F.col("status") == "O", "non_goal").otherwise("alternative").alias("kind"), F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderpriority")).alias("reason"), F.col("title").alias("summary"))
    ranked = _ranked(spark, sf_dir, 6).select("input_id", F.concat(F.lit("idea:"), F.col("doc_id").cast("string")).alias("idea_id"), "score", "rank")
    return expand.non_goal_warnings(ranked, ideas).select("input_id", F.array_join("warnings", "|").alias("warnings"))


CLOSEST = f"""{LINEAGE}, {LINKS}, {VERSIONS}, {RANKED}, newer AS (SELECT doc_id, string_agg(DISTINCT next::VARCHAR, ',' ORDER BY next::VARCHAR) AS superseded_by FROM versions GROUP BY doc_id),
said AS (SELECT input_id, doc_id, string_agg(CASE relation WHEN 'MENTIONS' THEN 'mentions' ELSE lower(relation) END || ' ' || concept, '|' ORDER BY relation = 'MENTIONS', concept) AS said FROM (SELECT *, row_number() OVER (PARTITION BY input_id, doc_id, relation = 'MENTIONS' ORDER BY concept) AS nth FROM ranked JOIN lineage USING (doc_id) WHERE rank <= 5) WHERE relation <> 'MENTIONS' OR nth <= 2 GROUP BY input_id, doc_id),
closest AS (SELECT input_id, rank, doc_id, 'Order ' || doc_id AS title, o_orderstatus AS status, year(o_orderdate) AS year, score, coalesce(said, '') || CASE WHEN doc_id % 2 = 0 THEN CASE WHEN said IS NULL THEN '' ELSE '|' END || 'same words: ' || o_orderpriority || ', ' || o_orderstatus ELSE '' END AS why, coalesce(superseded_by, '') AS superseded_by, CASE WHEN o_orderstatus = 'P' THEN 'P/' || o_orderpriority END AS decision
FROM ranked JOIN orders ON o_orderkey = doc_id LEFT JOIN said USING (input_id, doc_id) LEFT JOIN newer USING (doc_id) WHERE rank <= 5)"""


def _closest(spark, sf_dir):
    meta, ranked = _meta(spark, sf_dir), expand.cut(_ranked(spark, sf_dir, 5), "ranked")
    pairs = ranked.select("input_id", "doc_id").join(_lineage(spark, sf_dir), "doc_id").select("input_id", "doc_id", "concept", "relation")
    terms = ranked.where("doc_id % 2 = 0").join(meta, "doc_id").select("input_id", "doc_id", F.array("o_orderpriority", "status").alias("terms"))
    told = meta.where("outcome = 'failed'").select("doc_id", "status", F.col("o_orderpriority").alias("rationale"), F.lit(None).cast("string").alias("resolution"))
    return expand.closest(ranked, meta, pairs, terms, expand.current_versions(_links(spark, sf_dir)), told)


@query(f"WITH {CLOSEST} SELECT * FROM closest")
def f12_closest_with_reasons(spark, sf_dir):
    newer = F.array_join(F.array_sort(F.transform("superseded_by", lambda d: d.cast("string"))), ",")
    return _closest(spark, sf_dir).withColumn("why", F.array_join("why", "|")).withColumn("superseded_by", newer).withColumn("decision", F.concat_ws("/", "decision.status", "decision.rationale")).withColumn("decision", F.nullif("decision", F.lit("")))


@query(f"""WITH {CLOSEST}, {VERDICTS.split(", tops AS", 1)[1].join(["tops AS", ""])}, close AS (SELECT input_id, count(*) AS n_close, string_agg(doc_id::VARCHAR, ',' ORDER BY rank) AS close FROM closest GROUP BY input_id)
SELECT c_custkey AS input_id, label, confidence, coalesce(n_close, 0) AS n_close, close FROM customer LEFT JOIN verdicts ON verdicts.input_id = c_custkey LEFT JOIN close ON close.input_id = c_custkey""")
def f13_assessed(spark, sf_dir):
    """One nested record for each customer, of verdicts and closest documents, flattened for comparison."""
    customers, verdict = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("input_id")), _verdicts(spark, sf_dir)
    parts = {"verdict": verdict.select("input_id", F.struct("label", "confidence").alias("verdict")), "closest": expand.gathered(_closest(spark, sf_dir), "closest", "rank")}
    out = expand.assembled(customers, parts)
    ids = F.array_join(F.transform("closest", lambda x: x["doc_id"].cast("string")), ",")
    return out.select("input_id", "verdict.label", "verdict.confidence", F.coalesce(F.size("closest"), F.lit(0)).cast("long").alias("n_close"), ids.alias("close"))


SUMMARIES = f"""{VERDICTS}, {LINKS}, {VERSIONS}, newer AS (SELECT doc_id AS basis_doc, ' Newer: ' || string_agg('doc ' || next, ', ' ORDER BY next) || '.' AS newer FROM versions GROUP BY doc_id),
first_ AS (SELECT input_id, 'doc ' || doc_id || ' (Order ' || doc_id || ', ' || o_orderstatus || ')' AS top FROM tops JOIN orders ON o_orderkey = doc_id WHERE rank = 1),
known AS (SELECT c_custkey AS input_id, 'area ' || c_nationkey || ', ' || c_mktsegment AS known FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 5 = 0),
told AS (SELECT v.input_id, CASE label WHEN 'already_exists' THEN top || ' does this already; what it lacks would be an extension of it.' || coalesce(newer, '') WHEN 'previously_rejected' THEN top || ' asked for this and failed; its decision has the reasons to answer.' || coalesce(newer, '')
 WHEN 'in_progress' THEN top || ' is still open on this subject; joining it may be better than a rival.' || coalesce(newer, '') WHEN 'previously_rejected_alternative' THEN 'Turned down before: "Plan ' || v.input_id || '" in doc ' || (v.input_id + 7) || '.' || CASE WHEN v.input_id % 8 = 0 THEN ' Taken up later by doc ' || (v.input_id + 9) || '.' ELSE '' END
 WHEN 'extends_existing_area' THEN 'New within a known area (' || coalesce(known, '') || ').' || coalesce(' Nearest: ' || top || '.', '') ELSE 'No known concept is touched.' || coalesce(' By wording alone nearest: ' || top || '.', '') END AS summary
 FROM verdicts v LEFT JOIN newer USING (basis_doc) LEFT JOIN first_ USING (input_id) LEFT JOIN known USING (input_id))"""


@query(f"WITH {SUMMARIES} SELECT input_id, summary FROM told")
def f10_summaries(spark, sf_dir):
    """What verdicts say, with newer versions, rejected ideas and what became of them."""
    customers, i = table(spark, sf_dir, "customer"), F.col("c_custkey")
    ideas = customers.select(F.concat(F.lit("idea:"), i.cast("string")).alias("idea_id"), (i + 7).alias("doc_id"), F.concat(F.lit("Plan "), i.cast("string")).alias("title"))
    revisited = customers.where(i % 8 == 0).select(F.concat(F.lit("idea:"), i.cast("string")).alias("idea_id"), F.explode(F.array(i + 20, i + 9)).alias("doc_id"))
    names = F.explode(F.array(F.col("c_mktsegment"), F.concat(F.lit("area "), F.col("c_nationkey").cast("string"))))
    concepts = customers.where((i % 3 == 0) | (i % 5 == 0)).select(i.alias("input_id"), names.alias("concept"))
    # small letters come after large ones in both engines
    concepts = concepts.withColumn("concept", F.when(F.col("concept").startswith("area"), F.col("concept")).otherwise(F.concat(F.lit("b"), "concept")))
    told = expand.summaries(_verdicts(spark, sf_dir), _ranked(spark, sf_dir, 1), _meta(spark, sf_dir), ideas, expand.current_versions(_links(spark, sf_dir)), revisited, concepts)
    return told.withColumn("summary", F.regexp_replace("summary", ", b(?=[A-Z]+\\))", ", "))


def _part(name: str, row: str, order: str) -> str:
    return f"(SELECT input_id, string_agg({row}, '|' ORDER BY {order}) AS x FROM ({ORACLES[name]}) GROUP BY input_id)"


PARTS = {
    "people": _part("f4_people", "person || ' ' || round(score, 3) || ' ' || roles", "rank"),
    "objections": _part("f6_objections", "concern || ' ' || weight || ' ' || from_intent || ' ' || quotes", "rank"),
    "read_first": _part("f9_reading_list", "doc_id || ' ' || why", "pos"),
    "venue": _part("f8_venue", "venue || ' ' || doc_id", "doc_id"),
    "record": _part("f5_track_record", "accepted || '/' || failed || '/' || open", "input_id"),
    "warnings": _part("f11_non_goal_warnings", "warnings", "input_id"),
    "closest": _part("f12_closest_with_reasons", "doc_id || ' ' || why || ' ' || superseded_by", "rank"),
    "said": _part("f10_summaries", "summary", "input_id"),
}


@query("SELECT c_custkey AS input_id, label, confidence, " + ", ".join(f"coalesce({k}.x, '') AS {k}" for k in PARTS) + f" FROM customer LEFT JOIN ({ORACLES['f10_verdicts']}) v ON v.input_id = c_custkey " + " ".join(f"LEFT JOIN {sql} {k} ON {k}.input_id = c_custkey" for k, sql in PARTS.items()))
def f13_all_parts(spark, sf_dir):
    """One nested record for each input with all its parts, flattened for comparison."""
    inputs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("input_id"))
    text = lambda *cols: F.concat_ws(" ", *(F.col(c).cast("string") for c in cols))

    def lines(rows, order, *cols):
        """Each input's rows as lines of text, in order."""
        found = expand.gathered(rows.select("input_id", F.col(order).alias("_k") if order != "input_id" else F.lit(0).alias("_k"), text(*cols).alias("t")), "x", "_k")
        return found.select("input_id", F.array_join(F.transform("x", lambda r: r["t"]), "|").alias("x"))

    record = f5_track_record(spark, sf_dir).withColumn("t", F.concat_ws("/", *(F.col(c).cast("string") for c in ("accepted", "failed", "open"))))
    rows = {
        "people": lines(f4_people(spark, sf_dir), "rank", "person", "score", "roles"),
        "objections": lines(f6_objections(spark, sf_dir), "rank", "concern", "weight", "from_intent", "quotes"),
        "read_first": lines(f9_reading_list(spark, sf_dir), "pos", "doc_id", "why"),
        "venue": lines(f8_venue(spark, sf_dir), "input_id", "venue", "doc_id"),
        "record": lines(record, "input_id", "t"),
        "warnings": lines(f11_non_goal_warnings(spark, sf_dir), "input_id", "warnings"),
        "closest": lines(f12_closest_with_reasons(spark, sf_dir), "rank", "doc_id", "why", "superseded_by"),
        "said": lines(f10_summaries(spark, sf_dir), "input_id", "summary"),
    }
    parts = {"verdict": _verdicts(spark, sf_dir).select("input_id", F.struct("label", "confidence").alias("verdict"))}
    # each part is written by itself: one plan of them all would hold the sorts of all at once
    parts |= {name: expand.cut(part.withColumnRenamed("x", name), name) for name, part in rows.items()}
    out = expand.assembled(inputs, parts)
    return out.select("input_id", "verdict.label", "verdict.confidence", *(F.coalesce(name, F.lit("")).alias(name) for name in rows))


# --------------------------------------------------------------- evaluation

SPLIT = f"""{META}, train AS (SELECT * FROM meta WHERE created < DATE '2000-01-01'), test AS (SELECT * FROM meta WHERE created >= DATE '2000-01-01')"""


@query(f"WITH {SPLIT} SELECT 'train' AS part, doc_id FROM train UNION ALL SELECT 'test', doc_id FROM test")
def g1_temporal_split(spark, sf_dir):
    train, test = evaluate.temporal_split(_meta(spark, sf_dir), "2000-01-01")
    part = lambda df, name: df.select(F.lit(name).alias("part"), "doc_id")
    return part(train, "train").union(part(test, "test"))


@query(f"""WITH {SPLIT}, {LINKS}, gold AS (SELECT DISTINCT src AS input_id, dst AS doc_id FROM links WHERE type IN ('BUILDS_ON', 'REQUIRES', 'REPLACES') AND dst IN (SELECT doc_id FROM train) AND src IN (SELECT doc_id FROM test))
SELECT input_id, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS gold, 'Order an earlier proposal. See an earlier proposal' AS text FROM gold GROUP BY input_id""")
def g2_holdout_cases(spark, sf_dir):
    meta = _meta(spark, sf_dir).withColumn("title", F.concat(F.lit("Order doc "), F.col("doc_id").cast("string"))).withColumn("abstract", F.concat(F.lit("See DOC-"), (F.col("doc_id") % 999).cast("string")))
    train, test = evaluate.temporal_split(meta, "2000-01-01")
    inputs, gold = evaluate.holdout_cases(test, _links(spark, sf_dir), train, "doc")
    grouped = gold.groupBy("input_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda d: d.cast("string")), ",").alias("gold"))
    return grouped.join(inputs, "input_id")


GOLD = f"""{TFIDF}, gold AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON b.text <> '' AND contains(d.text, left(b.text, 60))), ranked AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY round(cosine, 6) DESC, doc_id) AS rank FROM cos WHERE round(cosine, 6) > 0),
cases AS (SELECT item_id, count(*) AS gold FROM gold GROUP BY item_id), per AS (SELECT c.item_id, any_value(c.gold) AS gold, count(*) FILTER (WHERE rank <= 5) / any_value(c.gold) AS r5, count(*) FILTER (WHERE rank <= 10) / any_value(c.gold) AS r10, coalesce(1 / min(rank), 0) AS rr, coalesce(string_agg(g.doc_id::VARCHAR, ',' ORDER BY g.doc_id) FILTER (WHERE rank <= 10), '') AS hits FROM cases c LEFT JOIN gold g USING (item_id) LEFT JOIN ranked r ON r.item_id = g.item_id AND r.doc_id = g.doc_id GROUP BY c.item_id)"""


def _gold(spark, sf_dir):
    """Documents that hold the first 60 characters of an item."""
    return holders(_inputs(spark, sf_dir).select("input_id", F.substring("text", 1, 60).alias("start")), table(spark, sf_dir, "documents"))


def holders(items, docs):
    """items(input_id, start), docs(doc_id, text) -> input_id, doc_id where the text holds the start, which isn't empty.

    A text that holds a start holds the words between its blanks. The rarest of
    them in the texts finds the texts to test. Starts without any, which are short
    or odd, are tested on every text.
    """
    items, docs = items.where("start <> ''"), docs.select("doc_id", "text")
    own = items.select("input_id", F.explode(F.array_distinct(F.regexp_extract_all("start", F.lit(r"(?<=\s)(\S+)(?=\s)"), F.lit(1)))).alias("word"))
    words = docs.select("doc_id", F.explode(F.split("text", r"\s+")).alias("word")).join(own.select("word").distinct(), "word", "left_semi").distinct()
    words = expand.cut(words, "words")
    counts = words.groupBy("word").agg(F.count("*").alias("c"))
    rare = own.join(counts, "word", "left").groupBy("input_id").agg(F.min(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "word"))["word"].alias("word"))
    some = words.join(rare, "word").join(items, "input_id").join(docs, "doc_id").where(F.contains("text", F.col("start")))
    rest = docs.join(items.join(own.select("input_id").distinct(), "input_id", "left_anti"), F.contains("text", F.col("start")))
    return some.select("input_id", "doc_id").union(rest.select("input_id", "doc_id")).distinct()


def _gold_ranks(spark, sf_dir, gold):
    found = retrieval.cosines(_index(spark, sf_dir).products(_inputs(spark, sf_dir)), ["input_id", "doc_id"]).withColumn("score", F.round("cosine", 6)).where("score > 0")
    return evaluate.gold_ranks(expand.cut(found.select("input_id", "doc_id", "score"), "scores"), gold)


@query(f"WITH {GOLD} SELECT count(*) AS cases, round(avg(round(r5, 6)), 6) AS recall_5, round(avg(round(r10, 6)), 6) AS recall_10, round(avg(round(rr, 6)), 6) AS mrr FROM per")
def g3_ranking_metrics(spark, sf_dir):
    gold = expand.cut(_gold(spark, sf_dir), "gold")
    return evaluate.ranking_metrics(_gold_ranks(spark, sf_dir, gold), gold)


@query(f"WITH {GOLD} SELECT item_id, gold, hits, round(r10, 6) AS recall_10, round(rr, 6) AS rr FROM per")
def g6_per_case(spark, sf_dir):
    gold = expand.cut(_gold(spark, sf_dir), "gold")
    found = evaluate.per_case(_gold_ranks(spark, sf_dir, gold), gold)
    hits = F.array_join(F.transform("hits", lambda d: d.cast("string")), ",")
    return found.select(F.col("input_id").alias("item_id"), "gold", hits.alias("hits"), "recall_10", "rr")


JUDGED = f"""{VERDICTS}, judged AS (SELECT c.c_custkey AS input_id, CASE c.c_mktsegment WHEN 'BUILDING' THEN 'already_exists' WHEN 'MACHINERY' THEN 'previously_rejected' WHEN 'HOUSEHOLD' THEN 'extends_existing_area' ELSE 'outside_known_territory' END AS expected, v.label AS got, CASE WHEN c_custkey % 2 = 0 THEN 'in_progress' END AS also, CASE WHEN c_custkey % 3 <> 1 THEN (SELECT max(doc_id) FROM tops t WHERE t.input_id = c.c_custkey AND rank <= 2) END AS expected_doc, v.basis_doc, (SELECT list(doc_id ORDER BY rank) FROM tops t WHERE t.input_id = c.c_custkey AND rank <= 5) AS close FROM customer c JOIN verdicts v ON v.input_id = c.c_custkey),
placed AS (SELECT *, CASE WHEN basis_doc = expected_doc THEN 1 WHEN basis_doc IS NULL OR basis_doc = close[1] THEN coalesce(list_position(close, expected_doc), 0) ELSE CASE WHEN list_position(close, expected_doc) IS NULL THEN 0 ELSE list_position([x FOR x IN close IF x <> basis_doc], expected_doc) + 1 END END AS place FROM judged)"""


def _judged(spark, sf_dir):
    segment = F.col("c_mktsegment")
    expected = F.when(segment == "BUILDING", "already_exists").when(segment == "MACHINERY", "previously_rejected").when(segment == "HOUSEHOLD", "extends_existing_area").otherwise("outside_known_territory")
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("input_id"), expected.alias("expected"))
    close = expand.cut(_ranked(spark, sf_dir, 5), "close").groupBy("input_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("close"), F.max(F.when(F.col("rank") <= 2, F.col("doc_id"))).alias("m"))
    rows = customers.join(_verdicts(spark, sf_dir), "input_id").join(close, "input_id", "left")
    also = F.when(F.col("input_id") % 2 == 0, F.array(F.lit("in_progress"))).otherwise(F.array().cast("array<string>"))
    cited = F.array_compact(F.concat(F.array("basis_doc"), F.coalesce("close", F.array().cast("array<long>"))))
    return rows.select("input_id", "expected", F.col("label").alias("got"), also.alias("also"), F.when(F.col("input_id") % 3 != 1, F.col("m")).alias("expected_doc"), cited.alias("cited"))


@query(f"""WITH {JUDGED} SELECT count(*) AS cases, count(*) FILTER (WHERE expected = got) AS exact, count(*) FILTER (WHERE expected = got OR also = got) AS acceptable, count(*) FILTER (WHERE expected = got OR (expected LIKE 'previously%' AND got LIKE 'previously%')) AS tried_as_one,
count(*) FILTER (WHERE got NOT IN ('extends_existing_area', 'outside_known_territory')) AS claims, count(*) FILTER (WHERE got NOT IN ('extends_existing_area', 'outside_known_territory') AND (expected = got OR also = got)) AS claims_right, count(expected_doc) AS with_doc, count(*) FILTER (WHERE expected_doc IS NOT NULL AND place = 1) AS doc_first, count(*) FILTER (WHERE expected_doc IS NOT NULL AND place BETWEEN 1 AND 3) AS doc_in_three FROM placed""")
def g4_verdict_metrics(spark, sf_dir):
    return evaluate.verdict_metrics(_judged(spark, sf_dir))


@query(f"WITH {JUDGED} SELECT e.expected, " + ", ".join(f"count(*) FILTER (WHERE got = '{x}') AS {x}" for x in expand.LABELS) + f" FROM (SELECT unnest({expand.LABELS}) AS expected) e LEFT JOIN judged USING (expected) GROUP BY e.expected")
def g5_confusion(spark, sf_dir):
    return evaluate.confusion(_judged(spark, sf_dir))


# ---------------------------------------------------------------- summaries


@query(f"WITH {CITED} SELECT 'node' AS what, outcome AS type, count(*) AS n FROM dated GROUP BY outcome UNION ALL SELECT 'edge', type, count(*) FROM typed GROUP BY type")
def h1_counts_by_type(spark, sf_dir):
    """Counts of a graph that was written by type and read again."""
    from ..sources.corpus import read_graph, write_graph

    typed = _typed(spark, sf_dir)
    edges = relations.edges(typed.select(relations.key("doc", "src").alias("src"), relations.key("doc", "dst").alias("dst"), "type", "section"))
    nodes = _dated(spark, sf_dir).select(relations.key("doc", "doc_id").alias("id"), F.col("outcome").alias("type"))
    path = scratch(spark, "graph")
    write_graph(nodes, edges, path)
    return summary.counts_by_type(*read_graph(spark, path))


@query(f"""WITH {LINEAGE}, n AS (SELECT concept, count(*) AS ideas FROM scores JOIN meta USING (doc_id) WHERE outcome = 'failed' GROUP BY concept)
SELECT concept, coalesce(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FILTER (WHERE relation = 'INTRODUCES'), '') AS introduced, count(*) FILTER (WHERE relation = 'EXTENDS') AS extended, coalesce(sum(doc_id) FILTER (WHERE relation = 'PROPOSES'), 0)::BIGINT AS proposed_ids, any_value(ideas) AS ideas FROM lineage JOIN n USING (concept) WHERE relation <> 'MENTIONS' GROUP BY concept""")
def h2_concept_lineage(spark, sf_dir):
    focused = _focused(spark, sf_dir)
    failed = _meta(spark, sf_dir).where("outcome = 'failed'").select("doc_id")
    subjects = focused.join(failed, "doc_id", "left_semi").select(F.col("doc_id").alias("idea_id"), "concept")
    lists, counts = summary.concept_lineage(_lineage(spark, sf_dir), subjects, 5000)
    ids = F.array_join(F.transform("ids", lambda d: d.cast("string")), ",")
    first = lists.where("relation = 'INTRODUCES'").select("concept", ids.alias("introduced"))
    proposed = lists.where("relation = 'PROPOSES'").groupBy("concept").agg(F.sum(F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x)).alias("proposed_ids"))
    found = counts.where("introduced + extended + proposed > 0").select("concept", "extended", "ideas").join(first, "concept", "left").join(proposed, "concept", "left")
    return found.na.fill("", ["introduced"]).na.fill(0, ["proposed_ids"]).select("concept", "introduced", "extended", "proposed_ids", "ideas")


@query(f"""WITH {LINEAGE} SELECT concept, relation, doc_id // 5000 AS part, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS ids FROM lineage WHERE relation <> 'MENTIONS' GROUP BY ALL""")
def h2_lineage_lists(spark, sf_dir):
    """The documents of each concept and relation, in parts by ranges of their ids."""
    lists, _ = summary.concept_lineage(_lineage(spark, sf_dir), _focused(spark, sf_dir).select(F.col("doc_id").alias("idea_id"), "concept"), 5000)
    return lists.withColumn("ids", F.array_join(F.transform("ids", lambda d: d.cast("string")), ","))


@query(f"""WITH {LINEAGE}, {LINKS} SELECT doc_id, coalesce((SELECT string_agg(concept, ',' ORDER BY weight DESC, concept) FROM focused f WHERE f.doc_id = m.doc_id AND focus), '') AS focus, coalesce((SELECT string_agg(DISTINCT dst::VARCHAR, ',') FROM links l WHERE l.src = m.doc_id AND type = 'BUILDS_ON'), '') AS builds_on, (SELECT count(*) FROM lineitem WHERE l_orderkey = m.doc_id AND l_returnflag = 'R') AS considered FROM meta m""")
def h3_corpus_table(spark, sf_dir):
    ideas = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("doc_id"))
    found = summary.corpus_table(_meta(spark, sf_dir).select("doc_id").join(relations.focus_lists(_focused(spark, sf_dir)), "doc_id", "left"), _links(spark, sf_dir), ideas)
    return found.select("doc_id", F.array_join("focus", ",").alias("focus"), F.array_join(F.transform("builds_on", lambda d: d.cast("string")), ",").alias("builds_on"), "considered")


@query(f"""WITH {REVISITS}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY idea_id ORDER BY round(cosine, 9) DESC, doc_id) AS k FROM pairs) WHERE k = 1)
SELECT idea_id, 'Order ' || substr(idea_id, 6) AS idea, substr(idea_id, 6)::BIGINT AS rejected_in, doc_id, 'Order ' || doc_id AS title, o_orderstatus AS status, round(least(0.9, 0.4 + cosine), 3) AS confidence FROM best JOIN orders ON o_orderkey = doc_id""")
def h4_revisited(spark, sf_dir):
    meta = _meta(spark, sf_dir)
    ideas = meta.where("outcome = 'failed'").select(F.concat(F.lit("idea:"), F.col("doc_id").cast("string")).alias("idea_id"), "doc_id", "title")
    return summary.revisited_list(_revisits(spark, sf_dir), ideas, meta)


@query("""SELECT event_type AS concern, count(*) FILTER (WHERE user_id % 2 = 0) AS by_ideas, count(*) FILTER (WHERE user_id % 2 <> 0) AS by_docs, count(*) AS total FROM events GROUP BY event_type""")
def h5_objection_frequency(spark, sf_dir):
    src = F.concat(F.when(F.col("user_id") % 2 == 0, "idea:").otherwise("doc:"), F.col("user_id").cast("string"))
    return summary.objection_frequency(table(spark, sf_dir, "events").select(src.alias("src"), F.col("event_type").alias("concern")))


@query("""SELECT l_suppkey AS person, count(*) AS roles FROM lineitem GROUP BY l_suppkey ORDER BY roles DESC, person LIMIT 12""")
def h6_most_involved(spark, sf_dir):
    return summary.most_involved(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("person")))
