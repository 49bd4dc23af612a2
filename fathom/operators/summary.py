"""Summary tables of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts_by_type(nodes: DataFrame, all_edges: DataFrame) -> DataFrame:
    """what (node or edge), type, n."""
    count = lambda df, what: df.groupBy("type").agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "type", "n")
    return count(nodes, "node").union(count(all_edges, "edge"))


def concept_lineage(relations: DataFrame, subjects: DataFrame, width: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """(doc_id, concept, relation), (idea_id, concept) -> (concept, relation, part, ids) and (concept, introduced, extended, proposed, ideas).

    The first lists the documents of each concept and relation: a part has the
    sorted ids of one range of `width`, so no row grows with the concept, and
    parts follow each other in the order of ids. The second counts.
    """
    kinds = ["INTRODUCES", "EXTENDS", "PROPOSES"]
    own = relations.where(F.col("relation").isin(*kinds))
    lists = own.groupBy("concept", "relation", F.floor(F.col("doc_id") / width).alias("part")).agg(F.array_sort(F.collect_set("doc_id")).alias("ids"))
    counts = own.groupBy("concept").agg(*(F.count_if(F.col("relation") == k).alias(name) for k, name in zip(kinds, ("introduced", "extended", "proposed"), strict=True)))
    about = subjects.groupBy("concept").agg(F.count("*").alias("ideas"))
    return lists, counts.join(about, "concept", "full_outer").na.fill(0)


def corpus_table(focuses: DataFrame, links: DataFrame, all_ideas: DataFrame) -> DataFrame:
    """(doc_id, focus_concepts) of all documents -> doc_id, focus, builds_on (sorted), considered."""
    b = links.where("type = 'BUILDS_ON'").groupBy(F.col("src").alias("doc_id")).agg(F.array_sort(F.collect_set("dst")).alias("builds_on"))
    c = all_ideas.groupBy("doc_id").agg(F.count("*").alias("considered"))
    out = focuses.select("doc_id", "focus_concepts").join(b, "doc_id", "left").join(c, "doc_id", "left")
    return out.select("doc_id", F.coalesce("focus_concepts", F.array().cast("array<string>")).alias("focus"), F.coalesce("builds_on", F.array().cast("array<long>")).alias("builds_on"), F.coalesce("considered", F.lit(0)).alias("considered"))


def revisited_list(revisited: DataFrame, all_ideas: DataFrame, meta: DataFrame) -> DataFrame:
    """(idea_id, doc_id, confidence) with the idea's and the document's titles."""
    named = revisited.join(all_ideas.select("idea_id", F.col("doc_id").alias("rejected_in"), F.col("title").alias("idea")), "idea_id")
    return named.join(meta.select("doc_id", "title", "status"), "doc_id").select("idea_id", "idea", "rejected_in", "doc_id", "title", "status", "confidence")


def objection_frequency(raises: DataFrame) -> DataFrame:
    """(src, concern) -> concern, by_ideas, by_docs, total."""
    is_idea = F.col("src").startswith("idea:")
    return raises.groupBy("concern").agg(F.count_if(is_idea).alias("by_ideas"), F.count_if(~is_idea).alias("by_docs"), F.count("*").alias("total"))


def most_involved(roles: DataFrame, limit: int = 12) -> DataFrame:
    """(person, ...) one row for each role -> person, roles: the first by number, ties by id."""
    return roles.groupBy("person").agg(F.count("*").alias("roles")).orderBy(F.desc("roles"), "person").limit(limit)
