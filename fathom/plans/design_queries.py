"""Sections, document relations and the whole workloads, over design documents made of the documents table.

Each document becomes one in markup: headers, its text as the abstract, sections
of rejected ideas and others. Which headers and sections it has, and how deep
they go, depends on its doc_id, so that every type of edge occurs.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..operators import expand, relations
from ..operators.sections import sections, subtree_texts, top_level
from ..sources import corpus
from . import precedents
from .registry import query, table

LEXICON = lx.Lexicon(
    concepts=(lx.Concept("thing", phrases=(" the ", " der ", " les ", " los ")), lx.Concept("swap", phrases=(r"\binstead\b",)), lx.Concept("mark", phrases=("[#*$%&]{3}",))),
    concerns=lx.DEFAULT.concerns, intents=lx.DEFAULT.intents, intent_concerns=lx.DEFAULT.intent_concerns, tools={"licence": r"licensed?"},
    section_kinds=lx.DEFAULT.section_kinds, rejected_heading=lx.DEFAULT.rejected_heading, reason_cues=lx.DEFAULT.reason_cues, generic_words=lx.DEFAULT.generic_words, venues=lx.DEFAULT.venues,
    url="https://docs.example.org/{}",
)

#: Sections: when a document k has them, level, title, and text in SQL; `{x}` are columns or expressions.
IDEA = "'We rejected ' || source || ' because it is slow for plan' || (doc_id % 37) || ', see doc ' || (doc_id // 5) || '. However the reader may find it confusing and costly.'"
AGAIN = "'Use ' || lang || ' instead of ' || source || ', because plan' || (doc_id % 37) || ' was rejected as slow. ' || replace(left(text, 60), chr(10), ' ')"
ABSTRACT = f"CASE WHEN doc_id % 9 = 0 THEN {AGAIN} || chr(10) || chr(10) ELSE '' END || text || chr(10) || chr(10) || 'It builds on doc ' || (doc_id // 3) || '.'"
LAYOUT = (
    ("doc_id >= 0", 1, "'Abstract'", ABSTRACT, "abstract"),
    ("doc_id >= 0", 1, "'Rejected Ideas'", "''", "rejected"),
    ("doc_id >= 0", 2, "'Use ' || lang || ' instead'", f"CASE WHEN doc_id % 4 = 1 THEN '' ELSE {IDEA} END", "rejected"),
    ("doc_id % 4 = 1", 3, "'First part'", IDEA, "rejected"),
    ("doc_id % 4 = 1", 3, "'Second part'", "'It was seen as not worth it by ' || source || '.'", "rejected"),
    ("doc_id % 3 >= 1", 2, "'Split ' || source", "'Splitting ' || source || ' was too slow for ' || lang || '.'", "rejected"),
    ("doc_id % 3 = 2", 2, "'Keep plan' || (doc_id % 37)", "'To keep plan' || (doc_id % 37) || ' would break things for ' || lang || '.'", "rejected"),
    ("doc_id % 6 = 0", 1, "'Reference Implementation'", "'A licensed branch of ' || source || ' has it.'", "reference_impl"),
    ("doc_id % 5 = 2", 1, "'Compatibility'", "'Old calls of ' || source || ' may break.'", "compat"),
    ("doc_id % 3 = 1", 1, "'Resolution'", "'Because ' || source || ' would be too costly for ' || lang || '.'", "decision"),
)


def design_documents(spark, sf_dir, all_resolved: bool = False):
    """As LAYOUT says; with all_resolved, each document has the section on its resolution."""
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    n = lambda c: c.cast("string")
    line = lambda name, *value: F.concat(F.lit(f"{name}: "), *(F.lit(v) if isinstance(v, str) else v for v in value), F.lit("\n"))
    some = lambda test, text: F.when(test, text).otherwise("")
    lang, source, plan = F.col("lang"), F.col("source"), F.concat(F.lit("plan"), n(k % 37))
    status = F.when(k % 3 == 0, "Final").when(k % 3 == 1, "Rejected").otherwise("Draft")
    created = F.date_format(F.date_add(F.lit("2000-01-01").cast("date"), (k % 9000).cast("int")), "dd-MMM-yyyy")
    head = F.concat(
        line("Doc", n(k)), line("Title", "On ", source, " and ", lang, some(k % 9 == 0, " instead")), line("Status", status), line("Type", "Standards Track"), line("Created", created),
        line("Author", "Ann ", source, " <", source, "@example.org>,\n  Bob ", lang), line("Requires", n(F.floor(k / 2))), line("Discussions-To", "mail.example.org"),
        some(k % 5 == 0, line("Sponsor", "Sue ", lang)), some(k % 4 == 0, line("Delegate", "Del ", source)), some(k % 2 == 0, line("Version", "1.", n(k % 3), ", 2.0")),
        some(k % 7 == 3, line("Superseded-By", n(k + 1))), some((k % 7 == 5) & (k > 0), line("Replaces", n(k - 1))), F.lit("\n"),
    )
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    idea = text("We rejected ", source, " because it is slow for ", plan, ", see doc ", n(F.floor(k / 5)), ". However the reader may find it confusing and costly.")
    again = text("Use ", lang, " instead of ", source, ", because ", plan, " was rejected as slow. ", F.replace(F.substring("text", 1, 60), F.lit("\n"), F.lit(" ")), "\n\n")
    nested = k % 4 == 1

    def section(rule: str, title, own, when=None):
        width = F.char_length(title) if not isinstance(title, str) else F.lit(len(title))
        made = text(title, "\n", F.repeat(F.lit(rule), width), "\n\n", own, "\n\n")
        return made if when is None else some(when, made)

    body = F.concat(
        section("=", "Abstract", text(some(k % 9 == 0, again), F.col("text"), "\n\nIt builds on doc ", n(F.floor(k / 3)), ".")),
        section("=", "Rejected Ideas", ""),
        section("-", text("Use ", lang, " instead"), some(~nested, idea)),
        section("~", "First part", idea, nested),
        section("~", "Second part", text("It was seen as not worth it by ", source, "."), nested),
        section("-", text("Split ", source), text("Splitting ", source, " was too slow for ", lang, "."), k % 3 >= 1),
        section("-", text("Keep ", plan), text("To keep ", plan, " would break things for ", lang, "."), k % 3 == 2),
        section("=", "Reference Implementation", text("A licensed branch of ", source, " has it."), k % 6 == 0),
        section("=", "Compatibility", text("Old calls of ", source, " may break."), k % 5 == 2),
        section("=", "Resolution", text("Because ", source, " would be too costly for ", lang, "."), None if all_resolved else k % 3 == 1),
    )
    return corpus.documents(d.select(F.concat(head, body).alias("raw")))


def _layout_sql() -> str:
    """laid(doc_id, ord, last, level, title, path, own, kind, leaf): the sections that LAYOUT says a document has."""
    trimmed = lambda x: rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
    rows = ["SELECT doc_id, 0 AS pos, 0 AS level, '' AS title, '' AS own, 'body' AS kind FROM documents"]
    rows += [f"SELECT doc_id, {pos}, {level}, {title}, {trimmed(own)}, '{kind}' FROM documents WHERE {when}" for pos, (when, level, title, own, kind) in enumerate(LAYOUT, 1)]
    return f"""placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS ord FROM ({" UNION ALL ".join(rows)})),
ended AS (SELECT p.*, coalesce((SELECT min(q.ord) FROM placed q WHERE q.doc_id = p.doc_id AND q.ord > p.ord AND q.level <= p.level), (SELECT max(q.ord) + 1 FROM placed q WHERE q.doc_id = p.doc_id)) - 1 AS last FROM placed p),
laid AS (SELECT e.*, last = ord AS leaf, coalesce((SELECT string_agg(a.title, ' / ' ORDER BY a.ord) FROM ended a WHERE a.doc_id = e.doc_id AND a.level > 0 AND a.ord <= e.ord AND e.ord <= a.last), '') AS path FROM ended e)"""


LAID = _layout_sql()
DOCS = """said AS (SELECT *, 'On ' || source || ' and ' || lang || CASE WHEN doc_id % 9 = 0 THEN ' instead' ELSE '' END AS title, CASE doc_id % 3 WHEN 0 THEN 'Final' WHEN 1 THEN 'Rejected' ELSE 'Draft' END AS status, CASE doc_id % 3 WHEN 0 THEN 'accepted' WHEN 1 THEN 'failed' ELSE 'open' END AS outcome, DATE '2000-01-01' + (doc_id % 9000)::INT AS created FROM documents)"""


@query(f"""WITH {DOCS} SELECT doc_id, title, 'Ann ' || source || ' <' || source || '@example.org>, Bob ' || lang AS author, 8 + (doc_id % 5 = 0)::INT + (doc_id % 4 = 0)::INT + (doc_id % 2 = 0)::INT + (doc_id % 7 = 3)::INT + (doc_id % 7 = 5)::INT AS n FROM said""")
def b1_headers(spark, sf_dir):
    h = F.col("headers")
    return design_documents(spark, sf_dir).select("doc_id", h["Title"].alias("title"), h["Author"].alias("author"), F.size(h).alias("n"))


@query(f"WITH {LAID} SELECT doc_id, ord, last, level, title, path, md5(own) AS digest, kind FROM laid")
def b2_b3_sections(spark, sf_dir):
    found = sections(design_documents(spark, sf_dir), LEXICON.section_kinds)
    return found.select("doc_id", "ord", "last", "level", "title", F.array_join("path", " / ").alias("path"), F.md5("own_text").alias("digest"), "kind")


@query(f"""WITH {LAID}, below AS (SELECT a.doc_id, a.ord, string_agg(b.title || CASE WHEN b.own <> '' OR b.leaf THEN chr(10) || b.own ELSE '' END, chr(10) ORDER BY b.ord) AS rest FROM laid a JOIN laid b ON b.doc_id = a.doc_id AND b.ord > a.ord AND b.ord <= a.last GROUP BY a.doc_id, a.ord)
SELECT doc_id, ord, md5(CASE WHEN rest IS NULL THEN own WHEN own = '' THEN rest ELSE own || chr(10) || rest END) AS digest FROM laid LEFT JOIN below USING (doc_id, ord)""")
def b4_subtree_texts(spark, sf_dir):
    """Empty own texts add nothing: neither a line of their own nor one behind their title, unless nothing follows below it."""
    found = sections(design_documents(spark, sf_dir), LEXICON.section_kinds)
    return subtree_texts(found).select("doc_id", "ord", F.md5("full_text").alias("digest"))


@query(f"WITH {LAID} SELECT doc_id, title, md5(own) AS digest FROM laid WHERE title = 'Abstract'")
def b5_top_level(spark, sf_dir):
    found = sections(design_documents(spark, sf_dir))
    return top_level(found, ["abstract", "summary"]).select("doc_id", "title", F.md5("own_text").alias("digest"))


@query(f"""WITH {DOCS}, {LAID} SELECT doc_id, title, outcome, strftime(created, '%Y-%m-%d') AS created, (SELECT string_agg(l.title, '|' ORDER BY ord) FROM laid l WHERE l.doc_id = said.doc_id AND level BETWEEN 1 AND 2 AND kind <> 'decision') AS outline, 'https://docs.example.org/' || doc_id AS url FROM said""")
def d1_documents(spark, sf_dir):
    docs = design_documents(spark, sf_dir)
    meta = relations.document_table(docs, sections(docs, LEXICON.section_kinds), LEXICON)
    return meta.select("doc_id", "title", "outcome", F.col("created").cast("string").alias("created"), F.array_join("outline", "|").alias("outline"), "url")


@query("""SELECT 'doc:' || doc_id AS src, 'person:ann-' || source AS dst, 'AUTHORED_BY' AS type, 0 AS ord FROM documents UNION ALL SELECT 'doc:' || doc_id, 'person:bob-' || lang, 'AUTHORED_BY', 1 FROM documents
UNION ALL SELECT 'doc:' || doc_id, 'doc:' || (doc_id // 2), 'REQUIRES', 0 FROM documents UNION ALL SELECT 'doc:' || doc_id, 'venue:list', 'DISCUSSED_AT', 0 FROM documents
UNION ALL SELECT 'doc:' || doc_id, 'person:sue-' || lang, 'SPONSORED_BY', 0 FROM documents WHERE doc_id % 5 = 0
UNION ALL SELECT 'doc:' || doc_id, 'version:1.' || (doc_id % 3), 'TARGETS', 0 FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT 'doc:' || doc_id, 'version:2.0', 'TARGETS', 1 FROM documents WHERE doc_id % 2 = 0
UNION ALL SELECT 'doc:' || doc_id, 'doc:' || (doc_id + 1), 'SUPERSEDED_BY', 0 FROM documents WHERE doc_id % 7 = 3 UNION ALL SELECT 'doc:' || doc_id, 'doc:' || (doc_id - 1), 'REPLACES', 0 FROM documents WHERE doc_id % 7 = 5""")
def d3_header_edges(spark, sf_dir):
    return relations.header_edges(design_documents(spark, sf_dir), LEXICON).select("src", "dst", "type", "ord")


@query("""SELECT 'person:ann-' || source AS id, 'Ann ' || source AS name, source || '@example.org' AS emails FROM documents GROUP BY source UNION ALL SELECT 'person:bob-' || lang, 'Bob ' || lang, '' FROM documents GROUP BY lang UNION ALL SELECT 'person:sue-' || lang, 'Sue ' || lang, '' FROM documents WHERE doc_id % 5 = 0 GROUP BY lang""")
def d4_persons(spark, sf_dir):
    found = relations.persons(relations.header_people(design_documents(spark, sf_dir), ["Author", "Sponsor"]))
    return found.select("id", "name", F.array_join("emails", ",").alias("emails"))


def _decisions(spark, sf_dir, all_resolved: bool = False):
    docs = design_documents(spark, sf_dir, all_resolved)
    return docs, relations.decisions(docs, sections(docs, LEXICON.section_kinds), LEXICON)


@query(f"""WITH {DOCS} SELECT doc_id, status, outcome, CASE WHEN doc_id % 3 = 1 THEN 'Because ' || source || ' would be too costly for ' || lang || '.' END AS rationale FROM said WHERE doc_id % 3 < 2""")
def d5_decisions(spark, sf_dir):
    return _decisions(spark, sf_dir)[1].select("doc_id", "status", "outcome", "rationale")


@query(f"WITH {LAID} SELECT doc_id, ord, 2 AS container FROM laid WHERE kind = 'rejected' AND leaf")
def d10_rejected_leaves(spark, sf_dir):
    return relations.rejected_leaves(sections(design_documents(spark, sf_dir), LEXICON.section_kinds), LEXICON)


IDEAS = f"{LAID}, ideas AS (SELECT l.doc_id, ord, title, own, 'idea:' || l.doc_id || ':' || regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g') AS idea_id FROM laid l WHERE kind = 'rejected' AND leaf)"


def _ideas(spark, sf_dir):
    docs = design_documents(spark, sf_dir)
    found = expand.cut(sections(docs, LEXICON.section_kinds), "sections")
    return docs, found, expand.cut(relations.ideas(found, relations.document_table(docs, found, LEXICON), LEXICON), "ideas")


@query(f"""WITH {IDEAS} SELECT idea_id, doc_id, title, 'alternative' AS kind, own AS summary, CASE WHEN regexp_matches(own, 'rejected|because|However|too') THEN own END AS reason, year(DATE '2000-01-01' + (doc_id % 9000)::INT) AS year FROM ideas""")
def d11_ideas(spark, sf_dir):
    return _ideas(spark, sf_dir)[2].select("idea_id", "doc_id", "title", "kind", "summary", "reason", "year")


CUES = "(SELECT * FROM (VALUES ('cost', 'slow|cost'), ('clarity', 'confus'), ('breakage', 'break'), ('need', 'not worth')) v(concern, cue))"


@query(f"""WITH {IDEAS}, sentences AS (SELECT idea_id, unnest(string_split(replace(own, '. However', '.' || chr(1) || 'However'), chr(1))) AS s, generate_subscripts(string_split(replace(own, '. However', '.' || chr(1) || 'However'), chr(1)), 1) AS n FROM ideas)
SELECT idea_id AS src, 'concern:' || concern AS dst, 0.6 AS confidence, 'rejected_idea' AS context, first(s ORDER BY n) AS evidence FROM sentences JOIN {CUES} ON regexp_matches(s, cue) GROUP BY idea_id, concern
UNION ALL SELECT 'doc:' || doc_id, 'concern:cost', 0.7, 'decision', own FROM laid WHERE kind = 'decision'
UNION ALL SELECT 'doc:' || doc_id, 'concern:breakage', 0.5, 'compat', own FROM laid WHERE kind = 'compat'""")
def d13_raises(spark, sf_dir):
    """Concerns of ideas, of failed decisions, and of sections on compatibility."""
    docs, found, ideas = _ideas(spark, sf_dir)
    decided = relations.decisions(docs, found, LEXICON)
    every = relations.idea_edges(ideas, LEXICON).unionByName(relations.decision_edges(docs, decided, LEXICON)).unionByName(relations.section_concerns(found, LEXICON))
    return every.where("type = 'RAISES'").select("src", "dst", "confidence", "context", "evidence")


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Final' ELSE 'Rejected' END AS status, 'Because ' || source || ' would be too costly for ' || lang || '.' AS rationale FROM documents WHERE doc_id % 3 < 2""")
def f7_reported_decisions(spark, sf_dir):
    """All documents say why here: accepted ones are told of for their rationale, drafts aren't decided on."""
    return expand.reported_decisions(_decisions(spark, sf_dir, all_resolved=True)[1]).select("doc_id", "status", "rationale")


@query(f"""WITH {DOCS}, {IDEAS}, cited AS (SELECT doc_id // 2 AS d FROM documents UNION SELECT doc_id // 3 FROM documents UNION SELECT doc_id // 5 FROM documents UNION SELECT doc_id + 1 FROM documents WHERE doc_id % 7 = 3 UNION SELECT doc_id - 1 FROM documents WHERE doc_id % 7 = 5)
SELECT 'doc:' || doc_id AS id, 'Document' AS type, title AS label, doc_id, title, status, outcome, true AS in_corpus, 'https://docs.example.org/' || doc_id AS url, NULL AS kind, NULL AS section, NULL AS reason, NULL AS rationale, year(created) AS year FROM said
UNION ALL SELECT 'doc:' || d, 'Document', '?', NULL, '?', NULL, NULL, false, 'https://docs.example.org/' || d, NULL, NULL, NULL, NULL, NULL FROM (SELECT d FROM cited EXCEPT SELECT doc_id FROM documents)
UNION ALL SELECT 'decision:' || doc_id, 'Decision', status, doc_id, NULL, status, outcome, NULL, NULL, NULL, NULL, NULL, CASE WHEN doc_id % 3 = 1 THEN 'Because ' || source || ' would be too costly for ' || lang || '.' END, NULL FROM said WHERE doc_id % 3 < 2
UNION ALL SELECT idea_id, 'RejectedIdea', i.title, i.doc_id, i.title, NULL, NULL, NULL, NULL, 'alternative', path, CASE WHEN regexp_matches(i.own, 'rejected|because|However|too') THEN i.own END, NULL, year(DATE '2000-01-01' + (i.doc_id % 9000)::INT) FROM ideas i JOIN laid l ON l.doc_id = i.doc_id AND l.ord = i.ord""")
def a6_stored_graph(spark, sf_dir):
    """Nodes with their attributes, of a graph that was built, checked and written by type, and read again."""
    path = precedents.scratch(spark, "graph")
    precedents.build(design_documents(spark, sf_dir), LEXICON, path=path)
    nodes = precedents.Graph.load(spark, path).nodes.where("type in ('Document', 'Decision', 'RejectedIdea')")
    inside = F.when((F.col("type") == "Document") & ~F.col("in_corpus"), None).otherwise(F.col("doc_id"))
    return nodes.select("id", "type", "label", inside.alias("doc_id"), "title", "status", "outcome", "in_corpus", "url", "kind", "section", "reason", "rationale", "year")


def w1_build_graph(spark, sf_dir):
    """Edges of the whole graph by type, with their mean confidence."""
    g = precedents.build(design_documents(spark, sf_dir), LEXICON)
    return g.edges.groupBy("type").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))


def w2_assess(spark, sf_dir):
    """Benchmark items assessed against the graph as it was stored and read again, one row for each."""
    g = precedents.build(design_documents(spark, sf_dir), LEXICON)
    inputs = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("input_id"), F.concat("text", F.lit(" Use doc "), (F.col("item_id") + 3).cast("string"), F.lit(" instead, with new syntax.")).alias("text"))
    out = precedents.assess(g, inputs)
    return out.select("input_id", "verdict.label", "verdict.confidence", "verdict.summary", F.to_json("closest").alias("closest"), F.to_json("rejected_ideas").alias("rejected_ideas"), F.to_json("objections").alias("objections"), F.to_json("read_first").alias("read_first"), F.to_json("people").alias("people"), F.to_json("warnings").alias("warnings"))


def w3_holdout(spark, sf_dir):
    """Documents of later dates as inputs to the graph of earlier ones."""
    return precedents.holdout(design_documents(spark, sf_dir), LEXICON, "2002-01-01")


query()(w1_build_graph)
query()(w2_assess)
query()(w3_holdout)
