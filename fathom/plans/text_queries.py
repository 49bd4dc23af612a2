"""Text functions, the lexicon and sources, run over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx
from ..operators.dictionary import phrase_counts, words_of
from ..session import shared_dir
from ..sources import corpus
from .registry import query, table

#: Words of the synthetic prose serve as a lexicon, free of lookaround and word boundaries, whose meaning differs between engines, so that SQL can count them too.
CONCEPTS = (
    lx.Concept("the", phrases=(" the ",)),
    lx.Concept("that", phrases=(" that ", " this ")),
    lx.Concept("der", phrases=(" der ", " die ", " das ")),
    lx.Concept("les", phrases=(" les ",)),
    lx.Concept("los", phrases=(" los ",)),
)
TOOLS = {"licence": r"licensed?", "mail": r"@[a-z]+\.", "address": r"\d+\.\d+\.\d+\.\d+", "marks": r"[&%$*#]{3}"}
CONCERNS = {"insult": (r"\bidiot\b", r"\bmoron\b"), "clown": (r"\bclown\b",), "rights": (r"licen[sc]e", r"rights")}
INTENTS = {"shout": (r"!!",), "number": (r"\d{4,}",), "mail": (r"@",), "list": (r"\n",)}


def _any(patterns) -> str:
    return "(?i)" + "|".join(f"(?:{p})" for p in patterns)


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SENTENCES = r"""list_filter([trim(s, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) FOR s IN string_split(regexp_replace({t}, '([.!?])\s+([A-Z`("''])', '\1' || chr(1) || '\2', 'g'), chr(1))], lambda s: length(s) > 15)"""
#: Paragraphs of texts without markup: blocks of lines, indented ones left out. Stars, which would need lookaround, are replaced on both sides.
PARAGRAPHS = r"""[p FOR p IN [trim(regexp_replace(array_to_string([trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) FOR x IN b], ' '), '\s+', ' ', 'g')) FOR b IN
 [[x FOR x IN string_split(b, chr(10)) IF regexp_matches(x, '\S')] FOR b IN string_split_regex({t}, '\n\s*\n')]
 IF len(b) > 0 AND NOT (len([x FOR x IN b IF regexp_matches(x, '^[ \t]')]) = len(b) AND NOT regexp_matches(b[1], '^\s*(?:[*-]|#\.)')) AND NOT starts_with(b[1], '>>>') AND NOT (len(b) = 1 AND regexp_matches(b[1], '::\s*$'))]
 IF length(p) > 20]"""
WORDS = r"SELECT doc_id, trim(unnest(regexp_extract_all(lower(text), '[a-z_][a-z0-9_]+')), '_') AS w FROM documents"
STOPS = ", ".join(_q(w) for w in tx.STOP_WORDS)


def terms_sql(words: str, key: str) -> str:
    return f"""SELECT {key}, CASE WHEN w LIKE '%ies' AND length(w) > 6 THEN left(w, length(w) - 3) || 'y'
     WHEN w LIKE '%es' AND length(w) > 5 THEN left(w, length(w) - 2)
     WHEN w LIKE '%s' AND length(w) > 4 AND w NOT LIKE '%ss' THEN left(w, length(w) - 1) ELSE w END AS term
     FROM ({words}) WHERE length(w) >= 3 AND w NOT IN ({STOPS})"""


@query(r"""SELECT doc_id, md5(chr(10) || lang || ' and ' || source || ' in ' || lang || ', ' || source || ' at site: 2*3 ' || regexp_replace(translate(text, '*`:<_', '+++++'), '[ \t]+', ' ', 'g')) AS digest FROM documents""")
def b6_strip_markup(spark, sf_dir):
    """Each document behind a directive, a role with a target, a literal, bold, italic and a link."""
    own = F.translate("text", "*`:<_", "+++++")
    raw = F.concat(F.lit(".. note:: gone\n:ref:`"), "lang", F.lit(" <t>` and ``"), "source", F.lit("`` in  **"), "lang", F.lit("**, *"), "source", F.lit("* at `site <http://x>`_: 2*3\t "), own)
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.plain(raw)).alias("digest"))


@query(f"""SELECT doc_id, len(p) AS n, md5(array_to_string(p, '|')) AS digest FROM (SELECT doc_id, {PARAGRAPHS.format(t="replace(text, '*', '+')")} AS p FROM documents)""")
def b7_paragraphs(spark, sf_dir):
    p = tx.paragraphs(F.translate("text", "*", "+"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(p).cast("long").alias("n"), F.md5(F.array_join(p, "|")).alias("digest"))


@query(rf"""SELECT doc_id, CASE WHEN length(f) <= 320 THEN f WHEN length(stop) > 81 THEN stop ELSE rtrim(left(f, 320)) || '…' END AS opening
FROM (SELECT doc_id, f, regexp_extract(left(f, 320), '(?s)^(.*[.?]) ', 1) AS stop FROM (SELECT doc_id, CASE WHEN len(p) = 0 THEN '' ELSE p[1] END AS f FROM (SELECT doc_id, {PARAGRAPHS.format(t="replace(text, '*', '+')")} AS p FROM documents)))""")
def b8_first_sentences(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.first_sentences(F.translate("text", "*", "+"), 320).alias("opening"))


@query(f"""SELECT doc_id, len(s) AS n, md5(array_to_string(s, '|')) AS digest FROM (SELECT doc_id, {SENTENCES.format(t="text")} AS s FROM documents)""")
def b9_sentences(spark, sf_dir):
    s = tx.sentences("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(s).cast("long").alias("n"), F.md5(F.array_join(s, "|")).alias("digest"))


@query(f"""SELECT doc_id, term, count(*) AS tf FROM ({terms_sql(WORDS, "doc_id")}) GROUP BY doc_id, term""")
def b10_term_counts(spark, sf_dir):
    from ..operators.retrieval import term_counts

    return term_counts(table(spark, sf_dir, "documents"))


@query(r"""SELECT p_partkey, left(trim(regexp_replace(lower(p_name || ' / ' || p_brand || ' ' || p_type), '[^a-z0-9]+', '-', 'g'), '-'), 60) AS slug FROM part""")
def b11_slug(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", tx.slug(F.concat_ws(" ", "p_name", F.lit("/"), "p_brand", "p_type")).alias("slug"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'O') THEN strftime(o_orderdate, '%Y-%m-%d') END AS created FROM orders""")
def b12_parse_date(spark, sf_dir):
    day = F.col("o_orderdate")
    written = F.when(F.col("o_orderstatus") == "F", F.date_format(day, "dd-MMM-yyyy")).when(F.col("o_orderstatus") == "O", F.date_format(day, "yyyy-MM-dd")).otherwise("soon")
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.parse_date(written).cast("string").alias("created"))


@query("""SELECT n_nationkey, CAST(pos AS INTEGER) AS pos, name, CASE WHEN pos % 2 = 0 THEN lower(replace(name, '#', '.')) || '@example.org' END AS email FROM (
SELECT c_nationkey AS n_nationkey, c_name AS name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS pos FROM customer)""")
def b13_people(spark, sf_dir):
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1
    rows = table(spark, sf_dir, "customer").withColumn("pos", nth)
    email = F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@example.org"))
    one = F.when(F.col("pos") % 2 == 0, F.concat(F.lit('"'), "c_name", F.lit('"  <'), email, F.lit(">"))).otherwise(F.col("c_name"))
    value = rows.groupBy("c_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", one.alias("p")))), lambda x: x["p"]), ", ").alias("value"))
    return value.select(F.col("c_nationkey").alias("n_nationkey"), F.posexplode(tx.people("value")).alias("pos", "p")).select("n_nationkey", "pos", "p.name", "p.email")


@query("""SELECT page_id, CASE WHEN contains(lower(url), 'example.com') THEN 'com' WHEN contains(lower(url), 'example.net') THEN 'net' WHEN contains(lower(url), 'example.org') THEN 'org' END AS venue FROM pages""")
def b14_venue(spark, sf_dir):
    rules = {"com": "example.com", "net": "Example.net", "org": "example.org"}
    return table(spark, sf_dir, "pages").select("page_id", tx.first_rule("url", rules).alias("venue"))


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'P' THEN 'failed' ELSE 'open' END AS outcome FROM orders""")
def b15_outcome(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.outcome("o_orderstatus", ["F"], ["P"]).alias("outcome"))


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'P' THEN 'failed' ELSE 'open' END AS outcome FROM orders""")
def b15_default_outcome(spark, sf_dir):
    """With the sets of the default lexicon: what was superseded had been accepted."""
    status = F.when(F.col("o_orderstatus") == "F", "Superseded").when(F.col("o_orderstatus") == "P", "Withdrawn").otherwise("Deferred")
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.outcome(status, lx.DEFAULT.accepted, lx.DEFAULT.failed).alias("outcome"))


KINDS = {"chat": r"^user$", "reply": r"assist", "rules": r"^system$"}


@query("""SELECT conv_id, turn, CASE WHEN regexp_matches(role, '(?i)^user$') THEN 'chat' WHEN regexp_matches(role, '(?i)assist') THEN 'reply' WHEN regexp_matches(role, '(?i)^system$') THEN 'rules' ELSE 'body' END AS kind FROM conversations""")
def b16_section_kind(spark, sf_dir):
    path = F.array(F.lit("Conversation"), "role", F.lit("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", lx.section_kind(path, KINDS).alias("kind"))


@query(r"""SELECT p_partkey, len([w FOR w IN string_split_regex(lower(p_name), '[\s/]+') IF w NOT IN ('small', 'red', 'ring', 'widget', '')]) = 0 AS generic FROM part""")
def b17_generic_heading(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", tx.generic_heading("p_name", ["small", "red", "ring", "widget"]).alias("generic"))


@query(r"""SELECT s_suppkey, regexp_replace('see ' || s_name || ', supplier ' || s_suppkey || ' or SUPPLIER-' || (s_suppkey % 100) || ' again', '(?i)\bsupplier[\s-]*\d+\b', 'an earlier proposal', 'g') AS masked FROM supplier""")
def b18_mask_references(spark, sf_dir):
    text = F.concat(F.lit("see "), "s_name", F.lit(", supplier "), F.col("s_suppkey").cast("string"), F.lit(" or SUPPLIER-"), (F.col("s_suppkey") % 100).cast("string"), F.lit(" again"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", tx.mask_references(text, "supplier").alias("masked"))


def _counts_sql(rules: dict[str, tuple[str, ...]], name: str, text: str = "text") -> str:
    one = lambda k, ps: f"SELECT doc_id, {_q(k)} AS {name}, " + " + ".join(f"len(regexp_extract_all({text}, {_q('(?i)' + p)}))" for p in ps) + " AS n FROM documents"
    return f"SELECT * FROM ({' UNION ALL '.join(one(k, ps) for k, ps in rules.items())}) WHERE n > 0"


@query(_counts_sql({c.id: c.phrases for c in CONCEPTS}, "concept", r"regexp_replace(text, '\s+', ' ', 'g')"))
def c1_count_concepts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.explode(lx.count_concepts("text", CONCEPTS)).alias("c")).select("doc_id", "c.concept", "c.n")


@query("""WITH spelt AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM benchmark), places AS (SELECT item_id, w, unnest(range(1, len(w))) AS i FROM spelt),
phrases AS (SELECT DISTINCT item_id, CASE WHEN i % 3 = 0 AND i + 2 <= len(w) THEN array_to_string(w[i:i + 2], ' ') ELSE array_to_string(w[i:i + 1], ' ') END AS p FROM places),
texts AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM documents), starts AS (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM texts),
runs AS (SELECT doc_id, array_to_string(w[i:i + 1], ' ') AS p FROM starts UNION ALL SELECT doc_id, array_to_string(w[i:i + 2], ' ') FROM starts WHERE i + 2 <= len(w))
SELECT doc_id, 'item' || item_id AS concept, count(*) AS n FROM runs JOIN phrases USING (p) GROUP BY doc_id, item_id""")
def c1_dictionary(spark, sf_dir):
    """All word pairs of the benchmark's items, and some triples, as a lexicon of thousands of phrases."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array(words_of("text"))).alias("w"))
    places = items.where(F.size("w") > 1).select("item_id", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("i"))
    three = (F.col("i") % 3 == 0) & (F.col("i") + 2 <= F.size("w"))
    phrases = places.select(F.concat(F.lit("item"), F.col("item_id").cast("string")).alias("concept"), F.array_join(F.slice("w", F.col("i"), F.when(three, 3).otherwise(2)), " ").alias("phrase"))
    return phrase_counts(table(spark, sf_dir, "documents"), phrases, ["doc_id"])


@query("SELECT page_id, concept FROM (" + " UNION ALL ".join(f"SELECT page_id, {_q(c.id)} AS concept FROM pages WHERE " + " OR ".join(f"regexp_matches(regexp_replace(regexp_extract(html, '<h1>(.*?)</h1>', 1), '[`*]', '', 'g'), {_q('(?i)' + p)})" for p in c.phrases) for c in CONCEPTS) + ")")
def c2_concepts_in_heading(spark, sf_dir):
    title = F.regexp_extract("html", "<h1>(.*?)</h1>", 1)
    return table(spark, sf_dir, "pages").select("page_id", F.explode(lx.concepts_in_heading(title, CONCEPTS)).alias("concept"))


@query("SELECT item_id, concept, array_to_string(list_sort(list_distinct([trim(f) FOR f IN forms])), '|') AS matched FROM (" + " UNION ALL ".join(f"SELECT item_id, {_q(c.id)} AS concept, " + " || ".join(f"regexp_extract_all(text, {_q('(?i)' + p)})" for p in c.phrases) + " AS forms FROM benchmark" for c in CONCEPTS) + ") WHERE len(forms) > 0")
def c3_match_input(spark, sf_dir):
    found = table(spark, sf_dir, "benchmark").select("item_id", F.explode(lx.match_input("text", CONCEPTS)).alias("c"))
    return found.select("item_id", "c.concept", F.array_join("c.matched", "|").alias("matched"))


@query(_counts_sql({k: (p,) for k, p in TOOLS.items()}, "tool"))
def c4_count_tools(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.explode(lx.count_rules("text", TOOLS)).alias("t")).select("doc_id", "t.tool", "t.n")


@query(f"""WITH paras AS (SELECT doc_id, unnest(p) AS p, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, {PARAGRAPHS.format(t="replace(text, '*', '+')")} AS p FROM documents)),
sents AS (SELECT doc_id, flatten(list({SENTENCES.format(t="p")} ORDER BY i)) AS ss FROM paras GROUP BY doc_id)
SELECT * FROM ({" UNION ALL ".join(f"SELECT doc_id, {_q(k)} AS concern, [s FOR s IN ss IF regexp_matches(s, {_q(_any(ps))})][1] AS evidence FROM sents" for k, ps in CONCERNS.items())}) WHERE evidence IS NOT NULL""")
def c5_classify_concerns(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("text", F.translate("text", "*", "+"))
    return docs.select("doc_id", F.explode(lx.concerns_of("text", CONCERNS)).alias("c")).select("doc_id", "c.concern", "c.evidence")


@query("SELECT doc_id, array_to_string([i FOR i IN [" + ", ".join(f"CASE WHEN regexp_matches(text, {_q(_any(ps))}) THEN {_q(k)} END" for k, ps in INTENTS.items()) + "] IF i IS NOT NULL], ',') AS intents FROM documents")
def c6_detect_intents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(lx.detect_intents("text", INTENTS), ",").alias("intents"))


@query(r"""SELECT page_id, r AS doc_id, count(*) AS n FROM (
SELECT page_id, unnest(list_concat(['12'], list_concat([(page_id + 3)::VARCHAR, (page_id % 7)::VARCHAR], regexp_extract_all(regexp_replace(url, '/(fr|en|de|es)/', ' PAGE ', 'g'), '(?i)\bpage[\s-]*0*(\d+)\b', 1))))::BIGINT AS r FROM pages) WHERE r <> 0 GROUP BY page_id, r""")
def c7_references(spark, sf_dir):
    """Running text, roles with and without a target, labels with numbers of their own, and a role that cites nothing."""
    n = F.col("page_id")
    label = F.concat(F.lit(" as in :page:`12`, :page:`Notes 3 of page 5 <"), (n + 3).cast("string"), F.lit("#s2>`, :page:`x 9 <00"), (n % 7).cast("string"), F.lit(">` and :page:`see 4`"))
    cited = F.concat(F.regexp_replace("url", "/(fr|en|de|es)/", " PAGE "), label)
    return table(spark, sf_dir, "pages").select("page_id", F.explode(tx.references(cited, "page")).alias("doc_id")).groupBy("page_id", "doc_id").agg(F.count("*").alias("n"))


@query(r"""SELECT s_suppkey, array_to_string(list_sort(list_distinct([s_suppkey, 12])), ',') AS named FROM supplier""")
def c8_mentions(spark, sf_dir):
    text = F.concat(F.lit("Like Doc 0012, doc-"), F.col("s_suppkey").cast("string"), F.lit(" and DOC 12"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(F.transform(tx.mentions(text, "doc"), lambda x: x.cast("string")), ",").alias("named"))


# sources and sinks


@query("""SELECT d.doc_id, length(d.text) AS n FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)""")
def a1_exclude(spark, sf_dir):
    docs = corpus.without(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("toxic = 1"))
    return docs.select("doc_id", F.char_length("text").cast("long").alias("n"))


@query(r"""SELECT d.doc_id FROM documents d WHERE regexp_matches(left(d.text, 3000), '(?m)^The\b.*\btion') OR d.doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)""")
def a2_select_corpus(spark, sf_dir):
    allowed = table(spark, sf_dir, "labels").where("quality = 0")
    return corpus.select_corpus(table(spark, sf_dir, "documents"), r"(?m)^The\b.*\btion", allowed, text="text").select("doc_id")


@query(r"""SELECT page_id AS doc_id, rtrim(regexp_extract(html, '<title>(.*?)</title>', 1)) AS title FROM pages""")
def a3_title_index(spark, sf_dir):
    """Titles written as tab-separated values, and read again."""
    raw = F.concat(F.lit("Doc: x\nTitle: "), F.regexp_extract("html", "<title>(.*?)</title>", 1), F.lit("\nStatus: y"))
    titles = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.rtrim(corpus.title_of(raw, 100_000)).alias("title"))
    path = scratch(spark, "titles")
    corpus.write_titles(titles, path)
    return corpus.read_titles(spark, path)


@query("""SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN quality = 1 THEN 'already_exists' ELSE 'outside_known_territory' END AS expected_label, doc_id AS expected_doc, toxic AS n_also FROM labels""")
def a4_read_cases(spark, sf_dir):
    """Labelled cases written as JSON objects with a `cases` array, and read again."""
    label = F.when(F.col("quality") == 1, "already_exists").otherwise("outside_known_territory")
    also = F.when(F.col("toxic") == 1, F.array(F.lit("in_progress"))).otherwise(F.array().cast("array<string>"))
    case = F.struct(F.col("doc_id").cast("string").alias("id"), label.alias("expected_label"), F.col("doc_id").alias("expected_doc"), also.alias("also_acceptable"))
    path = scratch(spark, "cases")
    groups = table(spark, sf_dir, "labels").withColumn("g", F.pmod(F.xxhash64("doc_id"), F.lit(64))).groupBy("g").agg(F.collect_list(case).alias("cases"))
    groups.select(F.to_json(F.struct(F.lit("labels").alias("about"), "cases")).alias("value")).repartition(64, "value").write.option("maxRecordsPerFile", 1).text(path)
    return corpus.read_cases(spark, path).select("id", "expected_label", "expected_doc", F.size("also_acceptable").alias("n_also"))


def scratch(spark, name: str) -> str:
    """A new place in the folder that driver and executors share."""
    import uuid

    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
