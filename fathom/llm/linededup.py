"""Line dedup: lines that many documents share stay in one document only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, LOWER, UPPER, Carried, row_key


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """docs(doc_id, text, ...) -> docs with text rebuilt, and n_lines, n_dropped.

    A line's key is the line without blanks at both ends, A-Z in lower case.
    Keys of at least min_chars code points found under at least min_docs
    distinct doc_ids lose all their lines, but those in the largest doc_id
    that holds the key. The rest is joined by \\n in its order.

    Nulls and empty texts are one empty line, and stay as they are. Rows with
    equal doc_ids count as one document. Rows with a null doc_id count for no
    key and keep their lines. Other columns pass through.

    Keys travel as two 64-bit hashes; counts are summed before and after the
    shuffle, so a line that all documents hold is no burden for one task. What
    comes back to a document is the positions of its dropped lines. Texts without
    any aren't rebuilt, others in time proportional to their lines.
    """
    carried = Carried(docs, ["doc_id", "text"], ["n_lines", "n_dropped"])
    docs = carried.docs
    # the text's hash is made before the lines are: behind them it would be made again for each
    keyed = docs.select("doc_id", "text", row_key().alias("_row")).select("doc_id", "_row", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keyed = keyed.where(f"doc_id is not null and char_length(line) >= {min_chars}").withColumn("line", line_key(F.col("line"))).where(f"char_length(line) >= {min_chars}")
    keyed = keyed.select("doc_id", "_row", "pos", *(F.xxhash64(F.lit(k), "line").alias(f"h{k}") for k in (1, 2)))
    common = keyed.groupBy("h1", "h2").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("last")).where(f"n >= {min_docs}").select("h1", "h2", "last")
    # repeated rows share their key and so their positions
    drops = keyed.join(common, ["h1", "h2"]).where("doc_id < last").groupBy(F.col("doc_id").alias("_doc"), F.col("_row").alias("_key")).agg(F.collect_set("pos").alias("_drops"))
    whole = docs.withColumn("_row", row_key()).join(drops, F.expr("doc_id = _doc and _row = _key"), "left").select(*docs.columns, "_drops")

    # a generator keeps the lines as values, so that they aren't cut again for each of them; other texts aren't cut at all
    cut = F.explode(F.array(F.when(F.col("_drops").isNotNull(), F.split("text", "\n", -1)))).alias("_lines")
    whole = whole.select(*docs.columns, "_drops", cut)
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_drops"))  # one pass, in order
    rebuilt = whole.withColumn("_kept", F.when(F.col("_drops").isNotNull(), F.transform(left, lambda k: F.get("_lines", k))))
    n_lines = F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"))) + 1
    return rebuilt.select(
        "doc_id",
        "_rest",
        F.coalesce(F.array_join("_kept", "\n"), "text").alias("text"),
        F.coalesce(n_lines, F.lit(1)).cast("long").alias("n_lines"),
        F.when(F.col("_drops").isNull(), 0).otherwise(F.size("_drops")).cast("long").alias("n_dropped"),
    ).select(*carried.columns(), "n_lines", "n_dropped")
