"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a table; run() writes it as
Parquet and reads it again as the next stage's docs. All but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm.common import discard, row_key, spool, table
from fathom.llm.linededup import dedup_lines
from fathom.llm.minhash import near_duplicates
from fathom.llm.mixing import mix_sources
from fathom.llm.packing import pack_documents
from fathom.llm.perplexity import classify
from fathom.llm.queries import vocabulary
from fathom.session import ship


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the perplexity classifier rejects go.

    So do null and empty texts, which have no perplexity. Null languages are one
    of their own; repeated rows are judged alike; an empty table stays empty.
    Other columns pass through, whatever their names.
    """
    judged = classify(docs, table(ship(spark), sf_dir, "labels"))
    return judged.where("kept").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 characters or more that five documents share stay in one of them, that with the largest doc_id.

    Rows without a doc_id keep their lines; null and empty texts stay as they are;
    n_chars follows the text.
    """
    return dedup_lines(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def minhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest doc_id.

    Rows are judged by doc_id and text: repeated rows stay or go together, other
    texts under the same doc_id by themselves. Rows without a doc_id, and texts
    without words, stay.
    """
    ship(spark)
    found = near_duplicates(docs, percent=85)
    gone = found.where("not kept").select(F.col("doc_id").alias("_near_doc"), F.col("row_key").alias("_near_row")).distinct()
    return docs.join(gone, (F.col("doc_id") == F.col("_near_doc")) & (row_key() == F.col("_near_row")), "left_anti").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix takes them: never, once or twice.

    A null source is one of its own; texts without words are never taken; repeated rows are taken alike.
    """
    mixed = mix_sources(docs).where("repeats > 0")
    return mixed.select(*docs.columns, F.explode(F.array_repeat(F.lit(0), F.col("repeats").cast("int"))).alias("_fathom_copy")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2,048 tokens; a document that comes twice is packed twice, a null text is its end id alone."""
    ship(spark)
    return pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("quality_classifier", quality_classifier), ("line_dedup", line_dedup), ("minhash", minhash), ("mixing", mixing), ("packing", packing)]

#: The classifier's model can't be expressed in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(ship(spark), sf_dir, "documents")
    before = None
    for _, stage in STAGES:
        docs = spool(stage(spark, docs, sf_dir))
        if before is not None:
            discard(before)
        before = docs
    return docs
