"""Corpora, title indexes, labelled cases and graphs: reading and writing."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import headers, plain_rule
from ..session import tidy


def read_corpus(spark: SparkSession, path: str, id_header: str = "Doc", exclude: DataFrame | None = None) -> DataFrame:
    """Text files, one document each -> docs(doc_id, headers, raw); exclude(doc_id) takes documents away."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "\r\n?", "\n").alias("raw"))
    return without(documents(files, id_header), exclude)


def documents(raw: DataFrame, id_header: str = "Doc") -> DataFrame:
    """(raw) -> docs(doc_id, headers, raw); the id is a header."""
    parsed = raw.withColumn("headers", headers("raw"))
    return parsed.select(F.expr("try_cast(headers['" + id_header + "'] AS long)").alias("doc_id"), "headers", "raw")


def without(docs: DataFrame, exclude: DataFrame | None, key: str = "doc_id") -> DataFrame:
    return docs if exclude is None else docs.join(exclude.select(key).distinct(), key, "left_anti")


def select_corpus(docs: DataFrame, pattern: str, allowed: DataFrame | None = None, first: int = 3000, text: str = "raw", key: str = "doc_id") -> DataFrame:
    """Documents whose first characters match, and those with an id in allowed. The pattern is read as plain_rule() says."""
    match = F.coalesce(F.substring(text, 1, first).rlike(plain_rule(pattern)), F.lit(False))
    if allowed is None:
        return docs.where(match)
    marked = docs.join(allowed.select(key).distinct().withColumn("_allowed", F.lit(True)), key, "left")
    return marked.where(match | F.col("_allowed").isNotNull()).drop("_allowed")


def title_of(raw: Column | str, first: int = 2000) -> Column:
    return F.regexp_extract(F.substring(raw, 1, first), r"(?m)^Title:\s*(.+)$", 1)


def write_titles(titles: DataFrame, path: str) -> None:
    """(doc_id, title) as tab-separated values, one line each."""
    titles.select(F.concat_ws("\t", F.col("doc_id").cast("string"), F.translate("title", "\t\n", "  "))).write.text(path)


def read_titles(spark: SparkSession, path: str) -> DataFrame:
    parts = F.split("value", "\t", 2)
    return spark.read.text(path).select(parts[0].cast("long").alias("doc_id"), parts[1].alias("title"))


def read_cases(spark: SparkSession, *paths: str) -> DataFrame:
    """JSON objects with a `cases` array -> one row per case."""
    case = "struct<id string, expected_label string, expected_doc long, text string, also_acceptable array<string>, source string>"
    return spark.read.schema(f"about string, cases array<{case}>").json(list(paths), multiLine=True).select(F.explode("cases").alias("c")).select("c.*")


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, only: Iterable[str] | None = None, last: Callable[[DataFrame], DataFrame] = lambda edges: edges) -> None:
    """Nodes by (type, id), edges by (type, src, dst, section), a folder for each type.

    Rows are dealt out in ranges of that order, so that files follow it across
    tasks. With `only`, these types replace what is there of them. last: applied
    to the edges as they are written.
    """
    for table, name, order, put in ((nodes, "nodes", ["id"], lambda df: df), (edges, "edges", ["src", "dst", "section"], last)):
        order = ["type", *(c for c in order if c in table.columns)]
        ranged = put(table.repartitionByRange(*order).sortWithinPartitions(*order))
        with tidy(table.sparkSession):
            ranged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if only is not None else "static").partitionBy("type").parquet(f"{path}/{name}")
        if only is not None:
            _drop_types(table, name, path, set(only))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, if there is one."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _drop_types(table: DataFrame, name: str, path: str, types: set[str]) -> None:
    """Types that have no rows any more: a dynamic overwrite leaves their folders alone."""
    spark = table.sparkSession
    here = {r.type for r in table.select("type").distinct().collect()}  # a row for each type
    for gone in types - here:
        remove(spark, f"{path}/{name}/type={gone}")


def read_graph(spark: SparkSession, path: str, nodes: str | None = None, edges: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges, with the given schemas or those of the files."""
    read = lambda schema: spark.read.schema(schema) if schema else spark.read
    return read(nodes).parquet(f"{path}/nodes"), read(edges).parquet(f"{path}/edges")
