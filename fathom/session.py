"""Sessions, and the library's code on the executors."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> SparkSession:
    """Give the executors' Python workers this package, once for each application."""
    context = spark.sparkContext
    if getattr(context, "_fathom_shipped", False):
        return spark
    made = shutil.make_archive(f"{tempfile.mkdtemp(prefix='spark-')}/fathom", "zip", _PACKAGE.parent, _PACKAGE.name)
    context.addPyFile(made)
    context._fathom_shipped = True
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only for a local master, where none is set."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.sparkContext.setCheckpointDir(path)
    return path


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Spark removes what the jobs inside shuffle as soon as each ends: for jobs whose written result is all that is kept."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: to the folder that all executors share."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with tidy(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_at = path
    return out


def session(name: str = "fathom", cores: int | str = "*", **conf) -> SparkSession:
    """A local session with the settings that tests and benchmarks use; clusters bring their own."""
    made = SparkSession.builder.master(f"local[{cores}]").appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
    made = made.config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
    for key, value in conf.items():
        made = made.config(key, value)
    return ship(made.getOrCreate())
