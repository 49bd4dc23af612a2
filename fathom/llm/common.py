"""Shared helpers: tables, durable intermediate results, hashing of words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space, tab, \n, \v, \f and \r.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only for a local master, where none is set."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.sparkContext.setCheckpointDir(path)
    return path


def shared_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


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


def spool(df: DataFrame) -> DataFrame:
    """Cut the lineage: write as Parquet to the shared folder and read again."""
    path = shared_path(df.sparkSession, "spool")
    with tidy(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.spooled_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete spooled tables that nothing reads any more."""
    for df in tables:
        spark, path = df.sparkSession, df.spooled_at
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Carried:
    """A table's columns that an operator doesn't use, kept in one struct so that their names clash with none of its own.

    An input column with the name of a result column gives way to the result.
    """

    def __init__(self, docs: DataFrame, needs: list[str], makes: list[str]):
        self.own, self.made = {c.lower() for c in needs}, {c.lower() for c in makes}
        self.names = [c for c in docs.columns if c.lower() not in self.made]
        rest = [F.col(f"`{c}`") for c in self.names if c.lower() not in self.own]
        self.docs = docs.select(*needs, F.struct(*rest, F.lit(0).alias("_")).alias("_rest") if rest else F.struct(F.lit(0).alias("_")).alias("_rest"))

    def columns(self) -> list[Column]:
        """The input's columns in their order, for the last select."""
        return [F.col(c) if c.lower() in self.own else F.col("_rest").getField(c).alias(c) for c in self.names]


def row_key() -> Column:
    """Tells rows with one doc_id but different texts apart; repeated rows share it."""
    return F.xxhash64("doc_id", "text")


def bytes_of(col: pa.Array) -> Iterator[np.ndarray | None]:
    """Each row's UTF-8 bytes, without copies; None for null."""
    kind = pa.large_binary() if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else pa.large_string()
    col = col.cast(kind)
    _, ends, data = col.buffers()
    at = np.frombuffer(ends, dtype=np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    valid = col.is_valid().to_numpy(zero_copy_only=False)
    for k in range(len(col)):
        yield data[at[k] : at[k + 1]] if valid[k] else None


class _Powers:
    """Powers of an odd base and of its inverse, modulo 2**64, as far as needed."""

    def __init__(self, base: int):
        self.base, self.n = base, 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 2 * self.n, 1 << 14)
            one = [np.full(self.n, x % 2**64, dtype=np.uint64) for x in (self.base, pow(self.base, -1, 2**64))]
            for x in one:
                x[0] = 1
            self.up, self.down = (np.multiply.accumulate(x) for x in one)
        return self.up[:n], self.down[:n]


_BYTES = np.random.default_rng(20240607).integers(0, 2**64, 256, dtype=np.uint64)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, *range(9, 14)]] = True
_LETTERS, _SEQUENCE = _Powers(0xD6E8FEB86659FD93), _Powers(0xA0761D6478BD642F)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit depends on every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: _Powers) -> np.ndarray:
    """64-bit hashes of values[starts:ends], each independent of where it stands."""
    up, down = powers.upto(len(values) + 1)
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(text: np.ndarray, fold: bool = False) -> np.ndarray:
    """A 64-bit hash of each word, in order."""
    blank = np.ones(len(text) + 2, dtype=bool)
    blank[1:-1] = _BLANK[text]
    turns = np.flatnonzero(blank[1:] != blank[:-1])
    return spans(_BYTES[_FOLD[text] if fold else text], turns[::2], turns[1::2], _LETTERS)


def run_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of runs of words, given the words' hashes."""
    return spans(words, starts, ends, _SEQUENCE)


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of n consecutive words."""
    starts = np.arange(max(0, len(words) - n + 1))
    return run_hashes(words, starts, starts + n)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys, of batches sorted by these keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        if held:
            last = held[-1].slice(held[-1].num_rows - 1)
            same = all(last.column(k)[0].as_py() == c[0] for k, c in zip(keys, cols, strict=True))
            if not same:
                yield pa.Table.from_batches(held)
                held = []
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            held.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def rooted(n: int, pairs: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 joined by pairs, each one's smallest node reachable."""
    root = np.arange(n)
    if len(pairs):
        a, b = pairs[:, 0], pairs[:, 1]
        while True:
            low = np.minimum(root[a], root[b])
            new = root.copy()
            for end in (a, b):
                np.minimum.at(new, end, low)
                np.minimum.at(new, root[end], low)
            new = new[new]
            if np.array_equal(new, root):
                break
            root = new
    return root
