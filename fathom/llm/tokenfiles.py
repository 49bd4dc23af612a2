"""Token ids in seekable zstandard files, one frame for each document.

A file is, in order: a skippable frame with the documents' ids, one independent
zstandard frame for each document, and a seek table as in the public seekable
format: a skippable frame with each frame's compressed size, decompressed size
and checksum (low 32 bits of XXH64 of the decompressed bytes), at the very end.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import row_key, shared_path, spool, tidy
from .encoding import encoder

#: Fixed values of the public format.
HEAD_MAGIC, SEEK_MAGIC, FOOT_MAGIC, CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
ENTRY, FOOT = struct.Struct("<III"), struct.Struct("<IBI")
NO_ID = -(2**63)


def _checksum(data: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


def assemble(shard: int, part: int, width: int, docs: list[tuple[int | None, bytes, int, int]]) -> bytes:
    """docs: doc_id, frame, decompressed size and checksum of each document."""
    ids = np.array([NO_ID if d[0] is None else d[0] for d in docs], dtype="<i8").tobytes()
    info = struct.pack("<4sBqqI", b"TOKS", width, shard, part, len(docs)) + ids
    head = struct.pack("<II", HEAD_MAGIC, len(info)) + info
    entries = [(len(head), 0, _checksum(b"")), *((len(f), n, c) for _, f, n, c in docs)]
    table = b"".join(ENTRY.pack(*e) for e in entries) + FOOT.pack(len(entries), CHECKSUMS, FOOT_MAGIC)
    return b"".join((head, *(d[1] for d in docs), struct.pack("<II", SEEK_MAGIC, len(table)), table))


def seek(data: memoryview) -> tuple[int, int, int, np.ndarray, np.ndarray, np.ndarray]:
    """width, shard, part, doc ids, the frames' entries and their places in the file."""
    n, flags, magic = FOOT.unpack(data[-FOOT.size :])
    if magic != FOOT_MAGIC or not flags & CHECKSUMS:
        raise ValueError("not a token file")
    table = np.frombuffer(data[-FOOT.size - n * ENTRY.size : -FOOT.size], dtype="<u4").reshape(n, 3)
    at = np.concatenate([[0], np.cumsum(table[:, 0], dtype=np.int64)])
    kind, width, shard, part, _ = struct.unpack_from("<4sBqqI", data, 8)
    if kind != b"TOKS":
        raise ValueError("not a token file")
    return width, shard, part, np.frombuffer(data[8 + struct.calcsize("<4sBqqI") : int(at[1])], dtype="<i8"), table[1:], at[1:]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, mode: str = "blank before word", width: int = 2, file_bytes: int = 8 << 20) -> str:
    """Encode every text of docs(doc_id, text) and write token files to path, in ascending doc_id order.

    Null and empty texts hold the end id only. Null doc_ids come first; equal
    doc_ids stand in the order of a hash of their texts; repeated rows are
    written again. Other columns are ignored. An empty table gives no files.
    width: bytes of an id in a file, 2 for ids below 65,536, else 4; an id that
    doesn't fit is an error.

    Documents are encoded and compressed where they are read, so what is
    shuffled is the frames. A shard is a range of doc_ids; its files hold at
    most about file_bytes each. Spark's own writer makes the files, so lost
    tasks leave none behind: a row is a file, and the writer's end of line is
    the last three bytes of the footer, which form one character of UTF-8. The
    files are in path; path/_index has one row for each, with its place in
    the order, its numbers of ids, and its first and last doc_id.
    """
    shards = max(1, docs.rdd.getNumPartitions())
    bounds = docs.select("doc_id").stat.approxQuantile("doc_id", [k / shards for k in range(1, shards)], 0.25 / shards) if shards > 1 else []

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        encode_texts, pack = encoder(tokenizer, mode), zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            ids = batch.column("doc_id")
            frames, sizes, sums = [], [], []
            for own in encode_texts(batch.column("text")):
                own = np.append(own, np.uint32(end_id))
                if width < 4 and own.max() >> (8 * width):
                    raise ValueError(f"id {own.max()} doesn't fit into {width} bytes")
                raw = own.astype(f"<u{width}").tobytes()
                frames.append(pack(raw))
                sizes.append(len(raw))
                sums.append(_checksum(raw))
            shard = np.searchsorted(bounds, ids.fill_null(NO_ID).to_numpy().astype(np.float64), side="left")
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), ids, batch.column("_row"), pa.array(frames, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())], ["shard", "doc_id", "_row", "frame", "size", "checksum"])

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, held, size = 0, None, [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([assemble(shard, part, width, held)[:-3]], pa.binary())], ["value"])

        for batch in batches:
            for k, *doc in zip(*(batch.column(c).to_pylist() for c in ("shard", "doc_id", "frame", "size", "checksum")), strict=True):
                if held and (k != shard or size >= file_bytes):
                    yield out()
                    part, held, size = part + 1, [], 0
                shard = k
                held.append(tuple(doc))
                size += len(doc[1])
        if held:
            yield out()

    encoded = docs.select("doc_id", "text", row_key().alias("_row")).mapInArrow(encode, "shard int, doc_id long, _row long, frame binary, size long, checksum long")
    dealt = encoded.repartitionById(shards, "shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "_row")
    payloads = dealt.mapInArrow(files, "value binary").select(F.col("value").cast("string"))
    foot = struct.pack("<I", FOOT_MAGIC)[1:].decode()
    with tidy(docs.sparkSession):
        payloads.write.option("lineSep", foot).option("maxRecordsPerFile", 1).text(path)
    index_of(docs.sparkSession.read.format("binaryFile").load(path)).write.parquet(f"{path}/_index")
    return path


def index_of(files: DataFrame) -> DataFrame:
    """binaryFile rows -> path, shard, part, tokens, first_id, last_id; from heads and seek tables, nothing is decompressed."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, x in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                width, shard, part, ids, table, _ = seek(memoryview(x.as_buffer()))
                known = ids[ids != NO_ID]
                ends = [int(known.min()), int(known.max())] if len(known) else [None, None]
                row = [path, shard, part, int(table[:, 1].sum(dtype=np.int64)) // width, *ends]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.string(), *[pa.int64()] * 5), strict=True)], names)

    names = ["path", "shard", "part", "tokens", "first_id", "last_id"]
    return files.where("length > 0").select("path", "content").mapInArrow(look, "path string, shard long, part long, tokens long, first_id long, last_id long")


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """Token files -> doc_id, start, n_tokens, ids (little-endian unsigned 32-bit).

    start: ids of all documents before it. With doc_ids, a bounded list, only
    the files that may hold them are read, and only their frames decompressed;
    start stays the same. Checksums of all frames that are decompressed are verified.
    """
    index = spark.read.parquet(f"{path}/_index")
    # one row for each shard, in one task: a shard is a partition's worth of documents
    shards = index.groupBy("shard").agg(F.sum("tokens").alias("t")).withColumn("base", F.coalesce(F.sum("t").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = index.withColumn("before", F.coalesce(F.sum("tokens").over(within), F.lit(0))).join(shards.select("shard", "base"), "shard")
    # a small table, so Spark may send it to all tasks: if not, it joins by shuffle
    starts = spool(starts.select("path", "shard", "part", (F.col("base") + F.col("before")).alias("first"), "first_id", "last_id"))
    wanted, places = None if doc_ids is None else set(doc_ids), [path]
    if wanted is not None:
        ids = spark.createDataFrame([(k,) for k in wanted if k is not None], "id long")
        hits = starts.join(ids, F.expr("id between first_id and last_id"), "left_semi")
        if None in wanted:
            hits = hits.union(starts.where("first_id is null or shard = 0")).distinct()
        places = [r.path for r in hits.select("path").collect()]  # a few for each id asked for
        if not places:
            return starts.select(F.lit(None).cast("long").alias("doc_id"), F.col("first").alias("start"), F.lit(0).cast("long").alias("n_tokens"), F.lit(b"").alias("ids")).where("false")
    files = spark.read.format("binaryFile").load(places).where("length > 0").select("content")

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for x in batch.column("content"):
                data = memoryview(x.as_buffer())
                width, shard, part, ids, table, at = seek(data)
                before = np.concatenate([[0], np.cumsum(table[:, 1], dtype=np.int64)[:-1]]) // width
                for lo in range(0, len(ids), 512):
                    rows = []
                    for k in range(lo, min(lo + 512, len(ids))):
                        doc = None if ids[k] == NO_ID else int(ids[k])
                        if wanted is not None and doc not in wanted:
                            continue
                        raw = unpack(data[at[k] : at[k] + table[k, 0]], max_output_size=int(table[k, 1]))
                        if len(raw) != table[k, 1] or _checksum(raw) != table[k, 2]:
                            raise ValueError(f"wrong checksum: document {doc}")
                        rows.append((shard, part, doc, int(before[k]), len(raw) // width, np.frombuffer(raw, dtype=f"<u{width}").astype("<u4").tobytes()))
                    if rows:
                        cols = list(zip(*rows, strict=True))
                        kinds = (pa.int64(),) * 5 + (pa.binary(),)
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["shard", "part", "doc_id", "before", "n_tokens", "ids"])

    found = files.mapInArrow(documents, "shard long, part long, doc_id long, before long, n_tokens long, ids binary")
    return found.join(starts.select("shard", "part", "first"), ["shard", "part"]).select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids")


def token_files(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write docs as token files in the shared folder and read them all back."""
    spark = docs.sparkSession
    return read_tokens(spark, write_tokens(docs, shared_path(spark, "tokens"), tokenizer, **options))
