"""Quality classifier: perplexity under a modified Kneser-Ney model of trusted text.

The model is of n-grams of characters. Their counts, contexts, back-off weights
and probabilities are tables that grow with the trusted text and stay
distributed. Documents are scored by joining their n-grams with them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Carried, bytes_of, discard, row_key, spool

#: An n-gram is up to ORDER symbols of BITS bits, the last one lowest.
ORDER, BITS = 5, 12
KINDS = 1 << BITS
#: Symbols that stand for no character: before a text, and its end.
START, CLOSE, FIRST = 0, 1, 2
FOLDS = 2
#: What a task works on at once: symbols, and bytes and texts of a chunk.
_PIECE, _CHUNK, _TEXTS = 1 << 20, 16 << 20, 1 << 16


def mask(m: int) -> int:
    return (1 << BITS * m) - 1


def symbols(text: np.ndarray) -> np.ndarray:
    """ORDER times START, a symbol for each character, CLOSE. Code points from 2,046 on share 2,048 symbols by a hash."""
    codes = np.frombuffer(text.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype="<u4")
    out = np.full(len(codes) + ORDER + 1, START, dtype=np.uint64)
    out[ORDER:-1] = np.where(codes < 2046, codes + np.uint32(FIRST), 2048 + ((codes * np.uint32(0x9E3779B1)) >> np.uint32(21)))
    out[-1] = CLOSE
    return out


def grams(texts: list[np.ndarray]) -> np.ndarray:
    """texts as symbols() -> the n-grams of the highest order that end at each symbol from the last START on, text after text."""
    s = np.concatenate(texts)
    n = len(s) - ORDER + 1
    keys = s[:n].copy()
    for k in range(1, ORDER):
        keys <<= np.uint64(BITS)
        keys |= s[k : k + n]
    inside = np.ones(n, dtype=bool)
    ends = np.cumsum([len(x) for x in texts])[:-1]
    inside[(ends[:, None] - np.arange(1, ORDER)).reshape(-1)] = False  # these begin in the text before
    return keys[inside]


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted, each once."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def finder(top: np.ndarray):
    """A function from keys that are all in top (sorted, each once) to their places: most by one look into a table."""
    bits = max(10, (4 * len(top)).bit_length())
    slot = lambda keys: (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
    table = np.zeros(1 << bits, dtype=np.int32)
    table[slot(top)] = np.arange(len(top), dtype=np.int32)

    def find(keys: np.ndarray) -> np.ndarray:
        at = table[slot(keys)]
        other = np.flatnonzero(top[at] != keys)
        at[other] = np.searchsorted(top, keys[other])
        return at

    return find


def by_pieces(texts: Iterable[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Symbols of texts, some millions at a time."""
    held, size = [], 0
    for text in texts:
        held.append(symbols(text))
        size += len(held[-1])
        if size > _PIECE:
            yield held
            held, size = [], 0
    if held:
        yield held


def fold_of(doc_id: str = "doc_id") -> Column:
    """The half of the documents that a document is in."""
    return F.pmod(F.xxhash64(F.lit("fold"), doc_id), F.lit(FOLDS)).cast("int")


# ------------------------------------------------------------- the model


def zipped(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> the same with each text compressed, for a shuffle."""

    def zip_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            texts = [None if x is None else pack(x.tobytes()) for x in bytes_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary())], ["doc_id", "text"])

    return docs.select("doc_id", "text").mapInArrow(zip_, "doc_id long, text binary")


def _unzip(data: bytes | None) -> np.ndarray | None:
    import zstandard

    return None if data is None else np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)


def counted(texts: DataFrame) -> DataFrame:
    """texts(fold, text) -> (fold, key, n): all n-grams of the highest order, summed in each task before the shuffle.

    Texts are strings, or as zipped() has them.
    """
    is_zipped = texts.schema["text"].dataType.typeName() == "binary"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(FOLDS)]

        def summed(fold: int) -> tuple[np.ndarray, np.ndarray]:
            keys, n = (np.concatenate(x) for x in zip(*held[fold], strict=True))
            found, where = np.unique(keys, return_inverse=True)
            return found, np.bincount(where, n).astype(np.int64)

        def out(fold: int) -> pa.RecordBatch:
            keys, n = summed(fold)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), fold, np.int32)), pa.array(keys.view(np.int64)), pa.array(n)], ["fold", "key", "n"])

        for batch in batches:
            folds = batch.column("fold").to_numpy()
            every = [_unzip(x) for x in batch.column("text").to_pylist()] if is_zipped else list(bytes_of(batch.column("text")))
            for fold in range(FOLDS):
                for piece in by_pieces(every[k] for k in np.flatnonzero(folds == fold) if every[k] is not None and len(every[k])):
                    keys = np.sort(grams(piece))
                    keys = keys[np.searchsorted(keys, 1) :]  # 0: nothing but START
                    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                    held[fold].append((keys[first], np.diff(np.append(first, len(keys)))))
                    if sum(len(k) for k, _ in held[fold]) > 1 << 21:
                        held[fold] = [summed(fold)]
                        if len(held[fold][0][0]) > 1 << 20:
                            yield out(fold)
                            held[fold] = []
        for fold in range(FOLDS):
            if held[fold]:
                yield out(fold)

    return texts.mapInArrow(count, "fold int, key long, n long").groupBy("fold", "key").agg(F.sum("n").alias("n"))


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney, from how many n-grams occur once to four times.

    Where too few n-grams are rare for the formula, 0.5, 1 and 1.5.
    """
    if not n1 * n2 * n3 * n4:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(k - (k + 1) * y * b / a, 0.05), k - 0.05) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def tagged(fold: Column, m: Column, key: Column) -> Column:
    """An n-gram of order m in the model of a fold, as one number."""
    return F.shiftleft(fold.cast("long"), 63).bitwiseOR(F.shiftleft(m.cast("long"), 60)).bitwiseOR(key)


def train(texts: DataFrame) -> tuple[DataFrame, dict[int, float]] | None:
    """texts(fold, text) of trusted documents -> values(key, value) and the base of each fold; None if there is no text.

    The highest order has counts of occurrences; lower ones count in how many
    left contexts an n-gram occurs. An n-gram's probability is its discounted
    share of its context, plus the context's back-off weight times the
    probability of its suffix, which a join with the order below finds. Its value
    is ln of that over what backing off would give, plus ln of its back-off
    weight as a context. So ln P of a text is the sum, over its symbols, of the
    base and of the values of the n-grams of all orders that end there, whether
    the model has them or not (0); before a text, START is a context only.
    Nothing but a row for each order and fold reaches the driver.
    """
    top = spool(counted(texts))
    tables = {ORDER: top.withColumn("m", F.lit(ORDER))}
    for m in range(ORDER - 1, 0, -1):
        tables[m] = tables[m + 1].groupBy("fold", F.col("key").bitwiseAND(F.lit(mask(m))).alias("key")).agg(F.count("*").alias("n")).withColumn("m", F.lit(m))
    every = tables[ORDER].select("m", "fold", "key", "n")
    for m in range(1, ORDER):
        every = every.union(tables[m].select("m", "fold", "key", "n"))
    source = every = spool(every)
    discard(top)
    rare = every.groupBy("m", "fold").agg(*(F.count_if(F.col("n") == k).alias(f"n{k}") for k in (1, 2, 3, 4))).collect()  # a row for each order and fold
    if not rare:
        return None
    cut = F.lit(None).cast("double")
    for r in rare:
        d = discounts(r.n1, r.n2, r.n3, r.n4)
        cut = F.when((F.col("m") == r.m) & (F.col("fold") == r.fold), F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])).otherwise(cut)
    every = every.withColumn("cut", cut).withColumn("context", F.shiftright("key", BITS))
    contexts = spool(every.groupBy("m", "fold", "context").agg(F.sum("n").alias("total"), (F.sum("cut") / F.sum("n")).alias("rest")))
    known = spool(every.join(contexts, ["m", "fold", "context"]).select("m", "fold", "key", ((F.col("n") - F.col("cut")) / F.col("total")).alias("own"), "rest"))
    steps = [known.where("m = 1").withColumn("q", F.lit(1 / KINDS))]
    for m in range(1, ORDER + 1):
        if m > 1:
            below = steps[-1].select("fold", F.col("key").alias("suffix"), F.col("p").alias("q"))
            steps.append(known.where(F.col("m") == m).withColumn("suffix", F.col("key").bitwiseAND(F.lit(mask(m - 1)))).join(below, ["fold", "suffix"]))
        steps[-1] = spool(steps[-1].select("m", "fold", "key", "own", "rest", "q", (F.col("own") + F.col("rest") * F.col("q")).alias("p")))
    values = contexts.where("m > 1").select(tagged(F.col("fold"), F.col("m") - 1, F.col("context")).alias("key"), F.log("rest").alias("value"))
    for step in steps:
        values = values.union(step.select(tagged(F.col("fold"), F.col("m"), F.col("key")), F.log("p") - F.log(F.col("rest") * F.col("q"))))
    values = spool(values.groupBy("key").agg(F.sum("value").alias("value")))
    bases = {r.fold: float(np.log(r.rest / KINDS)) for r in contexts.where("m = 1").collect()}  # a row for each fold
    discard(source, contexts, known, *steps)
    return values, bases


# ----------------------------------------------------------- the documents


def _packed(texts: list[np.ndarray], rows: list[int], folds: list[int]) -> bytes:
    import zstandard

    head = [np.array([len(texts)], "<i8"), np.array(rows, "<i8"), np.array(folds, "<i8"), np.array([len(t) for t in texts], "<i8")]
    return zstandard.ZstdCompressor(level=6).compress(b"".join([*(x.tobytes() for x in head), *(t.tobytes() for t in texts)]))


def _unpacked(data: bytes) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    rows, folds, sizes = np.frombuffer(raw, "<i8", 3 * n, 8).reshape(3, n)
    ends = np.cumsum(sizes)
    texts = np.frombuffer(raw, np.uint8, offset=8 + 24 * n)
    return [texts[b - k : b] for k, b in zip(sizes, ends, strict=True)], rows, folds


def _coded(keys: np.ndarray) -> bytes:
    """Numbers in order, by their differences."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.diff(keys, prepend=np.uint64(0)).tobytes())


def _decoded(data: bytes) -> np.ndarray:
    import zstandard

    return np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint64), dtype=np.uint64)


def _digest(keys: np.ndarray) -> bytes:
    """16 bytes that tell whether an answer is to these keys."""
    import xxhash

    return xxhash.xxh3_128_digest(keys.tobytes())


def _orders(top: np.ndarray, fold: int) -> Iterator[np.ndarray]:
    """The tagged n-grams of each order that end n-grams of the highest one, for each of these."""
    for m in range(1, ORDER + 1):
        yield (top & np.uint64(mask(m))) | np.uint64(fold << 63 | m << 60)


def _distinct(texts: list[np.ndarray], folds: np.ndarray, fold: int) -> np.ndarray:
    """The different n-grams of the highest order in the texts of one fold."""
    found = [distinct(grams(p)) for p in by_pieces(t for t, f in zip(texts, folds, strict=True) if f == fold)]
    return distinct(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def chunks_of(docs: DataFrame, bounds: np.ndarray) -> DataFrame:
    """docs(fold, row, text) -> (chunk, shard, data): chunks of texts, packed, and what they ask of each shard of the model.

    A chunk is neighbouring texts of one task, of at most _CHUNK bytes unless it is one
    text. Its row has no shard; the others have its different n-grams of all orders.
    A shard is a range of n-grams, so that neighbours in a block differ little.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, size = TaskContext.get().partitionId() << 32, 0
        texts: list[np.ndarray] = []
        rows: list[int] = []
        folds: list[int] = []

        def out() -> pa.RecordBatch:
            asked = [k for f in range(FOLDS) for k in _orders(_distinct(texts, np.array(folds), f), f)]
            keys = distinct(np.concatenate(asked).view(np.int64))
            shard = np.searchsorted(bounds, keys, side="right").astype(np.int32)
            ends = np.flatnonzero(np.diff(shard)) + 1
            blocks = np.split(keys.view(np.uint64), ends)
            own = shard[np.concatenate([[0], ends])]
            data = [_packed(texts, rows, folds), *map(_coded, blocks)]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(data), chunk)), pa.array([None, *own.tolist()], pa.int32()), pa.array(data, pa.binary())], ["chunk", "shard", "data"])

        for batch in batches:
            for fold, row, text in zip(batch.column("fold").to_pylist(), batch.column("row").to_pylist(), bytes_of(batch.column("text")), strict=True):
                if text is None or not len(text):
                    continue
                if texts and (size + len(text) > _CHUNK or len(texts) == _TEXTS):
                    yield out()
                    chunk, size, texts, rows, folds = chunk + 1, 0, [], [], []
                texts.append(text)
                rows.append(row)
                folds.append(fold)
                size += len(text)
        if texts:
            yield out()

    return docs.mapInArrow(pack, "chunk long, shard int, data binary")


def answers(asked: DataFrame, values: DataFrame, bounds: np.ndarray) -> DataFrame:
    """asked(chunk, shard, data), values(key, value) -> (chunk, shard, values): the values of each block's n-grams, 0 where the model has none.

    A shard of the model comes first, then the blocks that ask for it, one after
    the other: a task holds one shard, and one block, whatever their number.
    """

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        shard, parts, keys, found = None, [], None, None
        for batch in batches:
            shards_, is_block = batch.column("shard").to_numpy(), batch.column("chunk").is_valid().to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((shards_[1:] != shards_[:-1]) | (is_block[1:] != is_block[:-1])) + 1
            out: tuple[list, list, list] = ([], [], [])
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
                if a == b:
                    continue
                if shards_[a] != shard:
                    shard, parts, keys = shards_[a], [], None
                if not is_block[a]:
                    parts.append((batch.column("key").slice(a, b - a).to_numpy().view(np.uint64), batch.column("value").slice(a, b - a).to_numpy()))
                    continue
                if keys is None:
                    keys, found = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(1, np.uint64), np.zeros(1))  # no n-gram is 0
                    order = np.argsort(keys)
                    keys, found = keys[order], found[order]
                for chunk, data in zip(batch.column("chunk").slice(a, b - a).to_pylist(), batch.column("data").slice(a, b - a).to_pylist(), strict=True):
                    wanted = _decoded(data)
                    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                    out[0].append(chunk)
                    out[1].append(int(shard))
                    out[2].append(_digest(wanted) + pack(np.where(keys[at] == wanted, found[at], 0.0).astype("<f4").tobytes()))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.binary()), strict=True)], ["chunk", "shard", "values"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = np.searchsorted(bounds, batch.column("key").to_numpy(), side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(shard), batch.column("key"), batch.column("value")], ["shard", "key", "value"])

    placed = values.select("key", "value").mapInArrow(place, "shard int, key long, value double")
    table = placed.select("shard", F.lit(None).cast("long").alias("chunk"), "key", "value", F.lit(None).cast("binary").alias("data"))
    blocks = asked.mapInArrow(lambda batches: (b.filter(b.column("shard").is_valid()) for b in batches), asked.schema).select("shard", "chunk", F.lit(None).cast("long").alias("key"), F.lit(None).cast("double").alias("value"), "data")
    both = table.union(blocks).repartition("shard").sortWithinPartitions("shard", F.col("chunk").asc_nulls_first())
    return both.mapInArrow(answer, "chunk long, shard int, values binary")


def scored(docs: DataFrame, model: tuple[DataFrame, dict[int, float]] | None, per_shard: int = 1 << 20) -> DataFrame:
    """docs(doc_id, text) -> (row, nll): -ln P of each text, by row_key(), under the model of the other fold.

    Texts are packed into chunks, once. A chunk asks each shard of the model for
    its different n-grams, and what comes back is joined with the chunk, whose
    texts are then summed up. A hash says whether an answer is to the block that
    asked. Null and empty texts, and folds without a model, are left out.
    """
    if model is None:
        return docs.select(row_key().alias("row"), F.lit(None).cast("double").alias("nll")).where("false")
    values, bases = model

    def score(chunk: pa.Table, found: pa.Table) -> pa.Table:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        answered = {shard: (v[:16], np.frombuffer(unpack(v[16:]), "<f4")) for shard, v in zip(found.column("shard").to_pylist(), found.column("values").to_pylist(), strict=True)}
        asked, packed = [], []
        for shard, data in zip(chunk.column("shard").to_pylist(), chunk.column("data").to_pylist(), strict=True):
            if shard is None:
                packed.append(data)
            else:
                keys = _decoded(data)
                digest, value = answered.get(shard, (b"", None))
                if digest != _digest(keys):
                    raise ValueError("the documents came in another order when they were read again: write them to a table first")
                asked.append((keys, value))
        if len(packed) != 1:
            raise ValueError("a chunk came twice: write the documents to a table first")
        keys, value = (np.concatenate(x) for x in zip(*asked, strict=True))
        order = np.argsort(keys)
        keys, value = keys[order], value[order].astype(np.float64)
        texts, rows, folds = _unpacked(packed[0])
        rows_, nlls = [], []
        for fold, base in bases.items():
            own = np.flatnonzero(folds == fold)
            a, b = np.searchsorted(keys, np.array([fold << 63 | ORDER << 60, fold << 63 | ORDER << 60 | mask(ORDER)], np.uint64))
            top = keys[a : b + 1 if b < len(keys) and keys[b] == np.uint64(fold << 63 | ORDER << 60 | mask(ORDER)) else b] & np.uint64(mask(ORDER))
            if not len(top):
                continue
            total, find = sum(value[np.searchsorted(keys, k)] for k in _orders(top, fold)), finder(top)
            done = 0
            for piece in by_pieces(texts[k] for k in own):
                sizes = np.array([len(x) for x in piece]) - ORDER + 1
                sums = np.add.reduceat(total[find(grams(piece))], np.cumsum(sizes) - sizes) + base * (sizes - 1)
                rows_.extend(rows[own[done : done + len(piece)]].tolist())
                nlls.extend((-sums).tolist())
                done += len(piece)
        return pa.table({"row": pa.array(rows_, pa.int64()), "nll": pa.array(nlls, pa.float64())})

    # chunks are made twice, of the rows as they are read: what comes out of a shuffle, in any order, is written first
    written = "Exchange" in docs._jdf.queryExecution().executedPlan().toString()
    docs = spool(docs.select("doc_id", "text")) if written else docs
    partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())  # these follow the bytes read
    shards = max(partitions, -(-values.count() // per_shard))
    bounds = values.stat.approxQuantile("key", [k / shards for k in range(1, shards)], 0.25 / shards) if shards > 1 else []
    bounds = np.unique(np.array(bounds, dtype=np.float64)).astype(np.int64)  # a number for each shard
    # the shuffle by chunk is the one copy of the texts: what is asked comes from it, and what is answered goes to it
    made = chunks_of(docs.select((FOLDS - 1 - fold_of()).alias("fold"), row_key().alias("row"), "text"), bounds).repartition(partitions, "chunk")
    found = answers(made, values, bounds)
    each = made.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(score, "row long, nll double")
    out = spool(each.groupBy("row").agg(F.round(F.min("nll"), 6).alias("nll")))  # repeated rows have one key and one sum
    if written:
        discard(docs)
    return out


def thresholds(scores: DataFrame, by: list[str], quantile: float, step: float, least: int) -> DataFrame:
    """scores(nll, ...) of trusted documents -> by, threshold: the quantile of each group with `least` of them, from counts in steps."""
    counts = scores.where("nll is not null").groupBy(*by, F.ceil(F.col("nll") / step).alias("at")).count()
    upto = F.sum("count").over(Window.partitionBy(*by).orderBy("at"))
    total = F.sum("count").over(Window.partitionBy(*by))
    return counts.withColumn("upto", upto).withColumn("total", total).where((F.col("upto") >= quantile * F.col("total")) & (F.col("total") >= least)).groupBy(*by).agg((F.min("at") * step).alias("threshold"))


def length_class(n_bytes: Column) -> Column:
    """Texts of one class are less than twice as long as each other."""
    return F.floor(F.log2(F.greatest(n_bytes, F.lit(1)))).cast("int")


def wide_class(size: Column) -> Column:
    """Classes by factors of four; all texts below 64 bytes are one."""
    return F.greatest(F.floor(size / 2), F.lit(2)).cast("int")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """The doc_ids whose labels all say good and not toxic."""
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    return labels.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.coalesce(good, F.lit(False))).alias("good")).where("good").select("doc_id")


def classify(docs: DataFrame, labels: DataFrame, quantile: float = 0.995, slack: float = 1.05, step: float = 1e-3, least: int = 20) -> DataFrame:
    """docs(doc_id, lang, text, ...), labels(doc_id, quality, toxic) -> docs with perplexity, threshold, kept.

    Documents whose labels are good and not toxic are trusted. They are dealt into
    two halves, a model is trained on each, and every document is scored by that of
    the half it isn't in: trusted ones, which the thresholds come from, as all others.
    A threshold is the quantile of the trusted documents' perplexities, times slack,
    in a language and a class of length (by doublings), since short texts vary more.
    Where fewer than `least` are trusted, that of all languages' texts of the class
    stands in, then of a wider class, then the language's of any length, then that
    of all. Documents above
    it go. Perplexity is per character. Null and empty texts have none and go; without trusted
    text all others stay. Null languages are one of their own, repeated rows are
    judged alike, other columns pass through.
    """
    made = ["n_bytes", "perplexity", "threshold", "kept"]
    carried = Carried(docs, ["doc_id", "lang", "text"], made)
    docs = carried.docs
    # trusted ids grow with the labels: Spark sends them to all tasks only below its own limit of size, else it deals texts out by doc_id
    ids = spool(trusted_ids(labels))
    texts = spool(zipped(docs).join(ids, "doc_id", "left_semi").select(fold_of().alias("fold"), "text"))
    model = train(texts)
    discard(texts)
    found = scored(docs.select("doc_id", "text"), model).withColumnRenamed("row", "_row")
    if model:
        discard(model[0])
    docs = docs.withColumn("_row", row_key()).withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).withColumn("_n", F.char_length("text") + 1)
    with_scores = lambda df: df.join(found.hint("merge"), "_row", "left").withColumn("nll", F.col("nll") / F.col("_n"))
    scores = spool(with_scores(docs.select("doc_id", "lang", "_row", "n_bytes", "_n").join(ids.hint("merge"), "doc_id", "left_semi")).select("lang", length_class(F.col("n_bytes")).alias("_size"), "nll"))

    def limited(df: DataFrame) -> DataFrame:
        """With each row's threshold, of the first group that has one."""
        df, found = df.withColumn("_size", length_class(F.col("n_bytes"))).withColumn("_wide", wide_class(F.col("_size"))), []
        for k, by in enumerate((["lang", "_size"], ["_size"], ["_wide"], ["lang"])):
            table = spool(thresholds(scores.withColumn("_wide", wide_class(F.col("_size"))), by, quantile, step, least)).select(*(F.col(c).alias(f"_{k}{c}") for c in by), F.col("threshold").alias(f"_top{k}"))
            df = df.join(table, F.expr(" and ".join(f"{c} <=> _{k}{c}" for c in by)), "left")
            found.append(F.col(f"_top{k}"))
        pooled = thresholds(scores.withColumn("_all", F.lit(0)), ["_all"], quantile, step, 1).first()
        return df.withColumn("threshold", F.coalesce(*found, F.lit(pooled.threshold if pooled else None).cast("double")))

    judged = limited(with_scores(docs)).withColumn("threshold", F.exp("threshold") * slack).withColumn("perplexity", F.exp("nll"))
    kept: Column = (F.col("n_bytes") > 0) & (F.col("perplexity").isNull() | F.col("threshold").isNull() | (F.col("perplexity") <= F.col("threshold")))
    return judged.withColumn("kept", kept).select(*carried.columns(), *made)
