"""Language identification by the nearest of several centroids per language."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bytes_of

UNKNOWN = "und"
#: Models of more languages are refused: the model must fit into every worker.
MOST_LANGUAGES = 512


#: ASCII letters in lower case, all other ASCII as blanks, other bytes as they are.
_LETTER = np.arange(256, dtype=np.uint8)
_LETTER[:128] = 32
_LETTER[97:123] = _LETTER[65:91] = np.arange(97, 123)


def words_only(text: np.ndarray) -> np.ndarray:
    """The letters in lower case, one blank for whatever else stands between them."""
    x = _LETTER[text]
    capital = np.flatnonzero((x[1:] >= 0x80) & (x[1:] < 0x9F) & (x[:-1] == 0xC3)) + 1  # of Latin-1, in UTF-8
    x[capital] += 32
    keep = x != 32
    keep[1:] |= x[:-1] != 32
    return x[keep]


def ngrams(text: np.ndarray, dims: int) -> np.ndarray:
    """How often each hashed three- and four-byte sequence of the letters occurs."""
    x = words_only(text).astype(np.uint32)
    shift = np.uint32(32 - dims.bit_length() + 1)
    three = x[:-2] | (x[1:-1] << np.uint32(8)) | (x[2:] << np.uint32(16)) if len(x) > 2 else x[:0]
    four = three[:-1] | (x[3:] << np.uint32(24)) if len(x) > 3 else x[:0]
    found = np.zeros(dims)
    for keys, odd in ((three, 0x9E3779B1), (four, 0x85EBCA77)):
        if len(keys):
            found += np.bincount((keys * np.uint32(odd)) >> shift, minlength=dims)
    return found


def has_letter(text: np.ndarray) -> bool:
    folded = _LETTER[text]
    if ((folded >= 97) & (folded <= 122)).any():
        return True
    return any(map(str.isalpha, text.tobytes().decode("utf-8", "replace")))


def vector(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    return (v / (np.sqrt(v @ v) or 1.0)).astype(np.float32)


def clustered(x: np.ndarray, clusters: int, rounds: int = 8) -> np.ndarray:
    """Centres of spherical k-means; starts from mutually distant rows, so reruns agree."""
    chosen = [x.mean(0)]
    near = x @ chosen[0]
    for _ in range(min(clusters, len(x)) - 1):
        chosen.append(x[near.argmin()])
        near = np.maximum(near, x @ chosen[-1])
    centres = np.array(chosen)
    for _ in range(rounds):
        own = (x @ centres.T).argmax(1)
        centres = np.array([x[own == k].mean(0) if (own == k).any() else c for k, c in enumerate(centres)])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres.astype(np.float32)


def held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2


def fit(train: DataFrame, dims: int = 8192, clusters: int = 4, sample: int = 400) -> dict | None:
    """train(doc_id, lang, text) -> the model: langs, idf, centres and radii; None without documents.

    Inverse document frequencies cover all documents of train. The clusters of
    a language come from its `sample` documents with the lowest hashes of
    doc_id. Null languages and texts are left out.
    """
    train = train.where("lang is not null and text is not null")

    if train.select("lang").distinct().limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(dims + 1, dtype=np.int64), 0
        for batch in batches:
            for text in bytes_of(batch.column("text")):
                df[:dims] += ngrams(text, dims) > 0
                n += 1
        df[dims] = n
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(df[seen])], ["slot", "df"])

    counts = np.zeros(dims + 1)
    for slot, df in train.select("text").mapInArrow(frequencies, "slot long, df long").groupBy("slot").agg(F.sum("df")).collect():  # at most dims + 1 rows
        counts[slot] = df
    if not counts[dims]:
        return None
    idf = np.log((1 + counts[dims]) / (1 + counts[:dims])) + 1

    lowest = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = train.select("doc_id", "lang").withColumn("_n", F.row_number().over(lowest)).where(F.col("_n") <= sample).select("doc_id", "lang")
    texts = train.select(F.col("doc_id").alias("_doc"), F.col("lang").alias("_lang"), "text")
    chosen = texts.join(F.broadcast(chosen), F.expr("doc_id <=> _doc and lang = _lang")).select("lang", "doc_id", "text").dropDuplicates(["lang", "doc_id"])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [vector(ngrams(text, dims), idf).tobytes() for text in bytes_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("doc_id"), pa.array(made, pa.binary())], ["lang", "doc_id", "vector"])

    def centres(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id")
        x = np.array([np.frombuffer(v, dtype=np.float32) for v in rows.vector])
        found = clustered(x, clusters)
        near = x @ found.T
        radii = [1 - np.quantile(near[near.argmax(1) == k, k], 0.01) if (near.argmax(1) == k).any() else 0.0 for k in range(len(found))]
        return pd.DataFrame({"lang": key[0], "centre": [c.tobytes() for c in found], "radius": radii})

    # texts of any length become vectors of one length before they meet by language
    chosen = chosen.mapInArrow(vectors, "lang string, doc_id long, vector binary")
    rows = chosen.groupBy("lang").applyInPandas(centres, "lang string, centre binary, radius double").orderBy("lang", "centre").collect()  # at most MOST_LANGUAGES * clusters rows
    return {"langs": [r.lang for r in rows], "idf": idf, "centres": np.array([np.frombuffer(r.centre, dtype=np.float32) for r in rows]), "radii": np.array([r.radius for r in rows])}


def identify(docs: DataFrame, model: dict | None, slack: float = 1.5) -> DataFrame:
    """docs(doc_id, text) -> doc_id, lang_pred, score, rejected.

    lang_pred is the language of the centroid with the highest cosine to the
    text's normalised TF-IDF vector of n-grams, score that cosine. rejected: the
    text is further from the centroid than slack times the radius that holds 99
    of 100 of its documents, or isn't in a language at all. Null texts, texts
    without a letter and all texts under a model of None are `und`, score 0.
    Equal cosines go to the first language by code point. Rows are judged one by one.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in bytes_of(batch.column("text")):
                if text is None or model is None or not has_letter(text):
                    found.append((UNKNOWN, 0.0, True))
                    continue
                near = model["centres"] @ vector(ngrams(text, len(model["idf"])), model["idf"])
                k = int(near.argmax())
                found.append((model["langs"][k], float(min(1.0, max(0.0, near[k]))), bool(1 - near[k] > slack * model["radii"][k])))
            cols = list(zip(*found, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(judge, "doc_id long, lang_pred string, score double, rejected boolean")


def crc_of(doc_id: int) -> int:
    """What held_out() looks at, for tests."""
    return zlib.crc32(str(doc_id).encode()) % 4
