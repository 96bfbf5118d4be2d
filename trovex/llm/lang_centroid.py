"""Language identification by nearest centroids.

A text's vector holds its hashed byte 2- and 3-grams (letters lower-cased, all else folded to a blank), weighted by
sublinear term frequency and inverse document frequency and brought to unit length. Each language has several centroids,
the clusters of its training vectors (spherical k-means). A text gets the language of the centroid with the largest
cosine; if its distance to that centroid exceeds the one learned for the centroid, it is marked as rejected.

Document frequencies count all training documents. Only the clustering uses a sample, of about ``sample`` documents in
all, the same number for each language, drawn by a hash of the id; a language with fewer gives all it has.

Defined results: null texts and texts without a letter are ``und`` with score 0; without any training document all
texts are ``und``; rows without doc_id are neither held out nor learned from; equal texts have equal results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovex.llm import textkit as tk
from trovex.llm.runtime import ship, table

DIMS = 4096
SAMPLE = 1200
CLUSTERS = 4
UNKNOWN = "und"
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def fold_of(doc_id: str = "doc_id", folds: int = 5):
    """crc32 of the id as text, modulo ``folds``; null without an id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds))


def gram_counts(col: pa.Array, dims: int) -> np.ndarray:
    """One row of hashed n-gram counts for each text."""
    data, offsets = tk.buffer(col)
    n = len(offsets) - 1
    b = _FOLD[data].astype(np.int64)
    # runs of blanks count once
    blank = b == 32
    keep = np.ones(len(b), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    inner = offsets[:-1][offsets[:-1] < len(b)]
    keep[inner] = True
    first = np.concatenate([[0], np.cumsum(keep)])[offsets]
    b = b[keep]
    row = np.repeat(np.arange(n), np.diff(first))
    out = np.zeros(n * dims, np.int64)
    code = b
    for size in (2, 3):
        code = code[:-1] * 256 + b[size - 1 :]
        same = row[: len(code)] == row[size - 1 :]
        at = ((code * 0x9E3779B1 + size * 0x85EBCA6B) >> 9) % dims
        out += np.bincount((row[: len(code)] * dims + at)[same], minlength=n * dims)
    return out.reshape(n, dims)


def unit_vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * idf
    return (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def has_letter(data: bytes) -> bool:
    if data.isascii():
        return any(map(data.lower().__contains__, b"etaoinshrdlucmfwypvbgkjqxz"))
    return any(c.isalpha() for c in data.decode())


def spherical_kmeans(v: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Up to ``k`` unit centroids; starts from vectors that are far from each other."""
    start = [int(np.argmax(v @ v.mean(axis=0)))]
    while len(start) < min(k, len(v)):
        start.append(int(np.argmin((v @ v[start].T).max(axis=1))))
    c = v[start]
    for _ in range(rounds):
        own = np.argmax(v @ c.T, axis=1)
        c = np.stack([v[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c.astype(np.float32)


class CentroidModel:
    """Languages, their centroids and each centroid's largest accepted distance."""

    def __init__(self, idf: np.ndarray, langs: list[str], vectors: dict[str, np.ndarray], clusters: int = CLUSTERS, slack: float = 1.1):
        self.idf = idf
        self.lang: list[str] = []
        rows, reach = [], []
        for name in langs:
            c = spherical_kmeans(vectors[name], clusters)
            cos = vectors[name] @ c.T
            own = cos.argmax(axis=1)
            for j in range(len(c)):
                far = 1 - cos[own == j, j]
                rows.append(c[j])
                reach.append(min(1.0, float(far.max()) * slack) if len(far) else 0.0)
                self.lang.append(name)
        self.centroids = np.stack(rows) if rows else np.zeros((0, len(idf)), np.float32)
        self.reach = np.array(reach)

    def predict(self, col: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine and whether the distance is beyond the centroid's reach."""
        data, offsets = tk.buffer(col)
        raw = data.tobytes()
        at = offsets.tolist()
        letters = np.array([has_letter(raw[a:b]) for a, b in zip(at, at[1:])], bool)
        if not self.lang or not len(letters):
            return [UNKNOWN] * len(letters), np.zeros(len(letters)), np.ones(len(letters), bool)
        cos = unit_vectors(gram_counts(col, len(self.idf)), self.idf) @ self.centroids.T
        best = cos.argmax(axis=1)
        score = np.clip(cos[np.arange(len(best)), best].astype(float), 0, 1)
        rejected = (1 - score > self.reach[best]) | ~letters
        return [self.lang[b] if ok else UNKNOWN for b, ok in zip(best, letters)], np.where(letters, score, 0.0), rejected


def document_frequencies(texts: DataFrame, dims: int) -> tuple[np.ndarray, int]:
    """Documents of ``texts`` (text) that hold each dimension, and their number. A task sends one row for each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(dims, np.int64), 0
        for batch in batches:
            for part in tk.chunks(batch, "text", 1 << 20):
                for a in range(0, part.num_rows, 512):
                    df += (gram_counts(part.column(0).slice(a, 512), dims) > 0).sum(axis=0)
                n += part.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, dims)), pa.array(np.concatenate([[n], df]))], names=["dim", "n"])

    rows = texts.mapInArrow(run, "dim long, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect()
    found = {r["dim"]: r["n"] for r in rows}
    return np.array([found.get(i, 0) for i in range(dims)], float), found.get(-1, 0)


def fit(train: DataFrame, dims: int = DIMS, sample: int = SAMPLE, clusters: int = CLUSTERS) -> CentroidModel:
    """Learns from ``train`` (doc_id, text, lang)."""
    ship(train.sparkSession)
    train = train.where("text is not null and lang is not null")
    counts = {r["lang"]: r["count"] for r in train.groupBy("lang").count().collect()}
    df, n = document_frequencies(train.select("text"), dims)
    idf = np.log((1 + n) / (1 + df)) + 1
    langs = sorted(counts)
    if not langs:
        return CentroidModel(idf, [], {})
    part = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, sample / len(langs) / counts[k])))])
    drawn = train.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 24)) < part[F.col("lang")] * (1 << 24))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in tk.chunks(batch, "text", 1 << 20):
                for a in range(0, p.num_rows, 512):
                    q = p.slice(a, 512)
                    v = unit_vectors(gram_counts(q.column(1), dims), idf)
                    yield pa.RecordBatch.from_arrays([q.column(0), pa.array([x.astype(np.float16).tobytes() for x in v], pa.binary())], names=["lang", "v"])

    held: dict[str, list[bytes]] = {}
    for r in drawn.select("lang", "text").mapInArrow(vectors, "lang string, v binary").collect():
        held.setdefault(r["lang"], []).append(bytes(r["v"]))
    stacked = {k: np.stack([np.frombuffer(x, np.float16).astype(np.float32) for x in sorted(v)]) for k, v in held.items()}
    return CentroidModel(idf, [k for k in langs if k in stacked], stacked, clusters)


def identify(docs: DataFrame, model: CentroidModel) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for each row of ``docs`` (doc_id, text)."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.chunks(batch, "text", 1 << 20):
                for a in range(0, part.num_rows, 512):
                    q = part.slice(a, 512)
                    lang, score, rejected = model.predict(q.column(1))
                    yield pa.RecordBatch.from_arrays([q.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def op5_nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(fold_of() != 0))
    found = identify(docs, model)
    return found.select("doc_id", F.coalesce(fold_of() == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
