"""Language identification by the nearest of several clustered centroids per language.

Texts are vectors of hashed byte trigrams around each letter (lower-cased, all but letters as space),
term count times inverse document frequency, normalised. Document frequencies are counted over the whole corpus. At most SAMPLE documents of each language
(the least hashes of doc_id, so any size gives a like sample) train CENTROIDS spherical k-means
centroids per language. A text gets the language of the centroid of the greatest cosine, unless the
cosine is below that language's limit: REJECT times the 1 % quantile of its training texts.

Defined results: texts without a letter and null texts are 'und' with similarity 0; rows keep null
and repeated doc_ids; without labelled rows everything is 'und'; ties go to the alphabetically first language;
an empty table gives an empty one; columns named ``lang_id`` or ``similarity`` give way to the results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm import kernel
from cairn.session import BROADCAST_BYTES, bounded, cut

BUCKETS = 4096
SAMPLE = 400
CENTROIDS = 4
REJECT = 0.6
ROWS = 512
UNKNOWN = "und"
_LETTER = np.zeros(256, bool)
_LETTER[list(b"abcdefghijklmnopqrstuvwxyz")] = True
_LETTER[128:] = True


def counts(col: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, rows x BUCKETS counts of hashed trigrams), a block of rows at a time."""
    data, off = kernel.text_buffer(col)
    x = np.full(len(data) + 2, 32, np.uint32)
    x[1:-1] = np.where(_LETTER[data], data, 32)
    left, right = x[:-2].copy(), x[2:].copy()
    full = np.diff(off) > 0
    left[off[:-1][full]] = 32  # a text ends where the next one starts
    right[off[1:][full] - 1] = 32
    at = np.flatnonzero(x[1:-1] != 32)
    gram = ((left[at] << 16) | (x[1:-1][at] << 8) | right[at]) * np.uint32(2654435761) >> np.uint32(20)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))[at]
    for s in range(0, len(off) - 1, ROWS):
        e = min(len(off) - 1, s + ROWS)
        p, q = np.searchsorted(row, (s, e))
        yield s, np.bincount((row[p:q] - s) * BUCKETS + gram[p:q], minlength=(e - s) * BUCKETS).reshape(e - s, BUCKETS)


def frequencies(docs: DataFrame) -> np.ndarray:
    """Inverse document frequency of every bucket over the whole corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(BUCKETS + 1, np.int64)
        for b in kernel.chunks(batches):
            df[-1] += b.num_rows
            for _, m in counts(b.column("text")):
                df[:-1] += np.count_nonzero(m, axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS + 1)), pa.array(df)], ["bucket", "n"])

    rows = docs.filter("text is not null").select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(BUCKETS + 1)
    for bucket, n in rows:
        df[bucket] = n
    return np.log((df[-1] + 1) / (df[:-1] + 1)) + 1


def unit(m: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = (m * idf).astype(np.float32)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def cluster(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from the farthest-first start; rows of ``v`` are unit vectors."""
    c = [v.mean(0)]
    near = v @ c[0]
    for _ in range(min(k, len(v))):
        c.append(v[int(np.argmin(near))])
        near = np.maximum(near, v @ c[-1])
    c = np.stack(c[1:])
    for _ in range(rounds):
        own = np.argmax(v @ c.T, axis=1)
        c = np.stack([v[own == i].mean(0) if (own == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def train(docs: DataFrame, idf: np.ndarray, sample: int = SAMPLE, k: int = CENTROIDS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language, centroid, least similarity) of every centroid."""
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = docs.filter("lang is not null and doc_id is not null").select("doc_id", "lang").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= sample).select("doc_id").distinct()
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def fit(t: pa.Table) -> pa.Table:
        texts = t.column("text").combine_chunks()
        v = np.concatenate([unit(m, shared.value) for _, m in counts(texts)])
        v = v[v.any(axis=1)]
        if not len(v):
            return pa.table({"lang": pa.array([], pa.string()), "k": pa.array([], pa.int32()), "centroid": pa.array([], pa.list_(pa.float32())), "least": pa.array([], pa.float64())})
        c = cluster(v, k)
        least = REJECT * float(np.quantile((v @ c.T).max(1), 0.01))
        return pa.table({"lang": [t.column("lang")[0].as_py()] * len(c), "k": pa.array(range(len(c)), pa.int32()), "centroid": pa.array(list(c), pa.list_(pa.float32())), "least": [least] * len(c)})

    some = docs.select("doc_id", "lang", "text").filter("text is not null and lang is not null").join(bounded(cut(ids), 16), "doc_id", "left_semi")
    rows = some.select("lang", "text").groupBy("lang").applyInArrow(fit, "lang string, k int, centroid array<float>, least double").orderBy("lang", "k").collect()
    return [r["lang"] for r in rows], np.array([r["centroid"] for r in rows], np.float32).reshape(len(rows), BUCKETS), np.array([r["least"] for r in rows])


def identify(docs: DataFrame, labelled: DataFrame | None = None, drop: tuple[str, ...] = ("text",)) -> DataFrame:
    """Every row of ``docs`` with ``lang_id`` and ``similarity``. ``labelled`` (doc_id, lang, text): the
    rows to train on, ``docs`` itself if not given."""
    kernel.frugal(docs.sparkSession)
    docs = kernel.without(docs, "lang_id", "similarity")
    idf = frequencies(docs)
    langs, centroids, least = train(docs if labelled is None else labelled, idf)
    assert centroids.nbytes <= BROADCAST_BYTES, "fewer centroids or buckets: the model is broadcast"
    shared = docs.sparkSession.sparkContext.broadcast((idf, langs, centroids, least))
    kept = [f for f in docs.schema if f.name not in drop]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", lang_id string, similarity double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, langs, centroids, least = shared.value
        for b in kernel.chunks(batches):
            best = np.zeros(b.num_rows)
            name = np.full(b.num_rows, -1)
            if langs:
                for s, m in counts(b.column("text")):
                    sim = unit(m, idf) @ centroids.T
                    at = np.argmax(sim, axis=1)
                    top = sim[np.arange(len(m)), at]
                    best[s : s + len(m)] = top
                    name[s : s + len(m)] = np.where((top > 0) & (top >= least[at]), at, -1)
            lang = pa.array([langs[k] if k >= 0 else UNKNOWN for k in name.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in kept], lang, pa.array(best)], [*[f.name for f in kept], "lang_id", "similarity"])

    return docs.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    return identify(docs).select("doc_id", "lang_id", "similarity")
