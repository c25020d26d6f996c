"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

1. The words of the benchmark are counted over the whole corpus. Of a test item's runs of SEED words the rarest
   SEED_SHARE, LEAST_SEEDS at least, are its seeds; a run is rare by the product of its words' shares. (Its own
   count would say less: a leaked item makes its n-grams frequent.) Ranks don't depend on the size of the corpus. An
   item shorter than MIN_ITEM is its own only seed.
2. A pass over the corpus joins the passages to the items on their seeds; a passage reaches as far
   around a seed as the item could.
3. Passage and item are aligned word by word (match 2, mismatch and gap -1, Smith-Waterman). A pair
   leaks if the score is at least SCORE of the item's full score.

The benchmark travels to the tasks in parts of at most PART_WORDS words; a larger one takes more passes.

Defined results: null ids or texts on either side and texts without a word match nothing; repeated rows
give one pair; items of equal words each give theirs; the best passage of a pair counts; an empty table on
either side gives no pairs; other columns play no part (the stage keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import kernel
from cairn.session import BROADCAST_BYTES, cut

SEED = 3
SEED_SHARE, LEAST_SEEDS = 0.6, 8
SCORE = 0.5
MIN_ITEM = 5
PART_WORDS = 4_000_000
MATCH, MISS, GAP = 2, -1, -1


def align(a: np.ndarray, b: np.ndarray) -> int:
    """Best Smith-Waterman score of two word sequences, a row of the matrix at a time."""
    j = np.arange(len(b) + 1)
    row = np.zeros(len(b) + 1, np.int64)
    best = 0
    for w in a:
        new = np.zeros(len(b) + 1, np.int64)
        new[1:] = np.maximum(row[:-1] + np.where(b == w, MATCH, MISS), row[1:] + GAP)
        np.maximum(new, 0, out=new)
        new = np.maximum.accumulate(new - GAP * j) + GAP * j  # gaps along the row
        best = max(best, int(new.max()))
        row = new
    return best


def _item_words(items: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in kernel.chunks(batches):
            w = kernel.Words(b.column("text"))
            words = pa.ListArray.from_arrays(pa.array(w.first.astype(np.int32)), pa.array(w.hash.view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("item_id"), words], ["item_id", "words"])

    return items.filter("item_id is not null and text is not null").select("item_id", "text").distinct().mapInArrow(run, "item_id long, words array<long>").filter(F.size("words") > 0)


def word_counts(docs: DataFrame, vocabulary: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """(word hashes, their counts in the corpus, words of the corpus): for the benchmark's words only."""
    spark = docs.sparkSession
    known = np.sort(np.array([r[0] for r in vocabulary.collect()], np.int64).view(np.uint64))
    shared = spark.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        n = np.zeros(len(v), np.int64)
        total = 0
        for b in kernel.chunks(batches):
            h = kernel.Words(b.column("text")).hash
            total += len(h)
            n += np.bincount(_find(v, h), minlength=len(v) + 1)[: len(v)]
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1]), pa.array(np.r_[n[at], total])], ["word", "n"])

    rows = docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(len(known), np.int64)
    total = 0
    for word, count in rows:
        if word < 0:
            total = count
        else:
            n[word] = count
    return known, n, total


def _find(v: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Place of each hash in the sorted ``v``, len(v) if it isn't there. A bit table answers for most."""
    out = np.full(len(h), len(v))
    if not len(v) or not len(h):
        return out
    bits = max(16, int(np.ceil(np.log2(len(v)))) + 5)
    table = np.zeros(1 << bits, bool)
    table[v >> np.uint64(64 - bits)] = True
    at = np.flatnonzero(table[h >> np.uint64(64 - bits)])
    p = np.searchsorted(v, h[at])
    p[p == len(v)] = 0
    ok = v[p] == h[at]
    out[at[ok]] = p[ok]
    return out


class Seeds:
    """The seeds of a part of the benchmark: sorted hashes with the item and the place in it."""

    def __init__(self, ids: np.ndarray, words: list[np.ndarray], known: np.ndarray, n: np.ndarray, total: int):
        self.ids, self.words = ids, words
        h, item, pos = [], [], []
        share = np.maximum(n, 1) / max(1, total)
        for i, w in enumerate(words):
            size = min(SEED, len(w))
            if len(w) < MIN_ITEM:
                size = len(w)
            chance = np.convolve(np.log(share[np.searchsorted(known, w)]), np.ones(size), "valid")
            keep = max(LEAST_SEEDS, int(np.ceil(SEED_SHARE * len(chance))))
            at = np.sort(np.argsort(np.round(chance, 9), kind="stable")[:keep])
            h.append(self.gram(w, size)[at])
            item.append(np.full(len(at), i))
            pos.append(at)
        self.sizes = sorted({min(SEED, len(w)) if len(w) >= MIN_ITEM else len(w) for w in words})
        h, item, pos = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (h, item, pos))
        order = np.argsort(h, kind="stable")
        self.hash, self.item, self.pos = h[order].astype(np.uint64), item[order], pos[order]
        self.unique, self.first = np.unique(self.hash, return_index=True)
        self.last = np.r_[self.first[1:], len(self.hash)]

    @staticmethod
    def gram(w: np.ndarray, n: int) -> np.ndarray:
        m = len(w) - n + 1
        h = w[:m].copy()
        for k in range(1, n):
            h = h * np.uint64(0xD6E8FEB86659FD93) + w[k : k + m]
        return kernel.mix(h) + np.uint64(n)

    def hits(self, w: kernel.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, word, item, place in the item) of every seed in a chunk of texts."""
        out = []
        for size in self.sizes:
            h, at = w.ngrams(size)
            p = _find(self.unique, h + np.uint64(size))
            k = np.flatnonzero(p < len(self.unique))
            p, at = p[k], at[k]
            n = self.last[p] - self.first[p]
            of = np.repeat(self.first[p], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = np.repeat(at, n)
            out.append((w.doc[at] if len(at) else at, at, self.item[of], self.pos[of]))
        return tuple(np.concatenate([np.zeros(0, np.int64), *[x[k] for x in out]]) for k in range(4))


def _scan(seeds: Seeds, score: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in kernel.chunks(batches):
        w = kernel.Words(b.column("text"))
        row, at, item, pos = seeds.hits(w)
        if not len(row):
            continue
        size = np.array([len(x) for x in seeds.words])
        start = at - pos  # where the item would begin
        order = np.lexsort((start, item, row))
        row, item, start = row[order], item[order], start[order]
        reach = size[item]
        new = np.r_[True, (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (start[1:] - start[:-1] > reach[1:])]
        group = np.flatnonzero(new)
        end = start[np.r_[group[1:], len(start)] - 1]
        out: dict[tuple[int, int], float] = {}
        for g, e in zip(group.tolist(), end.tolist()):
            r, i = int(row[g]), int(item[g])
            slack = size[i] // 2 + 2
            lo = max(w.first[r], start[g] - slack)
            hi = min(w.first[r + 1], e + size[i] + slack)
            window = w.hash[lo:hi]
            if np.isin(seeds.words[i], window).sum() < score * size[i]:
                continue  # every match takes a word of the item that is here
            s = align(seeds.words[i], window) / (MATCH * size[i])
            if s >= score:
                out[r, i] = max(s, out.get((r, i), 0.0))
        if out:
            r, i = np.array(list(out), np.int64).T
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(r)), pa.array(seeds.ids[i]), pa.array(list(out.values()), pa.float64())], ["doc_id", "item_id", "score"])


def leaks(docs: DataFrame, items: DataFrame, score: float = SCORE, part_words: int = PART_WORDS) -> DataFrame:
    """(doc_id, item_id, score) of every leaking pair."""
    spark = docs.sparkSession
    kernel.frugal(docs.sparkSession)
    words = cut(_item_words(items))
    size = words.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    parts = int(size // part_words) + 1
    texts = docs.filter("doc_id is not null and text is not null").select("doc_id", "text")
    found = []
    for k in range(parts):
        part = words.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k)
        rows = part.orderBy("item_id").toArrow()
        known, n, total = word_counts(texts, part.select(F.explode("words").alias("w")).distinct())
        seeds = Seeds(rows.column("item_id").to_numpy(), [np.asarray(x.values.to_numpy()).view(np.uint64) for x in rows.column("words")], known, n, total)
        shared = spark.sparkContext.broadcast(seeds)
        found.append(texts.mapInArrow(lambda batches, s=shared: _scan(s.value, score, batches), "doc_id long, item_id long, score double"))
    return reduce(DataFrame.union, found).groupBy("doc_id", "item_id").agg(F.max("score").alias("score"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bad = cut(leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct())
    if bad.count() * 16 <= BROADCAST_BYTES:
        bad = F.broadcast(bad)
    return docs.join(bad, "doc_id", "left_anti").select(docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
