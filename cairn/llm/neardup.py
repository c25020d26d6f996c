"""SimHash near-dedup: small-world graph search per shard, verified edges, union.

1. One pass: a 128-bit SimHash of each text's distinct words, its content hash, and of its distinct
   word 3-grams their number, a bottom-64 sketch and BANDS minima, one of each residue class.
2. Texts of equal words are one node, the least doc_id of them.
3. Every node goes to the BANDS shards that its minima select, as a member and as a query. Two nodes of
   Jaccard J miss each other with probability (1-J)**BANDS. (Broadcasting every query to every shard
   would cost nodes times shards.) Shards hold about SHARD nodes, however many there are; the nodes of a
   minimum that over SHARD nodes share are told apart by further minima, up to LEVELS times, and what
   is still alike then (a template with other words filled in) meets in all pairs of half shards.
4. In a shard, a navigable small-world graph over Hamming distance finds each query's neighbours within
   RADIUS by beams that expand while they are full; recall is audited against exact search. All pairs whose
   sketches agree are candidates, but those that near certain ones (sketch Jaccard SURE) connect.
5. Candidates are verified by the exact Jaccard of the 3-gram sets, the likeliest first, and only true
   ones unioned; a candidate is passed over only if true edges connect its ends, or the near certain
   ones, which are verified too (if one fails, the search is repeated without them).
   The least doc_id of a group stays.

Defined results: null doc_ids and texts without a word are never duplicates; a text of one or two words
equals only texts of the same words; rows that repeat a doc_id are one document (the stage keeps one
row of it, if they are equal in all columns); of equal distances the lesser node comes first; an empty
table gives no groups; extra columns of any name pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm import graph, kernel
from cairn.operators.graph import components
from cairn.session import BROADCAST_BYTES, bounded, cut

RADIUS = 32
JACCARD = 0.5
BANDS = 5
SKETCH = 64
#: Three standard deviations of a sketch estimate at JACCARD; the exact check follows.
MARGIN = 3 * (JACCARD * (1 - JACCARD) / SKETCH) ** 0.5
SHARD, LEVELS = 16_384, 3
MOST_TASKS = 20_000
SURE = 0.9
PORTION, LAST = 2, 128
SHINGLE = 3
_C2 = np.uint64(0xA24BAED4963EE407)
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


def _shingles(w: kernel.Words, bits: int = 44) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, 3-gram hash); a text of fewer words has one shingle, all its words."""
    h, at = w.ngrams(SHINGLE)
    doc = w.doc[at]
    n = np.diff(w.first)
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(short):
        first = w.first[short]
        second = np.where(n[short] > 1, w.hash[np.minimum(first + 1, len(w.hash) - 1)], 0)
        h = np.concatenate([h, kernel.mix(w.hash[first] + second * _C2 + n[short].astype(np.uint64))])
        doc = np.concatenate([doc, short])
    return kernel.distinct_per_doc(doc, h, bits)


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in kernel.chunks(batches):
        b = b.filter(pc.is_valid(b.column("doc_id")))
        w = kernel.Words(b.column("text"))
        count = np.diff(w.first)
        rows = np.flatnonzero(count)
        if not len(rows):
            continue
        # content: polynomial of all words, twice
        content = []
        for c in (np.uint64(1), _C2):
            power, inverse = kernel._powers(len(w.hash) + 1)
            total = np.zeros(len(w.hash) + 1, np.uint64)
            np.cumsum(kernel.mix(w.hash * c) * power[: len(w.hash)], out=total[1:])
            first, last = w.first[rows], w.first[rows + 1]
            content.append(kernel.mix((total[last] - total[first]) * inverse[first] + (last - first).astype(np.uint64)))
        # SimHash of the distinct words
        doc, h = kernel.distinct_per_doc(w.doc, w.hash, 44)
        both = np.stack([kernel.mix(h), kernel.mix(h + _C2)], 1)
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        size = np.diff(np.r_[first, len(doc)])
        # each bit of a byte in a byte of its own: a sum of up to 255 rows of these words counts 8 bits at once
        part = np.union1d(first, np.arange(0, len(doc), 255))
        lanes = _SPREAD[both.view(np.uint8).reshape(len(h), 16)]
        ones = np.add.reduceat(lanes, part, axis=0).view(np.uint8)
        ones = np.add.reduceat(ones.astype(np.int32), np.searchsorted(part, first), axis=0)
        codes = np.packbits(2 * ones > size[:, None], axis=1).view(np.uint64)
        # shingles: number, sketch, minima of residue classes
        doc, h = _shingles(w)
        first = np.searchsorted(doc, rows)
        size = np.searchsorted(doc, rows, side="right") - first
        sketch = np.full((len(rows), SKETCH), 0xFFFFFFFF, np.uint32)
        take = np.minimum(size, SKETCH)
        r = np.repeat(np.arange(len(rows)), take)
        k = np.arange(len(r)) - np.repeat(np.cumsum(take) - take, take)
        sketch[r, k] = (h[first[r] + k] >> np.uint64(12)).astype(np.uint32)
        minima = np.zeros((len(rows), BANDS), np.int64)
        x = kernel.mix(h)
        for band in range(BANDS):
            at = np.flatnonzero(x % np.uint64(BANDS) == band)
            p = np.searchsorted(doc[at], rows)
            ok = p < len(at)
            ok[ok] = doc[at[p[ok]]] == rows[ok]
            minima[:, band] = np.where(ok, x[at[np.minimum(p, len(at) - 1)]].view(np.int64) if len(at) else 0, x[first].view(np.int64))
        raw = pa.py_buffer(np.ascontiguousarray(sketch).tobytes())
        fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(SKETCH * 4), len(rows), [None, raw])
        shards = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * len(rows) + 1, BANDS), pa.int32()), pa.array(minima.ravel()))
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id").take(pa.array(rows)), *[pa.array(c.view(np.int64)) for c in content], pa.array(codes[:, 0].view(np.int64)), pa.array(codes[:, 1].view(np.int64)),
             pa.array(size.astype(np.int32)), fixed.cast(pa.binary()), shards],
            ["doc_id", "c1", "c2", "s1", "s2", "n", "sketch", "minima"])


FINGERPRINT = "doc_id long, c1 long, c2 long, s1 long, s2 long, n int, sketch binary, minima array<long>"


def sketch_jaccard(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard of bottom-k sketches (rows, ascending, padded by the largest value)."""
    both = np.sort(np.concatenate([a, b], 1), axis=1)
    real = both != 0xFFFFFFFF
    same = np.zeros(both.shape, bool)
    same[:, 1:] = (both[:, 1:] == both[:, :-1]) & real[:, 1:]
    rank = np.cumsum(real & ~same, axis=1)
    within = rank <= a.shape[1]
    return (same & within).sum(1) / np.maximum(1, np.minimum(rank[:, -1], a.shape[1]))


class _Union:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            two = self.up[self.up]
            if (two == self.up).all():
                return self.up
            self.up = two

    def join(self, a: int, b: int) -> bool:
        up = self.up
        while up[a] != a:
            a = up[a]
        while up[b] != b:
            b = up[b]
        if a == b:
            return False
        up[max(a, b)] = min(a, b)
        return True


def _shard_pairs(batches: Iterator[pa.RecordBatch], sure: float) -> Iterator[pa.RecordBatch]:
    t = pa.Table.from_batches(list(batches))
    ids = t.column("doc_id").to_numpy()
    _, at = np.unique(ids, return_index=True)  # a node whose minima select one shard twice is there once
    order = at[np.argsort(kernel.mix(ids[at].astype(np.uint64)), kind="stable")]
    ids = ids[order]
    codes = np.stack([t.column("s1").to_numpy()[order], t.column("s2").to_numpy()[order]], 1).view(np.uint64)
    n = t.column("n").to_numpy()[order]
    sketch = np.frombuffer(b"".join(t.column("sketch").take(pa.array(order)).to_pylist()), np.uint32).reshape(len(order), SKETCH)
    del t
    u = _Union(len(ids))  # of pairs that are sure
    for i, j in graph.neighbours(codes, RADIUS):
        fits = np.minimum(n[i], n[j]) >= JACCARD * np.maximum(n[i], n[j])
        i, j = i[fits], j[fits]
        once = np.sort(np.unique(np.minimum(i, j) * len(ids) + np.maximum(i, j), return_index=True)[1])
        i, j = i[once], j[once]
        first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, int)
        rank = np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)]))
        order_ = np.argsort(rank, kind="stable")
        bounds = np.searchsorted(rank[order_], np.arange(rank.max() + 2)) if len(i) else [0]
        for s, e in zip(bounds[:-1], bounds[1:]):  # nearest of every query first, then the next nearest
            x, y = i[order_[s:e]], j[order_[s:e]]
            root = u.roots()
            apart = root[x] != root[y]
            x, y = x[apart], y[apart]
            for p in range(0, len(x), 1 << 15):
                px, py = x[p : p + (1 << 15)], y[p : p + (1 << 15)]
                like = sketch_jaccard(sketch[px], sketch[py])
                keep = like >= JACCARD - MARGIN
                for k in np.flatnonzero(like >= sure).tolist():
                    keep[k] = u.join(int(px[k]), int(py[k]))
                v, w = ids[px[keep]], ids[py[keep]]
                if len(v):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(v, w)), pa.array(np.maximum(v, w)), pa.array(like[keep], pa.float64())], ["a", "b", "like"])


MEMBER = ("doc_id", "s1", "s2", "n", "sketch")


def _further(level: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of a minimum ``m`` under BANDS new ones each: minima of their sketch by another hash, one of each residue class."""
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    for b in batches:
        if not b.num_rows:
            continue
        sk = np.frombuffer(b"".join(b.column("sketch").to_pylist()), np.uint32).reshape(b.num_rows, SKETCH)
        x = kernel.mix(sk.astype(np.uint64) + np.uint64(level + 1) * _C2)
        x[sk == 0xFFFFFFFF] = none
        every = x.min(axis=1)
        m = b.column("m").to_numpy().view(np.uint64)
        for band in range(BANDS):
            own = np.where((x % np.uint64(BANDS) == band) & (x != none), x, none).min(axis=1)
            own = kernel.mix(m + kernel.mix(np.where(own == none, every, own)))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in MEMBER], pa.array(own.view(np.int64))], [*MEMBER, "m"])


def shards(nodes: DataFrame, size: int = SHARD, levels: int = LEVELS) -> tuple[DataFrame, int]:
    """(members with their ``shard``, number of shards)."""
    rows = nodes.select(*MEMBER, F.explode(F.array_distinct("minima")).alias("m"))
    count, out, made = nodes.count() * BANDS, [], 0
    for level in range(levels + 1):
        held = rows.groupBy("m").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > size)
        hot = cut(held)
        n, many = hot.agg(F.count(F.lit(1)), F.coalesce(F.sum("c"), F.lit(0))).first()
        rest = max(1, -(-(count - many) // size))
        made += rest
        cold = rows.join(bounded(hot.select("m"), 16), "m", "left_anti") if n else rows
        out.append(cold.select(*MEMBER, F.xxhash64(F.lit(level), F.pmod(F.xxhash64("m"), F.lit(rest))).alias("shard")))
        if not n:
            break
        rows = rows.join(bounded(hot, 24), "m", "left_semi" if level < levels else "inner")
        if level < levels:
            rows = cut(rows.mapInArrow(lambda b, k=level: _further(k, b), "doc_id long, s1 long, s2 long, n int, sketch binary, m long").distinct())
            count = rows.count()
        else:  # the node is in half shard i of k; it meets its own and each other half
            k = F.ceil(F.col("c") * 2 / size).cast("long")
            rows = rows.withColumn("k", k).withColumn("i", F.pmod(F.xxhash64("doc_id", F.lit(11)), "k"))
            rows = rows.withColumn("j", F.explode(F.filter(F.sequence(F.lit(0).cast("long"), F.col("k") - 1), lambda j: (j != F.col("i")) | (F.col("k") == 1))))
            out.append(rows.select(*MEMBER, F.xxhash64(F.lit(-1), "m", F.least("i", "j"), F.greatest("i", "j")).alias("shard")))
            made += int(hot.agg(F.sum(k * k / 2)).first()[0])
    return reduce(DataFrame.unionByName, out), made


def candidate_pairs(nodes: DataFrame, sure: float = SURE, size: int = SHARD, levels: int = LEVELS) -> DataFrame:
    """(a, b, like) of every pair found whose sketches agree, but for those that pairs with a sketch
    Jaccard of at least ``sure`` connect already."""
    member, made = shards(nodes, size, levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _shard_pairs(batches, sure)

    tasks = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(made, MOST_TASKS))
    return member.repartition(tasks, "shard").groupBy("shard").applyInArrow(run, "a long, b long, like double").distinct()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in kernel.chunks(batches):
        doc, h = _shingles(kernel.Words(b.column("text")))
        at = np.searchsorted(doc, np.arange(b.num_rows + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(at), pa.array(h.astype(np.int64)))], ["doc_id", "grams"])


def verify(edges: DataFrame, docs: DataFrame) -> DataFrame:
    """The edges whose 3-gram sets have a Jaccard of at least JACCARD."""
    edges = cut(edges)
    ends = edges.select(F.col("a").alias("doc_id")).union(edges.select("b")).distinct()
    if edges.count() * 32 <= BROADCAST_BYTES:
        ends = F.broadcast(ends)
    grams = docs.select("doc_id", "text").join(ends, "doc_id", "left_semi").mapInArrow(_sets, "doc_id long, grams array<long>")
    x, y = (grams.select(F.col("doc_id").alias(k), F.col("grams").alias(g)) for k, g in (("a", "x"), ("b", "y")))
    both = F.size(F.array_intersect("x", "y"))
    j = edges.join(x, "a").join(y, "b").select("a", "b", (both / (F.size("x") + F.size("y") - both)).alias("jaccard"))
    return j.filter(F.col("jaccard") >= JACCARD)


def _settled(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """True edges that connect all that the true ones of ``pairs`` connect. The likeliest pairs of each
    node are verified first; those left inside a component of true edges need no check, the others are
    verified in growing portions, the last round all of them."""
    left, true, portion = cut(pairs), None, PORTION
    while True:
        rank = [F.row_number().over(Window.partitionBy(c).orderBy(F.desc("like"), "a", "b")) for c in ("a", "b")]
        first = F.lit(True) if portion > LAST else (F.least(*rank) <= portion) | (F.col("like") >= SURE)
        left = cut(left.withColumn("now", first))
        good = verify(left.filter("now").select("a", "b"), docs).select("a", "b")
        true = cut(good if true is None else true.union(good))
        left = left.filter("not now").drop("now")
        if left.isEmpty():
            return true
        root = cut(components(true))
        for c in ("a", "b"):
            left = left.join(root.select(F.col("id").alias(c), F.col("root").alias(f"root_{c}")), c, "left")
        left = cut(left.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b", "like"))
        if left.isEmpty():
            return true
        portion *= 8


def near_edges(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Verified edges that connect what the pairs found connect."""
    pairs = cut(candidate_pairs(nodes))
    true = _settled(pairs, docs)
    if not pairs.filter(F.col("like") >= SURE).join(true, ["a", "b"], "left_anti").isEmpty():
        true = _settled(candidate_pairs(nodes, 2.0), docs)  # a sure pair was none: without the short cut
    return true


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, keep) for every document that has a duplicate or is one; ``keep`` is its group's least doc_id."""
    kernel.frugal(docs.sparkSession)
    prints = cut(docs.select("doc_id", "text").mapInArrow(_fingerprint, FINGERPRINT))
    keys = prints.select("doc_id", "c1", "c2")
    lead = keys.groupBy("c1", "c2").agg(F.min("doc_id").alias("node"), F.max("doc_id").alias("last"))
    copies = keys.join(lead.filter("node < last"), ["c1", "c2"]).filter("doc_id <> node").select(F.col("node").alias("a"), F.col("doc_id").alias("b")).distinct()
    nodes = cut(prints.join(lead.select(F.col("node").alias("doc_id"), "c1", "c2"), ["doc_id", "c1", "c2"], "left_semi"))
    near = near_edges(nodes, docs)
    return components(copies.union(near)).select(F.col("id").alias("doc_id"), F.col("root").alias("keep"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = cut(groups(docs).filter("doc_id <> keep").select("doc_id"))
    if gone.count() * 16 <= BROADCAST_BYTES:
        gone = F.broadcast(gone)
    left = docs.join(gone, "doc_id", "left_anti")
    again = cut(docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    if again.isEmpty():
        return left.select(docs.columns)
    if again.count() * 16 <= BROADCAST_BYTES:
        again = F.broadcast(again)
    return left.join(again, "doc_id", "left_anti").unionByName(left.join(again, "doc_id", "left_semi").dropDuplicates()).select(docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, kept_id): each duplicate and the document of its group that stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return groups(docs).filter("doc_id <> keep").select("doc_id", F.col("keep").alias("kept_id"))
