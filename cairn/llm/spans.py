"""Substring dedup by sliding sentence spans.

A text is cut into pieces after each run of ``. ! ?`` and line ends (the pieces joined are the text).
A piece with words is a sentence; sentences are equal if their lower-cased words are. Every sentence
starts a span: the shortest run of 2 to 4 sentences with MIN_WORDS words (at the limit of 4 whatever
it has); a sentence of LONE_WORDS words is a span of its own, as a passage of a few long sentences that
lies between other text holds no run of whole ones. Spans are hashed and joined globally; every occurrence but the first, by (doc_id, position),
marks the pieces it covers, and marked pieces are removed.

A partition sends only its first occurrence of a span to the span's reducer: any other occurrence in it
is known not to be the first. So a boilerplate run in a billion documents costs a row a partition.

Defined results: rows of null doc_id or text pass unchanged; rows that repeat a doc_id count as one
document and keep or lose the same pieces; a text that loses all is empty (the pipeline drops it); a
span never crosses two texts; other columns are kept, but those named ``cuts``, ``_id`` or ``_removed``
(the pipeline's stage keeps these too); an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm import kernel
from cairn.session import BROADCAST_BYTES, cut

MIN_WORDS = 12
LONE_WORDS = 25
MOST = 4
FLUSH = 4 << 20
_END = np.zeros(256, bool)
_END[list(b".!?\n")] = True
_GAP = _END.copy()
_GAP[list(b" \t\r")] = True


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions at which a piece starts; each text that isn't empty starts one."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    gap = _GAP[data]
    ends = np.zeros(n + 1, np.int64)
    np.cumsum(_END[data], out=ends[1:])
    first = np.unique(offsets[:-1][np.diff(offsets) > 0])
    head = np.zeros(n, bool)
    head[first] = True
    run = gap & np.r_[True, ~gap[:-1]] | gap & head  # starts of runs of gap bytes
    out = np.flatnonzero(~gap & np.r_[False, gap[:-1]] & ~head)
    starts = np.flatnonzero(run)
    if len(out):
        of = starts[np.searchsorted(starts, out) - 1]
        out = out[ends[out] > ends[of]]
    return np.union1d(out, first)


def spans(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, first piece, last piece) of every span; pieces are counted from 0 in each text."""
    w = kernel.Words(col)
    none = np.zeros(0, np.int64)
    if not len(w.hash):
        return none, none.astype(np.uint64), none, none
    starts = piece_starts(w.data, w.offsets)
    piece = np.searchsorted(starts, w.start, side="right") - 1
    base = np.searchsorted(starts, w.offsets)
    at = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]])
    size = np.diff(np.r_[at, len(piece)])
    doc = w.doc[at]
    piece = piece[at] - base[doc]
    power, inverse = kernel._powers(len(w.hash) + 1)
    total = np.zeros(len(w.hash) + 1, np.uint64)
    np.cumsum(w.hash * power[: len(w.hash)], out=total[1:])
    h = kernel.mix((total[at + size] - total[at]) * inverse[at])
    n = len(at)
    length = (size >= LONE_WORDS).astype(np.int64)
    words = size.copy()
    value = h.copy()
    best = h + np.uint64(1)
    for m in range(2, MOST + 1):
        k = n - m + 1
        if k <= 0:
            break
        words[:k] += size[m - 1 :]
        value[:k] = value[:k] * np.uint64(0xD6E8FEB86659FD93) + h[m - 1 :]
        ok = (doc[:k] == doc[m - 1 :]) & (length[:k] == 0)
        if m < MOST:
            ok &= words[:k] >= MIN_WORDS
        length[:k][ok] = m
        best[:k][ok] = value[:k][ok] + np.uint64(m)
    j = np.flatnonzero(length)
    return doc[j], kernel.mix(best[j]), piece[j], piece[j + length[j] - 1]


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, ...]] = []

    def flush() -> Iterator[pa.RecordBatch]:
        h, doc, first, last = (np.concatenate([x[k] for x in held]) for k in range(4))
        held.clear()
        order = np.lexsort((first, doc, h))
        h, doc, first, last = h[order], doc[order], first[order], last[order]
        new = np.r_[True, h[1:] != h[:-1]]
        lead = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
        later = (doc != doc[lead]) | (first != first[lead])
        for s in range(0, len(h), 1 << 17):
            e = slice(s, s + (1 << 17))
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[e].view(np.int64)), pa.array(doc[e]), pa.array((first[e] << 32) | last[e]), pa.array(later[e])], ["h", "doc_id", "at", "later"])

    for b in kernel.chunks(batches):
        b = b.filter(pc.is_valid(b.column("doc_id")))
        row, h, first, last = spans(b.column("text"))
        held.append((h, b.column("doc_id").to_numpy()[row], first, last))
        if sum(len(x[0]) for x in held) > FLUSH:
            yield from flush()
    if held:
        yield from flush()


def removals(docs: DataFrame) -> DataFrame:
    """(doc_id, cuts): ranges of pieces to remove, each ``first << 32 | last``."""
    s = docs.select("doc_id", "text").mapInArrow(_emit, "h long, doc_id long, at long, later boolean")
    # what is known to be later needs no reducer of its span: its document spreads it
    w = Window.partitionBy("h", F.when(F.col("later"), F.col("doc_id"))).orderBy("doc_id", "at")
    s = s.withColumn("later", F.col("later") | (F.rank().over(w) > 1)).filter("later")
    return s.groupBy("doc_id").agg(F.collect_set("at").alias("cuts"))


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in kernel.chunks(batches):
        texts = b.column("text")
        cuts = b.column("cuts")
        rows = np.flatnonzero(np.asarray(pc.is_valid(cuts)))
        out = [0] * b.num_rows
        if len(rows):
            some = texts.take(pa.array(rows))
            data, off = kernel.text_buffer(some, lower=False)
            low, low_off = kernel.text_buffer(some)
            if len(low) != len(data):
                starts_of = lambda k: piece_starts(data[off[k] : off[k + 1]], np.array([0, off[k + 1] - off[k]]))
            else:
                every = piece_starts(data, off)
                starts_of = lambda k: every[np.searchsorted(every, off[k]) : np.searchsorted(every, off[k + 1])] - off[k]
            new = []
            for k, r in enumerate(rows):
                body = data[off[k] : off[k + 1]]
                starts = np.r_[starts_of(k), len(body)]
                keep = np.zeros(len(starts), np.int64)
                at = np.asarray(cuts[int(r)].values.to_numpy(), np.int64)
                first, last = at >> 32, at & 0xFFFFFFFF
                ok = last < len(starts) - 1
                np.add.at(keep, first[ok], 1)
                np.add.at(keep, last[ok] + 1, -1)
                gone = np.cumsum(keep)[:-1] > 0
                out[r] = int(gone.sum())
                new.append(body[np.repeat(~gone, np.diff(starts))].tobytes().decode())
            mask = np.zeros(b.num_rows, bool)
            mask[rows] = True
            texts = pc.replace_with_mask(texts, pa.array(mask), pa.array(new, texts.type))
        names = [n for n in b.schema.names if n != "cuts"]
        yield pa.RecordBatch.from_arrays([*[texts if n == "text" else b.column(n) for n in names], pa.array(out, pa.int32())], [*names, "_removed"])


def dedup(docs: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` with cleaned ``text`` and ``_removed``, the number of pieces that went. The removals are
    joined by a broadcast up to ``limit`` bytes, otherwise by a shuffled hash join whose table they are."""
    kernel.frugal(docs.sparkSession)
    docs = kernel.without(docs, "cuts", "_id", "_removed")
    r = cut(removals(docs))
    size = r.agg(F.coalesce(F.sum(F.size("cuts") * 8 + 24), F.lit(0))).first()[0]
    r = F.broadcast(r) if size <= limit else r.hint("shuffle_hash")
    j = docs.join(r.withColumnRenamed("doc_id", "_id"), docs["doc_id"] == F.col("_id"), "left").drop("_id")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", _removed int"
    return j.mapInArrow(_rebuild, schema)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    d, back = kernel.aside(docs, "cuts", "_id", "_removed")
    d = dedup(d).filter(~((F.col("_removed") > 0) & (F.trim("text") == "")))
    if "n_chars" in docs.columns:
        d = d.withColumn("n_chars", F.when(F.col("_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return back(d)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, without the sentences that repeat."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs).select("doc_id", "text", F.col("_removed").alias("n_removed"))


SQL = r"""
with pieces as (
  select doc_id, regexp_extract_all(text, '[^.!?\n]*[.!?\n][.!?\n \t\r]*|[^.!?\n]+') p from documents where doc_id is not null
), piece as (
  select doc_id, unnest(p) piece, unnest(range(len(p))) pos from pieces
), sent as (
  select doc_id, pos, trim(regexp_replace(lower(piece), '[^a-z0-9\x{80}-\x{10FFFF}]+', ' ', 'g')) s from piece
), near as (
  select doc_id, pos, s, len(string_split(s, ' ')) n,
    lead(s, 1) over w s1, lead(s, 2) over w s2, lead(s, 3) over w s3,
    lead(pos, 1) over w p1, lead(pos, 2) over w p2, lead(pos, 3) over w p3
  from sent where s <> '' window w as (partition by doc_id order by pos)
), span as (
  select doc_id, pos,
    case when n >= 25 then pos when p1 is not null and n + len(string_split(s1, ' ')) >= 12 then p1
         when p2 is not null and n + len(string_split(s1, ' ')) + len(string_split(s2, ' ')) >= 12 then p2
         when p3 is not null then p3 end last,
    case when n >= 25 then s when p1 is not null and n + len(string_split(s1, ' ')) >= 12 then s || '|' || s1
         when p2 is not null and n + len(string_split(s1, ' ')) + len(string_split(s2, ' ')) >= 12 then s || '|' || s1 || '|' || s2
         when p3 is not null then s || '|' || s1 || '|' || s2 || '|' || s3 end body
  from near
), later as (
  select doc_id, pos, last from (select *, rank() over (partition by body order by doc_id, pos) r from span where last is not null) where r > 1
), gone as (
  select distinct piece.doc_id, piece.pos from piece join later on piece.doc_id = later.doc_id and piece.pos between later.pos and later.last
), kept as (
  select piece.doc_id, string_agg(case when gone.pos is null then piece.piece else '' end, '' order by piece.pos) t, count(gone.pos) n
  from piece left join gone on piece.doc_id = gone.doc_id and piece.pos = gone.pos group by piece.doc_id
)
select d.doc_id, case when d.text is null then null else coalesce(k.t, d.text) end as text, cast(coalesce(k.n, 0) as integer) as n_removed
from documents d left join kept k on d.doc_id = k.doc_id
"""
