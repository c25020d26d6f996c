"""Quality classifier: interpolated modified Kneser-Ney over byte n-grams of trusted text.

Training counts the byte 5-grams of every trusted labelled document (quality 1, not toxic) but for a
held-out fifth, one model per language (a language of two such documents or more has one on each side; of one, no threshold). Counts, continuation counts, context totals and the
interpolated probabilities are joins and aggregations of tables sharded by (language, code). A code
packs the bytes of an n-gram into a long, so a suffix is a mask, a context is a shift, and there are
no collisions. A document is rejected if its perplexity per byte exceeds its language's threshold,
the ``quantile`` of the held-out trusted documents' perplexities; too few of them to have one above
it (under 100 for 0.99) give their greatest times ``slack``.

Defined results: a null or empty text is rejected; a document of a language without trusted text
(or of null language, unless labelled) is kept with null perplexity; doc_id may be null or repeated, each row is judged
by itself; without labels everything that has a text is kept; an empty table gives an empty one; columns
named ``perplexity``, ``threshold`` or ``_lang`` give way to the results (the pipeline's stage keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm import kernel
from cairn.session import BROADCAST_BYTES, bounded, cut

ORDER = 5
HELD_OUT = 5
QUANTILE = 0.99
SLACK = 1.2
BLOCK_BYTES = 64 << 20


def codes(col: pa.Array, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Code of the ``order`` bytes that end at each byte of each text (zeros before its start), and
    the number of bytes of each text."""
    data, off = kernel.text_buffer(col, lower=False)
    pad = order - 1
    rows = len(off) - 1
    size = np.diff(off)
    spread = np.zeros(len(data) + pad * rows, np.uint64)
    at = np.arange(len(data)) + pad * np.repeat(np.arange(1, rows + 1), size)
    spread[at] = data
    out = np.zeros(len(data), np.uint64)
    for k in range(order):
        out |= spread[at - k] << np.uint64(8 * k)
    return out, size


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
    lang = pc.fill_null(batch.column("lang"), "")
    for x in pc.unique(lang).to_pylist():
        yield x, np.flatnonzero(np.asarray(pc.equal(lang, x)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of codes by language, combined over a partition before they are sent."""
    kept: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        code = np.concatenate([p[0] for p in parts])
        n = np.concatenate([p[1] for p in parts])
        order = np.argsort(code, kind="stable")
        code, n = code[order], n[order]
        first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, int)
        return code[first], np.add.reduceat(n, first) if len(first) else n[:0]

    for b in kernel.chunks(batches):
        for lang, rows in _by_lang(b):
            c, _ = codes(b.column("text").take(pa.array(rows)))
            c.sort()
            first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]]) if len(c) else np.zeros(0, int)
            parts = kept.setdefault(lang, [])
            parts.append((c[first], np.diff(np.r_[first, len(c)])))
            if len(parts) > 8:
                kept[lang] = [merged(parts)]
    for lang, parts in kept.items():
        c, n = merged(parts)
        for s in range(0, len(c), 1 << 17):
            x = c[s : s + (1 << 17)]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(x)), pa.array(x.astype(np.int64)), pa.array(n[s : s + (1 << 17)].astype(np.int64))], ["lang", "code", "n"])


def trusted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(lang, text, held): the trusted labelled documents; the label side is broadcast only if small."""
    good = labels.filter("quality = 1 and toxic = 0 and doc_id is not null").select("doc_id").distinct()
    if good.count() * 16 <= BROADCAST_BYTES:
        good = F.broadcast(good)
    some = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), "text").join(good, "doc_id", "left_semi")
    h = F.xxhash64("doc_id")
    held = F.pmod(h, F.lit(HELD_OUT)) == 0
    one = some.groupBy("lang").agg(F.min(h).alias("least"), F.max(h).alias("last"), F.bool_or(held).alias("any"), F.bool_and(held).alias("all"))
    one = bounded(cut(one.filter((F.col("any") == F.col("all")) & (F.col("least") < F.col("last"))).select("lang", "least")), 64)
    # a language of two documents or more has some on both sides
    return some.join(one, "lang", "left").select("lang", "text", F.when(h == F.col("least"), ~held).otherwise(held).alias("held"))


def _discounts(level: DataFrame) -> DataFrame:
    """Modified Kneser-Ney discounts of one order, by language, from its counts of counts."""
    n = [F.count(F.when(F.col("n") == k, 1)).cast("double") for k in (1, 2, 3, 4)]
    t = level.groupBy("lang").agg(*[x.alias(f"n{k + 1}") for k, x in enumerate(n)])
    y = F.when(F.col("n1") + F.col("n2") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.5)

    def d(k: int):
        a, b = F.col(f"n{k}"), F.col(f"n{k + 1}")
        return F.when((a > 0) & (b > 0), F.greatest(F.lit(0.05), F.least(F.lit(k - 0.05), k - (k + 1) * y * b / a))).otherwise(k * 0.5)

    return t.select("lang", d(1).alias("d1"), d(2).alias("d2"), d(3).alias("d3"))


def model(train: DataFrame) -> DataFrame:
    """(lang, k, code, p, gamma): of each n-gram of order k seen, its interpolated probability and,
    as a context, the weight that it leaves to the next lower order. Code of order 0: the empty context."""
    c5 = cut(train.select("lang", "text").mapInArrow(_count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")))
    levels = {ORDER: c5}
    for k in range(ORDER - 1, 0, -1):  # continuation counts: distinct left extensions
        levels[k] = levels[k + 1].groupBy("lang", F.col("code").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("code")).agg(F.count(F.lit(1)).alias("n"))
    lower = None
    probs, weights = [], []
    for k in range(1, ORDER + 1):
        t = levels[k].join(_discounts(levels[k]), "lang")
        of = Window.partitionBy("lang", "ctx")
        cut_off = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        t = t.withColumn("ctx", F.shiftright("code", 8)).withColumn("off", cut_off)
        t = t.withColumn("total", F.sum("n").over(of)).withColumn("gamma", F.sum("off").over(of) / F.col("total"))
        own = (F.col("n") - F.col("off")) / F.col("total")
        if lower is None:
            t = t.withColumn("p", own + F.col("gamma") / 256)
        else:
            t = t.withColumn("suffix", F.col("code").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1)))
            t = t.join(lower.select("lang", F.col("code").alias("suffix"), F.col("p").alias("q")), ["lang", "suffix"])
            t = t.withColumn("p", own + F.col("gamma") * F.col("q"))
        lower = cut(t.select("lang", "code", "ctx", "gamma", "p"))
        probs.append(lower.select("lang", F.lit(k).alias("k"), "code", "p"))
        weights.append(lower.groupBy("lang", F.lit(k - 1).alias("k"), F.col("ctx").alias("code")).agg(F.max("gamma").alias("gamma")))
    p, g = (reduce(DataFrame.unionByName, x) for x in (probs, weights))
    return p.join(g, ["lang", "k", "code"], "full")


class Table:
    """The model of one language as sorted arrays, for a whole table or for one block's codes."""

    def __init__(self, k: np.ndarray, code: np.ndarray, p: np.ndarray, gamma: np.ndarray):
        self.p, self.gamma = {}, {}
        for order in range(ORDER + 1):
            for into, value in ((self.p, p), (self.gamma, gamma)):
                at = np.flatnonzero((k == order) & ~np.isnan(value))
                at = at[np.argsort(code[at])]
                into[order] = (code[at], value[at])

    @staticmethod
    def find(table: tuple[np.ndarray, np.ndarray], codes_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, values = table
        if not len(keys):
            return np.zeros(len(codes_), bool), np.zeros(len(codes_))
        at = np.minimum(np.searchsorted(keys, codes_), len(keys) - 1)
        return keys[at] == codes_, values[at]

    def log2p(self, codes_: np.ndarray) -> np.ndarray:
        """Of distinct codes of the highest order: seen n-grams as stored, others by backing off."""
        weight = np.ones(len(codes_))
        out = np.zeros(len(codes_))
        left = np.arange(len(codes_))
        for k in range(ORDER, 0, -1):
            code = codes_[left] & ((1 << 8 * k) - 1)
            seen, p = self.find(self.p[k], code)
            out[left[seen]] = weight[left[seen]] * p[seen]
            left, code = left[~seen], code[~seen]
            known, gamma = self.find(self.gamma[k - 1], code >> 8)
            weight[left[known]] *= gamma[known]
        out[left] = weight[left] / 256
        return np.log2(out)


def _perplexity(col: pa.Array, t: Table) -> np.ndarray:
    c, size = codes(col)
    c = c.astype(np.int64)
    each = np.sort(c)
    each = each[np.r_[True, each[1:] != each[:-1]]] if len(each) else each
    bits = t.log2p(each)[np.searchsorted(each, c)]
    total = np.zeros(len(c) + 1)
    np.cumsum(bits, out=total[1:])
    ends = np.cumsum(size)
    with np.errstate(all="ignore"):
        return np.exp2(-(total[ends] - total[ends - size]) / size)


def _scores(b: pa.RecordBatch, tables: dict[str, Table]) -> np.ndarray:
    out = np.full(b.num_rows, np.nan)
    for lang, rows in _by_lang(b):
        if lang in tables:
            out[rows] = _perplexity(b.column("text").take(pa.array(rows)), tables[lang])
    return out


def _tables(rows: pa.Table) -> dict[str, Table]:
    lang = rows.column("lang")
    out = {}
    for x in pc.unique(lang).to_pylist():
        t = rows.filter(pc.equal(lang, x))
        num = lambda c, t=t: pc.fill_null(t.column(c).cast(pa.float64()), float("nan")).to_numpy()
        out[x] = Table(t.column("k").to_numpy(), t.column("code").to_numpy(), num("p"), num("gamma"))
    return out


def _with(b: pa.RecordBatch, ppl: np.ndarray, drop: tuple[str, ...]) -> pa.RecordBatch:
    keep = [c for c in b.schema.names if c not in drop]
    cols = [b.column(c) for c in keep]
    return pa.RecordBatch.from_arrays([*cols, pa.array(ppl, from_pandas=True)], [*keep, "perplexity"])


def _schema(df: DataFrame, drop: tuple[str, ...] = ()) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in drop) + ", perplexity double"


def score(docs: DataFrame, m: DataFrame, limit: int = BROADCAST_BYTES, drop: tuple[str, ...] = ()) -> DataFrame:
    """The rows of ``docs`` (less the columns in ``drop``) with their perplexity. A model up to
    ``limit`` bytes is broadcast; beyond that each block of documents is joined to the model on the
    codes that it holds. Both give the same numbers."""
    spark = docs.sparkSession
    m = cut(m.withColumn("lang", F.coalesce("lang", F.lit(""))))
    if m.count() * 32 <= limit:
        shared = spark.sparkContext.broadcast(m.toArrow())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables = _tables(shared.value)
            for b in kernel.chunks(batches):
                yield _with(b, _scores(b, tables), drop)

        return docs.mapInArrow(run, _schema(docs, drop))
    return _score_sharded(docs, m, drop)


def _score_sharded(docs: DataFrame, m: DataFrame, drop: tuple[str, ...]) -> DataFrame:
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = int(size // BLOCK_BYTES) + 1
    d = docs.withColumn("_block", F.pmod(F.xxhash64("text"), F.lit(blocks))).repartition("_block")

    def needed(key, t):
        out = []
        for b in t.to_batches():
            for lang, rows in _by_lang(b):
                c = np.unique(codes(b.column("text").take(pa.array(rows)))[0]).astype(np.int64)
                for k in range(ORDER + 1):
                    x = np.unique(c & ((1 << 8 * k) - 1))
                    y = np.unique(np.concatenate([x, (c & ((1 << 8 * (k + 1)) - 1)) >> 8])) if k < ORDER else x
                    out.append(pa.table({"_block": pa.array([key[0].as_py()] * len(y), pa.int64()), "lang": [lang] * len(y), "k": pa.array([k] * len(y), pa.int32()), "code": y}))
        empty = pa.table({"_block": pa.array([], pa.int64()), "lang": pa.array([], pa.string()), "k": pa.array([], pa.int32()), "code": pa.array([], pa.int64())})
        return pa.concat_tables([empty, *out])

    asked = d.select("_block", "lang", "text").groupBy("_block").applyInArrow(needed, "_block long, lang string, k int, code long").distinct()
    part = asked.join(m, ["lang", "k", "code"])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        tables = _tables(right)
        out = [_with(b, _scores(b, tables), (*drop, "_block")) for b in left.to_batches()]
        return pa.Table.from_batches(out)

    return d.groupBy("_block").cogroup(part.groupBy("_block")).applyInArrow(run, _schema(docs, drop))


def thresholds(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, slack: float = SLACK) -> tuple[DataFrame, DataFrame]:
    """(model, thresholds by language): the limit is what nearly all held-out trusted text meets."""
    good = trusted(docs, labels)
    m = cut(model(good.filter(~F.col("held"))))
    held = score(good.filter("held").select("lang", "text"), m, drop=("text",)).filter("perplexity is not null")
    few = F.when(F.count(F.lit(1)) * (1 - quantile) < 1, slack).otherwise(1.0)
    limits = held.groupBy(F.coalesce("lang", F.lit("")).alias("_lang")).agg((F.percentile_approx("perplexity", quantile, 100000) * few).alias("threshold"))
    return m, cut(limits)


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, slack: float = SLACK, drop: tuple[str, ...] = (), limit: int = BROADCAST_BYTES) -> DataFrame:
    """The accepted rows of ``docs`` with ``perplexity`` and ``threshold``."""
    kernel.frugal(docs.sparkSession)
    docs = kernel.without(docs, "perplexity", "threshold", "_lang", "_block")
    m, limits = thresholds(docs, labels, quantile, slack)
    some = docs.filter(F.octet_length("text") > 0)
    out = score(some, m, limit, drop).withColumn("_lang", F.coalesce("lang", F.lit("")))
    out = out.join(bounded(limits, 64), "_lang", "left").drop("_lang")
    return out.filter("threshold is null or perplexity is null or perplexity <= threshold")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    d, back = kernel.aside(docs, "perplexity", "threshold", "_lang", "_block")
    return back(classify(d, labels))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted documents of the whole table with their perplexity and their language's threshold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    return classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), drop=("text",)).select("doc_id", "lang", "perplexity", "threshold")
