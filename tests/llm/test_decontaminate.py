import random

import brute
import numpy as np
from cairn.llm import decontaminate as d
from pyspark.sql import functions as F

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def test_alignment():
    r = np.random.default_rng(1)
    for _ in range(100):
        a, b = (r.integers(0, 5, r.integers(1, 15)).astype(np.uint64) for _ in range(2))
        assert d.align(a, b) == brute.align(a.tolist(), b.tolist())


def test_leaks_equal_brute_force(spark):
    r = random.Random(5)
    vocabulary = [f"v{k}" for k in range(2000)]
    w = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(k, w(r.randrange(8, 40))) for k in range(30)]
    docs = []
    for i in range(80):
        text = w(r.randrange(20, 120))
        if i % 2:
            part = list(r.choice(items)[1])
            for _ in range(len(part) // 10):  # edited: words replaced, dropped, added
                at = r.randrange(len(part))
                part[at : at + 1] = r.choice([[], w(1), [part[at], *w(1)]])
            text[10:10] = part
        docs.append((i, " ".join(text)))
    items = [(k, " ".join(t).title() + "?") for k, t in items]
    want = brute.leaks(docs, items)
    ds, bs = spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS)
    got = {(x["doc_id"], x["item_id"]): x["score"] for x in d.leaks(ds, bs).collect()}
    assert set(got) <= set(want) and len(set(got) & set(want)) >= 0.95 * len(want) and len(want) >= 40
    assert all(got[k] <= want[k] + 1e-9 for k in got)
    parts = {(x["doc_id"], x["item_id"]): x["score"] for x in d.leaks(ds, bs, part_words=100).collect()}
    assert set(parts) == set(got)  # a large benchmark takes several passes


def test_seeds_do_not_depend_on_the_corpus_size():
    r = np.random.default_rng(4)
    known = np.sort(r.integers(0, 1 << 63, 500).astype(np.uint64))
    n = r.integers(1, 1000, 500)
    items = [known[r.integers(0, 500, k)] for k in (4, 9, 30, 80)]
    one, many = (d.Seeds(np.arange(4), items, known, n * k, int(n.sum()) * 10 * k) for k in (1, 100_000))
    assert (one.hash == many.hash).all() and (one.pos == many.pos).all() and len(one.hash) < sum(map(len, items))


def test_edited_copies_are_found_among_common_words(spark):
    """Recall of copies with a sixth of the words changed, where the corpus is full of the items' words."""
    r = random.Random(8)
    vocabulary = [f"v{k}" for k in range(400)]
    w = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(k, w(r.randrange(20, 60))) for k in range(100)]
    docs = [(1000 + i, " ".join(w(400))) for i in range(300)]
    for k, t in items:
        t = list(t)
        for at in r.sample(range(len(t)), len(t) // 6):
            t[at] = r.choice(vocabulary)
        docs.append((k, " ".join(w(50) + t + w(50))))
    got = {(x["doc_id"], x["item_id"]) for x in d.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(k, " ".join(t)) for k, t in items], ITEMS)).collect()}
    assert sum((k, k) in got for k in range(100)) >= 99 and not any(i >= 1000 for i, _ in got)


def test_edge_rows(spark):
    q = "what is the capital of the small green island"
    docs = [(None, q), (1, None), (2, ""), (3, q), (3, q), (4, "so: What is the CAPITAL of the small, green island! " + "and more " * 30_000), (5, "nothing of it")]
    items = [(None, q), (1, None), (2, "..."), (3, q), (3, q), (4, q), (5, "yes")]
    ds = spark.createDataFrame(docs, DOCS).withColumn("item_id", F.lit(9)).withColumn("score", F.lit("s"))
    bs = spark.createDataFrame(items, ITEMS).withColumn("words", F.lit(1)).withColumn("doc_id", F.lit(1))
    got = sorted((x["doc_id"], x["item_id"], x["score"]) for x in d.leaks(ds, bs).collect())
    assert got == [(3, 3, 1.0), (3, 4, 1.0), (4, 3, 1.0), (4, 4, 1.0)]
    assert d.leaks(ds.limit(0), bs).count() == 0 and d.leaks(ds, bs.limit(0)).count() == 0


def test_stage_drops_leaking_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    left = d.stage(spark, docs, sf)
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    bad = {i for i, _ in brute.leaks([tuple(r) for r in left.select("doc_id", "text").collect() if len(r["text"] or "") < 3000], items[:10])}
    assert left.columns == docs.columns and not bad and left.count() < docs.count()
