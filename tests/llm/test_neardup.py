import random

import brute
import numpy as np
from cairn.llm import graph, neardup
from pyspark.sql import functions as F


def made(seed=2):
    r = random.Random(seed)
    w = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 7)))
    docs, i = [], 0
    for group in range(60):
        base = [w() for _ in range(r.randrange(30, 200))]
        for copy in range(r.choice([1, 1, 2, 3, 6])):
            t = list(base)
            for _ in range(int(len(t) * r.choice([0, 0, 0.02, 0.05])) if copy else 0):
                t[r.randrange(len(t))] = w()
            docs.append((i, " ".join(t)))
            i += 1
    r.shuffle(docs)
    return docs


def keeps(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    return {r["doc_id"]: r["keep"] for r in neardup.groups(df).collect()}


def test_groups_equal_brute_force(spark):
    docs = made()
    pairs = brute.near_pairs(docs)
    got = keeps(spark, docs)
    found = sum(got.get(a, a) == got.get(b, b) for a, b in pairs)
    assert len(pairs) > 50 and found / len(pairs) >= 0.98
    want = brute.roots(pairs)
    assert all(want.get(a) == want.get(k) for a, k in got.items())  # no group that isn't one


def test_recall_on_table(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").filter("text is not null").collect()]
    pairs = brute.near_pairs(docs)
    got = keeps(spark, docs)
    assert pairs and sum(got.get(a, a) == got.get(b, b) for a, b in pairs) / len(pairs) >= 0.98


def test_edge_rows(spark):
    long = " ".join(f"w{k}" for k in range(60_000))
    rows = [(None, "a b c d"), (1, None), (2, ""), (3, "..."), (4, "Hello"), (5, "hello!"), (6, "a b c d"), (7, "A b, c d"), (7, "A b, c d"), (8, long), (9, long + " end"), (10, "hello you")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("keep", F.lit("k")).withColumn("count", F.lit(5)).withColumn("a", F.lit(1))
    assert {r["doc_id"]: r["keep"] for r in neardup.groups(df).collect()} == {4: 4, 5: 4, 6: 6, 7: 6, 8: 8, 9: 8}
    left = neardup.stage(spark, df, "")
    assert left.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == sorted(["None", "1", "2", "3", "4", "6", "8", "10"])
    same = spark.createDataFrame([(1, "x y z q"), (1, "x y z q"), (1, "other words here now")], "doc_id long, text string")
    assert neardup.stage(spark, same, "").count() == 2
    assert neardup.groups(df.limit(0)).count() == 0


def test_graph_recall_and_ties():
    r = np.random.default_rng(0)
    centre = r.integers(0, 1 << 63, (150, 2), np.uint64)
    codes = np.repeat(centre, 20, axis=0)
    for k in range(len(codes)):
        for bit in r.integers(0, 128, r.integers(0, 7)):
            codes[k, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    codes = np.concatenate([codes, np.repeat(codes[:1], 600, axis=0)])  # many equal codes
    n = len(codes)
    found = np.unique(np.concatenate([i * n + j for i, j in graph.neighbours(codes, 24)]))
    i, j = graph.exact(codes, np.arange(n), 24)
    truth = i * n + j
    assert np.isin(truth, found).mean() >= 0.9 and np.isin(found, truth).all()


def edited(r, base, changes):
    t = list(base)
    for k in r.sample(range(len(t)), changes):
        t[k] = f"x{r.randrange(10**9)}"
    return " ".join(t)


def test_copies_of_a_base_that_are_far_from_each_other(spark):
    r = random.Random(7)
    base = [f"w{r.randrange(10**6)}" for _ in range(120)]
    docs = [(0, " ".join(base))] + [(k, edited(r, base, 8)) for k in range(1, 1001)]
    sets = [brute.shingles(t) for _, t in docs]
    to_base = [len(s & sets[0]) / len(s | sets[0]) for s in sets[1:]]
    assert min(to_base) >= 0.6
    got = keeps(spark, docs)
    assert sum(got.get(k) == 0 for k in range(1, 1001)) >= 980


def test_pairs_near_the_limit(spark):
    r = random.Random(11)
    docs = []
    while len(docs) < 800:
        base = [f"w{r.randrange(10**6)}" for _ in range(r.randrange(60, 150))]
        copy = edited(r, base, len(base) // 9)
        a, b = brute.shingles(" ".join(base)), brute.shingles(copy)
        if 0.5 <= len(a & b) / len(a | b) < 0.55:
            docs += [(len(docs), " ".join(base)), (len(docs) + 1, copy)]
    got = keeps(spark, docs)
    found = sum(got.get(k + 1) == k for k in range(0, 800, 2)) / 400
    print("found", found)
    assert found >= 0.94


def hot_documents(r, n):
    """Documents that begin with one boilerplate of a third of their length; a tenth of them are copies with a few words changed."""
    plate = [f"p{k}" for k in range(30)]
    docs, pairs = [], []
    while len(docs) < n:
        own = [f"w{r.randrange(10**7)}" for _ in range(60)]
        docs.append((len(docs), " ".join(plate + own)))
        if r.random() < 0.1:
            own = list(own)
            for k in r.sample(range(60), 4):
                own[k] = f"x{r.randrange(10**7)}"
            pairs.append((len(docs) - 1, len(docs)))
            docs.append((len(docs), " ".join(plate + own)))
    return docs, pairs


def test_hot_minima_are_split(spark):
    docs, pairs = hot_documents(random.Random(3), 2500)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    nodes = df.mapInArrow(neardup._fingerprint, neardup.FINGERPRINT).cache()
    for size, levels, most in ((400, 3, 2000), (400, 0, 800)):  # by further minima, and by pairs of halves
        member, _ = neardup.shards(nodes, size, levels)
        assert member.groupBy("shard").count().agg(F.max("count")).first()[0] <= most
        got = {(x["a"], x["b"]) for x in neardup.candidate_pairs(nodes, 2.0, size, levels).collect()}
        assert sum(p in got for p in pairs) >= 0.98 * len(pairs), (size, levels)


def test_recall_where_shards_are_graphs(spark):
    """Over 512 nodes a shard: the graph, not exact search, finds the pairs."""
    r = random.Random(12)
    docs, pairs = [], []
    for _ in range(2500):
        base = [f"w{r.randrange(10**6)}" for _ in range(r.randrange(40, 100))]
        pairs.append((len(docs), len(docs) + 1))
        docs += [(len(docs), " ".join(base)), (len(docs) + 1, edited(r, base, len(base) // 20))]
    nodes = spark.createDataFrame(docs, "doc_id long, text string").repartition(4).mapInArrow(neardup._fingerprint, neardup.FINGERPRINT).cache()
    member, _ = neardup.shards(nodes, 4000)
    assert member.groupBy("shard").count().agg(F.min("count")).first()[0] > 512
    got = {(x["a"], x["b"]) for x in neardup.candidate_pairs(nodes, 2.0, 4000).collect()}
    assert sum(p in got for p in pairs) >= 0.98 * len(pairs)
