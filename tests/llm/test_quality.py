import math
import random

import brute
import pytest
from cairn.llm import quality
from pyspark.sql import functions as F

SCHEMA = "doc_id long, lang string, text string"


def made(n=120, seed=4):
    r = random.Random(seed)
    good = "the river runs under old stone bridges and people walk along its bank each évening".split()
    rows, labels = [], []
    for i in range(n):
        junk = i % 6 == 5
        t = "".join(r.choice("qxzjkv0#{}") for _ in range(80)) if junk else " ".join(r.choice(good) for _ in range(r.randrange(10, 40)))
        rows.append((i, "en" if i % 3 else "fr", t))
        if i % 2 or junk:
            labels.append((i, 0 if junk else 1, 1 if i == 7 else 0))
    return rows, labels


@pytest.fixture(scope="module")
def fixture(spark):
    rows, labels = made()
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_perplexity_equals_brute_force(spark, fixture):
    rows, docs, labels = fixture
    t = quality.trusted(docs, labels).collect()
    m, limits = quality.thresholds(docs, labels)
    limits = {r["_lang"]: r["threshold"] for r in limits.collect()}
    own = {r["doc_id"]: r["perplexity"] for r in quality.score(docs, m).collect()}
    sharded = {r["doc_id"]: r["perplexity"] for r in quality.score(docs, m, limit=0).collect()}
    for lang in ("en", "fr"):
        kn = brute.KneserNey([r["text"] for r in t if r["lang"] == lang and not r["held"]])
        for i, _, text in [x for x in rows if x[1] == lang]:
            assert own[i] == pytest.approx(kn.perplexity(text), rel=1e-6) and sharded[i] == pytest.approx(own[i], rel=1e-9)
        held = sorted(kn.perplexity(r["text"]) for r in t if r["lang"] == lang and r["held"])
        assert limits[lang] == pytest.approx(held[-1] * quality.SLACK, rel=1e-6)  # the 99 % quantile of few is the last
    assert {r["doc_id"] for r in quality.classify(docs, labels).collect()} == {i for i, lang, _ in rows if own[i] <= limits[lang]}


def test_probabilities_sum_to_one():
    kn = brute.KneserNey(["abracadabra", "banana bandana"], 3)
    assert sum(kn.p(b"an" + bytes([x])) for x in range(256)) == pytest.approx(1)


def test_separates_labelled_documents(spark, fixture):
    rows, docs, labels = fixture
    kept = {r["doc_id"] for r in quality.classify(docs, labels).collect()}
    assert not any(i in kept for i, _, _ in rows if i % 6 == 5)
    assert sum(i in kept for i, _, _ in rows if i % 6 != 5) >= 0.97 * sum(i % 6 != 5 for i, _, _ in rows)


def test_edge_rows(spark, fixture):
    _, docs, labels = fixture
    more = [(900, "en", None), (901, "en", ""), (None, "en", "the river runs under old bridges"), (902, None, "the river"), (903, "xx", "anything"), (904, "en", "the old river walk " * 20_000), (0, "fr", "the river runs")]
    every = docs.union(spark.createDataFrame(more, SCHEMA)).withColumn("perplexity", F.lit("p")).withColumn("_lang", F.lit(1)).withColumn("threshold", F.lit(2))
    got = [(r["doc_id"], r["perplexity"]) for r in quality.classify(every, labels).collect()]
    ids = [i for i, _ in got]
    assert 900 not in ids and 901 not in ids and None in ids and 902 in ids and (903, None) in got and 904 in ids and ids.count(0) == 2
    none = labels.limit(0)
    assert quality.classify(docs, none).count() == docs.count()
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_threshold_is_the_quantile(spark):
    rows, labels = made(4200)
    docs, labels = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    m, limits = quality.thresholds(docs, labels)
    held = quality.score(quality.trusted(docs, labels).filter("held").select("lang", "text"), m).collect()
    for r in limits.collect():
        p = sorted(h["perplexity"] for h in held if h["lang"] == r["_lang"])
        assert len(p) >= 100 and r["threshold"] == pytest.approx(p[math.ceil(0.99 * len(p)) - 1], rel=1e-9)
