import math
import random

import duckdb
import pytest
from cairn.llm import mixture
from pyspark.sql import functions as F

SCHEMA = "doc_id long, source string, text string"


def made():
    rows = [(i, "big", "w " * (1 + i % 40)) for i in range(3000)] + [(5000 + i, "mid", "w " * 30) for i in range(300)] + [(9000 + i, "tiny", "w " * 20) for i in range(20)]
    return rows


def test_quotas_and_repeats(spark):
    docs = spark.createDataFrame(made(), SCHEMA)
    tokens = {r["source"]: r["n"] for r in docs.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(r"\S+"))).alias("n")).collect()}
    budget = math.floor(sum(tokens.values()) * mixture.BUDGET_SHARE)
    w = mixture.weights(tokens, mixture.exponent(tokens, budget))
    got = {r["source"]: (r["n"], r["p"], r["most"]) for r in mixture.mix(docs, block_tokens=500).groupBy("source").agg(F.sum("tokens").alias("n"), F.max("pass").alias("p"), F.max("tokens").alias("most")).collect()}
    for k, (n, passes, most) in got.items():
        assert w[k] * budget - passes * most - 1 <= n <= w[k] * budget + 1
        assert n <= mixture.REPEATS * tokens[k] + 1
    once = mixture.mix(docs, block_tokens=500).filter("source = 'tiny' and pass = 1")
    assert once.count() == once.select("doc_id").distinct().count() == 20


def test_many_sources_are_bisected_by_aggregation(spark):
    r = random.Random(2)
    rows = [(i, f"s{i % 40}", "w " * (1 + (i % 40) ** 2 // 20 + r.randrange(3))) for i in range(2000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for entropy, repeats in ((0.9, 1e9), (0.999, 1.5), (0.1, 4.0), (0.97, 1.0)):
        few, many = (sorted(map(tuple, mixture.mix(docs, entropy=entropy, repeats=repeats, driver_sources=n).collect())) for n in (10**6, 0))
        assert few == many and few


def test_registered_query_bisects_and_passes_again(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    tokens = {r["source"]: r["n"] for r in docs.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(r"\S+"))).alias("n")).collect()}
    assert 0 < mixture.exponent(tokens, math.floor(sum(tokens.values()) * mixture.BUDGET_SHARE)) < 1
    assert mixture.mix(docs).agg(F.max("pass")).first()[0] >= 2


def test_exponent_meets_its_limits():
    t = {"a": 10_000, "b": 500, "c": 10}
    h = lambda a: -sum(x * math.log(x) for x in mixture.weights(t, a).values()) / math.log(3)
    a = mixture.exponent(t, 1, entropy=0.9, repeats=1e9)
    assert h(a) == pytest.approx(0.9, abs=1e-6)
    b = mixture.exponent(t, 10_510, entropy=1.0, repeats=4)
    assert mixture.weights(t, b)["c"] * 10_510 <= 40.0001 and b > a
    assert mixture.exponent({"a": 5}, 5) == 1.0 and mixture.exponent({"a": 5, "b": 5}, 10) == 1.0


def test_equals_sql_on_edge_rows(spark):
    rows = made()[::7] + [(None, "big", "w w"), (1, None, "w w"), (2, "", "w"), (3, "big", None), (4, "big", " \n"), (5, "big", "w w"), (5, "big", "w w"), (6, "big", "w " * 100_000)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("tokens", F.lit("t")).withColumn("pass", F.lit(1)).withColumn("n", F.lit(1))
    got = sorted(tuple(r) for r in mixture.mix(docs).collect())
    db = duckdb.connect()
    documents = docs.select("doc_id", "source", "text").toPandas().astype({"doc_id": "Int64"})  # noqa: F841  read by the query
    want = sorted(db.execute(mixture.SQL).fetchall())
    assert set(got) - set(want) == set() == set(want) - set(got) and got == want and len(got) > 100
    assert mixture.mix(docs.limit(0)).count() == 0
