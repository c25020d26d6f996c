import random

import brute
from cairn.llm import spans
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def made(n=60, seed=1):
    r = random.Random(seed)
    word = lambda: r.choice("alpha beta gamma delta öl zeta eta theta iota kappa".split()) + str(r.randrange(40))
    sent = lambda: " ".join(word() for _ in range(r.randrange(1, 34))) + r.choice([".", "!", "?\n", "...  ", "\n"])
    pool = [" ".join(sent() for _ in range(r.randrange(2, 6))) for _ in range(8)]
    return [(i, " ".join(r.choice(pool) if r.random() < 0.3 else sent() for _ in range(r.randrange(1, 12)))) for i in range(n)]


def test_equals_brute_force(spark):
    docs = made()
    docs += [(100 + i, t) for i, t in docs[:5]]  # whole copies
    want = brute.dedup_spans(docs)
    df = spark.createDataFrame([(i, t, None, None, len(t)) for i, t in docs], SCHEMA).repartition(5)
    for limit in (64 << 20, 0):  # by broadcast and by shuffle
        got = {r["doc_id"]: (r["text"], r["_removed"]) for r in spans.dedup(df, limit).collect()}
        assert got == want
    assert sum(n for _, n in want.values()) > 20


def test_edge_rows(spark):
    passage = "One two three four five six seven. Eight nine ten eleven twelve thirteen fourteen."
    long = "word " * 50_000 + "."
    rows = [(None, passage), (1, None), (2, ""), (3, passage), (4, passage), (4, passage), (5, long), (6, long), (7, "...!!\n"), (8, passage + " " + passage)]
    df = spark.createDataFrame([(i, t, None, None, 7) for i, t in rows], SCHEMA).withColumn("_id", F.lit("x")).withColumn("Cuts", F.lit(1)).withColumn("_removed", F.lit(2))
    got = [(r["doc_id"], r["text"], r["_removed"]) for r in spans.dedup(df).collect()]
    by = {}
    for i, t, n in got:
        by.setdefault(i, []).append((t, n))
    assert by[None] == [(passage, 0)] and by[1] == [(None, 0)] and by[2] == [("", 0)] and by[3] == [(passage, 0)]
    assert by[4] == [("", 2), ("", 2)]
    assert by[5] == [(long, 0)] and by[6] == [("", 1)] and by[7] == [("...!!\n", 0)]
    assert by[8] == [("", 4)]
    kept = spans.stage(spark, df, "").collect()
    assert df.columns == spans.stage(spark, df, "").columns and all(r["_id"] == "x" and r["Cuts"] == 1 for r in kept)
    assert sorted(str(r["doc_id"]) for r in kept) == sorted(["None", "1", "2", "3", "5", "7"])
    assert spans.dedup(df.limit(0)).count() == 0


def test_passage_in_other_text(spark):
    """A passage of over 50 words is in one document only afterwards, wherever it stood."""
    r = random.Random(3)
    w = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    passage = f"{w(20)}. {w(18)}. {w(22)}."
    docs = [(i, f"{w(30)}. {w(9)}. {passage} {w(12)}. {w(5)}", None, None, 0) for i in range(50)]
    out = spans.dedup(spark.createDataFrame(docs, SCHEMA)).collect()
    assert sum(passage in r["text"] for r in out) == 1
    assert all(len(r["text"].split()) == 56 for r in out if passage not in r["text"])
