"""The pipeline against the brute-force operators in a row."""

import random
from pathlib import Path

import brute
import corpus_pipeline
import duckdb
from cairn.llm import mixture, quality
from cairn.llm.queries import QUERIES, SQL
from cairn.session import shared_dir


def test_run_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = {r["doc_id"]: r.asDict() for r in docs.collect()}
    trusted = quality.trusted(docs, labels).collect()
    kn = {x: brute.KneserNey([r["text"] for r in trusted if r["lang"] == x and not r["held"]]) for x in {r["lang"] for r in trusted}}
    limit = {}
    for x in kn:
        held = sorted(kn[x].perplexity(r["text"]) for r in trusted if r["lang"] == x and r["held"])
        if held:
            limit[x] = held[-1] * quality.SLACK  # the 99 % quantile of fewer than 100 is the greatest
    rows = {i: r for i, r in rows.items() if r["text"] and (r["lang"] not in limit or kn[r["lang"]].perplexity(r["text"]) <= limit[r["lang"]])}
    root = brute.roots(brute.near_pairs([(i, r["text"]) for i, r in rows.items()]))
    rows = {i: r for i, r in rows.items() if root.get(i, i) == i}
    for i, (text, n) in brute.dedup_spans([(i, r["text"]) for i, r in rows.items()]).items():
        rows[i] = rows[i] | {"text": text} if text.strip() or not n else None
    rows = {i: r for i, r in rows.items() if r}
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    grams = lambda t: {tuple(w[k : k + 2]) for w in [brute.words(t)] for k in range(len(w) - 1)}
    some = [(i, r["text"]) for i, r in rows.items()]
    near = [(i, t, [q for q in items if len(grams(q[1]) & grams(t)) >= 0.2 * len(grams(q[1]))]) for i, t in some]
    bad = {i for i, t, qs in near for q in qs if brute.leaks([(i, t)], [q])}
    db = duckdb.connect()
    db.execute("create table documents (doc_id bigint, source varchar, text varchar)")
    db.executemany("insert into documents values (?, ?, ?)", [(i, r["source"], r["text"]) for i, r in rows.items() if i not in bad])
    want = sorted(db.execute(mixture.SQL).fetchall())
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, sf).collect())
    assert got == want and len(got) > 100


EDGE = "doc_id long, text string, lang string, source string, n_chars long, perplexity string, threshold int, _lang int, cuts int, _id string, keep int, score int, item_id long, tokens string, pass int, block int"


def edge_rows(n):
    r = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    say = lambda k: " ".join(r.choice(words) for _ in range(k)) + "."
    rows = [(i, say(40), "en", f"s{i % 3}", 1) for i in range(n)]
    rows += [(None, say(40), "en", "s1", 1), (900, None, "en", "s1", None), (901, "", None, None, 0), (902, say(30), None, None, 1), (903, say(60_000), "en", "s2", 1), (0, *rows[0][1:]), (904, rows[1][1], "en", "s0", 1), (905, "...", "en", "s0", 3), (906, say(20), "xx", "s9", 1)]
    return [(*x, "p", 1, 2, 3, "i", 4, 5, 6, "t", 7, 8) for x in rows]


def test_edge_rows_through_all_stages(spark, sf, tmp_path):
    rows = edge_rows(60)
    labels = [(i, 1, 0) for i in range(40)] + [(None, 1, 0), (3, None, None)]
    for name, rows_ in (("some", rows), ("none", [])):
        d = tmp_path / name
        spark.createDataFrame(rows_, EDGE).write.parquet(str(d / "documents.parquet"))
        spark.createDataFrame(labels if rows_ else [], "doc_id long, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
        items = [(1, rows[5][1][:120]), (None, "x y z w v"), (2, None)] if rows_ else []
        spark.createDataFrame(items, "item_id long, text string").write.parquet(str(d / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    got = corpus_pipeline.run(spark, str(tmp_path / "some"))
    ids = {r["doc_id"] for r in got.collect()}
    assert got.columns == ["doc_id", "source", "tokens", "pass", "place"]
    assert {0, 1, 902, 903, 906} <= ids and not ids & {None, 5, 900, 901, 904}
    folders = list(Path(shared_dir(spark)).glob("pipeline-*/*"))
    assert all(f.name == "4-mixture" for f in folders)
    docs = spark.read.parquet(str(tmp_path / "some" / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path / "some"))
        assert out.columns == docs.columns and any(r["doc_id"] is None for r in out.collect()), name


def test_stages_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes), name
        assert out.count() <= before
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "neardup", "spans", "decontaminate", "mixture"]


def test_every_operator_is_registered():
    assert [q.split("_")[0] for q in QUERIES] == [f"op{n}" for n in range(1, 11)] and set(SQL) <= set(QUERIES)
