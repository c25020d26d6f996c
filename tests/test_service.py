"""Sources, sinks, deliverables, outside checks, pacing and the tool loop."""

import json

import pytest
from cairn.functions import geo as G
from cairn.functions.register import register, views
from cairn.operators import federated, registry, resolve, review
from cairn.plans import agent, batch
from cairn.sources import readers, sinks
from cairn.streaming.pacing import KeyPool, TokenBucket
from pyspark.sql import functions as F

RECORDS = "record_id long, source string, display_name string, name_key string, ci string, age string, status string, origin string, hospital string"


def records(spark):
    row = lambda i, src, name, ci="", st="localizado", h="H1": (i, src, name, " ".join(sorted(name.split())), ci, "", st, "", h)
    return spark.createDataFrame([row(1, "a", "ANA MORA PAZ PAZ", "12345678", "fallecido"), row(2, "b", "ANA MORA PAZ", "12345678", h="H2"), row(3, "a", "EVA LUNA SOL", "22222222"), row(4, "b", "EVA LUNA SOLL", "33333333"), row(5, "a", "TEO RIO MAR"), row(6, "a", "TEO RIO MAR")], RECORDS)


def test_batch_deliverables(spark, tmp_path):
    out = batch.build(records(spark))
    batch.write(out, str(tmp_path))
    people = {r["person_id"]: r for r in spark.read.json(str(tmp_path / "persons")).collect()}
    assert sorted(people) == ["P00001", "P00002", "P00003", "P00004"] and people["P00001"]["display_name"] == "ANA MORA PAZ" and people["P00001"]["n_records"] == 2
    back = {r["record_id"]: r["person_id"] for r in spark.read.csv(str(tmp_path / "records"), header=True).collect()}
    assert back["1"] == back["2"] == "P00001" and len(back) == 6
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "review")).collect()]
    counts = json.loads(next(x for x in lines if x.startswith("1 counts")).partition(": ")[2])
    assert counts == {"entities": 4, "cross_source": 1, "several_hospitals": 1, "ci_conflict": 0, "deceased": 1, "name_only": 1, "possible_same": 1, "possible_same_different": 1, "records": 6}
    assert sum(x.startswith("3 different numbers") and "EVA LUNA SOL" in x and "diff" in x for x in lines) == 1
    assert sum(x.startswith("6 deceased") for x in lines) == sum(x.startswith("5 several") for x in lines) == sum(x.startswith("7 name_only") for x in lines) == 1
    docs = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "search")).collect()]
    assert {d["id"] for d in docs} == set(people) and docs[0]["ap"]
    page = "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "page"), wholetext=True).collect())
    assert page.startswith("<!doctype html>") and page.count('"id":"P0000') == 4 and page.rstrip().endswith("</script>")


def test_sinks(spark, tmp_path):
    kpis = registry.kpis(resolve.summarize(records(spark), resolve.resolve(records(spark))), records(spark), records(spark))
    for k in (1, 2):
        sinks.append_metrics(kpis, str(tmp_path / "m"), 1.5, k, "note")
    m = spark.read.parquet(str(tmp_path / "m")).orderBy("changed").collect()
    assert [(r["changed"], r["persons"], r["records"], r["seconds"]) for r in m] == [(1, 4, 6, 1.5), (2, 4, 6, 1.5)]
    requests = spark.createDataFrame([("2024-01-01 00:00:00", "1.1.1.1", "2.2.2.2, 3.3.3.3", "4.4.4.4", "/a", 200), ("2024-01-01 00:00:01", "", " 2.2.2.2 , 3.3.3.3", "4.4.4.4", "/b", 404), ("2024-01-01 00:00:02", None, None, "4.4.4.4", "/c", 200)], "t string, real_ip string, forwarded string, peer string, path string, status int").withColumn("ts", F.col("t").cast("timestamp"))
    requests.write.parquet(str(tmp_path / "req"))
    sinks.audit_stream(spark.readStream.schema(requests.schema).parquet(str(tmp_path / "req")), str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination(60)
    assert sorted(r["value"].split("\t")[1:] for r in spark.read.text(str(tmp_path / "log")).collect()) == [["1.1.1.1", "/a", "200"], ["2.2.2.2", "/b", "404"], ["4.4.4.4", "/c", "200"]]
    assert sinks.seed(spark, str(tmp_path / "m"), f"file://{tmp_path}/copy") and not sinks.seed(spark, str(tmp_path / "m"), str(tmp_path / "copy")) and spark.read.parquet(str(tmp_path / "copy")).count() == 2
    made = []
    for now in (None, None, 4e9):
        assert sinks.cached(spark, str(tmp_path / "agg"), lambda: made.append(1) or spark.range(len(made)), 120, now).count() == len(made)
    assert len(made) == 2


def test_source_registry(spark, tmp_path):
    (tmp_path / "s.yaml").write_text("# list\nsources:\n  - id: one\n    kind: web   # a page\n    urls: [http://a/x, http://b/y]\n    cadence_min: 60\n    enabled: false\n  - id: two\n    statuses:\n      - buscando\n      - alta\n    notes: \"a: b\"\n    path: 'p # q'\n")
    got = [r.asDict() for r in readers.read_sources(spark, f"file://{tmp_path}/s.yaml").collect()]
    assert [(r["id"], r["kind"], r["urls"], r["statuses"], r["cadence_min"], r["enabled"], r["notes"], r["path"]) for r in got] == [("one", "web", ["http://a/x", "http://b/y"], None, 60, False, None, None), ("two", None, None, ["buscando", "alta"], None, True, "a: b", "p # q")]
    (tmp_path / "s.json").write_text(json.dumps({"sources": [{"id": "x", "urls": "http://z"}]}))
    assert readers.read_sources(spark, str(tmp_path / "s.json")).first()["urls"] == ["http://z"] and readers.read_sources(spark, str(tmp_path / "none")).count() == 0
    files = spark.createDataFrame([("one", "/a/x.pdf", "2024-01-01 00:00:00.9"), ("one", "/a/y.pdf", "2024-01-02 00:00:00")], "id string, path string, t string").withColumn("modified", F.col("t").cast("timestamp"))
    h = registry.content_hash(files).first()["hash"]
    assert h == registry.content_hash(files.withColumn("modified", F.date_trunc("second", "modified"))).first()["hash"] != registry.content_hash(files.limit(1)).first()["hash"]


def test_federated_check(spark):
    wanted = spark.createDataFrame([("12.345.678", ""), ("", "Ana Mora"), ("", "Ana"), ("12345678", "")], "ci string, name string")
    sources = spark.createDataFrame([("s1", True), ("s2", True), ("off", False)], "id string, enabled boolean")
    ledger = spark.createDataFrame([("s2", "nm:ANA MORA", "2024-01-01 00:00:00")], "source string, identity string, t string").withColumn("checked_at", F.col("t").cast("timestamp"))

    def search(source, q):
        if source == "s2":
            raise OSError("down")
        if q == "12.345.678":
            yield {"nombre": "Luis Mora", "ci": "12.345.678", "edad": "30", "estado": "Buscando", "lugar": "Catia"}
            yield {"nombre": " ", "ci": "1"}
        if q == "Ana Mora":
            yield {"nombre": "Ana Mora"}

    now = F.lit("2024-01-01 00:10:00").cast("timestamp")
    rows, log, new = federated.check(wanted, sources, ledger, now, search)
    assert sorted((r["source"], r["full_name"], r["ci"], r["status"]) for r in rows.collect()) == [("s1", "ANA MORA", "", "por_localizar"), ("s1", "LUIS MORA", "12345678", "por_localizar")]
    assert sorted(map(tuple, log.collect())) == [("s1", "ci:12345678", "checked", 2, "12.345.678"), ("s1", "nm:ANA MORA", "checked", 1, "Ana Mora"), ("s2", "ci:12345678", "failed", 0, None), ("s2", "nm:ANA MORA", "throttled", 0, None)]
    assert sorted((r["source"], r["identity"]) for r in new.collect()) == [("s1", "ci:12345678"), ("s1", "nm:ANA MORA")]


def test_pages_behind_centers(spark):
    c = spark.createDataFrame([("s", "http://a"), ("s", "http://a"), (None, "http://b"), ("s", ""), ("s", None)], "source string, url string")
    ledger = spark.createDataFrame([("page", "http://a", "2024-01-01 00:00:00")], "source string, identity string, t string").withColumn("checked_at", F.col("t").cast("timestamp"))
    assert sorted(map(tuple, federated.source_pages(c).collect())) == [("http://a", "s"), ("http://b", "")]
    at = lambda t: {r["url"] for r in federated.due_pages(c, ledger, F.lit(t).cast("timestamp")).collect()}
    assert at("2024-01-01 02:59:00") == {"http://b"} and at("2024-01-01 03:01:00") == {"http://a", "http://b"}


def test_sql_surface(spark):
    register(spark)
    persons = resolve.summarize(records(spark), resolve.resolve(records(spark)))
    views(persons, records(spark))
    assert spark.sql("select count(*) from person_ci where ci = '12345678'").first()[0] == 1
    assert spark.sql("select count(*) from persons where name_key like concat('%', name_key('de la Mora'), '%')").first()[0] == 1
    assert spark.sql("select seq_ratio('ABCD', 'BCDE') r").first()[0] == pytest.approx(0.75)
    assert [r[0] for r in spark.sql("select variant from name_spellings('Ana Hilda Oca')").collect()] == ["Ana Hilda Oca", "Ana Oca Hilda", "Ana ilda Oca", "Ana Hilda hOca"]


def test_map_expressions(spark):
    r = spark.range(1).select(G.damage_height(F.lit(0.5)), G.zone_radius(F.lit(100)), G.zone_radius(F.lit(10_000)), G.jitter(F.lit(10.0), F.lit("k"), 0.006), G.jitter(F.lit(10.0), F.lit("k"), 0.006)).first()
    assert r[0] == 19.0 and r[1] == 24.0 and r[2] == 38.0 and r[3] == r[4] and abs(r[3] - 10) <= 0.006


def test_footprints(spark):
    shape = {"features": [{"geometry": {"coordinates": [[[-66.0, 10.0], [-66.0, 10.2], [-66.2, 10.2], [-66.2, 10.0]]]}}, {"geometry": {"coordinates": [-67, 11]}}]}
    from cairn.operators.geo import footprint_centroids

    got = sorted((round(r["lat"], 6), round(r["lng"], 6)) for r in footprint_centroids(spark.createDataFrame([(json.dumps(shape),), ("{broken",)], "json string")).collect())
    assert got == [(10.1, -66.1), (11.0, -67.0)]


def test_samples_repeat(spark):
    s = lambda: [r["id"] for r in registry.sample_rows(spark.range(1000), "id", 20).collect()]
    assert s() == s() and len(set(s())) == 20


def test_pacing():
    now = [0.0]
    slept = []
    bucket = TokenBucket(60, lambda: now[0], lambda s: (slept.append(s), now.__setitem__(0, now[0] + s)))
    assert bucket.acquire(60) == 0 and bucket.acquire(30) == pytest.approx(30) and bucket.acquire(1000) == pytest.approx(60)

    class Refused(Exception):
        pass

    used = []

    def send(key):
        used.append(key)
        if key == "a":
            raise Refused
        return key

    pool = KeyPool(["a", "b"], 30, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))
    assert pool.call(send, Refused) == "b" and pool.call(send, Refused) == "b" and used == ["a", "b", "b"]
    now[0] += 60
    assert [pool.key(), pool.key()] == ["a", "b"]
    with pytest.raises(Refused):
        KeyPool(["a"], 30, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s)).call(send, Refused)


def test_tool_loop(spark):
    tools = {"count": lambda n: spark.range(n)}
    script = iter([("count", {"n": 3}), ("other", {}), ("count", {"n": "x"}), ("finish", {"answer": "3"})])
    answer, steps = agent.run("how many", tools, lambda q, done: next(script))
    assert answer == "3" and [len(s.rows) for s in steps] == [3, 0, 0] and [bool(s.error) for s in steps] == [False, True, True]
    assert len(agent.run("again", tools, lambda q, done: ("count", {"n": 1}))[1]) == 1


def test_review_pairs_on_the_query_view(spark, sf):
    """possible_same against brute force on the view that its query reads."""
    from difflib import SequenceMatcher

    from cairn import queries
    from cairn.sources.views import view

    r = view(spark, sf, "person_records")
    e = [(x["entity"], x["name_key"], x["cis"], int(x["age"]) if x["age"].isdigit() else None) for x in resolve.summarize(r, resolve.resolve(r)).collect()]
    want = set()
    for a, na, ca, ya in e:
        for b, nb, cb, yb in e:
            if a >= b or ya is not None and yb is not None and abs(ya - yb) > review.YEARS:
                continue
            blocks = lambda n, c: {"N" + w[:3] for w in n.split() if len(w) >= 3} | {"C" + x[:4] for x in c if len(x) >= 5}
            if not blocks(na, ca) & blocks(nb, cb):
                continue
            rel = {resolve.related(x, y) for x in ca for y in cb}
            near = bool(rel & {"equal", "flip"})
            ratio = SequenceMatcher(None, na, nb).ratio()
            if "equal" in rel or near and (set(na.split()) & set(nb.split()) or ratio >= 0.5) or ratio >= 0.82:
                want.add((a, b))
    assert {tuple(x) for x in queries.possible_same(spark, sf).select("a", "b").collect()} == want and want
