"""Operators that no SQL expresses: resolution, review, streams, sources, plans."""

import random
import time
from difflib import SequenceMatcher

import pytest
from cairn.functions import fields, ids
from cairn.functions import text as T
from cairn.operators import centers, geo, graph, resolve, review
from cairn.operators.registry import admit
from cairn.plans.question import plan
from cairn.streaming import maintain
from cairn.streaming.state import limit_requests
from pyspark.sql import functions as F


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_names_and_numbers(spark):
    lit = F.lit
    r = one(spark, T.fold_upper(lit("  Peñá-Ruiz, José ")), T.name_key(lit("WUIKMER/WILMER"), lit("de la Mora")), ids.find_ids(lit("CI 12.345.678, V-9876543 y 12345")), fields.age(lit("3 MESES")), fields.age(lit("39")), fields.age(lit("40 AÑOS")))
    assert r[0] == "PENA RUIZ JOSE" and set(r[1].split()) == {"WUIKMER", "WILMER", "MORA"} and r[2] == ["12345678", "9876543"]
    assert tuple(r[3]) == ("3", "months") and tuple(r[4]) == ("39", "") and tuple(r[5]) == ("40", "years")


@pytest.mark.parametrize("a, b, want", [("12345678", "12345687", "flip"), ("12345678", "12345679", "flip"), ("1234567", "12345678", "flip"), ("12345", "12345", "none"), ("12345678", "12345678", "equal"), ("12345678", "87654321", "diff")])
def test_relation(spark, a, b, want):
    assert one(spark, ids.relation(F.lit(a), F.lit(b)))[0] == want == resolve.related(a, b)


RECORDS = "record_id long, source string, display_name string, name_key string, ci string, age string, status string, origin string, hospital string"
row = lambda i, key, ci="", age="": (i, "s", key, key, ci, age, "localizado", "", "")


def test_resolution_guards_and_splits(spark):
    rows = [row(1, "ANA MORA PAZ", "12345678"), row(2, "ANA MORA PAZ"), row(3, "ANA MORA PAZ", "12345679"), row(4, "EVA LUNA SOL", "11111111"), row(5, "EVA LUNA SOL", "22222222"), row(6, "EVA LUNA SOL"), row(7, "TEO RIO", "", "30"), row(8, "TEO RIO", "", "50")]
    got = {r["record_id"]: r["entity"] for r in resolve.resolve(spark.createDataFrame(rows, RECORDS)).collect()}
    assert got[4] != got[5] and got[7] != got[8]
    assert set(got) == set(range(1, 9)) and got[1] == got[3]


def test_review_pairs_equal_brute_force(spark):
    r = random.Random(1)
    names = ["".join(r.choice("ABCDE") for _ in range(5)) for _ in range(12)]
    rows = [(i, " ".join(sorted(r.sample(names, 3))), [str(r.randrange(10**7, 10**7 + 40))] if i % 2 else [], "") for i in range(60)]
    got = {(x["a"], x["b"]) for x in review.possible_same(spark.createDataFrame(rows, "entity long, name_key string, cis array<string>, age string")).collect()}
    want = set()
    for i, (a, na, ca, _) in enumerate(rows):
        for b, nb, cb, _ in rows[i + 1 :]:
            blocks = lambda n, c: {"N" + w[:3] for w in n.split()} | {"C" + x[:4] for x in c}
            rel = {resolve.related(x, y) for x in ca for y in cb}
            near = bool(rel & {"equal", "flip"})
            ratio = SequenceMatcher(None, na, nb).ratio()
            if blocks(na, ca) & blocks(nb, cb) and ("equal" in rel or near and set(na.split()) & set(nb.split()) or ratio >= 0.82 or near and ratio >= 0.5):
                want.add((a, b))
    assert got == want and want


def test_components_both_ways(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(5, 5), (None, 3)]
    df = spark.createDataFrame(edges, "a long, b long")
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = sorted((root(a), root(b)))
            up[b] = a
    want = {x: root(x) for x in list(up)}
    for limit in (10**6, 0):
        assert {x["id"]: x["root"] for x in graph.components(df, limit).collect()} == want


def test_limiter():
    ok, left = admit([0, 1, 2, 61, 61.5], [], 2, 60)
    assert ok[:3] == [True, True, False] and ok[3] is True


def test_limiter_as_a_stream(spark, tmp_path):
    rows = [("a", f"2024-01-01 00:00:{s:02d}") for s in (0, 1, 2, 3)] + [("b", "2024-01-01 00:00:00")]
    spark.createDataFrame(rows, "key string, t string").select("key", F.col("t").cast("timestamp").alias("ts")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, ts timestamp").parquet(str(tmp_path / "in"))
    q = limit_requests(stream, 2, 60.0).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    until = time.time() + 40  # state that may time out asks for batches without end, so the query never idles
    while time.time() < until and spark.table("limited").count() < len(rows):
        time.sleep(0.5)
    q.stop()
    got = {r["key"]: r["n"] for r in spark.table("limited").groupBy("key").agg(F.count_if("allowed").alias("n")).collect()}
    assert got == {"a": 2, "b": 1}


STORE = "record_id long, source string, uid string, display_name string, name_key string, ci string, age string, status string, origin string, hospital string, ts timestamp"


def test_micro_batches_are_idempotent(spark, tmp_path):
    def batch(rows):
        return spark.createDataFrame([(i, "s", u, k, k, ci, "", st, "", "", None) for i, u, k, ci, st in rows], STORE).withColumn("ts", F.timestamp_seconds("record_id"))

    snaps = maintain.Snapshots(spark, str(tmp_path / "store"))
    first = batch([(1, "u1", "ANA MORA PAZ", "12345678", "por_localizar"), (2, "u2", "EVA LUNA SOL", "22222222", "localizado")])
    snaps.apply(first, 0)
    snaps.apply(batch([(3, "u3", "ANA MORA PAZ", "12345678", "localizado"), (4, "u1", "ANA MORA PAZ", "12345678", "fallecido")]), 1)
    once = sorted((r["uid"], r["person"], r["status"]) for r in snaps.read().collect())
    snaps.apply(batch([(3, "u3", "ANA MORA PAZ", "12345678", "localizado"), (4, "u1", "ANA MORA PAZ", "12345678", "fallecido")]), 1)
    assert once == sorted((r["uid"], r["person"], r["status"]) for r in snaps.read().collect())
    by = {u: (p, s) for u, p, s in once}
    assert by["u1"][0] == by["u3"][0] != by["u2"][0] and by["u1"][1] == "fallecido"
    assert maintain.persons(snaps.read()).count() == 2


def people_of(store):
    groups = {}
    for r in store.collect():
        groups.setdefault(r["person"], set()).add(r["uid"])
    return sorted(map(sorted, groups.values()))


def test_stream_of_three_batches(spark, tmp_path):
    """The same persons whether batches are followed, replayed or compacted; a batch reads only the buckets of its keys."""
    rows = [
        [(1, "s", "u1", "ANA MORA PAZ", "12345670", "por_localizar"), (2, "s", "u2", "EVA LUNA SOL", "22222222", "localizado"), (3, "s", "u3", "TEO RIO MAR", "", "herido")],
        [(4, "s", "u4", "ANA MORA PAZ", "12345671", "localizado"), (5, "s", "u5", "TEO RIO MAR", "", "herido"), (6, "s", "u2", "EVA LUNA SOL", "22222222", "fallecido"), (7, "s", "u6", "LUZ SOLA", "7654321", "alta"), (8, "s", "u7", "LUZ SOLA", "7654321", "alta")],
        [(9, "t", "u1", "EVA LUNA", "22222222", "localizado"), (0, "s", "u2", "EVA LUNA SOL", "22222222", "localizado"), (10, "s", "u3", "TEO RIOS CAL", "", "alta"), (11, "s", "u8", "OTRO NOMBRE", "", "")],
    ]
    folder = tmp_path / "in"
    for k, batch in enumerate(rows):
        df = spark.createDataFrame([(i, src, u, n, " ".join(sorted(n.split())), ci, "", st, "", "", None) for i, src, u, n, ci, st in batch], STORE).withColumn("ts", F.timestamp_seconds("record_id"))
        df.coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(0.1)
    stream = spark.readStream.schema(STORE).option("maxFilesPerTrigger", 1).parquet(str(folder))
    snaps = maintain.Snapshots(spark, str(tmp_path / "store"), keep=1)
    maintain.follow(stream, snaps, str(tmp_path / "cp")).awaitTermination(300)
    store = snaps.read().cache()
    assert people_of(store) == [["u1", "u2"], ["u1", "u4"], ["u3", "u5"], ["u6", "u7"], ["u8"]]
    status = {(r["source"], r["uid"]): r["status"] for r in store.collect()}
    assert status["s", "u2"] == "fallecido" and status["s", "u3"] == "alta" and len(status) == 9
    assert any(v[0] == "b" for v in snaps._versions())
    index = snaps._table("index", snaps._live()).cache()
    count = lambda word: index.filter("kind = 'word'").filter(F.col("key") == word).agg(F.sum("n")).first()[0]
    assert count("") == 9 and count("MAR") == 1 and count("RIOS") == 1  # a record that changed its name
    index.unpersist()  # a cached table would stand in for the scan
    some = snaps._probe(snaps._table("index", snaps._live()), "block", spark.createDataFrame([("NEVA",)], "key string"))
    assert {r["key"] for r in some.collect()} == {"NEVA"}
    assert "bucket" in some._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:300]


ZONES = [("Naiguatá", 10.6, -66.7), ("La Guaira", 10.6, -66.9), ("Los Caracas", 10.65, -66.57), ("Caracas", 10.5, -66.9), ("Ñ", 1.0, 2.0), ("", 0.0, 0.0)]


def test_gazetteer_is_the_same_by_broadcast_and_by_keys(spark):
    texts = ["Naiguata, La Guaira", "sector de LOS CARACAS", "xcaracasx", "nada", "", None, "y la guairaaa", "ñ", "caraca"]
    places = spark.createDataFrame([(k % 7, k // 7, t) for k, t in enumerate(texts)], "id int, pos int, origin string")
    zones = spark.createDataFrame(ZONES, "zone string, lat double, lng double")
    by = [{r["id"]: r["zone"] for r in geo.zones_found(places, zones, limit=limit).collect()} for limit in (1 << 20, 0)]
    assert by[0] == by[1] == {0: "Naiguatá", 1: "Los Caracas", 2: "Caracas", 3: "Ñ", 6: "La Guaira"}


def test_geocode_tiers(spark):
    zones = spark.createDataFrame(ZONES[:2], "zone string, lat double, lng double")
    sites = spark.createDataFrame([(1, 10.601, -66.701), (2, 11.0, -66.0)], "site_id long, lat double, lng double")
    asked = ["Edif Las Palmas, Naiguatá", "Edif Las Palmas, La Guaira", "Torre Miramar", "Torre Bahia", "La Guaira", "en otra parte", "Residencia Sola", "", "conocido"]
    hits = [("edif las palmas, naiguata", 10.61, -66.71, "Las Palmas"), ("edif las palmas, la guaira", 10.3, -66.9, "Las Palmas"), ("torre miramar", 10.60, -66.9, "Miramar Torre"), ("torre bahia", 10.9, -66.9, "Torre Bahia"), ("residencia sola", 10.60, -66.9, "Otra Cosa")]
    cache = spark.createDataFrame([("conocido", 1.0, 2.0, "building", "c")], "q string, lat double, lng double, tier string, label string")
    got = {r["q"]: (r["lat"], r["lng"], r["tier"]) for r in geo.geocode(spark.createDataFrame([(a,) for a in asked], "origin string"), zones, sites, spark.createDataFrame(hits, geo.NO_BUILDING), cache).collect()}
    assert got == {"edif las palmas, naiguata": (10.61, -66.71, "building"), "edif las palmas, la guaira": (10.6, -66.9, "sector"), "torre miramar": (10.60, -66.9, "building"), "torre bahia": (None, None, None),
                   "la guaira": (10.6, -66.9, "sector"), "en otra parte": (None, None, None), "residencia sola": (None, None, None), "conocido": (1.0, 2.0, "building")}
    people = spark.createDataFrame([(1, ["No indicada", "otra", "Naiguatá"]), (2, ["conocido"]), (3, [])], "id int, origins array<string>")
    at = {r["id"]: (r["origins"][:1], r["lat"], r["geo_tier"]) for r in geo.attach(people, zones, sites, cache).collect()}
    assert at == {1: (["Naiguatá"], 10.601, "zone"), 2: (["conocido"], 1.0, "building"), 3: ([], None, None)}
    assert geo.coverage(geo.attach(people, zones, sites, cache)).first().asDict() == {"persons": 3, "placed_pct": 66, "building_pct": 33}


def test_merged_centers(spark):
    rows = [(1, "Centro Rio Alto", "A", "s1", "", "", "9-5", ["agua"]), (2, "centro  río alto", "a", "s2", "calle", "", "", ["ropa"]), (3, "Centro Rio Alto", "A", "s1", "", "555", "8-4", []), (4, "Centro de Ayuda", "A", "s1", "", "", "", []), (5, "Centro de Ayuda", "A", "s2", "", "", "", []), (6, "Otro", "", "s9", "", "", "", [])]
    df = spark.createDataFrame(rows, "center_id long, name string, municipality string, source string, address string, phone string, hours string, needs_tags array<string>")
    got = {r["center_id"]: (r["canonical_id"], r["merged_sources"], r["address"], r["phone"], r["hours"], r["needs_tags"]) for r in centers.merged(df).collect()}
    assert got[2] == (None, "s1,s2", "calle", "555", "9-5", ["agua", "ropa"]) and got[1][0] == got[3][0] == 2 and got[1][1] is None
    assert got[4][0] is got[5][0] is got[6][0] is None and got[4][1] is None  # generic words alone don't merge


def test_plans():
    assert plan("¿Quiénes son los fallecidos de nombre Luz?").status == "fallecido"
    assert plan("busco la cédula 12.345.678").ci == "12345678"
    p = plan("¿Qué refugios hay en La Guaira?")
    assert (p.tool, p.municipality) == ("centers", "Guaira") or (p.tool, p.municipality) == ("centers", "La Guaira")
