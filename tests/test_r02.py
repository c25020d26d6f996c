"""What the findings of the second round showed."""

import random
from collections import Counter

from pyspark.sql import functions as F

from cairn import queries
from cairn.functions import fields, ids
from cairn.functions import text as T
from cairn.operators import geo, resolve
from cairn.sources.views import view


def test_hours_are_counted_to_the_microsecond(spark):
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    ago = lambda t: fields.freshness(F.lit(t).cast("timestamp"), now)
    got = spark.range(1).select(ago("2024-01-31 23:00:00.5"), ago("2024-01-31 23:00:00"), ago("2024-01-30 00:00:00.000001"), ago("2024-01-30 00:00:00")).first()
    assert tuple(got) == ("confirmado hace 0h", "confirmado hace 1h", "confirmado hace 47h", "sin confirmar hace 2d")


def test_sites_a_millimetre_apart_tie(spark):
    points = spark.createDataFrame([(1, 10.5, -67.0)], "id long, lat double, lng double")
    sites = spark.createDataFrame([(7, 10.51, -67.0), (3, 10.51 + 1e-12, -67.0)], "site_id long, lat double, lng double")
    assert geo.nearest(points, sites).first().site_id == 3


def test_digits_of_a_word_are_no_number(spark):
    names = {"A12 LUZ FAM123456": ([], "A12 LUZ FAM123456"), "Ana Mora CI12.345.678": (["12345678"], "Ana Mora"), "Luis cédula: 9876543": (["9876543"], "Luis"), "V-9876543 Eva": (["9876543"], "Eva"), "Jose 1234567": (["1234567"], "Jose")}
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", ids.find_ids("n", ids.IN_NAMES), ids.strip_ids("n")).collect()
    assert {r[0]: (r[1], r[2]) for r in rows} == names


def test_a_text_is_folded_once_for_all_its_tags(spark):
    """fold_lower has two regular expressions; each tag had them again."""
    plan = spark.range(1).select(fields.needs_tags(F.col("id").cast("string")).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_replace") == 2
    got = spark.createDataFrame([("Agua y pañales",), ("",), (None,)], "t string").select(fields.needs_tags("t")).collect()
    assert [r[0] for r in got] == [["agua", "panales"], [], []]


def test_a_name_is_cleaned_once_for_all_its_variants(spark, sf):
    plan = spark.range(1).select(T.name_variants(F.col("id").cast("string")).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_replace") == 1 + 2 * 2  # of the name, and of its last two words
    assert queries.QUERIES["name_variants_persons"](spark, sf).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def people(n, seed=3):
    """Records of few words and numbers: big blocks, copies, numbers that flip, short ones and none, and names without a word."""
    r = random.Random(seed)
    names = ["", "ANA MORA", "ANA PAZ SOL", "EVA LUNA", "EVAN LUZ MORA", "TEO"]
    return [(i, r.choice(names), r.choice(["", "1234", *(str(12345600 + k) for k in range(12)), "12435601", "1234560", "98765432"]), "") for i in range(n)]


def test_candidate_pairs_and_their_relations_equal_brute_force(spark):
    rows = people(150)
    records = spark.createDataFrame(rows, "record_id long, name_key string, ci string, age string")
    blocks = lambda n, c: {f"N{w[:3]}" for w in n.split()[:1]} | ({f"C{c[:4]}"} if len(c) >= 6 else set())
    want = {(a[0], b[0]): resolve.related(a[2], b[2]) for a in rows for b in rows if a[0] < b[0] and blocks(a[1], a[2]) & blocks(b[1], b[2])}
    got = [(x.i, x.j) for x in resolve.candidate_pairs(records).collect()]
    assert len(got) == len(set(got)) and set(got) == set(want)
    assert any(rows[i][1] == rows[j][1] == "" for i, j in want)  # records without a word were lost
    n, total = Counter(want.values()), Counter()
    for (i, _), rel in want.items():
        total[rel] += i
    assert {x.relation: (x.n, x.total) for x in resolve.relation_totals(records).collect()} == {r: (n[r], total[r]) for r in n}
    lists = {tuple(sorted(x)) for x in resolve.skew.cliques(records.select(F.lit("b").alias("block"), F.lit(None).cast("string").alias("part"), F.col("record_id").alias("id")), 20).collect()}
    assert len(lists) == 150 * 149 // 2
    p = resolve.placed(records).filter("number_block is not null")
    assert resolve.flip_totals(p, 3).first() == resolve.flip_totals(p).first()


def test_flip_edges_equal_brute_force(spark):
    rows = people(150, 5)
    records = spark.createDataFrame(rows, "record_id long, name_key string, ci string, age string")
    p = resolve.profiles(records)
    block = lambda n: n.split()[0][:3]
    want = set()
    for a in rows:
        for b in rows:
            v, w = set(a[1].split()), set(b[1].split())
            if a[0] < b[0] and resolve.related(a[2], b[2]) == "flip" and v and w and len(v & w) / min(len(v), len(w)) >= 0.5 and (a[2][:4] == b[2][:4] or block(a[1]) == block(b[1])):
                want.add((a[0], b[0]))
    for most in (256, 2):
        got = [(x.a, x.b) for x in resolve.flip_edges(p, most).collect()]
        assert len(got) == len(set(got)) and set(got) == want and want
    got = {(x.i, x.j) for x in resolve.matches(records).collect() if x.reason == "ci_flip+name"}
    assert got == want


def test_views_are_spread_over_the_cores(spark, sf):
    """One row group held all parts, so that one task did all households."""
    assert view(spark, sf, "person_records").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
