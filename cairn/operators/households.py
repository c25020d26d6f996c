"""Household links between entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.text import fold_upper
from cairn.operators.graph import components
from cairn.session import cut

LARGEST, LARGEST_REPORT = 8, 4


def _pairs(members: DataFrame, most: int, kind: F.Column, weight: int) -> DataFrame:
    """Pairs of (key, person) within groups of 2 to ``most``: larger groups are common names or round-ups,
    not families. The least ``most`` + 1 persons of a key tell which it is, so the rest is dropped before the shuffle."""
    least = F.dense_rank().over(Window.partitionBy("key").orderBy("person"))
    few = members.filter("person is not null").withColumn("_r", least).filter(F.col("_r") <= most + 1)
    small = few.groupBy("key").agg(F.array_sort(F.collect_set("person")).alias("g")).filter(F.size("g").between(2, most))
    p = small.select("key", F.posexplode("g").alias("i", "a"), "g").select("key", "a", F.explode(F.slice("g", F.col("i") + 2, F.lit(most))).alias("b"))
    return p.select("a", "b", kind.alias("kind"), F.lit(weight).alias("weight"))


def edges(persons: DataFrame, records: DataFrame, surname_first: bool = False) -> DataFrame:
    """(a, b, kind, weight): siblings share both surnames (3), kin one (2), and people of one report (source,
    uid before '#') are co-mentioned (1). Persons: (person, display_name); records: (person, source, uid)."""
    w = F.filter(F.split(fold_upper("display_name"), " "), lambda t: t != "")
    last = F.slice(w, 1, 2) if surname_first else F.when(F.size(w) >= 2, F.slice(w, F.size(w) - 1, F.lit(2))).otherwise(w)
    p = persons.select("person", F.array_sort(F.array_distinct(last)).alias("s"), F.size(last).alias("n"))
    pair = p.filter("n >= 2").select(F.array_join("s", " ").alias("key"), "person")
    one = p.select(F.explode("s").alias("key"), "person").filter(F.length("key") > 2)
    base = records.filter("uid <> ''").select(F.concat_ws("|", "source", F.substring_index("uid", "#", 1)).alias("key"), "person")
    return (
        _pairs(pair, LARGEST, F.concat(F.lit("siblings:"), "key"), 3)
        .union(_pairs(one, LARGEST, F.concat(F.lit("kin:"), "key"), 2))
        .union(_pairs(base, LARGEST_REPORT, F.lit("co_mention"), 1))
    )


def households(links: DataFrame) -> DataFrame:
    """(person, household): the least person that surname links connect it to."""
    return components(links.filter("weight >= 2").select("a", "b")).select(F.col("id").alias("person"), F.col("root").alias("household"))


def members(person_households: DataFrame, links: DataFrame) -> DataFrame:
    """(person, member, kind): the others of a person's household, and who was reported with it; of
    several links the strongest."""
    x = cut(person_households)
    own = x.join(x.select(F.col("person").alias("member"), "household"), "household").filter("person <> member").select("person", "member", F.lit("household").alias("kind"), F.lit(0).alias("weight"))
    way = lambda a, b: F.struct(F.col(a).alias("person"), F.col(b).alias("member"), "kind", "weight")
    both = links.select(F.explode(F.array(way("a", "b"), way("b", "a"))).alias("x")).select("x.*")
    w = Window.partitionBy("person", "member").orderBy(F.col("weight").desc(), "kind")
    return own.union(both).withColumn("r", F.row_number().over(w)).filter("r = 1").select("person", "member", "kind")
