"""Pairs of entities for human review: alike, but not merged."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from cairn.functions import ids
from cairn.functions.fields import ages_fit
from cairn.operators import alike, skew
from cairn.operators.resolve import flips, words_of
from cairn.session import bounded, cut

ALIKE, SUPPORTED, YEARS = 0.82, 0.5, 2
#: Names of a list that meets another one.
NAMES = 4096
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 "


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff/Obershelp similarity. It isn't symmetric: the lesser entity comes first."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def letters(name: Column) -> Column:
    """How often each letter occurs, and last all others together."""
    known = [F.length(name) - F.length(F.replace(name, F.lit(c))) for c in _ALPHABET]
    return F.array(*known, F.length(F.translate(name, _ALPHABET, "")))


def name_blocks(name: Column | str) -> Column:
    """The prefixes of its words of three letters or more."""
    return F.array_distinct(F.transform(F.filter(words_of(name), lambda w: F.length(w) >= 3), lambda w: F.concat(F.lit("N"), F.substring(w, 1, 3))))


def number_blocks(cis: Column | str) -> Column:
    """The prefixes of numbers of five digits or more."""
    return F.array_distinct(F.transform(F.filter(cis, lambda c: F.length(c) >= 5), lambda c: F.concat(F.lit("C"), F.substring(c, 1, 4))))


def possible_same(entities: DataFrame) -> DataFrame:
    """(a, b): entities (entity, name_key, cis, age) that may be one person. Entities meet on the prefix of
    any word (of three letters or more) or number (five digits or more).

    Distinct names are compared, not entities, and the pairs of names that are alike meet with their entities; numbers that are
    equal or close are found by their keys. So beyond the rows that it gives, only the distinct names of a block grow with its square."""
    e = cut(entities.select("entity", F.coalesce("name_key", F.lit("")).alias("name"), "cis", F.col("age").try_cast("int").alias("years")))
    return close_pairs(e).union(alike_pairs(e))


def close_pairs(e: DataFrame) -> DataFrame:
    """The pairs of entities (entity, name, cis, years) whose numbers are equal or close, but for those of ``alike_pairs``."""
    placed = e.withColumn("blocks", F.concat(name_blocks("name"), number_blocks("cis")))
    bears = cut(placed.select(F.explode(F.array_distinct(F.filter("cis", lambda c: F.length(c) >= ids.SHORTEST))).alias("ci"), F.struct("entity", "name", "years", "blocks").alias("who")))
    numbers = bears.select("ci").distinct()
    near = flips(numbers).filter("ci < other").union(numbers.select("ci", F.col("ci").alias("other")))
    x = near.join(bears, "ci").select("other", (F.col("ci") == F.col("other")).alias("equal"), F.col("who").alias("x"))
    p = skew.pairs(x, bears.select(F.col("ci").alias("other"), F.col("who").alias("y")), "other")
    less = F.col("x.entity") < F.col("y.entity")
    p = p.filter((less | (~F.col("equal") & (F.col("x.entity") > F.col("y.entity")))) & ages_fit("x.years", "y.years", YEARS) & F.arrays_overlap("x.blocks", "y.blocks"))
    p = p.select("equal", F.when(less, F.struct("x", "y")).otherwise(F.struct(F.col("y").alias("x"), F.col("x").alias("y"))).alias("p"))
    p = p.groupBy(F.col("p.x.entity").alias("a"), F.col("p.y.entity").alias("b")).agg(F.bool_or("equal").alias("equal"), F.first("p.x.name").alias("m"), F.first("p.y.name").alias("n"))
    common = F.aggregate(F.zip_with(letters(F.col("m")), letters(F.col("n")), lambda s, t: F.least(s, t)), F.lit(0), lambda s, t: s + t)
    both = F.length("m") + F.length("n")
    p = cut(p.withColumn("sure", F.col("equal") | F.arrays_overlap(words_of("m"), words_of("n"))).withColumn("bound", F.when(both == 0, 1.0).otherwise(2 * common / both)))
    rest = p.filter((F.col("bound") >= ALIKE) | (~F.col("sure") & (F.col("bound") >= SUPPORTED))).withColumn("r", sequence_ratio(F.col("m"), F.col("n")))
    return p.filter(F.col("sure") & (F.col("bound") < ALIKE)).select("a", "b").union(rest.filter((F.col("r") < ALIKE) & (F.col("sure") | (F.col("r") >= SUPPORTED))).select("a", "b"))


def alike_names(e: DataFrame, chunk: int = NAMES) -> DataFrame:
    """(m, n, there, back), m < n: the names of ``e`` that share a block and are alike with m first (there) or n first (back). Some
    are borne by no two entities of fitting ages.

    Names meet in the most frequent block that they share: those whose most frequent one is the same don't meet in the others."""
    old = F.when(F.count_if(F.col("years").isNull()) > 0, F.array(F.lit(None).cast("int"))).otherwise(F.array().cast("array<int>"))
    names = cut(e.groupBy("name").agg(F.concat(F.collect_set("years"), old).alias("ages")))
    named = names.select("name", F.explode(name_blocks("name")).alias("block"))
    often = named.groupBy("block").agg(F.count(F.lit(1)).alias("often"))
    top = named.join(often, "block").groupBy("name").agg(F.max(F.struct("often", "block"))["block"].alias("top"))
    numbered = e.select("name", F.explode(number_blocks("cis")).alias("block")).distinct()
    rows = named.union(numbered).join(names, "name").join(top, "name", "left")
    rows = rows.select("block", F.when(F.col("block") != F.col("top"), F.col("top")).alias("part"), F.struct("name", "ages").alias("id"))
    met = skew.tiles(rows, chunk)
    return met.mapInArrow(lambda batches: alike.found(batches, ALIKE, YEARS), "m string, n string, there boolean, back boolean").distinct()


def alike_pairs(e: DataFrame, chunk: int = NAMES, most: int = skew.LISTED) -> DataFrame:
    """The pairs of entities (entity, name, cis, years) that share a block, whose ages fit and whose names are alike, the lesser entity first.

    Entities of one name and age are lists, and lists meet. Names that share no block need entities whose numbers share one."""
    equal = e.select(F.col("name").alias("m"), F.col("name").alias("n"), F.lit(True).alias("there"), F.lit(True).alias("back")).distinct()
    near = cut(alike_names(e, chunk).union(equal).withColumn("by_name", F.arrays_overlap(name_blocks("m"), name_blocks("n"))))
    parts = bounded(cut(e.groupBy("name", "years").agg(F.ceil(F.count(F.lit(1)) / F.lit(most)).cast("int").alias("p")).filter("p > 1")), 64)
    dealt = e.join(parts.select(F.col("name").alias("_n"), F.col("years").alias("_y"), "p"), (F.col("name") == F.col("_n")) & F.equal_null("years", "_y"), "left")
    k = F.pmod(F.xxhash64("entity"), F.coalesce("p", F.lit(1))).cast("int")
    lists = cut(dealt.groupBy("name", "years", k.alias("k")).agg(F.collect_list("entity").alias("l")))
    side = lambda name, at, l: lists.select(F.col("name").alias(name), F.struct("years", "k").alias(at), F.col("l").alias(l))
    n = skew.PER_CORE * skew.tasks(e)
    met = near.filter("by_name").join(side("m", "s", "x"), "m").join(side("n", "t", "y"), "n")
    met = met.filter(ages_fit("s.years", "t.years", YEARS) & ((F.col("m") != F.col("n")) | (F.col("s") <= F.col("t"))))
    met = met.select("there", "back", ((F.col("m") == F.col("n")) & (F.col("s") == F.col("t"))).alias("same"), "x", "y", F.xxhash64("m", "n", "s", "t").alias("_h")).repartition(n, "_h")
    i, j = F.col("i"), F.col("j")
    p = met.select("there", "back", "same", "y", F.explode("x").alias("i")).select("there", "back", "same", "i", F.explode("y").alias("j"))
    ordered = ((i < j) & F.col("there")) | ((i > j) & F.col("back") & ~F.col("same"))
    out = p.filter(ordered).select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"))
    placed = e.select("name", "years", "entity", F.explode(number_blocks("cis")).alias("block"))
    x = placed.select(F.col("name").alias("m"), F.col("years").alias("u"), F.col("entity").alias("i"), "block")
    y = placed.select(F.col("name").alias("n"), F.col("years").alias("v"), F.col("entity").alias("j"), "block")
    rest = near.filter("not by_name").withColumn("same", F.col("m") == F.col("n")).join(x, "m").join(y, ["n", "block"]).filter(ordered & ages_fit("u", "v", YEARS))
    return out.union(rest.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).distinct())


def different_numbers(a: str, b: str) -> Column:
    """Both have numbers, and none in common."""
    return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)


def relation_summary(pairs: DataFrame) -> DataFrame:
    """Label of each pair (with arrays cis_a and cis_b): equal before flip before diff, or a missing number."""
    some = lambda kind: F.exists("cis_a", lambda c: F.exists("cis_b", lambda d: ids.relation(c, d) == kind))
    label = F.when((F.size("cis_a") == 0) | (F.size("cis_b") == 0), "missing").when(some("equal"), "equal").when(some("flip"), "flip").otherwise("diff")
    return pairs.withColumn("relation", label)


def report(entities: DataFrame, pairs: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """The review report as lines (section, line): the counts, then number conflicts, pairs (a, b) of different numbers, other pairs,
    people in several hospitals, the deceased, and merges by name alone."""
    line = lambda s="": F.concat_ws(" | ", F.col(f"{s}entity").cast("string"), F.col(f"{s}display_name"), F.array_join(f"{s}cis", ","), F.array_join(f"{s}sources", ","), F.col(f"{s}n_records").cast("string"))
    n = lambda c: F.count_if(c)
    alone = F.col("only_name_merge") & (F.col("n_records") > 1) if "only_name_merge" in entities.columns else F.lit(False)
    e, x, y = entities, entities.alias("x"), entities.alias("y")
    p = pairs.join(x, F.col("a") == F.col("x.entity")).join(y, F.col("b") == F.col("y.entity"))
    some = lambda kind: F.exists("x.cis", lambda c: F.exists("y.cis", lambda d: ids.relation(c, d) == kind))
    why = F.when((F.size("x.cis") == 0) | (F.size("y.cis") == 0), "missing").when(some("equal"), "equal").when(some("flip"), "flip").otherwise("diff")
    p = p.select(different_numbers("x.cis", "y.cis").alias("different"), F.concat(line("x."), F.lit(" ~ "), line("y."), F.lit(" | "), why, F.lit(" "), F.round(sequence_ratio(F.col("x.name_key"), F.col("y.name_key")), 3).cast("string")).alias("line"))
    counts = e.agg(F.count(F.lit(1)).alias("entities"), n(F.size("sources") > 1).alias("cross_source"), n(F.size("hospitals") > 1).alias("several_hospitals"), n("ci_conflict").alias("ci_conflict"), n("deceased").alias("deceased"), n(alone).alias("name_only"))
    counts = counts.crossJoin(p.agg(F.count(F.lit(1)).alias("possible_same"), n("different").alias("possible_same_different")))
    if records is not None:
        counts = counts.crossJoin(records.agg(F.count(F.lit(1)).alias("records")))
    out = counts.select(F.lit("1 counts").alias("section"), F.to_json(F.struct("*")).alias("line"))
    part = lambda name, rows: rows.select(F.lit(name).alias("section"), "line")
    of = lambda name, cond: part(name, e.filter(cond).withColumn("line", line()))
    for rows in (of("2 ci_conflict", F.col("ci_conflict")), part("3 different numbers", p.filter("different")), part("4 possible_same", p.filter("not different")), of("5 several_hospitals", F.size("hospitals") > 1), of("6 deceased", F.col("deceased")), of("7 name_only", alone)):
        out = out.union(rows)
    return out
