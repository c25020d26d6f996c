"""Filters, rankings and fuzzy search over resolved persons."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.text import NAME_STOPWORDS, fold_lower, fold_upper

_PLACES = str.maketrans("ÁÀÂÄÃÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇ", "AAAAAEEEEIIIIOOOOOUUUUNC")


def _words(text: str) -> list[str]:
    """Words of a query argument, folded on the driver as fold_upper folds columns."""
    out = re.sub("[^A-Z0-9]+", " ", text.upper().translate(_PLACES)).split()
    return [w for w in out if w not in NAME_STOPWORDS]


def person_filter(status: str | None = None, name: str | None = None, ci: str | None = None, municipality: str | None = None, columns: dict[str, str] | None = None) -> Column:
    """The given conditions joined by AND. Arrays are tested as arrays, user text is never a pattern."""
    c = {"name_key": "name_key", "cis": "cis", "statuses": "statuses", "origins": "origins"} | (columns or {})
    terms = [F.lit(True)]
    if ci:
        terms.append(F.array_contains(c["cis"], "".join(x for x in ci if x in "0123456789")))
    if status:
        terms.append(F.array_contains(c["statuses"], status))
    terms += [F.contains(F.col(c["name_key"]), F.lit(w)) for w in _words(name or "")]
    if municipality:
        terms.append(F.exists(c["origins"], lambda o: F.contains(fold_lower(o), fold_lower(F.lit(municipality)))))
    return reduce(and_, terms)


def find_persons(persons: DataFrame, limit: int = 50, **given: str | None) -> DataFrame:
    """The matching persons of most records first; ``limit`` is 1 to 200."""
    if not 1 <= limit <= 200:
        raise ValueError("limit: 1 to 200")
    return persons.filter(person_filter(**given)).orderBy(F.col("n_records").desc(), "entity").limit(limit)


def count_persons(persons: DataFrame, **given: str | None) -> DataFrame:
    return persons.filter(person_filter(**given)).agg(F.count(F.lit(1)).alias("total"))


def for_question(persons: DataFrame, limit: int = 12, **given: str | None) -> DataFrame:
    """Those with a number first, then of most records."""
    return persons.filter(person_filter(**given)).orderBy((F.col("primary_ci") != "").desc(), F.col("n_records").desc(), "entity").limit(limit)


def for_agent(persons: DataFrame, limit: int = 8, **given: str | None) -> DataFrame:
    """The few that a tool loop sees: of most records first."""
    return persons.filter(person_filter(**given)).orderBy(F.col("n_records").desc(), "entity").limit(limit)


def with_sources(persons: DataFrame, records: DataFrame) -> DataFrame:
    """persons with ``listed``: the distinct sources of their records (entity, source), in order, joined by commas."""
    s = records.groupBy("entity").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("listed"))
    return persons.join(s, "entity", "left")


def review_queue(persons: DataFrame, limit: int = 100) -> DataFrame:
    if not 1 <= limit <= 500:
        raise ValueError("limit: 1 to 500")
    return persons.filter(F.col("ci_conflict") | (F.col("only_name_merge") & (F.col("n_records") > 1))).orderBy(F.col("n_records").desc(), "entity").limit(limit)


def person_by_id(persons: DataFrame, records: DataFrame, ci: str) -> DataFrame:
    """The person of a number with its appearances; of several the least entity."""
    one = persons.filter(F.array_contains("cis", "".join(x for x in ci if x in "0123456789"))).orderBy("entity").limit(1)
    seen = records.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("record_id", "source", "display_name", "status"))).alias("records"))
    return one.join(seen, "entity", "left")


def _number_score(query: str, cis: str) -> Column:
    if len(query) < 5 or not query.isdigit():
        return F.lit(0)
    q = F.lit(query)
    off = lambda c: F.size(F.filter(F.sequence(F.lit(1), F.lit(len(query))), lambda i: F.substr(c, i, F.lit(1)) != F.substr(q, i, F.lit(1))))
    each = F.transform(cis, lambda c: F.when(c == q, 1000).when(F.contains(c, q), 120).when(F.length(c) == len(query), F.when(off(c) <= 1, 90).otherwise(0)).otherwise(0))
    return F.coalesce(F.array_max(each), F.lit(0))


def _word_score(q: str, words: str) -> Column:
    n = len(q)
    rest = F.lit(0)

    def one(t: Column) -> Column:
        far = F.levenshtein(t, F.lit(q))
        out = F.when(t == q, 100).when(t.startswith(q), 70 + n).when((F.length(t) >= 3) & F.startswith(F.lit(q), t), 55)
        if n >= 4:
            out = out.when(F.contains(t, F.lit(q)), 42).when((F.length(t) >= 4) & (far <= 2), 42 - 9 * far - 3 * F.abs(F.length(t) - n))
        return out.otherwise(rest)

    return F.coalesce(F.greatest(rest, F.array_max(F.transform(words, one))), rest)


def _near(w: str) -> Callable[[Column], Column]:
    return lambda o: (o == w) | o.startswith(w) if len(w) >= 4 else o == w


def fuzzy(persons: DataFrame, query: str, limit: int = 80) -> DataFrame:
    """persons (entity, words, cis, places) with score, best first. Words score by equality, prefix, part or
    edit distance, numbers by equality, part or one digit; a place only adds where one of those did."""
    words = re.sub("[^A-Z0-9]+", " ", query.upper().translate(_PLACES)).split()
    name = reduce(lambda a, b: a + b, [_word_score(w, "words") for w in words], F.lit(0))
    number = _number_score(query.strip(), "cis")
    near = [F.exists("places", _near(w)) for w in words]
    place = F.when(reduce(lambda a, b: a | b, near, F.lit(False)), 12).otherwise(0)
    out = persons.withColumn("_n", name).withColumn("_c", number).filter((F.col("_n") >= 40) | (F.col("_c") > 0))
    return out.withColumn("score", (F.col("_n") + F.col("_c") + place).cast("int")).drop("_n", "_c").orderBy(F.col("score").desc(), "entity").limit(limit)


def words_of_text(c: Column | str) -> Column:
    return F.filter(F.split(fold_upper(c), " "), lambda t: t != "")
