"""The engine's functions and tables for SQL: ``register(spark)``, then ``select fold(name), name_key(name) ...``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from cairn.functions.text import _FROM, _TO, NAME_STOPWORDS

_FOLD = rf"trim(regexp_replace(upper(regexp_replace(translate(coalesce({{0}}, ''), '{_FROM}', '{_TO}'), '\\p{{{{Mn}}}}+', '')), '[^A-Z0-9]+', ' '))"
_SUBSTITUTED = "size(filter(sequence(1, greatest(length(a), 1)), i -> substr(a, i, 1) <> substr(b, i, 1)))"
_AT = "filter(sequence(1, greatest(length(a), 1)), i -> substr(a, i, 1) <> substr(b, i, 1))[{0}]"
_SWAPPED = f"{_SUBSTITUTED} = 2 and substr(a, {_AT.format(0)}, 1) = substr(b, {_AT.format(1)}, 1) and substr(a, {_AT.format(1)}, 1) = substr(b, {_AT.format(0)}, 1)"

#: native SQL functions: the optimizer inlines their bodies
SQL_FUNCTIONS = {
    "fold(x string) returns string": _FOLD.format("x"),
    "name_key(x string) returns string": f"array_join(array_sort(array_distinct(filter(split({_FOLD.format('x')}, ' '), t -> t <> '' and t not in ({', '.join(repr(w) for w in NAME_STOPWORDS)})))), ' ')",
    "haversine_km(lat1 double, lng1 double, lat2 double, lng2 double) returns double":
        "2 * 6371e0 * asin(sqrt(pow(sin((radians(lat2) - radians(lat1)) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin((radians(lng2) - radians(lng1)) / 2), 2)))",
    "ci_relation(a string, b string) returns string":
        f"case when length(a) < 6 or length(b) < 6 then 'none' when a = b then 'equal' when length(a) = length(b) then if({_SUBSTITUTED} = 1 or ({_SWAPPED}), 'flip', 'diff') when abs(length(a) - length(b)) = 1 and levenshtein(a, b) = 1 then 'flip' else 'diff' end",
}


@udtf(returnType="variant string, n int")
class NameSpellings:
    """name_spellings(name): the name with its last two words swapped, and each of the two with a silent h more or less."""

    def eval(self, name: str) -> Iterator[tuple[str, int]]:
        words = (name or "").split()
        out = [" ".join(words)]
        if len(words) >= 3:
            out.append(" ".join([*words[:-2], words[-1], words[-2]]))
        for k in range(max(0, len(words) - 2), len(words)):
            w = words[k]
            other = w[1:] if w[:1].lower() == "h" else "h" + w if w[:1].lower() in "aeiou" else ""
            if len(other) > 1:
                out.append(" ".join([*words[:k], other, *words[k + 1 :]]))
        yield from ((v, n) for n, v in enumerate(dict.fromkeys(v for v in out if v)))


def register(spark: SparkSession) -> None:
    """The SQL functions, seq_ratio (a pandas UDF) and the table function name_spellings."""
    from cairn.operators.review import sequence_ratio

    for head, body in SQL_FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {head} return {body}")
    spark.udf.register("seq_ratio", sequence_ratio)
    spark.udtf.register("name_spellings", NameSpellings)


def views(persons: DataFrame, records: DataFrame, centers: DataFrame | None = None) -> None:
    """The views that the service's routes read: persons, person_ci, appearances, person_status, review, centers_visible."""
    persons.createOrReplaceTempView("persons")
    persons.select("entity", F.explode("cis").alias("ci")).createOrReplaceTempView("person_ci")
    persons.select("entity", F.explode("statuses").alias("status")).createOrReplaceTempView("person_status")
    records.createOrReplaceTempView("appearances")
    persons.filter("ci_conflict").createOrReplaceTempView("review")
    if centers is not None:
        (centers.filter("canonical_id is null") if "canonical_id" in centers.columns else centers).createOrReplaceTempView("centers_visible")
