"""Text expressions: every function takes and gives columns, so that plans stay in generated code."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accents() -> tuple[str, str]:
    """Latin letters whose decomposition is one ASCII letter and marks, and those letters."""
    pairs = {}
    for k in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = "".join(x for x in unicodedata.normalize("NFKD", chr(k)) if not unicodedata.combining(x))
        if len(base) == 1 and base.isascii():
            pairs[chr(k)] = base
    return "".join(pairs), "".join(pairs.values())


_FROM, _TO = _accents()
NAME_STOPWORDS = ("DE", "DEL", "DI", "LA", "LOS", "Y")


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it: within a CASE or a lambda Spark shares nothing."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def present(x: Column | str) -> Column:
    """The empty string counts as missing."""
    return F.nullif(col(x), F.lit(""))


def strip_accents(x: Column | str) -> Column:
    return F.regexp_replace(F.translate(col(x), _FROM, _TO), r"\p{Mn}+", "")


def fold_upper(x: Column | str) -> Column:
    """Matching form: no accents, upper case, only A-Z, 0-9 and single spaces."""
    return F.trim(F.regexp_replace(F.upper(strip_accents(F.coalesce(col(x), F.lit("")))), "[^A-Z0-9]+", " "))


def fold_lower(x: Column | str) -> Column:
    """Search form: no accents, lower case, single spaces; punctuation stays."""
    return F.trim(F.regexp_replace(F.lower(strip_accents(F.coalesce(col(x), F.lit("")))), r"\s+", " "))


def clean(x: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(col(x), F.lit("")), r"\s+", " "))


def tokens(x: Column | str) -> Column:
    """Words of a folded column; none for the empty string."""
    return F.filter(F.split(col(x), " "), lambda t: t != "")


def split_variants(x: Column | str) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(col(x), F.lit("")), "/"), clean), lambda v: v != "")


def name_key(*parts: Column | str) -> Column:
    """The distinct folded words of all spellings, sorted, without particles."""
    words = F.split(fold_upper(F.concat_ws(" ", *[F.regexp_replace(F.coalesce(col(p), F.lit("")), "/", " ") for p in parts])), " ")
    return F.array_join(F.array_sort(F.array_distinct(F.filter(words, lambda t: (t != "") & ~t.isin(*NAME_STOPWORDS)))), " ")


def squeeze_repeats(x: Column | str) -> Column:
    """Drop a word that repeats the one before it, whatever the case."""
    return F.regexp_replace(clean(x), r"(?iu)(?<!\S)(\S+)(?: \1)+(?!\S)", "$1")


_SWAPS = (("v", "b"), ("b", "v"), ("s", "z"), ("z", "s"), ("y", "i"), ("j", "g"), ("ll", "y"), ("rr", "r"))


def spelling_variants(x: Column | str) -> Column:
    """A word with its usual confusions (a silent h, letter swaps), sorted."""

    def variants(t: Column) -> Column:
        silent = F.when(t.startswith("h"), F.substring(t, 2, 1 << 20)).when(F.substring(t, 1, 1).isin(*"aeiou"), F.concat(F.lit("h"), t))
        swapped = [F.when(F.contains(t, F.lit(a)), F.replace(t, F.lit(a), F.lit(b))) for a, b in _SWAPS]
        return F.array_sort(F.array_distinct(F.filter(F.array(t, silent, *swapped), lambda v: v.isNotNull() & (F.length(v) > 1))))

    return let(fold_lower(x), variants)


def name_variants(x: Column | str, most: int = 10) -> Column:
    """The name, its last two words swapped, and spellings of the last two words; the first ``most``."""

    def variants(w: Column) -> Column:
        n = F.size(w)
        swap = F.when(n >= 3, F.array_join(F.concat(F.slice(w, 1, n - 2), F.array(F.element_at(w, -1), F.element_at(w, -2))), " "))

        def respell(back: int) -> Column:
            before, after = F.slice(w, F.lit(1), n - back), F.slice(w, n - back + 2, F.lit(back - 1))
            return F.transform(spelling_variants(F.get(w, n - back)), lambda v: F.array_join(F.concat(before, F.array(v), after), " "))

        none = F.array().cast("array<string>")
        every = F.concat(F.array(F.array_join(w, " ")), F.array(swap), respell(1), F.when(n > 1, respell(2)).otherwise(none))
        return F.slice(F.array_distinct(F.filter(every, lambda v: v.isNotNull() & (v != ""))), 1, most)

    return let(F.split(clean(x), " "), variants)


def paternal_surname(x: Column | str) -> Column:
    w = F.split(clean(x), " ")
    return F.when(F.size(w) >= 2, F.element_at(w, -2)).otherwise(F.coalesce(F.get(w, F.lit(0)), F.lit("")))


def child_name(given: Column | str, father: Column | str, mother: Column | str) -> Column:
    return F.concat_ws(" ", present(clean(given)), present(paternal_surname(father)), present(paternal_surname(mother)))


def longest_spelling(x: Column | str) -> Column:
    """The longest of the spellings between ' / ', the first of equals."""
    ranked = F.transform(F.split(F.coalesce(col(x), F.lit("")), " / "), lambda p, i: F.struct(F.length(p).alias("n"), (-i).alias("i"), F.trim(p).alias("p")))
    return F.coalesce(F.array_max(ranked)["p"], F.lit(""))


def has_any(x: Column, patterns: list[str]) -> Column:
    """Whether one of the literal ``patterns`` is a part of the text."""
    return reduce(or_, [F.contains(x, F.lit(p)) for p in patterns])


def first_match(x: Column | str, rules: list[tuple[str, list[str]]], default: str | None = "") -> Column:
    """Label of the first rule that has a pattern in the text."""

    def pick(t: Column) -> Column:
        out = None
        for label, patterns in rules:
            hit = has_any(t, patterns)
            out = F.when(hit, label) if out is None else out.when(hit, label)
        return out.otherwise(F.lit(default))

    return let(col(x), pick)


def all_matches(x: Column | str, rules: list[tuple[str, list[str]]]) -> Column:
    """Labels of all rules that have a pattern in the text, in the rules' order."""
    return let(col(x), lambda t: F.array_compact(F.array(*[F.when(has_any(t, patterns), label) for label, patterns in rules])))


def estimated_tokens(text: Column | str, images: Column | int = 0, output: Column | int = 0) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.least(F.lit(100_000), F.floor(F.length(col(text)) / 4) + as_col(images) * 1100 + as_col(output)).cast("int")
