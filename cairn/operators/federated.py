"""Checks of identities against outside sources, and centers read again from their pages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import fields, ids
from cairn.functions.text import clean, name_key, present
from cairn.operators import centers as center_ops
from cairn.operators import registry
from cairn.session import cut
from cairn.sources.readers import build_record

VARIANTS, REFETCH_MIN, PAGE_MIN = 3, 30, 180
#: a source's answer to a query: rows of a person
ANSWER = "source string, identity string, variant int, q string, nombre string, ci string, edad string, hospital string, lugar string, estado string, error string"
Search = Callable[[str, str], Iterator[dict]]


def questions(wanted: DataFrame) -> DataFrame:
    """(identity, variant, q) of wanted (ci, name): the first VARIANTS spellings to ask for. An identity needs a number or a
    name of two words: nobody is looked for by less."""
    w = wanted.filter((ids.digits("ci") != "") | (F.size(F.split(name_key("name"), " ")) >= 2))
    return w.select(ids.identity("ci", "name").alias("identity"), F.posexplode(F.slice(ids.query_variants("ci", "name"), 1, VARIANTS)).alias("variant", "q")).dropDuplicates(["identity", "variant"])


def probe(asked: DataFrame, search: Search, tries: int = 1) -> DataFrame:
    """ANSWER rows of asked (source, identity, variant, q): a source is asked for the spellings of an identity in turn,
    until one finds something. A spelling that fails gives a row with ``error``, and the next one is tried."""
    names = [c.split()[0] for c in ANSWER.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[dict] = []
        for r in pdf.sort_values("variant").to_dict("records"):
            rows: list[dict] = []
            for k in range(tries):
                try:
                    rows = list(search(r["source"], r["q"]))
                    break
                except Exception as e:  # noqa: BLE001  a source is foreign code
                    if k == tries - 1:
                        out.append({**r, "error": f"{type(e).__name__}: {e}"})
            out += [{**r, **x} for x in rows]
            if rows:
                break
        return pd.DataFrame(out, columns=names, dtype=object)

    return asked.select("source", "identity", "variant", "q").groupBy("source", "identity").applyInPandas(run, ANSWER)


def records_of(answers: DataFrame) -> DataFrame:
    """The records of a probe's answers; rows without a name are left out."""
    a = answers.filter("error is null").withColumn("who", F.upper(clean("nombre"))).filter("who <> ''")
    a = a.withColumn("uid", F.concat_ws(":", "identity", F.substring(F.sha2(F.concat_ws("|", "who", "ci", "estado", "hospital"), 256), 1, 12)))
    return build_record(a, F.col("source"), source_type=F.lit("federated"), names=F.col("who"), hospital=clean("hospital"), ci=ids.digits("ci"), age=F.trim(F.coalesce("edad", F.lit(""))), origin=clean("lugar"),
                        status=F.coalesce(present(fields.status("estado")), F.lit("por_localizar")), obs=F.concat("source", F.lit(" (federated)")))


def check(wanted: DataFrame, sources: DataFrame, ledger: DataFrame, now: Column, search: Search, minutes: int = REFETCH_MIN) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, log, new ledger rows) of the identities wanted (ci, name) at the enabled sources (id, enabled).

    What a source was asked within ``minutes`` isn't asked again. Log: (source, identity, state, found, via), state 'throttled',
    'checked' or 'failed'; the ledger (source, identity, checked_at) gets the checked ones only, so that a failure is tried again."""
    q = cut(questions(wanted))
    pairs = q.select("identity").distinct().crossJoin(F.broadcast(sources.filter("enabled").select(F.col("id").alias("source"))))
    todo = cut(registry.unchecked(pairs, ledger, now, minutes))
    answers = cut(probe(todo.join(q, "identity"), search))
    found = answers.groupBy("source", "identity").agg(F.count_if(F.col("error").isNull()).alias("found"), F.min(F.when(F.col("error").isNull(), F.col("q"))).alias("via"), F.count("error").alias("errors"))
    log = todo.join(found, ["source", "identity"], "left").select("source", "identity", F.when((F.coalesce("found", F.lit(0)) == 0) & (F.coalesce("errors", F.lit(0)) > 0), "failed").otherwise("checked").alias("state"), F.coalesce("found", F.lit(0)).alias("found"), "via")
    log = log.union(pairs.join(todo, ["source", "identity"], "left_anti").select("source", "identity", F.lit("throttled"), F.lit(0).cast("long"), F.lit(None).cast("string")))
    return records_of(answers), log, log.filter("state = 'checked'").select("source", "identity", now.alias("checked_at"))


def source_pages(centers: DataFrame) -> DataFrame:
    """The distinct (url, source) of the pages behind the centers."""
    return centers.filter(present("url").isNotNull()).select("url", F.coalesce("source", F.lit("")).alias("source")).distinct()


def due_pages(centers: DataFrame, ledger: DataFrame, now: Column, minutes: int = PAGE_MIN) -> DataFrame:
    """The pages that weren't read in the last ``minutes``."""
    p = source_pages(centers).select(F.lit("page").alias("source"), F.col("url").alias("identity"))
    return registry.unchecked(p, ledger, now, minutes).select(F.col("identity").alias("url"))


def refresh(centers: DataFrame, seen: DataFrame, now: Column) -> DataFrame:
    """Centers after their pages were read again: ``seen`` are the rows that the pages have now.

    A center is known by its name and municipality. One that is seen takes the page's contents where these aren't empty (address,
    hours, needs, phone), its tags and type anew, and is active and confirmed now; new ones are added; what vanished from its page
    stays as it was, and ages by its last_confirmed."""
    content = ("address", "hours", "needs", "phone")
    names = [c for c in ("source", "url", "name", "municipality", "operator", "ctype") if c in seen.columns]
    key = center_ops.key()
    new = seen.withColumn("ckey", key).filter(F.regexp_replace("ckey", r"\|", "") != "").withColumn("_at", F.monotonically_increasing_id())
    new = center_ops.merge_last(new, "ckey", "_at", list(content), names)
    old = centers.withColumn("ckey", key)
    j = old.alias("o").join(new.alias("n"), "ckey", "full")
    hit = F.col("n.name").isNotNull()
    pick = {c: F.coalesce(present(f"n.{c}"), F.col(f"o.{c}"), F.lit("")) for c in content} | {c: F.coalesce(present(f"o.{c}"), F.col(f"n.{c}"), F.lit("")) for c in names}
    out = j.select(*[F.col(f"o.{c}").alias(c) for c in centers.columns if c not in pick and c not in ("needs_tags", "status", "last_confirmed")], *[v.alias(c) for c, v in pick.items()], hit.alias("_hit"),
                   *[F.col(f"o.{c}").alias(f"_{c}") for c in ("needs_tags", "status", "last_confirmed")])
    out = out.withColumn("needs_tags", F.when(F.col("_hit"), fields.needs_tags("needs")).otherwise(F.col("_needs_tags"))).withColumn("status", F.when(F.col("_hit"), "active").otherwise(F.col("_status")))
    out = out.withColumn("last_confirmed", F.when(F.col("_hit"), now).otherwise(F.col("_last_confirmed"))).withColumn("ctype", F.when(F.col("_hit"), fields.center_type("name", "needs", "ctype")).otherwise(F.col("ctype")))
    return out.select(*centers.columns)
