"""The batch run: sources, resolution, summary, review, deliverables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators import resolve, review
from cairn.session import cut


def build(records: DataFrame) -> dict[str, DataFrame]:
    """records with record_id -> entities (with person_id), records with person_id, and review pairs."""
    entities = cut(resolve.resolve(records))
    found = resolve.numbered(resolve.summarize(records, entities, resolve.matches(records)))
    found = cut(found)
    backfilled = records.join(entities, "record_id", "left").join(found.select("entity", "person_id"), "entity", "left").withColumn("person_id", F.coalesce("person_id", F.lit("")))
    return {"persons": found, "records": backfilled, "pairs": review.possible_same(found)}


def write(out: dict[str, DataFrame], folder: str) -> None:
    """Persons as JSON, records as CSV of fixed columns, the review report as text, the search page's documents."""
    out["persons"].write.mode("overwrite").json(f"{folder}/persons")
    columns = [c for c in ("record_id", "person_id", "source", "display_name", "name_key", "ci", "age", "status", "origin", "hospital") if c in out["records"].columns]
    out["records"].select(columns).write.mode("overwrite").csv(f"{folder}/records", header=True)
    lines = review.report(out["persons"], out["pairs"], out["records"]).orderBy("section", "line")
    lines.select(F.concat_ws(": ", "section", "line").alias("value")).write.mode("overwrite").text(f"{folder}/review")
    search_documents(out["persons"]).write.mode("overwrite").text(f"{folder}/search")
    page(out["persons"]).coalesce(1).write.mode("overwrite").text(f"{folder}/page")


def search_documents(persons: DataFrame) -> DataFrame:
    """One short-keyed JSON document a person, for a client-side search page."""
    short = F.struct(
        F.col("person_id").alias("id"), F.col("display_name").alias("n"), F.col("cis").alias("ci"), F.col("ages").alias("a"), F.col("hospitals").alias("h"), F.col("origins").alias("o"), F.col("statuses").alias("s"),
        F.transform("appearances", lambda x: F.struct(x["source"].alias("f"), x["status"].alias("s"), x["hospital"].alias("h"))).alias("ap"),
    )
    return persons.select(F.to_json(short).alias("value"))


def page(persons: DataFrame, title: str = "Buscador") -> DataFrame:
    """The search page as lines (value): one self-contained document with the people in it."""
    docs = persons.withColumn("person_id", F.col("person_id")).orderBy("name_key", "entity")
    body = search_documents(docs).select(F.concat(F.regexp_replace("value", "<", r"\\u003c"), F.lit(",")).alias("value"))
    spark = persons.sparkSession
    head = ["<!doctype html><meta charset=utf-8><title>" + title + "</title><input id=q autofocus><ol id=r></ol><script>const P=["]
    tail = ["];const f=s=>s.normalize('NFD').replace(/[\u0300-\u036f]/g,'').toUpperCase();", "q.oninput=()=>{const w=f(q.value).split(' ').filter(Boolean);r.innerHTML='';for(const p of P.filter(p=>w.every(t=>f(p.n+' '+p.ci).includes(t))).slice(0,80)){const li=document.createElement('li');li.textContent=[p.n,p.ci.join(', '),p.s.join(', '),p.h.join(', ')].join(' | ');r.append(li)}}</script>"]
    lines = lambda k, x: spark.createDataFrame([(k, n, v) for n, v in enumerate(x)], "part int, n long, value string")
    people = body.withColumn("n", F.monotonically_increasing_id()).select(F.lit(1).alias("part"), "n", "value")
    return lines(0, head).union(people).union(lines(2, tail)).orderBy("part", "n").select("value")
