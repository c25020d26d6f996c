"""Readers of the raw sources. Each gives the columns of RECORD; a source that isn't there gives no rows."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cairn.functions import fields, ids
from cairn.functions.text import clean, fold_upper, name_key, present
from cairn.operators import skew
from cairn.operators.registry import STATUSES
from cairn.session import exists

RECORD = ("source", "source_type", "hospital", "surnames", "names", "full_name", "name_key", "ci", "age", "age_unit", "sex", "origin", "status", "obs", "date", "row_raw")
CENTER = ("source", "url", "name", "ctype", "address", "municipality", "hours", "needs", "phone", "operator")


def build_record(df: DataFrame, source: str | Column, **given: Column) -> DataFrame:
    """RECORD columns (and ``line`` or ``uid`` where there is one) from the given expressions, with defaults and derived names."""
    src = F.lit(source) if isinstance(source, str) else source
    get = lambda c: F.coalesce(given.get(c, F.lit("")), F.lit(""))
    out = df.select(*[c for c in ("line", "uid") if c in df.columns], src.alias("source"), *[get(c).alias(c) for c in RECORD if c not in ("source", "name_key", "full_name", "hospital")], get("hospital").alias("_h"), get("full_name").alias("_f"))
    full = F.coalesce(present("_f"), F.concat_ws(" ", present("surnames"), present("names")))
    key = F.when(F.concat_ws("", "surnames", "names") != "", name_key("surnames", "names")).otherwise(name_key("_f"))
    hospital = F.coalesce(present(fields.canonical_facility("_h")), F.col("_h"))
    return out.withColumns({"full_name": clean(full), "name_key": key, "hospital": hospital}).select(*[c for c in ("line", "uid") if c in out.columns], *RECORD)


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) in the order of the files. A file is read whole, as its lines depend on the ones before."""
    if not exists(spark, path):
        return spark.createDataFrame([], "file string, line int, value string")
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "value"))
    return whole


def columns_of(line: Column | str) -> Column:
    """The parts of a line that two or more spaces part."""
    return F.filter(F.transform(F.split(F.trim(line), r"\s{2,}"), lambda x: F.trim(x)), lambda x: x != "")


def read_columns(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Lines of columns two or more spaces apart. The first rule that fits says what a column is: hospital,
    number, sex, age, age with unit, or text; texts are surnames, names and origin in turn."""
    rows = lines_of(spark, path).filter(fields.looks_like_facility("value") & ~F.col("value").rlike(r"APELLIDOS|^\s*NUM"))
    rows = rows.withColumn("t", columns_of("value")).filter(F.size("t") >= 2)
    kind = lambda x, i: (
        F.when(fields.looks_like_facility(x), "hospital").when(ids.looks_like_id(x), "ci").when(x.rlike("^[MFmf]$"), "sex")
        # a bare number at the head of a line is its number in the list, not an age
        .when(x.rlike(r"^\d{1,3}$"), F.when(i > 0, "age").otherwise("")).when(x.rlike(r"(?iu)^\d{1,3}\s*(a[nñ]os?|mes|meses|[mf])$"), "age").when(fields.find_date(x) != "", "date").when(x.rlike(r"\p{L}"), "text").otherwise("")
    )
    rows = rows.withColumn("k", F.transform("t", kind))
    # of each kind the first; another column of letters is text
    rows = rows.withColumn("k", F.transform("k", lambda k, i: F.when((k == "text") | (F.array_position("k", k) == i + 1), k).when(F.get("t", i).rlike(r"\p{L}") & (k != "date"), "text").otherwise("")))
    of = lambda name: F.filter("t", lambda x, i: F.get("k", i) == name)
    first = lambda name: F.get(of(name), F.lit(0))
    age, text = fields.age(first("age")), of("text")
    sex = F.coalesce(first("sex"), present(F.regexp_extract(F.coalesce(first("age"), F.lit("")), "(?i)[0-9] *([MF])$", 1)))
    out = build_record(rows, source, source_type=F.lit("text"), hospital=first("hospital"), surnames=F.get(text, F.lit(0)), names=F.get(text, F.lit(1)), origin=F.array_join(F.slice(text, 3, 1 << 20), " "),
                       ci=ids.digits(first("ci")), sex=F.upper(sex), age=age["value"], age_unit=age["unit"], date=fields.find_date("value"), row_raw=F.trim("value"))
    return out.filter("surnames <> '' or ci <> ''")


def forward_fill(value: Column, within: str = "file", by: str = "line") -> Column:
    return F.last(value, ignorenulls=True).over(Window.partitionBy(within).orderBy(by).rowsBetween(Window.unboundedPreceding, 0))


def read_numbered(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Numbered lines 'n  hospital  name  age': a hospital that a line names by a known label holds for the lines
    after it that don't; before any, the line's own words stand. Without a column of its own the age may end the name."""
    rows = lines_of(spark, path).withColumn("body", F.regexp_extract(F.trim("value"), r"^\d+\s+(.*)$", 1))
    rows = rows.withColumn("t", columns_of("body")).filter(F.size("t") > 0).withColumn("raw", F.get("t", F.lit(0)))
    own = present(fields.canonical_facility("raw"))
    rows = rows.withColumn("hospital", F.coalesce(own, forward_fill(own), clean("raw")))
    n, last = F.size("t"), F.element_at("t", -1)
    column = (n >= 3) & fold_upper(last).rlike(r"^\d{1,3}( ?(ANOS|MESES))?$")
    words = F.array_join(F.slice("t", 2, F.greatest(F.lit(0), F.when(column, n - 2).otherwise(n - 1))), " ")
    rows = rows.withColumn("words", words).withColumn("age", F.when(column, F.regexp_extract(last, r"^\d{1,3}", 0)).otherwise(F.regexp_extract("words", r"\s(\d{1,3})\s*$", 1)))
    name = clean(F.when(column | (F.col("age") == ""), F.col("words")).otherwise(F.regexp_replace("words", r"\s\d{1,3}\s*$", "")))
    rows = rows.withColumn("who", name).filter("who <> ''")
    return build_record(rows, source, source_type=F.lit("registro"), hospital=F.col("hospital"), surnames=F.col("who"), age=F.col("age"), row_raw=F.trim("value"))


def read_sections(spark: SparkSession, path: str, source: str, hospital: str) -> DataFrame:
    """Numbered lines under headings that say the status: deceased, or injured, which wins where a line says
    both and holds before any heading. A line is its name, then an age, a number, an origin and notes in any order."""
    folded = fold_upper("value")
    said = F.when(folded.rlike("HERIDOS|LESIONADOS"), "herido").when(F.contains(folded, F.lit("FALLECID")), "fallecido")
    rows = lines_of(spark, path).withColumn("status", F.coalesce(forward_fill(said), F.lit("herido")))
    rows = rows.withColumn("t", columns_of(F.regexp_extract(F.trim("value"), r"^\d+\s+(.*)$", 1))).filter(F.size("t") > 0)
    kind = lambda x: (
        F.when(x.rlike(r"^\d{1,3}$") | (x.rlike(r"\d") & F.contains(fold_upper(x), F.lit("ANOS"))), "age")
        .when(ids.looks_like_id(x), "ci").when(x.rlike("[A-Za-z]"), "text").otherwise("")
    )
    rows = rows.withColumn("k", F.transform(F.slice("t", 2, 1 << 20), lambda x: F.struct(kind(x).alias("k"), x.alias("x"))))
    of = lambda name: F.transform(F.filter("k", lambda s: s["k"] == name), lambda s: s["x"])
    text = of("text")
    return build_record(rows, source, source_type=F.lit("huc"), hospital=F.lit(hospital), surnames=F.get("t", F.lit(0)), ci=ids.digits(F.get(of("ci"), F.lit(0))), age=fields.age(F.get(of("age"), F.lit(0)))["value"],
                        origin=F.get(text, F.lit(0)), obs=F.array_join(F.slice(text, 2, 1 << 20), " "), status=F.col("status"), row_raw=F.trim("value"))


def union_records(*frames: DataFrame) -> DataFrame:
    """All records in the order of their sources, numbered R00001..."""
    out = frames[0].withColumn("_s", F.lit(0))
    for k, f in enumerate(frames[1:], 1):
        out = out.unionByName(f.withColumn("_s", F.lit(k)), allowMissingColumns=True)
    for c in RECORD:
        out = out.withColumn(c, F.coalesce(c, F.lit("")))
    order = ["_s", *[c for c in ("line",) if c in out.columns], "row_raw", "full_name", "ci", *[c for c in RECORD if c not in ("row_raw", "full_name", "ci")]]
    return skew.positions(out, order, "_n").withColumn("record_id", F.format_string("R%05d", "_n")).drop("_s", "_n")


_ROW = "array<struct<raw:string,apellidos:string,nombres:string,ci:string,edad:string,sexo:string,cama:string,direccion:string,observacion:string,estado:string>>"
PHOTOS = f"images array<struct<file:string,folder:string,hospital:string,hospital_header:string,list_kind:string,rows:{_ROW}>>"


def read_photos(spark: SparkSession, path: str, folder_status: dict[str, str] | None = None) -> DataFrame:
    """Photographed lists: JSON of images, each of rows. The root may be the list of images itself."""
    if not exists(spark, path):
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in RECORD))
    text = spark.read.text(path, wholetext=True)
    image = F.coalesce(F.from_json("value", PHOTOS)["images"], F.from_json("value", PHOTOS.removeprefix("images ")))
    r = text.select(F.explode(image).alias("i")).select("i.*").select("file", "folder", F.coalesce(present("hospital"), "hospital_header").alias("place"), F.explode("rows").alias("r"))
    raw = clean(F.regexp_replace(F.coalesce("r.raw", F.lit("")), r"(?i)^\s*(?:(?:cama\s*)?#?\s*)?\d+\s*", ""))
    default = F.coalesce(F.create_map(*[F.lit(x) for kv in (folder_status or {"_": "ingresado"}).items() for x in kv])[F.col("folder")], F.lit("ingresado"))
    said = fields.status("r.estado")
    a = fields.age("r.edad")
    bare = (clean("r.apellidos") == "") & (clean("r.nombres") == "")
    return build_record(r, F.concat(F.lit("photos:"), F.coalesce("folder", F.lit(""))), source_type=F.lit("photo"), hospital=F.col("place"), surnames=F.when(bare, raw).otherwise(clean("r.apellidos")), names=clean("r.nombres"),
                        ci=ids.digits("r.ci"), age=a["value"], age_unit=a["unit"], sex=fields.sex(F.substring(F.trim("r.sexo"), 1, 1)), origin=clean("r.direccion"),
                        status=F.when(said.isin(*STATUSES), said).otherwise(default), obs=clean("r.observacion"), date=fields.date_of_file("file"), row_raw=F.col("r.raw")).filter("name_key <> ''")


def read_csv(spark: SparkSession, path: str, columns: tuple[str, ...] = RECORD) -> DataFrame:
    """A CSV of the named columns, whichever of them it has; no rows if there is no file."""
    if not exists(spark, path):
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in columns))
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return raw.select(*[F.coalesce(raw[c], F.lit("")).alias(c) if c in raw.columns else F.lit("").alias(c) for c in columns])


def json_lines(texts: DataFrame, schema: str, column: str = "text") -> DataFrame:
    """Objects of a text that has one on a line; fences, cut-off lines and whatever can't be read are left out."""
    keys = [c for c in texts.columns if c != column]
    line = texts.select(*keys, F.explode(F.split(column, "\n")).alias("_l")).withColumn("_l", F.regexp_replace(F.trim("_l"), "^`+|[`,]+$", ""))
    parsed = line.filter(F.col("_l").startswith("{") & F.col("_l").endswith("}")).withColumn("_j", F.try_parse_json("_l")).filter("_j is not null")
    return parsed.select(*keys, F.from_json("_l", schema).alias("j")).filter("j is not null").select(*keys, "j.*")


def web_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (source, url, kind, ...) of web pages as persons and centers, without placeholders."""
    centers = rows.filter("kind = 'center'").filter(~fields.is_placeholder("name", "address"))
    return rows.filter("kind = 'person'"), centers.select(*[F.coalesce(c, F.lit("")).alias(c) if c in rows.columns else F.lit("").alias(c) for c in CENTER])


def page_rows(pages: DataFrame) -> DataFrame:
    """(page_id, host, title, heading, links, placeholder) of raw pages, by expressions alone."""
    title = F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)
    return pages.select(
        "page_id", F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"), title.alias("title"), F.regexp_extract("html", r"(?is)<h1>(.*?)</h1>", 1).alias("heading"),
        F.regexp_count("html", F.lit(r"(?i)<a href=")).cast("long").alias("links"), fields.is_placeholder(title).alias("placeholder"))


def tolerant_json(text: Column | str) -> Column:
    """The JSON of a model's answer as text: without a code fence, from its first bracket on; null if it can't be read."""
    t = F.trim(F.regexp_replace(F.trim(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))), r"(?s)^`+(?:json)?\s*(.*?)`*$", "$1"))
    body = F.regexp_extract(t, r"(?s)[\[{].*$", 0)
    return F.when(F.try_parse_json(F.when(body != "", body)).isNotNull(), body)


def map_files(spark: SparkSession, path: str, extract: Callable[[str, bytes], Iterator[dict]], schema: str, pattern: str = "*", tries: int = 2) -> DataFrame:
    """Rows that ``extract`` (an OCR, a transcriber, a model) makes of each file, with ``file`` and ``error``. A file
    that fails ``tries`` times gives one row, empty but for these two."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in schema.split(",")] + ["file", "error"]
        for b in batches:
            out = []
            for at, content in zip(b["path"], b["content"]):
                for k in range(tries):
                    try:
                        out += [{**r, "file": at} for r in extract(at, content)]
                        break
                    except Exception as e:  # noqa: BLE001  foreign code; one bad file mustn't end the run
                        if k == tries - 1:
                            out.append({"file": at, "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(out, columns=names, dtype=object)

    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content").mapInPandas(run, f"{schema}, file string, error string")


def distinct_frames(frames: DataFrame) -> DataFrame:
    """frames (video, t, text): one of each text of a video, the earliest."""
    w = Window.partitionBy("video", F.substring(F.sha2("text", 256), 1, 12)).orderBy("t")
    return frames.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def names_of_json(c: str = "json") -> Column:
    """A person's name from a lookup's answer: four name parts, else the first of the usual keys."""
    get = lambda k: F.get_json_object(c, f"$.{k}")
    parts = F.concat_ws(" ", *[present(get(k)) for k in ("primer_nombre", "segundo_nombre", "primer_apellido", "segundo_apellido")])
    return clean(F.coalesce(present(parts), *[present(get(k)) for k in ("nombre_completo", "nombre", "nombres", "name")], F.lit("")))


def split_people(rows: DataFrame) -> DataFrame:
    """rows (id, nombre, cedula, edad, genero, ciudad, zona, status) of a registry API as records; a name
    field of several people gives one each, all but the first with the id '#k', and age and sex only where it is one.
    Rows with an ``error`` of the source are left out, as are names without a word, unless they are one person with a number."""
    rows = rows.filter("error is null") if "error" in rows.columns else rows
    many = F.filter(F.transform(F.split("nombre", r"(?i)\s+(?:y|e)\s+|\s*[/&]\s*"), lambda x: F.trim(x)), lambda x: x != "")
    people = F.when(ids.is_multi("nombre") | F.col("nombre").rlike("[/&]"), many).otherwise(F.array(F.coalesce("nombre", F.lit(""))))
    r = rows.withColumn("n", F.size(people)).select("*", F.posexplode(people).alias("k", "who"))
    solo = F.col("n") == 1
    key = F.col("id").cast("string")
    r = r.withColumn("uid", F.when(F.col("k") == 0, key).otherwise(F.concat_ws("#", key, F.col("k").cast("string"))))
    found = F.get(ids.find_ids("who", ids.IN_NAMES), F.lit(0))
    number = F.coalesce(F.when(solo, present(ids.digits("cedula"))), found)
    place = F.concat_ws(" / ", present(clean("ciudad")), F.when(clean("zona") != clean("ciudad"), present(clean("zona"))))
    a = fields.age(F.when(solo, F.col("edad").cast("string")))
    r = r.filter(~ids.is_junk(ids.strip_ids("who")) | (solo & number.isNotNull()))
    return build_record(r, "registry", source_type=F.lit("api"), full_name=F.upper(ids.strip_ids("who")), ci=number, age=a["value"], age_unit=a["unit"], sex=F.when(solo, fields.sex(F.substring(F.trim("genero"), 1, 1))), origin=place,
                        status=fields.status(F.coalesce("status", F.lit("buscando"))), obs=F.concat(F.lit("id="), "uid"), row_raw=F.substring("zona", 1, 120))


SOURCE = "id string, kind string, path string, urls array<string>, statuses array<string>, refresh_url string, entity string, cadence_min int, enabled boolean, notes string"


def source_list(text: str) -> list[dict]:
    """The entries of a source registry in YAML: a list of flat maps whose values are scalars or lists."""

    def scalar(v: str):
        v = v.strip()
        if v[:1] in "\"'" and v[-1:] == v[:1] and len(v) > 1:
            return v[1:-1]
        v = re.sub(r"\s+#.*$", "", v)
        return {"true": True, "false": False, "null": None, "~": None, "": None}.get(v.lower(), int(v) if re.fullmatch(r"-?\d+", v) else v)

    out: list[dict] = []
    name, deep = None, 0
    for line in text.splitlines():
        body = line.strip()
        indent = len(line) - len(line.lstrip())
        if not body or body.startswith("#"):
            continue
        if body.startswith("- ") and name and indent > deep:  # an item of a list value
            out[-1][name] = [*(out[-1][name] or []), scalar(body[2:])]
            continue
        if body.startswith("- "):
            out.append({})
            body, indent = body[2:].strip(), indent + 2
        key, colon, value = body.partition(":")
        if not colon or not out:
            continue
        name, deep, value = key.strip(), indent, value.strip()
        items = re.sub(r"\s+#.*$", "", value)
        out[-1][name] = [scalar(x) for x in items[1:-1].split(",") if x.strip()] if items[:1] == "[" and items[-1:] == "]" else scalar(value)
    return out


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """The source registry (SOURCE) of a YAML or JSON file, a small dimension; sources are enabled unless they say no."""
    if not exists(spark, path):
        return spark.createDataFrame([], SOURCE)
    text = spark.read.text(path, wholetext=True).first()[0]
    entries = json.loads(text) if text.lstrip()[:1] in "[{" else source_list(text)
    entries = entries.get("sources", []) if isinstance(entries, dict) else entries
    names = [c.split()[0] for c in SOURCE.split(", ")]
    listed = lambda v: v if isinstance(v, list) or v is None else [v]
    rows = [tuple(listed(e.get(c)) if c in ("urls", "statuses") else e.get(c) for c in names) for e in entries]
    return spark.createDataFrame(rows, SOURCE).withColumn("enabled", F.coalesce("enabled", F.lit(True)))


class RegistrySource(DataSource):
    """``spark.read.format("registry")``: pages of a registry API, a partition for each status.

    Options: path (a folder of <status>.json files, each {"total", "personas"}), statuses (comma-separated),
    since (ISO time, rows changed later), q (words of a name), page (rows a page), max (rows a status).
    retries (of a page, 2 by default) and wait (seconds before the first, doubled by each). A page that still fails ends its
    status with a row that holds only ``status`` and ``error``. A fetcher over HTTP takes the same place by
    ``RegistryReader.fetch``."""

    @classmethod
    def name(cls) -> str:
        return "registry"

    def schema(self) -> str:
        return "id string, nombre string, cedula string, edad string, genero string, ciudad string, zona string, updated string, status string, error string"

    def reader(self, schema) -> RegistryReader:
        return RegistryReader(dict(self.options))


class RegistryReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(s) for s in self.options.get("statuses", "buscando").split(",")]

    def fetch(self, status: str, offset: int, size: int) -> dict:
        """One page; the server applies ``since`` and ``q``."""
        with open(f"{self.options['path']}/{status}.json") as f:
            rows = json.load(f)["personas"]
        since, q = self.options.get("since", ""), self.options.get("q", "").lower()
        rows = [r for r in rows if str(r.get("updated") or "") >= since and q in str(r.get("nombre") or "").lower()]
        return {"total": len(rows), "personas": rows[offset : offset + size]}

    def page(self, status: str, offset: int, size: int) -> dict:
        wait = float(self.options.get("wait", 0.5))
        for k in range(int(self.options.get("retries", 2)), -1, -1):
            try:
                return self.fetch(status, offset, size)
            except (OSError, ValueError):
                if not k:
                    raise
                time.sleep(wait)
                wait *= 2
        raise AssertionError

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        status, seen = partition.value, 0
        most, size = int(self.options.get("max", 1 << 60)), int(self.options.get("page", 100))
        while seen < most:
            try:
                page = self.page(status, seen, size)
            except (OSError, ValueError) as e:  # a status that fails doesn't end the others
                yield (*[None] * 8, status, f"at {seen}: {type(e).__name__}")
                return
            rows = page.get("personas") or []
            if not rows:
                return
            for r in rows[: most - seen]:
                yield tuple(None if r.get(c) is None else str(r[c]) for c in ("id", "nombre", "cedula", "edad", "genero", "ciudad", "zona", "updated")) + (status, None)
            seen += len(rows)
            if seen >= page.get("total", seen):
                return
