"""Files to records: each reader on small files of its format, and the deliverables."""

import json

import pytest
from cairn.operators import skew
from cairn.sources import readers
from pyspark.sql import functions as F


@pytest.fixture(params=["plain", "uri"])
def at(request, tmp_path):
    """Paths as they are and as URIs, which a cluster's files have."""
    return lambda name: f"{'file://' if request.param == 'uri' else ''}{tmp_path / name}"


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def test_columns(spark, tmp_path, at):
    (tmp_path / "a.txt").write_text("NUM  APELLIDOS  NOMBRES  HOSPITAL\n"
                                    "  12  PEREZ MORA  ANA  12345670  30  F  PLAYA GRANDE  HOSPITAL VARGAS DE CARACAS  25/06/2026\n"
                                    "13  RUIZ  LUZ  22334451  9 M  Cruz Roja\nheading\nHOSPITAL\n14  20 meses  SOL  HOSPITAL X  CLINICA Y\n15  HOSPITAL Z\n")
    got = rows(readers.read_columns(spark, at("a.txt"), "t"), "surnames", "names", "ci", "age", "age_unit", "sex", "origin", "hospital", "date")
    assert got == [("PEREZ MORA", "ANA", "12345670", "30", "", "F", "PLAYA GRANDE", "Hospital Vargas de Caracas", "25/06/2026"),
                   ("RUIZ", "LUZ", "22334451", "9", "", "M", "", "Cruz Roja", ""),
                   ("SOL", "CLINICA Y", "", "20", "months", "", "", "HOSPITAL X", "")]
    assert readers.read_columns(spark, at("none.txt"), "t").count() == 0


def test_numbered_lines_carry_the_hospital(spark, tmp_path, at):
    (tmp_path / "r.txt").write_text("N°  HOSPITAL  APELLIDOS\n1  sala 3  ANA PAZ 40\n2  Hosp. Perez Carreño  LUIS MORA  34\n3  piso 2  EVA SOL 71\n4  Cruz Roja  TEO RIO  5 MESES\n5  x\nnota\n")
    got = rows(readers.read_numbered(spark, at("r.txt"), "r"), "full_name", "age", "hospital")
    assert got == [("ANA PAZ", "40", "sala 3"), ("LUIS MORA", "34", "Hospital Pérez Carreño"), ("EVA SOL", "71", "Hospital Pérez Carreño"), ("TEO RIO", "5", "Cruz Roja")]


def test_sections_carry_the_status(spark, tmp_path, at):
    (tmp_path / "h.txt").write_text("1  ANTES DE TODO  30\nCUADRO DE FALLECIDOS\n1  ANA PAZ  34 AÑOS  12345670  Naiguatá  trasladada  hoy\n2  LUIS MORA\nFALLECIDOS Y HERIDOS\n3  EVA SOL  22  7654321\n")
    got = rows(readers.read_sections(spark, at("h.txt"), "h", "HUC"), "full_name", "status", "age", "ci", "origin", "obs")
    assert got == [("ANTES DE TODO", "herido", "30", "", "", ""), ("ANA PAZ", "fallecido", "34", "12345670", "Naiguatá", "trasladada hoy"), ("LUIS MORA", "fallecido", "", "", "", ""), ("EVA SOL", "herido", "22", "7654321", "", "")]


def test_photographed_lists(spark, tmp_path, at):
    image = {"file": "IMG-20260625-WA1.jpg", "folder": "f1", "hospital": "", "hospital_header": "HOSP VARGAS DE CARACAS",
             "rows": [{"apellidos": "PEREZ", "nombres": "ANA", "ci": "V-12.345.670", "edad": "3 MESES", "sexo": "femenino", "estado": "fallecido"}, {"raw": "cama # 12 LUIS MORA", "estado": "estable"}, {"raw": "7"}]}
    (tmp_path / "o.json").write_text(json.dumps({"images": [image], "total_rows": 3}))
    (tmp_path / "l.json").write_text(json.dumps([image]))
    want = [("PEREZ ANA", "12345670", "3", "months", "F", "fallecido", "25/06/2026", "Hospital Vargas de Caracas"), ("LUIS MORA", "", "", "", "", "albergado", "25/06/2026", "Hospital Vargas de Caracas")]
    for name in ("o.json", "l.json"):
        assert rows(readers.read_photos(spark, at(name), {"f1": "albergado"}), "full_name", "ci", "age", "age_unit", "sex", "status", "date", "hospital") == want
    assert readers.read_photos(spark, at("none.json")).count() == 0


def test_csv_has_the_named_columns(spark, tmp_path, at):
    (tmp_path / "c.csv").write_text('full_name,ci,extra\n"Paz, Ana",123456,x\nLuis,,y\n"two\nlines",7,z\n')
    got = readers.read_csv(spark, at("c.csv"), ("full_name", "ci", "status"))
    assert got.columns == ["full_name", "ci", "status"] and sorted(rows(got, *got.columns)) == [("Luis", "", ""), ("Paz, Ana", "123456", ""), ("two\nlines", "7", "")]
    assert readers.read_csv(spark, at("none.csv")).count() == 0


def test_union_numbers_all_records(spark, tmp_path, at):
    for k, name in enumerate(("a.csv", "b.csv")):
        (tmp_path / name).write_text("full_name,ci,row_raw\n" + "".join(f"N{k}{i},,r{i:02d}\n" for i in range(30)))
    got = rows(readers.union_records(readers.read_csv(spark, at("a.csv")), readers.read_csv(spark, at("b.csv"))), "record_id", "full_name")
    assert sorted(got) == [(f"R{30 * k + i + 1:05d}", f"N{k}{i}") for k in (0, 1) for i in range(30)]


def test_people_of_one_field(spark):
    names = ["Ana Paz CI 12345670 y Luis Mora V-22334451", "Eva Sol", "Teo Rio & Ada Mar", "...", "¿?", "Luz CI 1.234.560"]
    df = spark.createDataFrame([(str(k), n, "11111110" if k in (1, 3) else None, "30", "F", "Caracas", "Catia" if k else "Caracas", "buscando", None) for k, n in enumerate(names)] + [(None,) * 7 + ("alta", "at 0: OSError")],
                               "id string, nombre string, cedula string, edad string, genero string, ciudad string, zona string, status string, error string")
    got = rows(readers.split_people(df), "uid", "full_name", "ci", "age", "origin", "status")
    assert sorted(got) == [("0", "ANA PAZ", "12345670", "", "Caracas", "por_localizar"), ("0#1", "LUIS MORA", "22334451", "", "Caracas", "por_localizar"), ("1", "EVA SOL", "11111110", "30", "Caracas / Catia", "por_localizar"),
                           ("2", "TEO RIO", "", "", "Caracas / Catia", "por_localizar"), ("2#1", "ADA MAR", "", "", "Caracas / Catia", "por_localizar"), ("3", "...", "11111110", "30", "Caracas / Catia", "por_localizar"),
                           ("5", "LUZ", "1234560", "30", "Caracas / Catia", "por_localizar")]


def test_registry_pages(spark, tmp_path):
    people = [{"id": k, "nombre": f"Ana {k}", "cedula": None, "updated": f"2024-01-0{k}"} for k in range(1, 6)]
    (tmp_path / "buscando.json").write_text(json.dumps({"total": 5, "personas": people}))
    (tmp_path / "alta.json").write_text("{broken")
    spark.dataSource.register(readers.RegistrySource)
    load = lambda **o: spark.read.format("registry").options(path=str(tmp_path), statuses="buscando,alta", page="2", wait="0", **o).load()
    ok = lambda df: df.filter("error is null")
    assert ok(load()).count() == 5 and ok(load(since="2024-01-04")).count() == 2 and ok(load(max="3")).count() == 3 and ok(load(q="ana 3")).count() == 1
    assert rows(load().filter("error is not null"), "status", "error") == [("alta", "at 0: JSONDecodeError")]
    assert readers.split_people(load()).count() == 5


def test_files_through_a_model(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one")
    (tmp_path / "b.txt").write_bytes(b"bad")
    (tmp_path / "c.md").write_bytes(b"other")

    def extract(path, content):
        if content == b"bad":
            raise ValueError("cannot read")
        yield {"text": content.decode()}

    got = sorted(rows(readers.map_files(spark, str(tmp_path), extract, "text string", "*.txt"), "text", "error"), key=str)
    assert set(got) == {("one", None), (None, "ValueError: cannot read")} and len(got) == 2
    frames = spark.createDataFrame([("v", 1, "x"), ("v", 2, "x"), ("v", 3, "y"), ("w", 9, "x")], "video string, t int, text string")
    assert sorted(rows(readers.distinct_frames(frames), "video", "t")) == [("v", 1), ("v", 3), ("w", 9)]


def test_json_of_a_model(spark):
    lines = '```json\n{"k": 1},\n{"k": 2\n{"k": 3}\n```'
    got = readers.json_lines(spark.createDataFrame([(1, lines)], "id int, text string"), "k long").collect()
    assert [r["k"] for r in got] == [1, 3]
    texts = ['```json\n{"a": 1}\n```', 'Sure: [1, 2]', '{"a": 1', "", None, '{"b": "```"}']
    out = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", readers.tolerant_json("t").alias("j")).orderBy("k").collect()
    assert [r["j"] and json.loads(r["j"]) for r in out] == [{"a": 1}, [1, 2], None, None, None, {"b": "```"}]


def test_web_rows_part_by_kind(spark):
    df = spark.createDataFrame([("s", "u", "person", "Ana", None), ("s", "u", "center", "Centro A", "calle 1"), ("s", "u", "center", "Nombre del centro", ""), ("s", "u", "center", "x", "Lorem 3")], "source string, url string, kind string, name string, address string")
    persons, centers = readers.web_rows(df)
    assert rows(persons, "name") == [("Ana",)] and rows(centers, "name", "address", "phone") == [("Centro A", "calle 1", "")] and tuple(centers.columns) == readers.CENTER


def test_names_of_a_lookup(spark):
    j = ['{"primer_nombre": "Ana", "primer_apellido": "Paz", "segundo_apellido": ""}', '{"nombres": "", "name": "Luis  Mora"}', "{", "{}"]
    out = spark.createDataFrame([(k, x) for k, x in enumerate(j)], "k int, json string").select("k", readers.names_of_json().alias("n")).orderBy("k").collect()
    assert [r["n"] for r in out] == ["Ana Paz", "Luis Mora", "", ""]


def test_positions_over_ranges(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 500).alias("k")).repartition(7)
    got = skew.positions(df, ["k"], "n").collect()
    assert sorted((r["k"], r["n"]) for r in got) == [(k, k + 1) for k in range(500)]
    assert skew.positions(df.limit(0), ["k"], "n").count() == 0


def test_pairs_of_a_hot_key(spark):
    a = spark.range(300).select(F.when(F.col("id") < 200, 0).otherwise(F.col("id")).alias("key"), F.col("id").alias("x"))
    b = a.withColumnRenamed("x", "y")
    want = sorted(map(tuple, a.join(b, "key").select("x", "y").collect()))
    for chunk in (7, 10_000):
        assert sorted((r["x"], r["y"]) for r in skew.pairs(a, b, "key", chunk).collect()) == want
