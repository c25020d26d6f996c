"""Ages, dates, statuses, labels and tags of person and center records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.functions.text import all_matches, col, first_match, fold_lower, fold_upper, present

#: canonical label: patterns in folded text. The first rule that fits holds.
FACILITIES = [
    ("Hospital Pérez Carreño", ["PEREZ CARRENNO", "PEREZ CARRENO"]),
    ("Hospital Domingo Luciani (El Llanito)", ["LLANITO", "LUCIANI"]),
    ("Hospital José María Vargas (La Guaira)", ["VARGAS LA GUAIRA", "JOSE MARIA VARGAS"]),
    ("Hospital Vargas de Caracas", ["VARGAS DE CARACAS"]),
    ("Hospital Universitario de Caracas (HUC)", ["HUC", "UNIVERSITARIO"]),
    ("Hospital Ricardo Baquero González (Periférico de Catia)", ["PERIFERICO CATIA", "PERIFERICO DE CATIA", "BAQUERO GONZALEZ", "RICARDO BAQUERO"]),
    ("Hospital J.M. de los Ríos (Niños)", ["DE NINOS", "DE LOS RIOS"]),
    ("Cruz Roja", ["CRUZ ROJA"]),
]

#: what a center asks for: fragments in folded lower-case text
NEEDS = [
    ("agua", "agua"),
    ("alimentos", "mercado granos viver comida aliment enlatad perecedero"),
    ("medicinas", "farmac medicina insulina medicament antibiotic tratamiento"),
    ("insumos_medicos", "gasa suero guantes insumo jeringa vendaje quirurg material_medico"),
    ("higiene", "aseo cloro jabon papel toalla cepillo higiene desinfect"),
    ("panales", "panal femenin toallas_sanitarias"),
    ("bebes", "leche bebe formula lactante"),
    ("ropa", "abrigo ropa zapato calzado vestiment"),
    ("colchones_cobijas", "cama manta cobija sabana colchon almohada"),
    ("refugio", "carpa refugio albergue alojamiento"),
    ("herramientas", "bota pala pico saco cuerda linterna marcador herramienta"),
    ("combustible", "diesel gasoil gasolina generador combustible planta_electric"),
    ("voluntarios", "voluntari"),
    ("dinero", "zelle dinero monetar efectivo transferencia donacion_en"),
    ("mascotas", "gato perro animal mascota veterinar"),
]
NEEDS = [(tag, [w.replace("_", " ") for w in words.split()]) for tag, words in NEEDS]
CENTER_TYPES = [("refugio", ["albergue", "damnificad", "refugio"]), ("hub", ["distribu", "logistic", "almacen"])]
STATUS_RULES = [
    ("por_localizar", ["buscando", "desaparecid", "localizar"]),
    ("localizado", ["encontrad", "localizad", "salvo"]),
    ("fallecido", ["muert", "fallecid"]),
    ("ingresado", ["hospital", "ingres"]),
]
STATUS_ORDER = ("fallecido", "ingresado", "herido", "localizado", "alta", "por_localizar")
STATUS_WORDS = {"fallecido": "fallecido/a", "ingresado": "ingresado/a en un hospital", "herido": "herido/a", "albergado": "en un refugio", "alta": "dado/a de alta", "localizado": "localizado/a", "por_localizar": "por localizar"}
PLACEHOLDERS = ("demo", "lorem", "ejemplo", "example", "plantilla", "placeholder", "tu nombre", "nombre del centro")
VAGUE = ("n/a", "no se sabe", "no especific", "no indicada", "no indicado", "desconocid", "se desconoce", "sin informacion")


def canonical_facility(x: Column | str) -> Column:
    return first_match(fold_upper(x), FACILITIES)


def looks_like_facility(x: Column | str) -> Column:
    return F.coalesce(col(x).rlike("(?iu)hosp|hopital|cl[ií]nica|cruz roja|de los rios|de ni[nñ]os|perif[eé]rico"), F.lit(False))


def needs_tags(x: Column | str) -> Column:
    return all_matches(fold_lower(x), NEEDS)


def center_type(name: Column | str, needs: Column | str, kind: Column | str) -> Column:
    return first_match(fold_lower(F.concat_ws(" ", col(name), col(needs), col(kind))), CENTER_TYPES, "acopio")


def status(x: Column | str) -> Column:
    low = F.lower(F.coalesce(col(x), F.lit("")))
    return F.coalesce(first_match(low, STATUS_RULES, None), low)


def primary_status(statuses: Column | str) -> Column:
    known = F.filter(F.array(*[F.lit(s) for s in STATUS_ORDER]), lambda s: F.array_contains(col(statuses), s))
    return F.coalesce(F.get(known, F.lit(0)), F.get(col(statuses), F.lit(0)), F.lit("?"))


def status_in_words(statuses: Column | str) -> Column:
    out = None
    for s, words in STATUS_WORDS.items():
        hit = F.array_contains(col(statuses), s)
        out = F.when(hit, words) if out is None else out.when(hit, words)
    return out.otherwise(F.coalesce(F.get(col(statuses), F.lit(0)), F.lit("desconocido")))


def is_placeholder(*fields: Column | str) -> Column:
    return F.lower(F.concat_ws(" ", *[col(f) for f in fields])).rlike("|".join(PLACEHOLDERS))


def is_vague(origin: Column | str) -> Column:
    f = fold_lower(origin)
    return (f == "") | f.rlike("|".join(VAGUE))


def sex(x: Column | str) -> Column:
    f = fold_upper(x)
    return F.when(f.isin("M", "F"), f).otherwise("")


def age(x: Column | str) -> Column:
    """struct(value, unit): the first one to three digits; months, years or ''."""
    f = fold_upper(x)
    value = F.regexp_extract(f, r"(\d{1,3})", 1)
    unit = F.when(value == "", "").when(f.rlike(r"MESES|\bMES\b"), "months").when(F.contains(f, F.lit("ANO")), "years").otherwise("")
    return F.struct(value.alias("value"), unit.alias("unit"))


def age_years(value: Column | str, unit: Column | str | None = None) -> Column:
    years = F.when(col(value).rlike("^[0-9]+$"), col(value).try_cast("int"))
    return years if unit is None else F.when(col(unit) == "months", F.lit(0)).otherwise(years)


def ages_fit(a: Column | str, b: Column | str, years: int = 1) -> Column:
    return F.coalesce(F.abs(col(a) - col(b)) <= years, F.lit(True))


def find_date(x: Column | str) -> Column:
    return F.regexp_replace(F.regexp_extract(F.coalesce(col(x), F.lit("")), r"\d{1,2}\s*/\s*\d{1,2}\s*/\s*\d{2,4}", 0), " ", "")


def date_of_file(name: Column | str) -> Column:
    """dd/mm/yyyy from a file name that holds yyyy-mm-dd or -yyyymmdd-."""
    n = col(name)
    long = F.regexp_extract(n, r"(\d{4}-\d{2}-\d{2})", 1)
    short = F.regexp_extract(n, r"-(\d{8})-", 1)
    return F.coalesce(F.regexp_replace(present(long), r"(\d{4})-(\d{2})-(\d{2})", "$3/$2/$1"), F.regexp_replace(present(short), r"(\d{4})(\d{2})(\d{2})", "$3/$2/$1"), F.lit(""))


def freshness(confirmed: Column | str, now: Column) -> Column:
    micros = lambda t: F.unix_micros(t.cast("timestamp"))  # noqa: E731  whole seconds would end an hour early
    hours = F.floor((micros(now) - micros(col(confirmed))) / 3_600_000_000)
    return (
        F.when(hours.isNull(), "sin confirmar")
        .when(hours < 48, F.concat(F.lit("confirmado hace "), hours.cast("string"), F.lit("h")))
        .otherwise(F.concat(F.lit("sin confirmar hace "), F.floor(hours / 24).cast("string"), F.lit("d")))
    )


def json_list(x: Column | str) -> Column:
    """A JSON array of strings; none if it is missing or can't be read."""
    return F.coalesce(F.from_json(col(x), "array<string>"), F.array().cast("array<string>"))


def merge_lists(old: Column | str, new: Column | str) -> Column:
    return F.array_union(col(old), F.filter(col(new), lambda x: x.isNotNull() & (x != "")))


def jaccard(a: Column | str, b: Column | str) -> Column:
    union = F.size(F.array_union(col(a), col(b)))
    return F.when(union > 0, F.size(F.array_intersect(col(a), col(b))) / union).otherwise(F.lit(0.0))


def overlap(a: Column | str, b: Column | str) -> Column:
    return F.size(F.array_intersect(col(a), col(b))) / F.greatest(F.lit(1), F.least(F.size(col(a)), F.size(col(b))))
