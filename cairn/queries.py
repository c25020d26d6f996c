"""The registered queries of the registry operators, each with the DuckDB SQL that it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions import fields, ids
from cairn.functions import text as T
from cairn.functions.geo import haversine_km, inside
from cairn.functions.register import register
from cairn.operators import centers, federated, geo, households, registry, resolve, review, search
from cairn.plans.question import answer
from cairn.session import cut, table
from cairn.sources import readers
from cairn.sources.views import ctes, view
from cairn.streaming.state import tumbling

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
NOW = "2024-02-01 00:00:00"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


UPPER = "trim(regexp_replace(upper(strip_accents(replace({0}, 'ß', 'ss'))), '[^A-Z0-9]+', ' ', 'g'))"
LOWER = r"trim(regexp_replace(lower(strip_accents({0})), '\s+', ' ', 'g'))"
TOKENS = "list_filter(list_distinct(string_split({0}, ' ')), lambda t: t <> '')"
KM = "2 * 6371e0 * asin(sqrt(pow(sin(radians({2} - {0}) / 2), 2) + cos(radians({0})) * cos(radians({2})) * pow(sin(radians({3} - {1}) / 2), 2)))"
REACH = """reach(id, root) as (
  select id, id from (select a id from links union select b from links)
  union
  select case when l.a = r.id then l.b else l.a end, r.root from reach r join links l on l.a = r.id or l.b = r.id where r.root <= (case when l.a = r.id then l.b else l.a end)
), roots as (select id, min(root) root from reach group by id)"""


# ---------------------------------------------------------------- text

@query(f"select doc_id, {UPPER.format('text')} as folded from documents")
def fold_documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.fold_upper("text").alias("folded"))


@query(f"select doc_id, {LOWER.format('text')} as folded from documents")
def fold_lower_documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.fold_lower("text").alias("folded"))


@query(r"""select p_partkey, array_to_string(list_sort(list_distinct(list_filter(string_split(w, ' '), lambda t: t <> '' and t not in ('DE','DEL','DI','LA','LOS','Y')))), ' ') as name_key,
  cast(len(list_filter(list_transform(string_split(p_name || '/ ' || p_type, '/'), lambda v: trim(v)), lambda v: v <> '')) as integer) as spellings
from (select p_partkey, p_name, p_type, trim(regexp_replace(upper(p_name || ' ' || p_type || ' de la ' || p_brand), '[^A-Z0-9]+', ' ', 'g')) w from part)""")
def name_key_parts(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", T.name_key("p_name", F.concat("p_type", F.lit(" de la "), "p_brand")).alias("name_key"), F.size(T.split_variants(F.concat("p_name", F.lit("/ "), "p_type"))).alias("spellings"))


_FACILITY_OF = ["Hosp. Perez Carreño", "clinica El Llanito", "VARGAS DE LA GUAIRA", "Jose Maria Vargas, La Guaira", "h.u.c.", "Hospital Universitario", "Cruz  Roja", "Niños J.M. de los Ríos", "plaza"]


@query(rf"""with t as (select p_partkey, p_name || ' ' || {_FACILITY_OF}[cast(p_partkey % 9 as integer) + 1] || ' ' || p_type raw from part), f as (select *, {UPPER.format('raw')} u from t)
select p_partkey, raw, case
  when regexp_matches(u, 'PEREZ CARRENNO|PEREZ CARRENO') then 'Hospital Pérez Carreño' when regexp_matches(u, 'LLANITO|LUCIANI') then 'Hospital Domingo Luciani (El Llanito)'
  when regexp_matches(u, 'VARGAS LA GUAIRA|JOSE MARIA VARGAS') then 'Hospital José María Vargas (La Guaira)' when u like '%VARGAS DE CARACAS%' then 'Hospital Vargas de Caracas'
  when regexp_matches(u, 'HUC|UNIVERSITARIO') then 'Hospital Universitario de Caracas (HUC)' when regexp_matches(u, 'RICARDO BAQUERO|BAQUERO GONZALEZ|PERIFERICO (DE )?CATIA') then 'Hospital Ricardo Baquero González (Periférico de Catia)'
  when regexp_matches(u, 'DE NINOS|DE LOS RIOS') then 'Hospital J.M. de los Ríos (Niños)' when u like '%CRUZ ROJA%' then 'Cruz Roja' else '' end as label,
  regexp_matches(raw, '(?i)hosp|hopital|cl[ií]nica|cruz roja|de los rios|de ni[nñ]os|perif[eé]rico') as looks from f""")
def canonical_label(spark, sf):
    raw = F.concat_ws(" ", "p_name", F.get(F.array(*[F.lit(x) for x in _FACILITY_OF]), (F.col("p_partkey") % 9).cast("int")), "p_type")
    return table(spark, sf, "part").select("p_partkey", raw.alias("raw")).select("p_partkey", "raw", fields.canonical_facility("raw").alias("label"), fields.looks_like_facility("raw").alias("looks"))


@query(r"""select c_custkey, regexp_replace(c_name, '[^0-9]', '', 'g') as digits, regexp_matches(cast(c_custkey * 977 as varchar), '^\d{5,9}\)?$') as looks from customer""")
def digits_only_customer(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", ids.digits("c_name").alias("digits"), ids.looks_like_id((F.col("c_custkey") * 977).cast("string")).alias("looks"))


@query(r"""select o_orderkey, case when o_orderkey % 5 = 0 then 'u' || o_orderkey when o_orderkey % 5 = 1 then 'x' || o_custkey
  else 'h' || substr(sha256(o_custkey || '|' || o_orderstatus || '|' || o_orderpriority), 1, 22) end as uid from orders""")
def uid_hash_orders(spark, sf):
    k = F.col("o_orderkey").cast("string")
    uid = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("u"), k)).otherwise("")
    obs = F.when(F.col("o_orderkey") % 5 == 1, F.concat(F.lit("seen | id=x"), F.col("o_custkey").cast("string"), F.lit("| end")))
    return table(spark, sf, "orders").select("o_orderkey", ids.derive_uid(uid, obs, "o_custkey", "o_orderstatus", "o_orderpriority").alias("uid"))


_DIGITS = r"[0-9]"
#: The engine has no look-around: every character that isn't a digit or a dot is doubled, so that one of it ends a match and one starts the next.
_FOUND = r"""list_filter(list_transform(regexp_extract_all(regexp_replace({0}, '([^0-9.])', '\1\1', 'g'), '(^|[^0-9.])((VV|vv|EE|ee)?(--|\s\s)?)?([0-9]{{1,2}}(\.|\s\s)?[0-9]{{3}}(\.|\s\s)?[0-9]{{3}}|[0-9]{{6,9}})($|[^0-9.])', 5),
  lambda m: regexp_replace(m, '[^0-9]', '', 'g')), lambda d: length(d) between 6 and 9)"""


def _first_seen(items: str) -> str:
    """Distinct items in the order of their first occurrence."""
    return f"list_filter({items}, lambda x, i: list_position({items}, x) = i)"


@query(f"with f as (select doc_id, {_FOUND.format('text')} l from documents) select doc_id, array_to_string({_first_seen('l')}, ',') as found from f where len(l) > 0")
def find_ids_documents(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", ids.find_ids("text").alias("found"))
    return d.filter(F.size("found") > 0).select("doc_id", F.array_join("found", ",").alias("found"))


@query(r"""with d as (select c_custkey, cast(12000000 + c_custkey * 37 as varchar) d from customer), t as (select *, reverse(regexp_replace(reverse(d), '(\d{3})(\d{3})(\d+)', '\1.\2.\3')) p from d)
select c_custkey, d || ',' || p || ',V-' || p || ',V' || d || ',V-' || d as spellings from t""")
def dotted_id(spark, sf):
    d = (F.lit(12000000) + F.col("c_custkey") * 37).cast("string")
    return table(spark, sf, "customer").select("c_custkey", F.array_join(ids.id_spellings(d), ",").alias("spellings"))


@query(r"""with w as (select p_partkey, lower(split_part(p_name, ' ', 1)) t from part),
v as (select p_partkey, [t, case when t like 'h%' then substr(t, 2) when t[1] in ('a','e','i','o','u') then 'h' || t end,
  case when contains(t,'v') then replace(t,'v','b') end, case when contains(t,'b') then replace(t,'b','v') end, case when contains(t,'s') then replace(t,'s','z') end, case when contains(t,'z') then replace(t,'z','s') end,
  case when contains(t,'y') then replace(t,'y','i') end, case when contains(t,'j') then replace(t,'j','g') end, case when contains(t,'ll') then replace(t,'ll','y') end, case when contains(t,'rr') then replace(t,'rr','r') end] x from w)
select p_partkey, array_to_string(list_sort(list_distinct(list_filter(x, lambda s: s is not null and length(s) > 1))), ',') as spellings from v""")
def spelling_variants_parts(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.array_join(T.spelling_variants(F.split("p_name", " ")[0]), ",").alias("spellings"))


def _respell(t: str) -> str:
    swaps = "".join(f", case when contains({t},'{a}') then replace({t},'{a}','{b}') end" for a, b in (("v", "b"), ("b", "v"), ("s", "z"), ("z", "s"), ("y", "i"), ("j", "g"), ("ll", "y"), ("rr", "r")))
    return f"list_sort(list_distinct(list_filter([{t}, case when {t} like 'h%' then substr({t}, 2) when {t}[1] in ('a','e','i','o','u') then 'h' || {t} end{swaps}], lambda s: s is not null and length(s) > 1)))"


_DOTTED = "case length(ci) when 8 then substr(ci, 1, 2) || '.' || substr(ci, 3, 3) || '.' || substr(ci, 6) when 4 then substr(ci, 1, 1) || '.' || substr(ci, 2) else ci end"


@query(f"""with {ctes('person_records')}, w as (select record_id, ci, {_DOTTED} p, display_name x, string_split(display_name, ' ') w, name_key from person_records), l as (select *, len(w) n, lower(w[-1]) la, lower(w[-2]) lb from w),
v as (select *, list_filter([x] || case when n >= 3 then [array_to_string(w[1:n-2] || [w[-1], w[-2]], ' ')] else [] end || list_transform({_respell('la')}, lambda s: array_to_string(w[1:n-1] || [s], ' '))
   || case when n > 1 then list_transform({_respell('lb')}, lambda s: array_to_string(w[1:n-2] || [s, w[-1]], ' ')) else [] end, lambda s: s <> '') every from l),
d as (select *, {_first_seen('every')} names from v),
t as (select *, (case when ci = '' then [] else [ci, p, 'V-' || p, 'V' || ci, 'V-' || ci] end) || (case when len(string_split(name_key, ' ')) >= 2 then names[1:5] else [] end) a,
  (case when ci = '' then [] else [ci, p, 'V-' || p] end) || names[1:10] || [w[1] || ' Mora Rojas', w[1] || ' Mora', w[1] || ' Rojas', 'Ana Mora Luz'] b from d)
select record_id, array_to_string(names[1:10], ',') as variants, array_to_string({_first_seen('a')}, ',') as asked, array_to_string(({_first_seen('b')})[1:16], ',') as terms from t""")
def name_variants_persons(spark, sf):
    v = view(spark, sf, "person_records")
    terms = ids.search_terms("ci", "display_name", F.lit("Ana Mora Luz"), F.lit("Eva Rojas Paz"))
    return v.select("record_id", F.array_join(T.name_variants("display_name"), ",").alias("variants"), F.array_join(ids.query_variants("ci", "display_name"), ",").alias("asked"), F.array_join(terms, ",").alias("terms"))


_AGES = ["39", "3 MESES", "9 M", "40 AÑOS", "", "s/n", "UN MES 2", "101 años"]


@query(rf"""with t as (select doc_id, {_AGES}[cast(doc_id % 8 as integer) + 1] || ' ' || text raw from documents), f as (select *, {UPPER.format('raw')} u from t), v as (select *, coalesce(regexp_extract(u, '(\d{{1,3}})', 1), '') v from f)
select doc_id, v as age, case when v = '' then '' when regexp_matches(u, 'MESES|\bMES\b') then 'months' when contains(u, 'ANO') then 'years' else '' end as unit,
  case when v <> '' and regexp_matches(u, 'MESES|\bMES\b') then 0 when v <> '' then cast(v as integer) end as years from v""")
def parse_ages(spark, sf):
    raw = F.concat_ws(" ", F.get(F.array(*[F.lit(x) for x in _AGES]), (F.col("doc_id") % 8).cast("int")), "text")
    a = table(spark, sf, "documents").select("doc_id", fields.age(raw).alias("a"))
    return a.select("doc_id", F.col("a.value").alias("age"), F.col("a.unit").alias("unit"), fields.age_years("a.value", "a.unit").alias("years"))


# ---------------------------------------------------------------- statuses, labels, JSON

_SAID = ["Desaparecida", "buscando a", "sin localizar", "Localizada", "a salvo", "FALLECIDO", "Ingresado ayer", "otro"]


@query(f"""with t as (select conv_id, turn, role, lower({_SAID}[cast((conv_id + turn) % 8 as integer) + 1] || ' ' || text) s from conversations)
select conv_id, turn, role, case when regexp_matches(s, 'desaparecid|buscando|localizar') then 'por_localizar' when regexp_matches(s, 'localizad|encontrad|salvo') then 'localizado'
  when regexp_matches(s, 'fallecid|muert') then 'fallecido' when regexp_matches(s, 'ingres|hospital') then 'ingresado' else s end as status from t""")
def status_case_events(spark, sf):
    raw = F.concat_ws(" ", F.get(F.array(*[F.lit(x) for x in _SAID]), ((F.col("conv_id") + F.col("turn")) % 8).cast("int")), "text")
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", fields.status(raw).alias("status"))


_STATUS_OF = "case event_id % 7 when 0 then 'por_localizar' when 1 then 'localizado' when 2 then 'ingresado' when 3 then 'herido' when 4 then 'alta' when 5 then 'fallecido' else 'albergado' end"


@query(f"""with s as (select user_id, list(distinct st) l, min(st) least from (select user_id, {_STATUS_OF} st from events) group by user_id)
select user_id, case when list_contains(l,'fallecido') then 'fallecido' when list_contains(l,'ingresado') then 'ingresado' when list_contains(l,'herido') then 'herido' when list_contains(l,'localizado') then 'localizado'
  when list_contains(l,'alta') then 'alta' when list_contains(l,'por_localizar') then 'por_localizar' else least end as status,
  case when list_contains(l,'fallecido') then 'fallecido/a' when list_contains(l,'ingresado') then 'ingresado/a en un hospital' when list_contains(l,'herido') then 'herido/a' when list_contains(l,'albergado') then 'en un refugio'
  when list_contains(l,'alta') then 'dado/a de alta' when list_contains(l,'localizado') then 'localizado/a' else 'por localizar' end as said from s""")
def primary_status(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.expr(_STATUS_OF).alias("st"))
    g = e.groupBy("user_id").agg(F.array_sort(F.collect_set("st")).alias("l"))
    return g.select("user_id", fields.primary_status("l").alias("status"), fields.status_in_words("l").alias("said"))


@query("""select event_type, cast(json_extract_string(props, '$.k') as bigint) as k, count(*) as n from events group by all""")
def json_prop_events(spark, sf):
    lines = readers.json_lines(table(spark, sf, "events").select("event_type", F.concat(F.lit("```json\n"), "props", F.lit(",\n{\"k\": 1\nnot json\n```")).alias("text")), "k long")
    return lines.groupBy("event_type", "k").agg(F.count(F.lit(1)).alias("n"))


_NEED_WORDS = ["Agua y comida", "pañales, leche", "Jabón; toallas sanitarias", "ROPA de abrigo", "planta eléctrica", "nada", "colchones y cobijas para bebés", "medicinas / gasas"]


@query(rf"""with t as (select doc_id, {LOWER.format(f"{_NEED_WORDS}[cast(doc_id % 8 as integer) + 1] || ' ' || text")} s from documents)
select doc_id, array_to_string(list_filter([{', '.join(f"case when regexp_matches(s, '{'|'.join(w)}') then '{tag}' end" for tag, w in fields.NEEDS)}], lambda x: x is not null), ',') as tags from t""")
def multi_label_tags(spark, sf):
    raw = F.concat_ws(" ", F.get(F.array(*[F.lit(x) for x in _NEED_WORDS]), (F.col("doc_id") % 8).cast("int")), "text")
    return table(spark, sf, "documents").select("doc_id", F.array_join(fields.needs_tags(raw), ",").alias("tags"))


@query("""select doc_id, array_to_string(list_filter([case when contains(s, 'thion') then 'a' end, case when contains(s, 'ungch') or contains(s, 'keitsch') then 'b' end, case when contains(s, 'the ') then 'c' end], lambda x: x is not null), ',') as tags
from (select doc_id, lower(strip_accents(text)) s from documents)""")
def multi_label_documents(spark, sf):
    rules = [("a", ["thion"]), ("b", ["ungch", "keitsch"]), ("c", ["the "])]
    return table(spark, sf, "documents").select("doc_id", F.array_join(T.all_matches(F.lower(T.strip_accents("text")), rules), ",").alias("tags"))


@query("""with t as (select p_partkey, lower(p_name || ' ' || ['refugio','almacén central','punto','DAMNIFICADOS'][cast(p_partkey % 4 as integer) + 1] || ' ' || p_type) s from part)
select p_partkey, case when regexp_matches(strip_accents(s), 'albergue|damnificad|refugio') then 'refugio' when regexp_matches(strip_accents(s), 'distribu|logistic|almacen') then 'hub' else 'acopio' end as ctype from t""")
def classify_type(spark, sf):
    need = F.get(F.array(*[F.lit(x) for x in ("refugio", "almacén central", "punto", "DAMNIFICADOS")]), (F.col("p_partkey") % 4).cast("int"))
    return table(spark, sf, "part").select("p_partkey", fields.center_type("p_name", need, "p_type").alias("ctype"))


@query(r"""select page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) as host, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) as title, regexp_extract(html, '(?is)<h1>(.*?)</h1>', 1) as heading,
  cast(len(regexp_extract_all(html, '(?i)<a href=')) as bigint) as links, regexp_matches(lower(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)), 'demo|lorem|ejemplo|example|plantilla|placeholder|tu nombre|nombre del centro') as placeholder from pages""")
def page_extract(spark, sf):
    return readers.page_rows(table(spark, sf, "pages"))


# ---------------------------------------------------------------- windows, nesting

@query("""select conv_id, turn, last_value(case when role = 'system' then text when turn % 3 = 1 then text end ignore nulls) over (partition by conv_id order by turn rows unbounded preceding) as section from conversations""")
def forward_fill_sections(spark, sf):
    head = F.when(F.col("role") == "system", F.col("text")).when(F.col("turn") % 3 == 1, F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", readers.forward_fill(head, "conv_id", "turn").alias("section"))


@query("select conv_id, turn, role, length(text) as n from conversations")
def nested_explode(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return c.select("conv_id", F.explode("turns").alias("t")).select("conv_id", "t.turn", "t.role", F.length("t.text").cast("long").alias("n"))


_DOC_TOKENS = f"select doc_id, unnest(list_distinct({TOKENS.format(UPPER.format('text'))})) token from documents"


@query(f"select token, count(*) as df from ({_DOC_TOKENS}) group by token")
def token_df(spark, sf):
    d = table(spark, sf, "documents").select(T.fold_upper("text").alias("name_key"))
    return resolve.token_counts(d)


@query(f"select token, count(*) as df from ({_DOC_TOKENS}) group by token having count(*) >= greatest(4, floor(0.004e0 * (select count(*) from documents)))")
def common_tokens(spark, sf):
    return resolve.common_tokens(table(spark, sf, "documents").select(T.fold_upper("text").alias("name_key")))


@query(f"with {ctes('person_records')} select name_key, count(distinct ci) as ids from person_records where ci <> '' group by name_key having count(distinct ci) >= 2")
def name_multi_id(spark, sf):
    return resolve.shared_names(view(spark, sf, "person_records"))


# ---------------------------------------------------------------- filters, joins, top-k

def _people(spark, sf):
    r = view(spark, sf, "person_records").withColumn("entity", F.floor(F.col("record_id") / 4).cast("long"))
    some = lambda c: F.array_sort(F.collect_set(F.nullif(c, F.lit(""))))
    return r.groupBy("entity").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.split("name_key", " "))))), " ").alias("name_key"), some("ci").alias("cis"), some("status").alias("statuses"), some("origin").alias("origins"),
                                   F.coalesce(F.min(F.nullif("ci", F.lit(""))), F.lit("")).alias("primary_ci"), F.count(F.lit(1)).alias("n_records"), F.max(F.col("status") == "fallecido").alias("deceased"), (F.count_distinct(F.nullif("ci", F.lit(""))) > 1).alias("ci_conflict"))


_PEOPLE = f"""{ctes('person_records')}, people as (select cast(floor(record_id / 4e0) as bigint) entity, list(distinct name_key) names, list(distinct nullif(ci, '')) cis, list(distinct status) statuses, list(distinct origin) origins,
  coalesce(min(nullif(ci, '')), '') primary_ci, count(*) n_records, bool_or(status = 'fallecido') deceased, count(distinct nullif(ci, '')) > 1 ci_conflict from person_records group by 1)"""
_MATCH = "list_contains(statuses, 'herido') and len(list_filter(names, lambda s: contains(s, 'LUZ'))) > 0 and len(list_filter(origins, lambda o: contains(lower(o), 'nation_1'))) > 0"


@query(f"with {_PEOPLE} select entity, primary_ci, n_records from people where {_MATCH} order by n_records desc, entity limit 50")
def filter_topk_persons(spark, sf):
    return search.find_persons(_people(spark, sf), status="herido", name="de la Luz", municipality="NATION_1").select("entity", "primary_ci", "n_records")


@query(f"with {_PEOPLE} select count(*) as total from people where {_MATCH}")
def filtered_total(spark, sf):
    return search.count_persons(_people(spark, sf), status="herido", name="de la Luz", municipality="NATION_1")


@query(f"with {_PEOPLE} select entity, primary_ci, n_records from people where list_contains(statuses, 'fallecido') and len(list_filter(names, lambda s: contains(s, 'LUZ'))) > 0 order by (primary_ci <> '') desc, n_records desc, entity limit 12")
def question_persons(spark, sf):
    _, rows = answer("¿Quiénes son los fallecidos de nombre Luz?", _people(spark, sf), view(spark, sf, "centers_v"))
    return rows.select("entity", "primary_ci", "n_records")


@query("select o_orderkey, o_custkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING' and c_acctbal > 5000)")
def semi_by_id(spark, sf):
    some = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING' and c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf, "orders").join(some, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query(f"""select c_mktsegment as source, c_custkey as identity from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderdate > timestamp '1998-01-01' - interval 100000 minute)""")
def anti_unchecked(spark, sf):
    want = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("source"), F.col("c_custkey").alias("identity"))
    ledger = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("source"), F.col("c_custkey").alias("identity"), F.col("o_orderdate").alias("checked_at"))
    return registry.unchecked(want, ledger, F.lit("1998-01-01").cast("timestamp_ntz"), 100000)


@query(f"with {_PEOPLE} select status, count(*) as n from (select unnest(statuses) status from people) group by status")
def status_histogram(spark, sf):
    return registry.status_histogram(_people(spark, sf))


@query(f"""with {_PEOPLE} select count(*) as persons, count(*) filter (primary_ci <> '') as with_number, count(*) filter (deceased) as deceased, count(*) filter (ci_conflict) as ci_conflict,
  {', '.join(f"count(*) filter (list_contains(statuses, '{s}')) as {s}" for s in registry.STATUSES)}, (select count(*) from part) as records, (select count(*) from supplier) as centers from people""")
def kpi_stats(spark, sf):
    return registry.kpis(_people(spark, sf), view(spark, sf, "person_records"), view(spark, sf, "geo_sites"))


# ---------------------------------------------------------------- places

_ZONES = "zones as (select lower(n_name) zone, cast(n_nationkey as double) lat, cast(n_regionkey as double) lng from nation)"


def _zones(spark, sf):
    return table(spark, sf, "nation").select(F.lower("n_name").alias("zone"), F.col("n_nationkey").cast("double").alias("lat"), F.col("n_regionkey").cast("double").alias("lng"))


@query(f"""with {ctes('person_records')}, {_ZONES}, best as (select record_id, status, zone, row_number() over (partition by record_id order by length(zone) desc, zone) r from person_records join zones on contains(lower(origin), zone)),
c as (select zone, count(*) total, {', '.join(f"count(*) filter (status = '{s}') {s}" for s in registry.STATUSES)} from best where r = 1 group by zone)
select *, case greatest({', '.join(registry.STATUSES)}) {' '.join(f"when {s} then '{s}'" for s in registry.STATUSES)} end as leading from c""")
def zone_status_pivot(spark, sf):
    r = view(spark, sf, "person_records").select(F.col("record_id").alias("id"), F.lit(0).alias("pos"), "origin", "status")
    z = geo.zones_found(r, _zones(spark, sf))
    return registry.zone_histogram(r.join(z, "id").select("zone", "status"))


@query(f"""with {ctes('geo_sites')} select site_id, round({KM.format('lat', 'lng', '10.6e0', '-66.93e0')}, 1) as dist_km from geo_sites
where lat between 10.4e0 and 10.74e0 and lng between -67.35e0 and -66.2e0 and round({KM.format('lat', 'lng', '10.6e0', '-66.93e0')}, 1) <= 25 order by dist_km, site_id limit 40""")
def bbox_radius_topk(spark, sf):
    s = view(spark, sf, "geo_sites").filter(inside("lat", "lng", (10.4, 10.74, -67.35, -66.2)))
    d = s.select("site_id", F.round(haversine_km("lat", "lng", F.lit(10.6), F.lit(-66.93)), 1).alias("dist_km"))
    return d.filter("dist_km <= 25").orderBy("dist_km", "site_id").limit(40)


@query(f"""with {ctes('geo_sites')}, p as (select c_custkey id, 10.4e0 + cast((c_custkey * 91) % 340 as double) / 1000e0 a, -67.35e0 + cast((c_custkey * 29) % 1150 as double) / 1000e0 g from customer),
d as (select id, site_id, round({KM.format('a', 'g', 'lat', 'lng')}, 6) dist from p join geo_sites on abs(a - lat) <= 0.03e0 and abs(g - lng) <= 0.03e0)
select id, site_id, round(dist, 3) as dist_km from (select *, row_number() over (partition by id order by dist, site_id) r from d where dist <= 2) where r = 1""")
def nearest_site(spark, sf):
    k = F.col("c_custkey")
    p = table(spark, sf, "customer").select(k.alias("id"), (F.lit(10.4) + ((k * 91) % 340).cast("double") / 1000).alias("lat"), (F.lit(-67.35) + ((k * 29) % 1150).cast("double") / 1000).alias("lng"))
    return geo.nearest(p, view(spark, sf, "geo_sites")).withColumn("dist_km", F.round("dist_km", 3))


@query(f"""with {ctes('person_records')}, {_ZONES}, best as (select record_id, zone, lat, lng, row_number() over (partition by record_id order by length(zone) desc, zone) r from person_records join zones on contains(lower(origin), zone) where not contains(lower(origin), 'no indicada'))
select p.record_id id, zone, lat from person_records p left join best b on p.record_id = b.record_id and r = 1""")
def attach_zones(spark, sf):
    r = view(spark, sf, "person_records").select(F.col("record_id").alias("id"), F.array(F.lit("No indicada"), "origin").alias("origins"))
    o = r.select("id", F.posexplode(geo.order_origins("origins")).alias("pos", "origin"))
    return r.select("id").join(geo.zones_found(o, _zones(spark, sf)), "id", "left").select("id", "zone", "lat")


@query(f"""with h as (select event_id, cast(floor(epoch(timestamp '{NOW}' - ts) / 3600) as bigint) h from events)
select event_id, case when h < 48 then 'confirmado hace ' || h || 'h' else 'sin confirmar hace ' || (h // 24) || 'd' end as freshness from h""")
def freshness_bucket(spark, sf):
    return table(spark, sf, "events").select("event_id", fields.freshness(F.col("ts").cast("timestamp"), F.lit(NOW).cast("timestamp")).alias("freshness"))


# ---------------------------------------------------------------- merges

_NOTED = "case when event_id % 4 = 0 then '' else event_type || cast(event_id % 13 as varchar(9)) end"


@query(f"""with e as (select user_id, event_id, {_NOTED} a, case when event_id % 3 = 0 then props else '' end b from events)
select user_id, coalesce(min_by(a, event_id) filter (a <> ''), '') as a, coalesce(min_by(b, event_id) filter (b <> ''), '') as b from e group by user_id""")
def merge_first_nonempty(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", F.expr(_NOTED).alias("a"), F.when(F.col("event_id") % 3 == 0, F.col("props")).otherwise("").alias("b"))
    return centers.merge_first(e, "user_id", "event_id", ["a", "b"])


@query(f"""with e as (select user_id, event_id, {_NOTED} a, case when event_id % 3 = 0 then props else '' end b from events)
select user_id, coalesce(max_by(a, event_id) filter (a <> ''), '') as a, coalesce(min_by(b, event_id) filter (b <> ''), '') as b from e group by user_id""")
def merge_last_nonempty(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", F.expr(_NOTED).alias("a"), F.when(F.col("event_id") % 3 == 0, F.col("props")).otherwise("").alias("b"))
    return centers.merge_last(e, "user_id", "event_id", ["a"], ["b"])


@query("select coalesce(n.k, o.k) as k, coalesce(n.what, o.what) as what from (select o_custkey k, count(*) || ' orders' what from orders group by o_custkey) n full join (select c_custkey k, c_mktsegment what from customer) o on n.k = o.k")
def merge_by_id(spark, sf):
    old = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("what"))
    new = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.concat(F.count(F.lit(1)).cast("string"), F.lit(" orders")).alias("what"))
    return centers.merge_by_id(old, new, "k")


@query("""select o_custkey, o_orderpriority from (select *, row_number() over (partition by o_custkey order by n desc, first) r from (select o_custkey, o_orderpriority, count(*) n, min(o_orderkey) first from orders group by all)) where r = 1""")
def best_value(spark, sf):
    return resolve.most_common("o_orderpriority", "o_custkey", "o_orderkey", table(spark, sf, "orders"))


# ---------------------------------------------------------------- resolution

_RELATION = """case when length({a}) < 6 or length({b}) < 6 then 'none' when {a} = {b} then 'equal'
  when length({a}) = length({b}) then case when hamming({a}, {b}) = 1 or (hamming({a}, {b}) = 2 and len(list_filter(range(1, length({a}) + 1), lambda i: {a}[i] <> {b}[i])) = 2
      and {a}[list_filter(range(1, length({a}) + 1), lambda i: {a}[i] <> {b}[i])[1]] = {b}[list_filter(range(1, length({a}) + 1), lambda i: {a}[i] <> {b}[i])[2]]
      and {a}[list_filter(range(1, length({a}) + 1), lambda i: {a}[i] <> {b}[i])[2]] = {b}[list_filter(range(1, length({a}) + 1), lambda i: {a}[i] <> {b}[i])[1]]) then 'flip' else 'diff' end
  when abs(length({a}) - length({b})) = 1 and levenshtein({a}, {b}) = 1 then 'flip' else 'diff' end"""
_PAIRS = f"""{ctes('person_records')}, prof as (select record_id, name_key, ci, try_cast(nullif(age, '') as integer) yrs, {TOKENS.format('name_key')} words from person_records),
blocks as (select record_id, 'N' || substr(words[1], 1, 3) block from (select record_id, list_sort(words) words from prof) union select record_id, 'C' || substr(ci, 1, 4) from prof where length(ci) >= 6),
pairs as (select distinct x.record_id i, y.record_id j from blocks x join blocks y on x.block = y.block and x.record_id < y.record_id)"""
_REASONS = f"""{_PAIRS}, df as (select token, count(*) n from (select record_id, unnest(words) token from prof) group by token), common as (select coalesce(list(token), []) c from df where n >= greatest(4, floor(0.004e0 * (select count(*) from prof)))),
multi as (select name_key from prof where ci <> '' group by name_key having count(distinct ci) >= 2),
x as (select i, j, a.name_key ka, b.name_key kb, a.yrs ya, b.yrs yb, {_RELATION.format(a='a.ci', b='b.ci')} rel, list_intersect(a.words, b.words) s, least(len(a.words), len(b.words)) m,
  a.name_key in (select name_key from multi) or b.name_key in (select name_key from multi) shared, c from pairs join prof a on a.record_id = i join prof b on b.record_id = j cross join common),
verdict as (select i, j, case when m = 0 then '' when rel = 'equal' and len(s) > 0 then 'ci_equal' when rel = 'flip' and len(s) > 0 and len(s) / m >= 0.5e0 then 'ci_flip+name' when rel = 'diff' then ''
  when abs(ya - yb) > 1 then '' when shared or (len(s) between 1 and 2 and len(list_filter(s, lambda t: not list_contains(c, t))) = 0) then 'common_name_needs_strong_id'
  when ka = kb then 'name_exact' when len(s) >= 2 and len(s) = m then 'name_subset' when len(s) >= 2 and len(s) / m >= 0.67e0 then 'name_overlap' else '' end reason from x)"""


@query(f"with {_PAIRS} select i, j from pairs")
def er_candidate_pairs(spark, sf):
    return resolve.candidate_pairs(view(spark, sf, "person_records"))


@query(f"with {_PAIRS}, r as (select i, j, {_RELATION.format(a='a.ci', b='b.ci')} relation from pairs join prof a on a.record_id = i join prof b on b.record_id = j) select relation, count(*) as n, sum(i) as total from r group by relation")
def ci_relation_pairs(spark, sf):
    return resolve.relation_totals(view(spark, sf, "person_records"))


SQL["ci_relation_pairs"] = SQL["ci_relation_pairs"].replace("sum(i) as total", "cast(sum(i) as bigint) as total")


@query(f"with {_REASONS} select i, j, reason from verdict where reason not in ('', 'common_name_needs_strong_id')")
def er_match_reasons(spark, sf):
    return resolve.matches(view(spark, sf, "person_records"))


@query(f"with recursive {_REASONS}, links as materialized (select i a, j b from verdict where reason not in ('', 'common_name_needs_strong_id')), {REACH} select id, root from roots")
def er_components(spark, sf):
    m = resolve.matches(view(spark, sf, "person_records"))
    return resolve.components(m.select(F.col("i").alias("a"), F.col("j").alias("b")))


_SOME = "coalesce(array_to_string(list_sort(list(distinct {0}) filter ({0} <> '')), ','), '')"
_QUOTED = """coalesce('"' || array_to_string(list_sort(list(distinct {0}) filter ({0} <> '')), '","') || '"', '')"""


@query(f"""with recursive {_REASONS}, links as materialized (select i a, j b from verdict where reason not in ('', 'common_name_needs_strong_id')), {REACH},
lab as materialized (select p.record_id, ci, coalesce(root, p.record_id) root from person_records p left join roots on id = p.record_id),
seq as materialized (select root, record_id, ci, row_number() over (partition by root order by record_id) rn from lab where ci <> '' and root in (select root from lab where ci <> '' group by root having count(*) > 1)),
walk(root, rn, record_id, held, b) as (
  select root, rn, record_id, [[ci]], cast(1 as bigint) from seq where rn = 1
  union all
  select root, rn, record_id, case when f is null then list_append(held, [ci]) else list_transform(held, lambda h, k: case when k = f then list_append(h, ci) else h end) end, coalesce(f, len(held) + 1)
  from (select s.root, s.rn, s.record_id, s.ci, w.held, list_position(list_transform(w.held, lambda h: len(list_filter(h, lambda x: {_RELATION.format(a='s.ci', b='x')} not in ('equal', 'flip'))) = 0), true) f
        from walk w join seq s on s.root = w.root and s.rn = w.rn + 1)
), most as (select root, max(len(held)) k from walk group by root),
ent as (select record_id, case when coalesce(k, 1) <= 1 then min(record_id) over (partition by root) else min(record_id) over (partition by root, coalesce(b, 0)) end entity
  from lab left join (select root r1, record_id i1, b from walk) on r1 = root and i1 = record_id left join (select root r2, k from most) on r2 = root),
r as (select e.entity, p.* from ent e join person_records p on p.record_id = e.record_id),
shown as (select entity, string_split(display_name, ' ') w from (select entity, display_name, row_number() over (partition by entity order by count(*) desc, min(record_id)) k from r group by entity, display_name) where k = 1),
g as (select entity, min(name_key) nk, coalesce(min(ci) filter (ci <> ''), '') primary_ci, coalesce(min(age) filter (age <> ''), '') age, {', '.join(f"{_SOME.format(c)} {n}" for c, n in (("ci", "cis"), ("age", "ages"), ("hospital", "hospitals"), ("origin", "origins"), ("status", "statuses"), ("source", "sources")))},
  bool_or(status = 'fallecido') deceased, count(*) n_records, count(distinct ci) filter (ci <> '') > 1 ci_conflict, {_QUOTED.format('ci')} q_ci, {_QUOTED.format('source')} q_source from r group by entity)
select entity, array_to_string(list_filter(w, lambda x, i: i = 1 or upper(x) <> upper(w[i - 1])), ' ') as display_name, primary_ci, age, cis, ages, hospitals, origins, statuses, sources, deceased, n_records, ci_conflict,
  sha256('{{"name_key":"' || nk || '","cis":[' || q_ci || '],"sources":[' || q_source || ']}}') as entity_hash from g join shown using (entity)""")
def er_clusters(spark, sf):
    r = view(spark, sf, "person_records")
    e = resolve.resolve(r)
    s = resolve.summarize(r, e)
    flat = [F.array_join(c, ",").alias(c) for c in ("cis", "ages", "hospitals", "origins", "statuses", "sources")]
    return s.select("entity", "display_name", "primary_ci", "age", *flat, "deceased", "n_records", "ci_conflict", "entity_hash")


@query()
def possible_same(spark, sf):
    r = view(spark, sf, "person_records")
    return review.possible_same(resolve.summarize(r, resolve.resolve(r)))


_QUERY_WORDS = ("LUZ", "FAM12", "SOLL")


def _word_sql(q: str) -> str:
    return f"""coalesce(greatest(0, list_max(list_transform(words, lambda t: case when t = '{q}' then 100 when starts_with(t, '{q}') then {70 + len(q)} when length(t) >= 3 and starts_with('{q}', t) then 55
      {f"when contains(t, '{q}') then 42 when length(t) >= 4 and levenshtein(t, '{q}') <= 2 then 42 - 9 * levenshtein(t, '{q}') - 3 * abs(length(t) - {len(q)})" if len(q) >= 4 else ''} else 0 end))), 0)"""


@query(f"""with {ctes('person_records')}, s as (select record_id entity, {' + '.join(_word_sql(q) for q in _QUERY_WORDS)} n from (select *, string_split(name_key, ' ') words from person_records))
select entity, cast(n as integer) as score from s where n >= 40 order by n desc, entity limit 80""")
def fuzzy_search(spark, sf):
    v = view(spark, sf, "person_records")
    p = v.select(F.col("record_id").alias("entity"), resolve.words_of().alias("words"), F.array("ci").alias("cis"), F.array().cast("array<string>").alias("places"))
    return search.fuzzy(p, " ".join(_QUERY_WORDS)).select("entity", "score")


@query(f"""with {ctes('person_records')}, s as (select entity, case when ci = '10000007' then 1000 when contains(ci, '10000007') then 120 when length(ci) = 8 and hamming(ci, '10000007') <= 1 then 90 else 0 end n from (select record_id entity, ci from person_records))
select entity, cast(n as integer) as score from s where n > 0 order by n desc, entity limit 80""")
def fuzzy_number(spark, sf):
    v = view(spark, sf, "person_records")
    p = v.select(F.col("record_id").alias("entity"), F.array().cast("array<string>").alias("words"), F.array("ci").alias("cis"), F.array().cast("array<string>").alias("places"))
    return search.fuzzy(p, "10000007").select("entity", "score")


# ---------------------------------------------------------------- households, centers

_HOUSE = f"""{ctes('person_records')}, last as (select record_id person, list_sort(list_distinct(case when len(w) >= 2 then w[-2:] else w end)) s, len(case when len(w) >= 2 then w[-2:] else w end) n
  from (select record_id, list_filter(string_split({UPPER.format('display_name')}, ' '), lambda t: t <> '') w from person_records)),
keyed as (select 'siblings:' || array_to_string(s, ' ') k, person, 3 w from last where n >= 2 union select 'kin:' || t, person, 2 from (select unnest(s) t, person from last) where length(t) > 2
  union select 'co_mention|' || source || '|' || uid, record_id, 1 from person_records),
gate as (select k from keyed group by k, w having count(*) between 2 and case when w = 1 then 4 else 8 end),
house_edges as (select x.person a, y.person b, case when x.w = 1 then 'co_mention' else x.k end kind, x.w weight from keyed x join keyed y on x.k = y.k and x.person < y.person where x.k in (select k from gate))"""


def _households(spark, sf):
    r = view(spark, sf, "person_records").withColumn("person", F.col("record_id"))
    r = r.withColumn("uid", F.concat("uid", F.lit("#"), F.col("record_id").cast("string")))
    return households.edges(r.select("person", "display_name"), r.select("person", "source", "uid"))


@query(f"with {_HOUSE} select a, b, kind, weight from house_edges")
def household_edges(spark, sf):
    return _households(spark, sf)


@query(f"with recursive {_HOUSE}, links as materialized (select distinct a, b from house_edges where weight >= 2), {REACH} select id as person, root as household from roots")
def household_ids(spark, sf):
    return households.households(_households(spark, sf))


@query(f"""with recursive {_HOUSE}, links as materialized (select distinct a, b from house_edges where weight >= 2), {REACH},
every as (select x.id person, y.id member, 'household' kind, 0 weight from roots x join roots y on x.root = y.root and x.id <> y.id union all select a, b, kind, weight from house_edges union all select b, a, kind, weight from house_edges)
select person, member, kind from (select *, row_number() over (partition by person, member order by weight desc, kind) r from every) where r = 1""")
def household_members(spark, sf):
    e = cut(_households(spark, sf))
    return households.members(households.households(e), e)


_GENERIC = ", ".join(f"'{w}'" for w in centers.GENERIC)


@query(f"""with recursive {ctes('centers_v')}, c as (select *, lower(municipality) place, list_filter(list_distinct(string_split(lower(name), ' ')), lambda t: length(t) > 2) words from centers_v),
links as materialized (select x.center_id a, y.center_id b from c x join c y on x.place = y.place and x.center_id < y.center_id and x.source <> y.source
  where len(list_intersect(x.words, y.words)) / len(list_distinct(list_concat(x.words, y.words))) >= 0.8e0 and len(list_filter(list_intersect(x.words, y.words), lambda w: w not in ({_GENERIC}))) > 0), {REACH},
g as (select r.root, c.center_id, c.source, first_value(c.center_id) over (partition by r.root order by (c.address = ''), (c.phone = ''), c.center_id) survivor from roots r join c on c.center_id = r.id),
s as (select root, array_to_string(list_sort(list(distinct source)), ',') merged_sources from g group by root)
select center_id, nullif(survivor, center_id) as canonical_id, merged_sources from g join s using (root)""")
def center_dedup(spark, sf):
    return centers.reconcile(view(spark, sf, "centers_v"))


# ---------------------------------------------------------------- time

@query("""with d as (select cast(date_trunc('day', ts) as timestamp) ts, count(*) n, count(*) filter (event_type = 'click') clicks from events group by 1), l as (select * from d order by ts desc limit 20)
select count(*) as points, min(ts) as since, max(ts) as until, max_by(n, ts) - min_by(n, ts) as n, max_by(clicks, ts) - min_by(clicks, ts) as clicks from l""")
def history_delta(spark, sf):
    d = table(spark, sf, "events").groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "click").alias("clicks"))
    return registry.history_delta(d, ["n", "clicks"], 20)


@query("select event_id, count(*) over (partition by user_id order by ts range between interval 6 hour preceding and current row) as in_window from events")
def sliding_rate(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("key"), "ts", "event_id")
    return registry.window_counts(e, 6 * 3600).select("event_id", "in_window")


@query("""with recursive e as (select user_id, event_id, ts, row_number() over (partition by user_id order by ts, event_id) rn from events),
g(user_id, event_id, rn, allowed, taken) as (
  select user_id, event_id, rn, true, [ts] from e where rn = 1
  union all
  select e.user_id, e.event_id, e.rn, len(list_filter(g.taken, lambda t: e.ts - t <= interval 12 hour)) < 2,
    case when len(list_filter(g.taken, lambda t: e.ts - t <= interval 12 hour)) < 2 then list_append(list_filter(g.taken, lambda t: e.ts - t <= interval 12 hour), e.ts) else g.taken end
  from g join e on e.user_id = g.user_id and e.rn = g.rn + 1)
select event_id, allowed from g""")
def rate_limit_greedy(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("key"), "ts", "event_id")
    return registry.rate_limit(e, 2, 12 * 3600.0, "event_id").select("event_id", "allowed")


@query(f"""with c as (select event_type source, user_id identity, max(ts) checked_at from events group by all)
select source, identity from c where checked_at <= timestamp '2024-01-31 00:00:00' - interval 1440 minute""")
def ttl_recheck(spark, sf):
    c = table(spark, sf, "events").groupBy(F.col("event_type").alias("source"), F.col("user_id").alias("identity")).agg(F.max("ts").alias("checked_at"))
    return registry.unchecked(c.select("source", "identity"), c, F.lit("2024-01-31").cast("timestamp_ntz"), 1440)


@query(f"""with s as (select user_id id, max(value) > 99 enabled, cast(user_id % 3 * 600 as integer) cadence_min, 'h' || (user_id % 7) hash from events group by user_id),
st as (select user_id id, 'h' || (user_id % 5) hash, max(ts) last_run from events where event_type = 'click' group by user_id)
select s.id, s.enabled, s.cadence_min, s.hash from s left join st on s.id = st.id where enabled and (st.hash is null or st.hash <> s.hash or epoch(timestamp '2024-01-31 00:00:00' - last_run) >= cadence_min * 60)""")
def due_sources(spark, sf):
    e = table(spark, sf, "events")
    s = e.groupBy(F.col("user_id").alias("id")).agg((F.max("value") > 99).alias("enabled")).select("id", "enabled", (F.col("id") % 3 * 600).cast("int").alias("cadence_min"), F.concat(F.lit("h"), (F.col("id") % 7).cast("string")).alias("hash"))
    st = e.filter("event_type = 'click'").groupBy(F.col("user_id").alias("id")).agg(F.max("ts").cast("timestamp").alias("last_run")).withColumn("hash", F.concat(F.lit("h"), (F.col("id") % 5).cast("string")))
    return registry.due(s, st, F.lit("2024-01-31 00:00:00").cast("timestamp"))


@query("""with h as (select user_id identity, event_type source, cast(event_id % 4 as integer) variant, event_id from events)
select identity, source, variant, event_id from (select *, min(variant) over (partition by source, identity) m from h) where variant = m""")
def first_hit_probe(spark, sf):
    h = table(spark, sf, "events").select(F.col("user_id").alias("identity"), F.col("event_type").alias("source"), (F.col("event_id") % 4).cast("int").alias("variant"), "event_id")
    return registry.first_hits(h)


# ---------------------------------------------------------------- sets, streams

@query("""select source, count(*) as n, cast(sum(length(text)) as bigint) as chars from (select 'd:' || source source, text from documents union all select 'c:' || role, text from conversations union all select 'b', text from benchmark) group by source""")
def union_sources(spark, sf):
    d = table(spark, sf, "documents").select(F.concat(F.lit("d:"), "source").alias("source"), "text", "lang")
    c = table(spark, sf, "conversations").select(F.concat(F.lit("c:"), "role").alias("source"), "text")
    b = table(spark, sf, "benchmark").select(F.lit("b").alias("source"), "text")
    every = d.unionByName(c, allowMissingColumns=True).unionByName(b, allowMissingColumns=True)
    return every.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query("select sha256(text) as digest, min(doc_id) as doc_id, count(*) as copies from documents group by text")
def dedupe_documents(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return d.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@query("select cast(date_trunc('day', ts) as timestamp) as since, event_type, count(*) as n, round(sum(value), 2) as total from events group by all")
def tumbling_events(spark, sf):
    t = tumbling(table(spark, sf, "events"))
    return t.select(F.col("since").cast("timestamp_ntz").alias("since"), "event_type", "n", F.round("total", 2).alias("total"))


_PLAIN = "trim(regexp_replace(display_name, '[^A-Z0-9]+', ' ', 'g'))"


@query(f"""with {ctes('person_records')}, x as (select *, {_PLAIN} nm, record_id % 6 = 0 many, origin || ' / ' || hospital place from person_records)
select cast(record_id as varchar) as uid, nm as full_name, array_to_string(list_sort(list_distinct(list_filter(string_split(nm, ' '), lambda t: t not in ('DE','DEL','DI','LA','LOS','Y')))), ' ') as name_key,
  case when many then '12345678' else ci end as ci, case when many then '' else age end as age, case when many then '' else 'F' end as sex, place as origin, status from x
union all select record_id || '#1', 'LUIS MORA', 'LUIS MORA', '9876543', '', '', place, status from x where many""")
def split_registry_names(spark, sf):
    v = view(spark, sf, "person_records")
    many = F.when(F.col("record_id") % 6 == 0, F.concat("display_name", F.lit(" CI 12.345.678 y Luis Mora V-9876543"))).otherwise(F.col("display_name"))
    rows = v.select(F.col("record_id").alias("id"), many.alias("nombre"), F.col("ci").alias("cedula"), F.col("age").alias("edad"), F.lit("f").alias("genero"), F.col("origin").alias("ciudad"), F.col("hospital").alias("zona"), "status")
    return readers.split_people(rows).select("uid", "full_name", "name_key", "ci", "age", "sex", "origin", "status")


# ---------------------------------------------------------------- helpers that other queries don't reach

_CLEAN = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"


@query(f"""with w as (select doc_id, text, string_split({_CLEAN.format('text')}, ' ') w, string_split({UPPER.format('text')}, ' ') u from documents)
select doc_id, md5(array_to_string(list_filter(w, lambda x, i: i = 1 or upper(x) <> upper(w[i - 1])), ' ')) as squeezed, cast(len(list_filter(u, lambda t: length(t) >= 4 and t <> 'MIT')) as integer) as telling,
  cast(least(100000, floor(length(text) / 4e0) + 2 * 1100 + 50) as integer) as tokens from w""")
def text_helpers_documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.squeeze_repeats("text")).alias("squeezed"), F.size(geo.distinctive_words("text", ("MIT",))).alias("telling"), T.estimated_tokens("text", 2, 50).alias("tokens"))


@query("""with d as (select o_orderkey, o_custkey, o_orderpriority p, o_orderstatus s, day(o_orderdate) d, month(o_orderdate) m, year(o_orderdate) y from orders)
select o_orderkey, d || '/' || m || '/' || y as noted, lpad(cast(d as varchar), 2, '0') || '/' || lpad(cast(m as varchar), 2, '0') || '/' || y as filed, case when o_custkey % 3 = 0 then 'nm:' || array_to_string(list_sort(list_distinct(string_split('ANA MORA ' || s, ' '))), ' ') else 'ci:' || o_custkey end as identity,
  case when length(p) > 8 then p else 'abcdefgh' end as longest from d""")
def record_helpers_orders(spark, sf):
    o = table(spark, sf, "orders")
    d, k = F.col("o_orderdate"), F.col("o_custkey")
    noted = F.concat_ws("", F.lit("visto el "), F.dayofmonth(d), F.lit(" / "), F.month(d), F.lit("/"), F.year(d), F.lit(" tarde"))
    name = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("IMG-"), F.date_format(d, "yyyyMMdd"), F.lit("-WA.jpg"))).otherwise(F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit(" lista.png")))
    return o.select("o_orderkey", fields.find_date(noted).alias("noted"), fields.date_of_file(name).alias("filed"), ids.identity(F.when(k % 3 == 0, "").otherwise(k.cast("string")), F.concat(F.lit("Mora de Ana "), "o_orderstatus")).alias("identity"),
                    T.longest_spelling(F.concat(F.lit("abcdefgh / "), "o_orderpriority", F.lit(" / x"))).alias("longest"))


@query("""with l as (select p_partkey, list_distinct(string_split(p_name, ' ')) a, list_distinct(string_split(lower(p_name || ' ' || p_type), ' ')) b from part), s as (select *, len(list_intersect(a, b)) n from l)
select p_partkey, round(n / len(list_distinct(a || b)), 6) as jaccard, round(n / greatest(1, least(len(a), len(b))), 6) as overlap, case when p_partkey % 4 = 0 then 0 else len(a) end as listed, case when p_partkey % 4 = 0 then len(b) else len(list_distinct(a || b)) end as merged from s""")
def list_helpers_parts(spark, sf):
    a, b = F.array_distinct(F.split("p_name", " ")), F.array_distinct(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " "))
    noted = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("["), F.to_json(F.array("p_name")))).otherwise(F.to_json(a))
    p = table(spark, sf, "part").select("p_partkey", a.alias("a"), b.alias("b"), fields.json_list(noted).alias("l"))
    return p.select("p_partkey", F.round(fields.jaccard("a", "b"), 6).alias("jaccard"), F.round(fields.overlap("a", "b"), 6).alias("overlap"), F.size("l").cast("long").alias("listed"), F.size(fields.merge_lists("l", F.concat("b", F.array(F.lit(""), F.lit(None).cast("string"))))).cast("long").alias("merged"))


@query(f"""with {ctes('centers_v')} select center_id, ctype, status, confirmations from (select center_id, name, municipality, address, 'acopio' ctype, 'active' status, cast(center_id = 12 as integer) confirmations from centers_v)
where contains(lower(municipality), 'brand#1') and contains(lower(name), 'annex') and address <> '' order by center_id limit 100""")
def center_search(spark, sf):
    v = view(spark, sf, "centers_v").withColumn("needs", F.lit("agua")).withColumn("ctype", F.lit(""))
    c = centers.confirm(centers.enrich(v).withColumn("last_confirmed", F.lit(None).cast("timestamp")), F.lit(12), F.lit(NOW).cast("timestamp"))
    return centers.search(c.filter("address <> ''"), q="Annex", municipality="BRAND#1", need="agua", status="active", ctype="acopio").select("center_id", "ctype", "status", "confirmations")


@query(f"""with {_PEOPLE} select p.entity, p.primary_ci, count(*) as records, min(r.record_id) as first from people p join person_records r on p.entity = cast(floor(r.record_id / 4e0) as bigint)
where p.entity = (select min(entity) from people where list_contains(cis, '10000014')) group by all""")
def person_by_number(spark, sf):
    r = view(spark, sf, "person_records").withColumn("entity", F.floor(F.col("record_id") / 4).cast("long"))
    one = search.person_by_id(_people(spark, sf), r, "10.000.014")
    return one.select("entity", "primary_ci", F.size("records").cast("long").alias("records"), F.get("records", F.lit(0))["record_id"].alias("first"))


@query(f"with {_PEOPLE} select entity, n_records from people where ci_conflict or (entity % 3 = 0 and n_records > 1) order by n_records desc, entity limit 200")
def review_queue(spark, sf):
    return search.review_queue(_people(spark, sf).withColumn("only_name_merge", F.col("entity") % 3 == 0), 200).select("entity", "n_records")


@query(f"""with {ctes('person_records')}, {_ZONES} select origin, count(*) as n from person_records where not exists (select 1 from zones where contains(lower(origin), zone)) group by origin order by n desc, origin limit 45""")
def origin_audit(spark, sf):
    r = view(spark, sf, "person_records").select(F.col("record_id").alias("id"), F.lit(0).alias("pos"), "origin")
    return registry.audit(r.join(geo.zones_found(r, _zones(spark, sf)).select("id", "lat"), "id", "left"))


@query("select source as video, min(doc_id) as t from documents group by source, text")
def distinct_frames_documents(spark, sf):
    return readers.distinct_frames(table(spark, sf, "documents").select(F.col("source").alias("video"), F.col("doc_id").alias("t"), "text")).select("video", "t")


@query(f"""with {_PEOPLE}, p as (select x.entity a, y.entity b, x.cis ca, y.cis cb from people x join people y on y.entity = x.entity + 1),
k as (select a, b, list_filter(ca, lambda c: c is not null) ca, list_filter(cb, lambda c: c is not null) cb from p),
f as (select a, b, ca, cb, list_transform(flatten(list_transform(ca, lambda c: list_transform(cb, lambda d: [c, d]))), lambda z: {_RELATION.format(a='z[1]', b='z[2]')}) r from k)
select a, b, case when len(ca) = 0 or len(cb) = 0 then 'missing' when list_contains(r, 'equal') then 'equal' when list_contains(r, 'flip') then 'flip' else 'diff' end as relation, len(ca) > 0 and len(cb) > 0 and len(list_intersect(ca, cb)) = 0 as different from f""")
def relation_labels(spark, sf):
    p = _people(spark, sf)
    x, y = p.select(F.col("entity").alias("a"), F.col("cis").alias("cis_a")), p.select(F.col("entity").alias("b"), F.col("cis").alias("cis_b"))
    pairs = x.join(y.withColumn("a", F.col("b") - 1), "a")
    return review.relation_summary(pairs).select("a", "b", "relation", review.different_numbers("cis_a", "cis_b").alias("different"))


@query(f"""with {ctes('person_records')} select printf('P%05d', row_number() over (order by name_key, record_id)) as person_id, record_id from person_records""")
def numbered_persons(spark, sf):
    return resolve.numbered(view(spark, sf, "person_records").select("name_key", F.col("record_id").alias("entity"))).select("person_id", F.col("entity").alias("record_id"))


@query(f"""with {ctes('person_records')}, p as (select x.record_id, x.display_name, x.ci a, y.ci b from person_records x join person_records y on y.record_id = x.record_id + 1)
select record_id, {UPPER.format("display_name || ' de la Peña'")} as folded, array_to_string(list_sort(list_distinct(list_filter(string_split({UPPER.format("display_name || ' de la Peña'")}, ' '), lambda t: t not in ('DE','DEL','DI','LA','LOS','Y')))), ' ') as name_key,
  {_RELATION.format(a='a', b='b')} as relation, round({KM.format('10.0e0', '-66.0e0', '(10.0e0 + record_id / 1000e0)', '-66.5e0')}, 3) as km from p""")
def sql_functions_persons(spark, sf):
    register(spark)
    v = view(spark, sf, "person_records")
    p = v.select("record_id", "display_name", F.col("ci").alias("a")).join(v.select((F.col("record_id") - 1).alias("record_id"), F.col("ci").alias("b")), "record_id")
    return spark.sql("""select record_id, fold(concat(display_name, ' de la Peña')) folded, name_key(concat(display_name, ' de la Peña')) name_key, ci_relation(a, b) relation,
      round(haversine_km(10.0e0, -66.0e0, 10.0e0 + record_id / 1000e0, -66.5e0), 3) km from {p}""", p=p)


@query(f"""with {ctes('centers_v')}, k as (select *, lower(name || '|' || municipality) ckey from centers_v), old as (select min(center_id) center_id, ckey, coalesce(min_by(address, center_id) filter (address <> ''), '') address from k where center_id % 2 = 0 group by ckey),
new as (select ckey, coalesce(max_by('nueva ' || phone, center_id) filter (phone <> ''), '') address from k where center_id % 3 = 0 group by ckey)
select o.center_id, coalesce(o.ckey, n.ckey) as ckey, coalesce(nullif(n.address, ''), o.address, '') as address, case when n.ckey is not null then 'active' else 'old' end as status, n.ckey is not null as confirmed from old o full join new n on o.ckey = n.ckey""")
def center_refresh(spark, sf):
    v = view(spark, sf, "centers_v").withColumn("_at", F.col("center_id")).withColumn("ckey", centers.key())
    old = centers.merge_last(v.filter("center_id % 2 = 0"), "ckey", "_at", [], ["name", "municipality", "address"]).join(v.filter("center_id % 2 = 0").groupBy("ckey").agg(F.min("center_id").alias("center_id")), "ckey")
    old = old.select("center_id", "name", "municipality", "address", *[F.lit("").alias(c) for c in ("source", "url", "operator", "ctype", "hours", "needs", "phone")], F.array().cast("array<string>").alias("needs_tags"), F.lit("old").alias("status"), F.lit(None).cast("timestamp").alias("last_confirmed"))
    seen = v.filter("center_id % 3 = 0").orderBy("center_id").select("name", "municipality", F.when(F.col("phone") != "", F.concat(F.lit("nueva "), "phone")).otherwise("").alias("address"), F.lit("").alias("hours"), F.lit("").alias("needs"), F.lit("").alias("phone"))
    out = federated.refresh(old, seen, F.lit(NOW).cast("timestamp"))
    return out.select("center_id", centers.key().alias("ckey"), "address", "status", F.col("last_confirmed").isNotNull().alias("confirmed"))


@query(f"""with {_PEOPLE} select p.entity, p.n_records, array_to_string(list_sort(list(distinct r.source)), ',') as listed from people p join person_records r on p.entity = cast(floor(r.record_id / 4e0) as bigint)
where list_contains(statuses, 'fallecido') group by p.entity, p.n_records order by p.n_records desc, p.entity limit 8""")
def agent_persons(spark, sf):
    r = view(spark, sf, "person_records").select(F.floor(F.col("record_id") / 4).cast("long").alias("entity"), "source")
    return search.with_sources(search.for_agent(_people(spark, sf), status="fallecido"), r).select("entity", "n_records", "listed")


@query(f"""with {ctes('centers_v')}
select center_id, case when center_id % 3 = 0 then 1e0 when address <> '' and center_id % 4 = 0 then cast(center_id as double) when municipality like '%1' then 5e-1 end as lat from centers_v""")
def center_places(spark, sf):
    v = view(spark, sf, "centers_v").withColumn("lat", F.when(F.col("center_id") % 3 == 0, F.lit(1.0))).withColumn("lng", F.col("lat"))
    whole = v.filter("center_id % 4 = 0 and address <> ''").select(F.concat_ws(", ", "address", "municipality", F.lit("Venezuela")).alias("q"), F.col("center_id").cast("double").alias("lat"), F.lit(2.0).alias("lng"))
    towns = v.filter("municipality like '%1'").select(F.col("municipality").alias("q"), F.lit(0.5).alias("lat"), F.lit(2.0).alias("lng")).distinct()
    return centers.placed(v, whole.union(towns)).select("center_id", "lat")
