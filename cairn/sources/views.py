"""Person, site and center records derived from the test tables, the same rows in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairn.session import spread, table

_KEY = {
    "spark": "array_join(array_sort(array_distinct(split(upper(nm), ' '))), ' ')",
    "duckdb": "array_to_string(list_sort(list_distinct(string_split(upper(nm), ' '))), ' ')",
}
_PERSONS = """
select record_id, source, upper(case when fam then nm else concat(p_name, ' ', p_brand) end) display_name, {key} name_key,
  case when record_id % 3 <> 0 and record_id % 7 <> 2
         then cast(10000000 + (cast(floor(record_id / 20e0) as bigint) % 8000) * 10000 + (cast(floor(record_id / 2e0) as bigint) * 7) % 900 as varchar(20))
       when record_id % 9 = 0 then cast(1000 + record_id % 90 as varchar(20)) else '' end ci,
  case when record_id % 10 = 0 then '' when fam then cast(20 + k % 50 as varchar(9)) else cast(p_size as varchar(9)) end age,
  case record_id % 5 when 0 then 'por_localizar' when 1 then 'localizado' when 2 then 'ingresado' when 3 then 'herido' else 'fallecido' end status,
  case when record_id % 11 = 0 then 'No indicada' else concat('Sector nation_', cast(record_id % 30 as varchar(9)), ', zone') end origin,
  p_brand hospital, concat('u', cast(cast(floor(record_id / 3e0) as bigint) as varchar(20))) uid
from (select *, (record_id % 7 < 2 or (record_id % 7 = 2 and k % 3 = 0)) fam,
        case when record_id % 7 = 0 then concat('a', cast(10 + k % 90 as varchar(9)), ' luz fam', cast(k as varchar(9)))
             when record_id % 7 = 1 then concat('a', cast(10 + k % 90 as varchar(9)), ' luz fam', cast(k as varchar(9)), case when k % 2 = 0 then ' paz' else '' end)
             when record_id % 7 = 2 and k % 3 = 0 then concat('a', cast(10 + k % 90 as varchar(9)), ' luz sol fam', cast(k as varchar(9)))
             else concat(p_name, ' ', p_type) end nm
      from (select p_partkey record_id, concat('src', cast(p_partkey % 4 as varchar(9))) source, cast(floor(p_partkey / 7e0) as bigint) k, p_name, p_type, p_brand, p_size from {table}) r0) r1
"""
_SITES = """
select s_suppkey site_id, 10.4e0 + cast((s_suppkey * 37) % 340 as double) / 1000e0 lat, -67.35e0 + cast((s_suppkey * 53) % 1150 as double) / 1000e0 lng from {table}
"""
_CENTERS = """
select p_partkey center_id, concat(p_name, ' ', lower(p_type), ' center', case when p_partkey % 5 = 0 then ' annex' else '' end) name, p_brand municipality,
  concat('src', cast(p_partkey % 4 as varchar(9))) source,
  case when p_partkey % 2 = 0 then concat('addr ', cast(p_partkey as varchar(20))) else '' end address,
  case when p_partkey % 3 = 0 then concat('tel ', cast(p_partkey as varchar(20))) else '' end phone
from {table}
"""
VIEWS = {"person_records": ("part", _PERSONS), "geo_sites": ("supplier", _SITES), "centers_v": ("part", _CENTERS)}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    base, sql = VIEWS[name]
    return spark.sql(sql.format(key=_KEY["spark"], table="{t}"), t=spread(table(spark, sf_dir, base)))


def ctes(*names: str) -> str:
    """The views as common table expressions for DuckDB."""
    return ", ".join(f"{n} as ({VIEWS[n][1].format(key=_KEY['duckdb'], table=VIEWS[n][0])})" for n in names)
