"""Shared pieces of the queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from moltide.functions.chemistry import ELEMENTS
from moltide.operators.records import complete_records
from moltide.sources.tables import table


def records(spark: SparkSession, d: str) -> DataFrame:
    return complete_records(table(spark, d, "structures"), table(spark, d, "datasets"))


def sql_case(value: str, key: int) -> str:
    return "case " + value + " " + " ".join(f"when {z} then {f'{x[key]!r}'}" for z, x in ELEMENTS.items()) + " end"


#: Complete records and their atoms, for DuckDB.
RECS = """
with d as (select * from datasets qualify row_number() over (partition by dset_id order by loaded_at) = 1),
s as (select * from structures qualify row_number() over (partition by struct_id order by loaded_at) = 1),
recs as (
  select s.struct_id, s.dset_id, case when isnan(s.e) then null else s.e end as e, s.r, s.f, s.r_prov_specs, d.z, d.entity_ids, d.comp_ids, d.mb, d.theory
  from s join d using (dset_id)
  where len(s.r) = 3 * len(d.z) and len(list_filter(s.r, lambda x: x is null or isnan(x) or isinf(x))) = 0)
"""
ATOMS = (
    RECS
    + """, idx as (select *, unnest(range(len(z))) as a from recs),
atoms as (
  select struct_id, dset_id, mb, a, z[a + 1] as number, entity_ids[a + 1] as entity_id, comp_ids[entity_ids[a + 1] + 1] as comp_id,
    """
    + sql_case("z[a + 1]", 1)
    + """ as mass, r[3 * a + 1] as x, r[3 * a + 2] as y, r[3 * a + 3] as w,
    f[3 * a + 1] as fx, f[3 * a + 2] as fy, f[3 * a + 3] as fz from idx),
pairs as (
  select p.struct_id, p.dset_id, p.a as i, q.a as j, p.x - q.x as dx, p.y - q.y as dy, p.w - q.w as dw, p.number as ni, q.number as nj, p.entity_id as ei, q.entity_id as ej,
    sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.w - q.w) ** 2) as dist
  from atoms p join atoms q on p.struct_id = q.struct_id and p.a > q.a)
"""
)
