"""Queries of the general problems: units (p3) and references (p4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moltide.operators import references, units
from moltide.sources.tables import table


def _units(spark: SparkSession, d: str) -> DataFrame:
    return units.dataset_units(table(spark, d, "structures"), table(spark, d, "datasets"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return units.values_not_in_common_units(table(spark, d, "structures"), _units(spark, d))


def p3_common_units(spark: SparkSession, d: str) -> DataFrame:
    """Every record once, its values in common units."""
    return units.to_common_units(table(spark, d, "structures"), _units(spark, d)).dropDuplicates(["struct_id"])


def p3_dataset_units(spark: SparkSession, d: str) -> DataFrame:
    """The real units of every data set."""
    return _units(spark, d).select("dset_id", "e_unit_real", "r_unit_real", "f_unit_real")


def _unresolved(spark: SparkSession, d: str) -> DataFrame:
    return references.unresolved(*(table(spark, d, t) for t in ("datasets", "structures", "predictsets", "rsets", "models")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _unresolved(spark, d)


def p4_by_month(spark: SparkSession, d: str) -> DataFrame:
    return references.by_period(_unresolved(spark, d))


QUERIES = {q.__name__: q for q in (p3_found, p3_common_units, p3_dataset_units, p4_found, p4_by_month)}

_CLEAN = r"nullif(nullif(regexp_replace(regexp_replace(lower(regexp_replace({0}, '^\s+|\s+$', '', 'g')), '^md5:', ''), '^\s+|\s+$', '', 'g'), ''), 'n/a')"
_P4 = f"""
with owners as (
  select distinct 'datasets' as ref_table, 'r_prov_ids' as ref_field, 'rsets' as parent, dset_id as owner_id, created_at, unnest(map_values(r_prov_ids)) as v from datasets
  union select 'datasets', 'mb_dsets_md5', 'datasets', dset_id, created_at, unnest(mb_dsets_md5) from datasets
  union select 'predictsets', 'models_md5', 'models', pset_id, created_at, unnest(models_md5) from predictsets),
refs as (select ref_table, ref_field, parent, owner_id, created_at, {_CLEAN.format('v')} as k from owners),
targets as (
  select parent, k, min(loaded_at) as loaded_at, min(deleted_at) as deleted_at from (
    select 'rsets' as parent, {_CLEAN.format('rset_md5')} as k, loaded_at, deleted_at from rsets
    union all select 'datasets', {_CLEAN.format('dset_md5')}, loaded_at, deleted_at from datasets
    union all select 'models', {_CLEAN.format('model_md5')}, loaded_at, deleted_at from models) group by 1, 2),
hashes as (
  select ref_table, ref_field, owner_id, r.k as ref_value,
    case when t.k is null then 'missing' when t.loaded_at > created_at then 'late' when t.deleted_at <= created_at then 'deleted' end as ref_state, created_at
  from refs r left join targets t on r.parent = t.parent and r.k = t.k where r.k is not null),
sizes as (select {_CLEAN.format('rset_md5')} as k, max(n_structs) as n_structs, max(n_entities) as n_entities from rsets group by 1),
entries as (select distinct dset_id, unnest(map_entries(r_prov_ids)) as en from datasets),
named as (
  select dset_id, en.key::bigint as source, max(n_structs) as n_structs, max(n_entities) as n_entities
  from entries left join sizes on {_CLEAN.format('en.value')} = k group by 1, 2),
specs as (
  select struct_id as owner_id, created_at, r_prov_specs as s, n.source, n_structs, n_entities
  from structures st left join named n on st.dset_id = n.dset_id and st.r_prov_specs[1] = n.source where len(r_prov_specs) > 0),
found as (
  select ref_table, ref_field, owner_id, ref_value, ref_state, created_at from hashes where ref_state is not null
  union all select 'structures', 'r_prov_specs', owner_id, array_to_string(s, ','), 'missing', created_at from specs
  where source is null or s[2] < 0 or s[2] >= n_structs or len(list_filter(s[3:], lambda x: x < 0 or x >= n_entities)) > 0),
rows as (select distinct ref_table, ref_field, owner_id, ref_value, ref_state, strftime(created_at, '%Y-%m') as ref_month from found)
"""
ORACLE = {
    "p4_found": _P4 + "select * from rows",
    "p4_by_month": _P4 + "select ref_table, ref_field, ref_state, ref_month, count(*) as n_refs, count(distinct owner_id) as n_owners from rows group by 1, 2, 3, 4",
}
