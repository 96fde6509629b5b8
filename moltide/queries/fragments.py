"""Queries on fragments: combinations, provenance, many-body sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moltide.operators import fragments as fr
from moltide.operators import geometry as g
from moltide.plans import nbody
from moltide.queries.common import ATOMS, RECS, records
from moltide.queries.problems import _CLEAN
from moltide.sources.tables import table

CUTOFF = 6.0


def combinations_by_label(spark: SparkSession, d: str) -> DataFrame:
    """Ascending combinations of each model's labels in every record, by data set and model."""
    models = table(spark, d, "models").select(F.array_join("comp_ids", ",").alias("labels")).filter("labels <> ''").distinct().orderBy("labels").collect()  # the models' label lists, a few
    counts = [F.struct(F.lit(x).alias("labels"), F.size(fr.labelled_combinations(F.col("comp_ids"), x.split(","))).alias("n")) for (x,) in models]
    rows = records(spark, d).select("struct_id", "dset_id", F.inline(F.array(*counts))).filter("n > 0")
    return rows.groupBy("dset_id", "labels").agg(F.sum("n").alias("combs"), F.count(F.lit(1)).alias("records"))


def _pairs_of_fragments(spark: SparkSession, d: str) -> DataFrame:
    rows = nbody.decomposed(records(spark, d), [nbody.NBodyModel(None, (None, None))], None, "dset_id")
    return rows.select("struct_id", "dset_id", "comb", F.round("spread", 6).alias("spread"))


def fragment_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Fragment pairs of every record with the sum of their distances to their common center, and whether it is under the cutoff."""
    rows = _pairs_of_fragments(spark, d)
    return rows.select("struct_id", F.get("comb", F.lit(0)).alias("entity_a"), F.get("comb", F.lit(1)).alias("entity_b"), "spread", g.accepted(F.col("spread"), CUTOFF).alias("accepted"))


def fragment_pair_counts(spark: SparkSession, d: str) -> DataFrame:
    """Pairs, accepted pairs and mean spread by data set: combinations, cutoff, aggregation."""
    rows = _pairs_of_fragments(spark, d)
    ok = g.accepted(F.col("spread"), CUTOFF)
    return rows.groupBy("dset_id").agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.when(ok, 1).otherwise(0)).alias("accepted"), F.round(F.avg("spread"), 4).alias("mean_spread"))


def _sourced(spark: SparkSession, d: str) -> DataFrame:
    rows = fr.with_source(records(spark, d), table(spark, d, "datasets"))
    level = F.regexp_replace(F.lower(F.trim("theory")), "[^a-z0-9]+", "")
    return rows.select("struct_id", "dset_id", "mb", "e", "source", "frame", "fragments", F.coalesce(level, F.lit("")).alias("theory"), F.size("comp_ids").alias("n_fragments"), F.when(F.size("f") == 3 * F.size("z"), F.col("f")).alias("f"), "entity_ids")


def provenance_combinations(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of the source's fragments that each record was cut from, counted by source."""
    rows = _sourced(spark, d).select("source", "struct_id", F.explode(fr.combinations_of(F.col("fragments"), 2)).alias("pair"))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct("pair").alias("different"), F.countDistinct("struct_id").alias("records"))


def many_body_remove(spark: SparkSession, d: str) -> DataFrame:
    """Energies of four-fragment records without the energies of the three-fragment records cut from the same frame."""
    rows = _sourced(spark, d)
    parents, lower = rows.filter("n_fragments = 4"), rows.filter("n_fragments = 3")
    out = fr.many_body(parents, fr.contributions(parents, lower, 3), "remove")
    return out.select("struct_id", "found", F.round("e", 4).alias("e"), F.round("e_new", 4).alias("e_rest"))


def many_body_add(spark: SparkSession, d: str) -> DataFrame:
    """The way back: the contributions added again give the parents' energies."""
    rows = _sourced(spark, d)
    parents, lower = rows.filter("n_fragments = 4"), rows.filter("n_fragments = 3")
    found = fr.contributions(parents, lower, 3)
    rest = fr.many_body(parents, found, "remove").select("struct_id", F.col("e_new").alias("e"))
    both = fr.many_body(rest, found, "add").join(parents.select("struct_id", F.col("e").alias("e_then")), "struct_id")
    return both.agg(F.count(F.lit(1)).alias("parents"), F.sum(F.when(F.col("found") > 0, 1).otherwise(0)).alias("with_parts"), F.sum(F.when(F.abs(F.col("e_new") - F.col("e_then")) > 1e-6, 1).otherwise(0)).alias("changed"))


def many_body_forces(spark: SparkSession, d: str) -> DataFrame:
    """Forces of four-fragment records without those of the three-fragment records cut from the same frame, where the atoms match: the force left on every atom."""
    rows = _sourced(spark, d)
    parents, lower = rows.filter("n_fragments = 4 and f is not null"), rows.filter("n_fragments = 3")
    out = fr.many_body(parents, fr.contributions(parents, lower, 3), "remove").filter("found > 0")
    left = out.select("struct_id", "found", F.posexplode(fr.take_atoms(F.col("f_new"), F.sequence(F.lit(0), F.size("entity_ids") - 1))).alias("k", "v"))
    axis = lambda c: F.round(F.sum(F.when(F.col("k") % 3 == c, F.col("v"))), 5)
    return left.groupBy("struct_id", "found", F.floor(F.col("k") / 3).cast("int").alias("atom_idx")).agg(*[axis(c).alias(n) for c, n in enumerate(("fx", "fy", "fz"))])


QUERIES = {q.__name__: q for q in (combinations_by_label, fragment_pairs, fragment_pair_counts, provenance_combinations, many_body_remove, many_body_add, many_body_forces)}

_PARTS = ATOMS + """, parts as (select struct_id, entity_id, sum(mass) as m, sum(mass * x) / sum(mass) as px, sum(mass * y) / sum(mass) as py, sum(mass * w) / sum(mass) as pw from atoms group by 1, 2),
two as (select p.struct_id, p.entity_id as entity_a, q.entity_id as entity_b, p.m as m1, q.m as m2, sqrt((p.px - q.px) ** 2 + (p.py - q.py) ** 2 + (p.pw - q.pw) ** 2) as l
  from parts p join parts q on p.struct_id = q.struct_id and p.entity_id < q.entity_id)"""
_SOURCED = RECS + """, entries as (select distinct dset_id, unnest(map_entries(r_prov_ids)) as en from datasets),
named as (select distinct dset_id, en.key::bigint as id, """ + _CLEAN.format("en.value") + """ as source from entries),
src as (select r.struct_id, r.dset_id, mb, e, source, r_prov_specs[2] as frame, r_prov_specs[3:] as fragments, coalesce(regexp_replace(lower(trim(theory)), '[^a-z0-9]+', '', 'g'), '') as theory, len(comp_ids) as n_fragments
  from recs r join named n on r.dset_id = n.dset_id and r.r_prov_specs[1] = n.id where len(r_prov_specs) > 2 and source is not null)"""
_LOWER = """, lower as (select source, theory, frame, fragments, arg_min(e, struct_id) as e from src where n_fragments = 3 and e is not null group by 1, 2, 3, 4),
asks as (select struct_id, source, theory, frame, unnest([[fragments[1], fragments[2], fragments[3]], [fragments[1], fragments[2], fragments[4]], [fragments[1], fragments[3], fragments[4]], [fragments[2], fragments[3], fragments[4]]]) as fragments
  from src where n_fragments = 4 and len(fragments) = 4 union all select struct_id, source, theory, frame, fragments from src where n_fragments = 4 and len(fragments) = 3),
got as (select struct_id, count(*) as found, sum(l.e) as e_lower from asks join lower l using (source, theory, frame, fragments) group by 1),
removed as (select struct_id, coalesce(found, 0) as found, s.e, s.e - coalesce(e_lower, 0) as e_rest, e_lower from src s left join got using (struct_id) where n_fragments = 4)"""
ORACLE = {
    "combinations_by_label": RECS + """, parts as (select struct_id, dset_id, unnest(range(len(comp_ids))) as i, comp_ids from recs), p as (select struct_id, dset_id, i, comp_ids[i + 1] as c from parts),
        m as (select distinct comp_ids as l from models),
        k as (select struct_id, dset_id, l from p join m on len(l) = 1 and c = l[1]
          union all select a.struct_id, a.dset_id, l from p a join p b on a.struct_id = b.struct_id and a.i < b.i join m on len(l) = 2 and a.c = l[1] and b.c = l[2]
          union all select a.struct_id, a.dset_id, l from p a join p b on a.struct_id = b.struct_id and a.i < b.i join p c on a.struct_id = c.struct_id and b.i < c.i join m on len(l) = 3 and a.c = l[1] and b.c = l[2] and c.c = l[3]
          union all select a.struct_id, a.dset_id, l from p a join p b on a.struct_id = b.struct_id and a.i < b.i join p c on a.struct_id = c.struct_id and b.i < c.i join p e on a.struct_id = e.struct_id and c.i < e.i join m on len(l) = 4 and a.c = l[1] and b.c = l[2] and c.c = l[3] and e.c = l[4])
        select dset_id, array_to_string(l, ',') as labels, count(*) as combs, count(distinct struct_id) as records from k group by 1, 2""",
    "fragment_pairs": _PARTS + f"select struct_id, entity_a, entity_b, round(l, 6) as spread, round(l, 6) < {CUTOFF} as accepted from two",
    "fragment_pair_counts": _PARTS + f"select dset_id, count(*) as pairs, sum((round(l, 6) < {CUTOFF})::int) as accepted, round(avg(round(l, 6)), 4) as mean_spread from two join recs using (struct_id) group by 1",
    "provenance_combinations": _SOURCED + """, n as (select source, struct_id, fragments, unnest(range(1, len(fragments) + 1)) as i from src), p as (select source, struct_id, fragments, i, unnest(range(i + 1, len(fragments) + 1)) as j from n)
        select source, count(*) as pairs, count(distinct [fragments[i], fragments[j]]) as different, count(distinct struct_id) as records from p group by 1""",
    "many_body_remove": _SOURCED + _LOWER + "select struct_id, found, round(e, 4) as e, round(e_rest, 4) as e_rest from removed",
    "many_body_forces": _SOURCED + """, low as (select source, theory, frame, fragments, arg_min(struct_id, struct_id) as lid from src where n_fragments = 3 and e is not null group by 1, 2, 3, 4),
        par as (select s.* from src s join recs r using (struct_id) where n_fragments = 4 and len(r.f) = 3 * len(r.z)),
        asks as (select struct_id, source, theory, frame, fragments as pf, unnest([[fragments[1], fragments[2], fragments[3]], [fragments[1], fragments[2], fragments[4]], [fragments[1], fragments[3], fragments[4]], [fragments[2], fragments[3], fragments[4]]]) as fragments
          from par where len(fragments) = 4 union all select struct_id, source, theory, frame, fragments, fragments from par where len(fragments) = 3),
        hits as (select a.*, lid from asks a join low l using (source, theory, frame, fragments)), cnt as (select struct_id, count(*) as found from hits group by 1),
        ix as (select struct_id, z, f, entity_ids, unnest(range(len(z))) as a from recs where len(f) = 3 * len(z)),
        pat as (select struct_id, a, entity_ids[a + 1] as en, row_number() over (partition by struct_id, entity_ids[a + 1] order by a) as rn, f[3 * a + 1] as x, f[3 * a + 2] as y, f[3 * a + 3] as w from ix),
        fits as (select h.* from hits h join recs p on p.struct_id = h.struct_id join recs l on l.struct_id = h.lid where len(l.z) = len(list_filter(p.entity_ids, lambda e: list_contains(h.fragments, h.pf[e + 1])))),
        mv as (select h.struct_id, p.a, sum(l.x) as x, sum(l.y) as y, sum(l.w) as w from fits h join pat p on p.struct_id = h.struct_id join pat l on l.struct_id = lid and l.rn = p.rn and l.en = list_position(h.fragments, pf[p.en + 1]) - 1 and list_contains(h.fragments, pf[p.en + 1]) group by 1, 2)
        select p.struct_id, found, p.a as atom_idx, round(p.x - coalesce(m.x, 0), 5) as fx, round(p.y - coalesce(m.y, 0), 5) as fy, round(p.w - coalesce(m.w, 0), 5) as fz from pat p join cnt using (struct_id) left join mv m on m.struct_id = p.struct_id and m.a = p.a""",
    "many_body_add": _SOURCED + _LOWER + "select count(*) as parents, sum((found > 0)::int) as with_parts, sum((abs(e_rest + coalesce(e_lower, 0) - e) > 1e-6)::int) as changed from removed",
}
