"""Queries on single records: accessors, units, descriptors, distances, cutoffs, cells, stress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moltide.functions import chemistry
from moltide.operators import geometry as g
from moltide.operators.records import atoms, packed, sets
from moltide.queries.common import ATOMS, RECS, records, sql_case
from moltide.sources.tables import table

CELL = (12.0, 14.0, 16.0)


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dataset_accessors(spark: SparkSession, d: str) -> DataFrame:
    """Attributes of each data set with their defaults, atom and record counts."""
    counts = table(spark, d, "structures").groupBy("dset_id").agg(F.countDistinct("struct_id").alias("n_r"))
    meta = table(spark, d, "datasets").groupBy("dset_id").agg(*[F.min_by(c, "loaded_at").alias(c) for c in ("dset_name", "theory", "mb", "z", "comp_ids", "e_unit", "r_unit")])
    default = lambda c: F.coalesce(F.col(c), F.lit("n/a")).alias(c)
    return meta.join(counts, "dset_id", "left").select("dset_id", default("dset_name"), default("theory"), F.coalesce("mb", F.lit(-1)).alias("mb"), default("e_unit"), default("r_unit"), F.size("z").alias("n_z"), F.size("comp_ids").alias("n_fragments"), F.coalesce("n_r", F.lit(0)).alias("n_r"))


def element_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Atoms of every data set as symbols."""
    return sets(table(spark, d, "datasets")).select("dset_id", F.array_join(F.transform("z", chemistry.symbol), " ").alias("symbols"))


def fragment_ids(spark: SparkSession, d: str) -> DataFrame:
    """Fragment ids and labels rebuilt from the count of fragments and atoms, beside those stored."""
    s = sets(table(spark, d, "datasets")).filter("size(z) > 0 and size(comp_ids) > 0 and size(z) % size(comp_ids) = 0")
    n = F.size("comp_ids")
    made = chemistry.repeat_ids(n, (F.size("z") / n).cast("int"))
    return s.select("dset_id", F.array_join(made.cast("array<string>"), ",").alias("made_ids"), F.array_join(chemistry.repeat_labels(F.get("comp_ids", F.lit(0)), n), ",").alias("first_label"), (made == F.col("entity_ids")).alias("as_stored"))


def unit_conversion(spark: SparkSession, d: str) -> DataFrame:
    """Energies, all coordinates and all forces of every record taken as hartree, bohr and hartree/bohr, in common units: the energy, and the mean squares of the others."""
    e = chemistry.convert_energy(F.col("e"), "hartree", "kcal/mol")
    r = F.transform("r", lambda x: chemistry.convert_length(x, "bohr", "angstrom"))
    f = F.transform("f", lambda x: chemistry.convert_force(x, ("hartree", "bohr"), ("kcal/mol", "angstrom")))
    mean = lambda a: _sum(F.transform(a, lambda x: x * x)) / F.size(a)
    return records(spark, d).select("struct_id", F.round(e, 2).alias("e"), F.round(F.sqrt(mean(r)), 6).alias("r_rms"), F.round(F.sqrt(mean(f)), 3).alias("f_rms"))


def centered_structures(spark: SparkSession, d: str) -> DataFrame:
    """Every atom relative to its record's center of mass, summed up by the spread around it."""
    c = g.centered(F.col("r"), F.col("z"))
    return records(spark, d).select("struct_id", F.round(_sum(F.transform(c, lambda x: x * x)), 5).alias("spread"), *[F.round(F.get(c, F.lit(k)), 6).alias(f"first_{n}") for k, n in enumerate("xyz")])


def center_of_mass(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).withColumn("c", g.center_of_mass(F.col("r"), F.col("z"))).select("struct_id", *[F.round(F.col(f"c.{n}"), 6).alias(n) for n in "xyz"])


def pair_distances(spark: SparkSession, d: str) -> DataFrame:
    """All pair distances, one row a pair."""
    rows = records(spark, d).select("struct_id", F.inline(g.over_pairs(F.col("r"), lambda i, j, v: F.struct(i.alias("i"), j.alias("j"), F.round(g.norm(v), 6).alias("distance")))))
    return rows


def pair_summary(spark: SparkSession, d: str) -> DataFrame:
    """Least, largest and total pair distance, and the two pair orders' checksums."""
    rows = records(spark, d).select("struct_id", F.explode(F.array(F.struct(g.pair_distances(F.col("r")).alias("low"), g.upper_pair_distances(F.col("r")).alias("up")))).alias("d"))  # each list is made once
    weighted = lambda a: F.aggregate(F.transform(a, lambda x, k: x * (k + 1)), F.lit(0.0), lambda s, x: s + x)
    return rows.select("struct_id", F.round(F.array_min("d.low"), 6).alias("least"), F.round(F.array_max("d.low"), 6).alias("largest"), F.round(_sum(F.col("d.low")), 4).alias("total"), F.round(weighted("d.low"), 3).alias("lower_order"), F.round(weighted("d.up"), 3).alias("upper_order"))


def inverse_descriptor(spark: SparkSession, d: str) -> DataFrame:
    x = g.inverse_distances(F.col("r"))
    return records(spark, d).select("struct_id", F.size(x).alias("n_pairs"), F.round(_sum(x), 6).alias("total"), F.round(F.array_max(x), 6).alias("largest"))


def descriptor_jacobian(spark: SparkSession, d: str) -> DataFrame:
    """The Jacobian's components summed over pairs, and the forces that equal pair values put on the atoms: the first one's, and the mean square of all."""
    n = F.size("z")
    ones = F.array_repeat(F.lit(1.0), F.floor(n * (n - 1) / 2).cast("int"))
    rows = records(spark, d).select("struct_id", g.let(g.descriptor_jacobian(F.col("r")), lambda j: F.array(*[_component_sum(j, c) for c in range(3)])).alias("s"), g.scatter_to_atoms(F.col("r"), ones).alias("f"))
    parts = [F.round(F.get("s", F.lit(k)), 6).alias(f"sum_{n}") for k, n in enumerate("xyz")]
    first = [F.round(F.get("f", F.lit(k)), 6).alias(f"first_{n}") for k, n in enumerate("xyz")]
    return rows.select("struct_id", *parts, *first, F.round(F.aggregate("f", F.lit(0.0), lambda s, x: s + x * x) / F.size("f"), 6).alias("mean_square"))


def _component_sum(j: Column, k: int) -> Column:
    return F.aggregate(j, F.lit(0.0), lambda s, v: s + F.get(v, F.lit(k)))


def descriptor_times_forces(spark: SparkSession, d: str) -> DataFrame:
    """How every pair's descriptor moves along the forces: the least, largest and total of the products."""
    x = g.jacobian_times(F.col("r"), F.col("f"))
    return records(spark, d).filter("size(f) = 3 * size(z)").select("struct_id", x.alias("x")).select("struct_id", F.round(F.array_min("x"), 4).alias("least"), F.round(F.array_max("x"), 4).alias("largest"), F.round(_sum(F.col("x")), 3).alias("total"))


def com_distance_sum(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).select("struct_id", F.round(g.com_distance_sum(F.col("r"), F.col("z"), F.col("entity_ids")), 6).alias("spread"))


def criteria(spark: SparkSession, d: str) -> DataFrame:
    """Records that strict cutoffs on the fragments' spread accept: below 8, above 8, between 5 and 10, all."""
    rows = records(spark, d).select("struct_id", "dset_id", F.round(g.com_distance_sum(F.col("r"), F.col("z"), F.col("entity_ids")), 6).alias("v"))
    tests = {"upper": (8.0, "upper"), "lower": (8.0, "lower"), "between": ((10.0, 5.0), "upper"), "all_of_them": (None, "upper")}
    return rows.groupBy("dset_id").agg(*[F.sum(F.when(g.accepted(F.col("v"), c, b), 1).otherwise(0)).alias(n) for n, (c, b) in tests.items()])


def minimum_image(spark: SparkSession, d: str) -> DataFrame:
    """Pair distances in a periodic cell, coordinates relative to the first atom, and the records within half the shortest side."""
    near, rel = g.pair_distances(F.col("r"), CELL), g.relative_to_first(F.col("r"), CELL)
    return records(spark, d).select("struct_id", F.round(F.array_max(near), 6).alias("largest"), F.round(_sum(near), 4).alias("total"), F.round(_sum(F.transform(rel, lambda x: x * x)), 4).alias("spread"), (F.round(F.array_max(near), 6) < min(CELL) / 2).alias("inside"))


def stress(spark: SparkSession, d: str) -> DataFrame:
    """Virial of every record with forces: its Voigt components and the isotropic stress in the cell."""
    rows = records(spark, d).filter((F.size("f") == 3 * F.size("z"))).select("struct_id", g.virial(F.col("r"), F.col("f")).alias("w"))
    v = chemistry.voigt(F.col("w"))
    iso = g.isotropic_stress(F.col("w"), g.cell_volume(CELL))
    return rows.select("struct_id", *[F.round(F.get(v, F.lit(k)), 4).alias(n) for k, n in enumerate(("xx", "yy", "zz", "yx", "xz", "xy"))], F.round(F.get(iso, F.lit(0)), 7).alias("pressure"))


def atoms_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Atoms in long form per element, and records that come back unchanged when packed again."""
    base = records(spark, d)
    back = packed(atoms(base)).withColumnsRenamed({"r": "r2", "z": "z2"}).select("struct_id", "r2", "z2")
    same = base.join(back, "struct_id").groupBy().agg(F.sum(F.when((F.col("r") == F.col("r2")) & (F.col("z") == F.col("z2")), 1).otherwise(0)).alias("unchanged"))
    counts = atoms(base).groupBy("symbol").agg(F.count(F.lit(1)).alias("n_atoms"), F.countDistinct("struct_id").alias("n_records"))
    return counts.crossJoin(F.broadcast(same))  # one row against a row an element


QUERIES = {q.__name__: q for q in (
    dataset_accessors, element_symbols, fragment_ids, unit_conversion, centered_structures, center_of_mass, pair_distances, pair_summary,
    inverse_descriptor, descriptor_jacobian, descriptor_times_forces, com_distance_sum, criteria, minimum_image, stress, atoms_round_trip,
)}

_D = "with d as (select * from datasets qualify row_number() over (partition by dset_id order by loaded_at) = 1) "
_COM = ATOMS + ", com as (select struct_id, sum(mass * x) / sum(mass) as cx, sum(mass * y) / sum(mass) as cy, sum(mass * w) / sum(mass) as cw from atoms group by 1)"
_SPREAD = _COM + """, parts as (select struct_id, entity_id, sum(mass * x) / sum(mass) as px, sum(mass * y) / sum(mass) as py, sum(mass * w) / sum(mass) as pw from atoms group by 1, 2),
spread as (select struct_id, round(sum(sqrt((px - cx) ** 2 + (py - cy) ** 2 + (pw - cw) ** 2)), 6) as v from parts join com using (struct_id) group by 1)"""
_MIC = lambda c, a: f"({c} - {a} * round_even({c} / {a}, 0))"
_MIC_NORM = f"sqrt({_MIC('dx', CELL[0])} ** 2 + {_MIC('dy', CELL[1])} ** 2 + {_MIC('dw', CELL[2])} ** 2)"
ORACLE = {
    "dataset_accessors": """with m as (select * from datasets qualify row_number() over (partition by dset_id order by loaded_at) = 1),
        c as (select dset_id, count(distinct struct_id) as n_r from structures group by 1)
        select dset_id, coalesce(dset_name, 'n/a') as dset_name, coalesce(theory, 'n/a') as theory, coalesce(mb, -1) as mb, coalesce(e_unit, 'n/a') as e_unit, coalesce(r_unit, 'n/a') as r_unit,
          len(z) as n_z, len(comp_ids) as n_fragments, coalesce(n_r, 0) as n_r from m left join c using (dset_id)""",
    "element_symbols": _D + f", a as (select dset_id, z, unnest(range(len(z))) as i from d) select dset_id, string_agg({sql_case('z[i + 1]', 0)}, ' ' order by i) as symbols from a group by 1",
    "fragment_ids": _D + """, k as (select *, len(z) // len(comp_ids) as each from d where len(z) > 0 and len(comp_ids) > 0 and len(z) % len(comp_ids) = 0),
        m as (select *, list_transform(range(len(z)), lambda i: (i // each)::int) as made from k)
        select dset_id, array_to_string(made, ',') as made_ids, array_to_string(list_transform(comp_ids, lambda c: comp_ids[1]), ',') as first_label, made = entity_ids as as_stored from m""",
    "unit_conversion": RECS + """select struct_id, round(e * 627.5094740631, 2) as e, round(sqrt(list_sum(list_transform(r, lambda x: (x * 0.529177210903) ** 2)) / len(r)), 6) as r_rms,
        round(sqrt(list_sum(list_transform(f, lambda x: (x * (627.5094740631 / 0.529177210903)) ** 2)) / len(f)), 3) as f_rms from recs""",
    "centered_structures": _COM + """select struct_id, round(sum((x - cx) ** 2 + (y - cy) ** 2 + (w - cw) ** 2), 5) as spread, round(max(case when a = 0 then x - cx end), 6) as first_x,
        round(max(case when a = 0 then y - cy end), 6) as first_y, round(max(case when a = 0 then w - cw end), 6) as first_z from atoms join com using (struct_id) group by 1""",
    "center_of_mass": _COM + "select struct_id, round(cx, 6) as x, round(cy, 6) as y, round(cw, 6) as z from com",
    "pair_distances": ATOMS + "select struct_id, i, j, round(dist, 6) as distance from pairs",
    "pair_summary": ATOMS + """, n as (select struct_id, count(*) as k from atoms group by 1), o as (
          select *, i * (i - 1) // 2 + j + 1 as lo, j * k - j * (j + 1) // 2 + (i - j) as up from pairs join n using (struct_id))
        select struct_id, round(min(dist), 6) as least, round(max(dist), 6) as largest, round(sum(dist), 4) as total, round(sum(dist * lo), 3) as lower_order, round(sum(dist * up), 3) as upper_order from o group by 1""",
    "inverse_descriptor": ATOMS + "select struct_id, count(*) as n_pairs, round(sum(1 / dist), 6) as total, round(max(1 / dist), 6) as largest from pairs group by 1",
    "descriptor_jacobian": ATOMS + """, fa as (select struct_id, j as a, dx / dist ** 3 as x, dy / dist ** 3 as y, dw / dist ** 3 as w from pairs union all select struct_id, i, -dx / dist ** 3, -dy / dist ** 3, -dw / dist ** 3 from pairs),
        on_atom as (select struct_id, a, sum(x) as x, sum(y) as y, sum(w) as w from fa group by 1, 2), ms as (select struct_id, avg(x * x + y * y + w * w) / 3 as m from on_atom group by 1)
        select struct_id, round(sum(dx / dist ** 3), 6) as sum_x, round(sum(dy / dist ** 3), 6) as sum_y, round(sum(dw / dist ** 3), 6) as sum_z,
        round(sum(case when j = 0 then dx / dist ** 3 else 0 end), 6) as first_x, round(sum(case when j = 0 then dy / dist ** 3 else 0 end), 6) as first_y, round(sum(case when j = 0 then dw / dist ** 3 else 0 end), 6) as first_z,
        round(any_value(m), 6) as mean_square from pairs join ms using (struct_id) group by 1""",
    "descriptor_times_forces": ATOMS + """, m as (select p.struct_id, (p.dx * (b.fx - a.fx) + p.dy * (b.fy - a.fy) + p.dw * (b.fz - a.fz)) / dist ** 3 as v from pairs p join atoms a on p.struct_id = a.struct_id and p.i = a.a
          join atoms b on p.struct_id = b.struct_id and p.j = b.a where p.struct_id in (select struct_id from recs where len(f) = 3 * len(z)))
        select struct_id, round(min(v), 4) as least, round(max(v), 4) as largest, round(sum(v), 3) as total from m group by 1""",
    "com_distance_sum": _SPREAD + "select struct_id, v as spread from spread",
    "criteria": _SPREAD + """select dset_id, sum((v < 8)::int) as upper, sum((v > 8)::int) as lower, sum((v > 5 and v < 10)::int) as between, count(*) as all_of_them from spread join recs using (struct_id) group by 1""",
    "minimum_image": ATOMS + f""", m as (select struct_id, max({_MIC_NORM}) as largest, sum({_MIC_NORM}) as total from pairs group by 1),
        q as (select t.struct_id, t.x - o.x as qx, t.y - o.y as qy, t.w - o.w as qw from atoms t join atoms o on t.struct_id = o.struct_id and o.a = 0),
        c as (select struct_id, sum({_MIC('qx', CELL[0])} ** 2 + {_MIC('qy', CELL[1])} ** 2 + {_MIC('qw', CELL[2])} ** 2) as spread from q group by 1)
        select struct_id, round(largest, 6) as largest, round(total, 4) as total, round(spread, 4) as spread, round(largest, 6) < {min(CELL) / 2} as inside from m join c using (struct_id)""",
    "stress": ATOMS + f""", v as (select struct_id, sum(x * fx) as xx, sum(y * fy) as yy, sum(w * fz) as zz, sum(y * fx) as yx, sum(x * fz) as xz, sum(x * fy) as xy
          from atoms where struct_id in (select struct_id from recs where len(f) = 3 * len(z)) group by 1)
        select struct_id, round(xx, 4) as xx, round(yy, 4) as yy, round(zz, 4) as zz, round(yx, 4) as yx, round(xz, 4) as xz, round(xy, 4) as xy, round((xx + yy + zz) / 3 / {g.cell_volume(CELL)}, 7) as pressure from v""",
    "atoms_round_trip": ATOMS + f"select {sql_case('number', 0)} as symbol, count(*) as n_atoms, count(distinct struct_id) as n_records, (select count(*) from recs) as unchanged from atoms group by 1",
}
