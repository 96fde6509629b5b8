"""Records of ``structures`` with what their data set says about the atoms, packed and long."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moltide.functions.chemistry import mass, symbol
from moltide.sources.tables import first_delivery, join_dimension, spread


def once(structures: DataFrame, key: str = "struct_id") -> DataFrame:
    """Every key once, its first delivery (null ``loaded_at`` last), without shuffling the other columns.

    Only key and time are grouped. The few repeated keys are joined as a dimension, and rows that were not their
    first delivery fall; keys delivered twice at one time are then reduced by their own small shuffle.
    """
    late = F.coalesce(F.col("loaded_at").cast("timestamp_ntz"), F.lit("9999-12-31").cast("timestamp_ntz"))
    times = structures.select(key, late.alias("_at")).groupBy(key, "_at").agg(F.count(F.lit(1)).alias("_n"))
    repeated = times.groupBy(key).agg(F.min("_at").alias("_first"), F.min_by("_n", "_at").alias("_ties"), F.sum("_n").alias("_all")).filter("_all > 1").drop("_all")
    rows = join_dimension(spread(structures), repeated, key, "left").filter(F.col("_first").isNull() | (late == F.col("_first")))
    tied = rows.filter("_ties > 1").drop("_first", "_ties")
    single = rows.filter("coalesce(_ties, 1) = 1").drop("_first", "_ties")
    return single.unionByName(tied.dropDuplicates([key])) if repeated.filter("_ties > 1").limit(1).count() else single


def sets(datasets: DataFrame) -> DataFrame:
    return first_delivery(datasets.select("dset_id", "z", "entity_ids", "comp_ids", "mb", "theory", "loaded_at"), "dset_id").drop("loaded_at")


def is_complete(r: Column, z: Column) -> Column:
    """Three finite numbers for every atom."""
    bad = F.exists(r, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return r.isNotNull() & z.isNotNull() & (F.size(r) == 3 * F.size(z)) & ~bad


def complete_records(structures: DataFrame, datasets: DataFrame) -> DataFrame:
    """Complete records, each struct_id once: struct_id, dset_id, e (NaN as null), r, f, r_prov_specs, z, entity_ids, comp_ids, mb, theory."""
    rows = once(structures.select("struct_id", "dset_id", F.when(~F.isnan("e"), F.col("e")).alias("e"), "r", "f", "r_prov_specs", "loaded_at")).drop("loaded_at")
    return join_dimension(rows, sets(datasets), "dset_id").filter(is_complete(F.col("r"), F.col("z")))


def atoms(records: DataFrame) -> DataFrame:
    """One row an atom: struct_id, atom_idx, entity_id, comp_id, number, symbol, mass, x, y, z_, fx, fy, fz."""
    at = records.select("struct_id", "r", "f", "entity_ids", "comp_ids", F.posexplode("z").alias("atom_idx", "number"))
    xyz = [F.get("r", F.col("atom_idx") * 3 + k).alias(n) for k, n in enumerate(("x", "y", "z_"))]
    force = [F.get("f", F.col("atom_idx") * 3 + k).alias(n) for k, n in enumerate(("fx", "fy", "fz"))]
    entity = F.get("entity_ids", F.col("atom_idx"))
    number = F.col("number")
    return at.select("struct_id", "atom_idx", entity.alias("entity_id"), F.get("comp_ids", entity).alias("comp_id"), "number", symbol(number).alias("symbol"), mass(number).alias("mass"), *xyz, *force)


def packed(long: DataFrame) -> DataFrame:
    """The way back: struct_id, z, r and f arrays in atom order."""
    rows = long.groupBy("struct_id").agg(F.array_sort(F.collect_list(F.struct("atom_idx", "number", "x", "y", "z_", "fx", "fy", "fz"))).alias("a"))
    flat = lambda *names: F.flatten(F.transform("a", lambda v: F.array(*[v[n] for n in names])))
    return rows.select("struct_id", F.transform("a", lambda v: v["number"]).alias("z"), flat("x", "y", "z_").alias("r"), flat("fx", "fy", "fz").alias("f"))
