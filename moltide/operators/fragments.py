"""Fragments of records: combinations, and many-body sums over them.

A record's fragments are its entities; a lower-order record belongs to a parent if both
name the same source, the same frame and, as provenance, the same fragments. Those
lookups are equi-joins on that key; combinations are made inside the row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moltide.operators.references import clean_hash


def labelled_combinations(comp_ids: Column, labels: list[str | None], ascending: bool = True) -> Column:
    """Combinations of fragment ids with these labels in their order, as an array of arrays; None stands for any label. No join: a row's own fragments meet.

    Members are distinct. By default only ascending tuples are kept, across labels too (for
    labels (A, B) a pair whose B has the smaller id is dropped); ``ascending=False`` keeps all orders.
    """
    ids = F.transform(comp_ids, lambda c, i: i)
    of = lambda label: ids if label is None else F.filter(ids, lambda i: F.get(comp_ids, i) == label)
    grown = F.transform(of(labels[0]), lambda i: F.array(i))
    for label in labels[1:]:
        more = of(label)
        fits = (lambda c, i: i > F.element_at(c, -1)) if ascending else (lambda c, i: ~F.array_contains(c, i))
        grown = _extended(grown, more, fits)
    return grown


def _extended(grown: Column, more: Column, fits: Callable[[Column, Column], Column]) -> Column:
    return F.flatten(F.transform(grown, lambda c: F.transform(F.filter(more, lambda i: fits(c, i)), lambda i: F.concat(c, F.array(i)))))


def combinations_of(values: Column, order: int) -> Column:
    """All combinations of ``order`` elements of an array, order kept, as an array of arrays; no join."""
    n = F.size(values)
    none = F.array().cast("array<int>")
    rising = lambda start: F.when(start < n, F.sequence(start, n - 1)).otherwise(none)
    grown = F.transform(rising(F.lit(0)), lambda i: F.array(i))
    for _ in range(order - 1):
        grown = F.flatten(F.transform(grown, lambda c: F.transform(rising(F.element_at(c, -1) + 1), lambda i: F.concat(c, F.array(i)))))
    return F.transform(grown, lambda c: F.transform(c, lambda i: F.get(values, i)))


def atoms_of(comb: Column, entity_ids: Column) -> Column:
    """Atom indices of a combination: in the combination's order of fragments, then in atom order."""
    of = lambda e: F.filter(F.transform(entity_ids, lambda x, i: F.when(x == e, i)), lambda i: i.isNotNull())
    return F.flatten(F.transform(comb, of))


def take_atoms(r: Column, at: Column) -> Column:
    """Coordinates (or forces) of the atoms at the given indices."""
    return F.flatten(F.transform(at, lambda i: F.array(F.get(r, i * 3), F.get(r, i * 3 + 1), F.get(r, i * 3 + 2))))


def with_source(records: DataFrame, datasets: DataFrame) -> DataFrame:
    """Adds source (hash of the set a record was cut from), frame and fragments (its ids there); records without provenance drop out."""
    named = datasets.select("dset_id", F.explode("r_prov_ids").alias("_id", "_v")).select("dset_id", F.col("_id").cast("bigint").alias("_id"), clean_hash(F.col("_v")).alias("source")).distinct()
    spec = F.col("r_prov_specs")
    rows = records.filter(F.size(spec) > 2).withColumns({"_id": F.get(spec, F.lit(0)), "frame": F.get(spec, F.lit(1)), "fragments": F.slice(spec, 3, F.size(spec) - 2)})
    return rows.join(named, ["dset_id", "_id"]).drop("_id").filter("source is not null")


def contributions(parents: DataFrame, lower: DataFrame, order: int) -> DataFrame:
    """Lower-order energies and forces found for each parent: struct_id, found (combinations with a record), e_lower (their sum) and f_lower (3 numbers an atom of the parent).

    parents: struct_id, source, frame, fragments, theory, entity_ids; lower: struct_id, source, frame, fragments, theory, e, and f with entity_ids for the
    forces. Of several lower records with one key the smallest struct_id counts. Atoms are aligned by
    fragment: the k-th fragment of a record has entity id k there, and the atoms of an entity lie in one order in both.
    """
    sources = lower.select("source", "theory").distinct()
    asking = parents.join(sources, ["source", "theory"], "left_semi")
    asking = asking.select("struct_id", "source", "theory", "frame", F.col("fragments").alias("_all"), F.col("entity_ids").alias("_ids"), F.explode(combinations_of(F.col("fragments"), order)).alias("fragments"))
    key = ["source", "theory", "frame", "fragments"]
    held = lower.filter("e is not null")
    first = held.groupBy(*key).agg(F.min_by(F.struct("e", "f", F.col("entity_ids").alias("ids")), "struct_id").alias("_l"))
    rows = asking.join(first, key)
    # where each atom of the lower record lies in the parent: fragments by their place in the parent's list, then atoms in order
    comb = F.transform("fragments", lambda x: (F.array_position("_all", x) - 1).cast("int"))
    at, own = atoms_of(comb, F.col("_ids")), atoms_of(F.sequence(F.lit(0), F.lit(order - 1)), F.col("_l.ids"))
    aligned = (F.size(at) == F.size(own)) & (F.size("_l.f") == 3 * F.size(at))
    rows = rows.select("struct_id", F.col("_l.e").alias("e"), F.when(aligned, at).alias("at"), F.when(aligned, take_atoms(F.col("_l.f"), own)).alias("f"), F.size("_ids").alias("n"))
    energies = rows.groupBy("struct_id").agg(F.count(F.lit(1)).alias("found"), F.sum("e").alias("e_lower"), F.max("n").alias("_n"))
    places = rows.filter("at is not null").select("struct_id", "f", F.posexplode("at").alias("k", "atom"))
    forces = places.groupBy("struct_id", "atom").agg(*[F.sum(F.get("f", F.col("k") * 3 + c)).alias(x) for c, x in enumerate("xyz")])
    forces = forces.groupBy("struct_id").agg(F.map_from_entries(F.collect_list(F.struct("atom", F.array(*"xyz")))).alias("_m"))  # one entry an atom of the parent
    none = F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))
    flat = F.flatten(F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.coalesce(F.element_at("_m", i), none)))
    return energies.join(forces, "struct_id", "left").select("struct_id", "found", "e_lower", F.when(F.col("_m").isNotNull(), flat).alias("f_lower"))


def many_body(parents: DataFrame, found: DataFrame, operation: str = "remove") -> DataFrame:
    """Parents' energies (e_new) and, where parents have ``f``, forces (f_new) with the contributions removed or added; parents without any keep theirs."""
    if operation not in ("add", "remove"):
        raise ValueError("operation is 'add' or 'remove'")
    sign = -1.0 if operation == "remove" else 1.0
    rows = parents.join(found, "struct_id", "left")
    rows = rows.withColumns({"found": F.coalesce("found", F.lit(0)), "e_new": F.col("e") + sign * F.coalesce("e_lower", F.lit(0.0))})
    if "f" in parents.columns and "f_lower" in found.columns:
        rows = rows.withColumn("f_new", F.when(F.col("f_lower").isNull(), F.col("f")).otherwise(F.zip_with("f", "f_lower", lambda a, b: a + sign * b)))
    return rows.drop("e_lower", "f_lower")


def totals(decomposed: DataFrame) -> DataFrame:
    """Per structure and order: combinations, those accepted, and the summed energy (rejected ones, null, count as zero)."""
    return decomposed.groupBy("struct_id", "nbody_order").agg(F.count(F.lit(1)).alias("combs"), F.count("e").alias("accepted"), F.sum(F.coalesce("e", F.lit(0.0))).alias("e"))


def alchemical(e: Column, comb: Column, order: Column, scalers: list[tuple[int, int, float]]) -> Column:
    """Energies times the factor of every (entity, order, factor) whose entity is in the combination and whose order matches."""
    for entity, of_order, factor in scalers:
        if not 0.0 <= factor <= 1.0:
            raise ValueError("a factor lies between 0 and 1")
        e = F.when(F.array_contains(comb, F.lit(entity)) & (order == of_order), e * factor).otherwise(e)
    return e
