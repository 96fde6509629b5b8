"""References to records that do not exist, are deleted, or arrive later.

Parent and child keys are put in one long table (parent table, key, is_parent, ...)
and grouped by parent table and key: a group without a parent flag is an orphan
key, one whose parent was loaded or deleted at an odd time, or is smaller than the
places that its children name, is a suspect. Only the children of orphan and
suspect keys are looked at one by one. The grouping combines map-side, so a key
that a third of all rows point to costs no more than any other. Records refer to
(data set, number of the source), which the data sets' ``r_prov_ids`` list.

Null, blank and 'n/a' references are none; an unknown creation time makes no reference late, but a
missing one stays missing. Hashes are compared trimmed, in lower
case and without a leading 'md5:'. Owners delivered twice, and references repeated
inside one owner, give one row. A parent delivered twice counts from its first
load. Empty tables give no rows on their side: with no parents every reference is
missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ("ref_table", "ref_field", "owner_id", "ref_value", "ref_state", "ref_month")


def trimmed(x: Column) -> Column:
    """Without blanks, tabs and line ends around it (``trim`` takes blanks only)."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def clean_hash(x: Column) -> Column:
    """Trimmed, lower case, no leading 'md5:'; null if that leaves no reference."""
    h = trimmed(F.regexp_replace(F.lower(trimmed(x)), "^md5:", ""))
    return F.when(~h.isin("", "n/a"), h)


def _children(owner: DataFrame, table: str, field: str, parent: str, owner_id: str, values: Column) -> DataFrame:
    rows = owner.select(F.col(owner_id).cast("bigint").alias("owner_id"), "created_at", F.explode(values).alias("_v"))
    return rows.select(F.lit(table).alias("ref_table"), F.lit(field).alias("ref_field"), F.lit(parent).alias("parent_table"), "owner_id", clean_hash(F.col("_v")).alias("key"), "created_at").filter("key is not null")


def _parents(target: DataFrame, parent: str, key: str) -> DataFrame:
    return target.select(F.lit(parent).alias("parent_table"), clean_hash(F.col(key)).alias("key"), "loaded_at", "deleted_at").filter("key is not null")


#: What a child may say about its target, and what a parent says about itself: numbers that have to lie in 0 ... size - 1.
_PLACES, _SIZES = ("frame_low", "frame_high", "entity_low", "entity_high"), ("n_structs", "n_entities")


def orphan_references(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Rows of ``children`` whose parent is missing, late, deleted or too small, with ``ref_state``.

    children: parent_table, key, owner_id, created_at and any more; frame_low to entity_high if they name places inside
    the parent. parents: parent_table, key, loaded_at, deleted_at; n_structs and n_entities where places are checked (null: any place).
    """
    filled = lambda df, names, kind: df.select("*", *[F.lit(None).cast(kind).alias(n) for n in names if n not in df.columns])
    children, parents = filled(children, _PLACES, "bigint"), filled(parents, _SIZES, "bigint")
    kids = filled(children.select("parent_table", "key", F.lit(0).alias("is_parent"), F.col("created_at").cast("timestamp_ntz").alias("created_at"), *_PLACES), _SIZES, "bigint")
    kids = filled(kids, ("loaded_at", "deleted_at"), "timestamp_ntz")
    tops = filled(parents.select("parent_table", "key", F.lit(1).alias("is_parent"), *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("loaded_at", "deleted_at")], *_SIZES), _PLACES, "bigint")
    keys = kids.unionByName(filled(tops, ("created_at",), "timestamp_ntz")).groupBy("parent_table", "key").agg(
        F.max("is_parent").alias("has_parent"), F.max(F.when(F.col("is_parent") == 0, 1)).alias("has_child"), F.min("loaded_at").alias("first_loaded"), F.min("deleted_at").alias("deleted"),
        F.min("created_at").alias("first_use"), F.max("created_at").alias("last_use"), *[F.max(c).alias(c) for c in _SIZES],
        F.min("frame_low").alias("_f0"), F.max("frame_high").alias("_f1"), F.min("entity_low").alias("_e0"), F.max("entity_high").alias("_e1"),
    )
    beyond = lambda low, high, size: F.coalesce(F.col(size).isNotNull() & ((F.col(low) < 0) | (F.col(high) >= F.col(size))), F.lit(False))
    odd = keys.filter((F.col("has_child") == 1) & ((F.col("has_parent") == 0) | F.expr("coalesce(first_use < first_loaded or last_use >= deleted, false)") | beyond("_f0", "_f1", "n_structs") | beyond("_e0", "_e1", "n_entities")))
    lost = (F.col("has_parent") == 0) | beyond("frame_low", "frame_high", "n_structs") | beyond("entity_low", "entity_high", "n_entities")
    state = F.when(lost, "missing").when(F.col("first_loaded") > F.col("created_at"), "late").when(F.col("deleted") <= F.col("created_at"), "deleted")
    rows = children.join(odd.select("parent_table", "key", "has_parent", "first_loaded", "deleted", *_SIZES), ["parent_table", "key"])
    return rows.withColumn("ref_state", state).filter("ref_state is not null").drop("has_parent", "first_loaded", "deleted", *_SIZES, *_PLACES)


def _sources(datasets: DataFrame, rsets: DataFrame) -> DataFrame:
    """Parents of the records' provenance: a key a data set and source number, with the sizes of the set named there, if it is known."""
    sizes = rsets.select(clean_hash(F.col("rset_md5")).alias("hash"), "n_structs", "n_entities").filter("hash is not null")
    sizes = sizes.groupBy("hash").agg(F.max("n_structs").alias("n_structs"), F.max("n_entities").cast("bigint").alias("n_entities"))
    named = datasets.select("dset_id", F.explode("r_prov_ids").alias("source", "_v")).select(_source_key(F.col("source")), clean_hash(F.col("_v")).alias("hash")).distinct()
    none = F.lit(None).cast("timestamp_ntz")
    return named.join(sizes, "hash", "left").select(F.lit("sources").alias("parent_table"), "key", none.alias("loaded_at"), none.alias("deleted_at"), "n_structs", "n_entities")


def _source_key(number: Column) -> Column:
    return F.concat_ws(":", "dset_id", number.cast("bigint")).alias("key")


def _provenance(structures: DataFrame) -> DataFrame:
    """Children: one row a record with a provenance, its key and the places that it names in the source."""
    spec = F.col("r_prov_specs")
    entities = F.slice(spec, 3, F.greatest(F.size(spec) - 2, F.lit(0)))
    rows = structures.filter(F.size(spec) > 0)
    return rows.select(
        F.lit("structures").alias("ref_table"), F.lit("r_prov_specs").alias("ref_field"), F.lit("sources").alias("parent_table"), F.col("struct_id").cast("bigint").alias("owner_id"),
        F.coalesce(_source_key(F.get(spec, F.lit(0))), F.lit("")).alias("key"), "created_at", F.array_join(F.transform(spec, lambda x: x.cast("string")), ",").alias("ref_value"),
        F.get(spec, F.lit(1)).alias("frame_low"), F.get(spec, F.lit(1)).alias("frame_high"), F.array_min(entities).alias("entity_low"), F.array_max(entities).alias("entity_high"),
    )


def unresolved(datasets: DataFrame, structures: DataFrame, predictsets: DataFrame, rsets: DataFrame, models: DataFrame) -> DataFrame:
    """All references of the domain's tables that do not resolve: the columns of ``COLUMNS``, each row once."""
    children = _children(datasets, "datasets", "r_prov_ids", "rsets", "dset_id", F.map_values("r_prov_ids"))
    children = children.unionByName(_children(datasets, "datasets", "mb_dsets_md5", "datasets", "dset_id", F.col("mb_dsets_md5")))
    children = children.unionByName(_children(predictsets, "predictsets", "models_md5", "models", "pset_id", F.col("models_md5")))
    children = children.distinct().withColumn("ref_value", F.col("key"))
    children = children.unionByName(_provenance(structures), allowMissingColumns=True)
    parents = _parents(rsets, "rsets", "rset_md5").unionByName(_parents(datasets, "datasets", "dset_md5")).unionByName(_parents(models, "models", "model_md5"))
    rows = orphan_references(children, parents.unionByName(_sources(datasets, rsets), allowMissingColumns=True))
    return rows.withColumn("ref_month", F.date_format("created_at", "yyyy-MM")).select(*COLUMNS).distinct()


def by_period(references: DataFrame) -> DataFrame:
    """Counts of unresolved references per table, field, state and month."""
    return references.groupBy("ref_table", "ref_field", "ref_state", "ref_month").agg(F.count(F.lit(1)).alias("n_refs"), F.countDistinct("owner_id").alias("n_owners"))
