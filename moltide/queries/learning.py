"""Queries on kernels and models: covariance rows, synthetic weights, training, n-body predictions, clustering."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moltide.functions.symmetry import group, swaps_of_equal_atoms
from moltide.operators import kernel, losses, sampling
from moltide.operators import geometry as g
from moltide.operators.records import is_complete, once, sets
from moltide.operators.units import dataset_units, to_common_units
from moltide.plans import nbody, search
from moltide.queries.common import ATOMS, records
from moltide.sources import models as kept
from moltide.sources.tables import first_delivery, join_dimension, materialise, shared_folder, table

SIGMA, POINTS = 10.0, 5
TRAIN = 30
#: Cutoffs on the spread by order, near the middle of these records' spreads.
CUTOFFS = {2: 8.0, 3: 14.0, 4: 20.0}
#: Permutations of equal hydrogens that a model may have (three ammonias have 216); with more, training is refused.
MOST_PERMUTATIONS = 256


def _anchors(spark: SparkSession, d: str) -> DataFrame:
    """The POINTS records of smallest struct_id of each number of atoms."""
    rows = records(spark, d).withColumn("n_atoms", F.size("z"))
    first = Window.partitionBy("n_atoms").orderBy("struct_id")
    return rows.withColumn("p", F.row_number().over(first) - 1).filter(F.col("p") < POINTS).select("n_atoms", "p", "r")


def matern_rows(spark: SparkSession, d: str) -> DataFrame:
    """Matern-5/2 covariance of every record with POINTS records of its size, in inverse distances: a bounded side, joined on the size."""
    points = materialise(_anchors(spark, d).select("n_atoms", "p", g.inverse_distances(F.col("r")).alias("x0")), "points")
    rows = records(spark, d).select("struct_id", F.size("z").alias("n_atoms"), g.inverse_distances(F.col("r")).alias("x"))
    rows = rows.join(F.broadcast(points), "n_atoms")  # POINTS rows a size
    d2 = F.aggregate(F.zip_with("x", "x0", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    q = F.sqrt(F.lit(5.0) * d2) / SIGMA
    return rows.select("struct_id", "p", F.round((1.0 + q + q * q / 3.0) * F.exp(-q), 6).alias("k"))


def kernel_energies(spark: SparkSession, d: str) -> DataFrame:
    """Energies by a model of POINTS points with weights sin(p + pair), for every record of nine atoms: the contraction in Arrow batches."""
    points = _anchors(spark, d).filter("n_atoms = 9").orderBy("p").select("r").toPandas()  # POINTS rows
    rows = records(spark, d).filter("size(z) = 9").select("struct_id", "r")
    if not len(points):
        return rows.select("struct_id", F.lit(0.0).alias("e"))
    x, _ = kernel.describe(np.stack([np.asarray(v, float) for v in points.r]).reshape(len(points), -1, 3))
    weights = np.sin(np.arange(len(points))[:, None] + np.arange(x.shape[1])[None])
    model = kernel.Model((0,) * 9, SIGMA, x, weights)
    return kernel.predict(rows, model, "struct_id").select("struct_id", F.round("e_pred", 6).alias("e"))


def _common(spark: SparkSession, d: str) -> DataFrame:
    """Complete records in common units, each once, with forces and energy."""
    structures, datasets = table(spark, d, "structures"), table(spark, d, "datasets")
    rows = to_common_units(once(structures), dataset_units(structures, datasets))
    rows = rows.filter(is_complete(F.col("r"), F.col("z")) & (F.size("f") == 3 * F.size("z")) & F.col("e").isNotNull() & ~F.isnan("e"))
    return join_dimension(rows, sets(datasets).select("dset_id", "entity_ids"), "dset_id")


def _start(rows: DataFrame, n: int) -> DataFrame:
    return sampling.stratified_sample(rows.select("struct_id", F.lit(0).alias("k"), "e"), ["k"], "e", "struct_id", n)


def _water_triples(rows: DataFrame) -> DataFrame:
    return rows.filter("mb = 3 and array_join(comp_ids, ',') = 'wat,wat,wat'")


def _kind(rows: DataFrame) -> tuple[tuple[int, ...], np.ndarray] | None:
    """Atoms of the records and the permutations of their equal hydrogens."""
    row = rows.select("z", "entity_ids").first()
    return None if row is None else (tuple(row.z), group(swaps_of_equal_atoms(row.z, row.entity_ids), MOST_PERMUTATIONS))


def _models(spark: SparkSession, d: str) -> tuple[DataFrame, list[nbody.NBodyModel]]:
    """All records in common units, and a model for every composition with n-body energies of its own order (a few), trained on a stratified sample of TRAIN records each."""
    rows = materialise(_common(spark, d), "common")
    found = []
    kinds = rows.filter("mb = size(comp_ids)").groupBy("comp_ids").agg(F.count(F.lit(1)).alias("n")).filter(f"n >= {TRAIN}").orderBy("comp_ids").collect()
    for labels, _ in kinds:
        mine = rows.filter(F.col("mb").isNotNull() & (F.array_join("comp_ids", ",") == ",".join(labels)))
        z, perms = _kind(mine)
        r, f, e, _ = search.training_rows(mine, _start(mine, TRAIN))
        found.append(nbody.NBodyModel(kernel.train(spark, r, f, e, z, 1.0, 1e-6, perms), tuple(labels), CUTOFFS[min(len(labels), max(CUTOFFS))]))
    return rows, found


def model_errors(spark: SparkSession, d: str) -> DataFrame:
    """Energy and force errors of every model on all n-body records of its composition, by data set: one prediction job for all models."""
    rows, models = _models(spark, d)
    rows = rows.filter("mb = size(comp_ids)")
    if not models:
        return rows.select("dset_id", *[F.lit(0.0).alias(c) for c in ("e_mae", "e_rmse", "f_rmse")], F.lit(0).alias("n")).filter("false")
    own = [nbody.NBodyModel(m.model, m.labels) for m in models]
    told = nbody.total(rows.withColumnsRenamed({"e": "e_true", "f": "f_true"}), own, None, None, "dset_id", "e_true", "f_true", "mb").filter("combs = 1 and accepted = 1")
    e = F.col("e") - F.col("e_true")
    f = losses.mean_square(F.zip_with("f", "f_true", lambda a, b: a - b))
    return told.groupBy("dset_id").agg(losses.mae(e).alias("e_mae"), losses.rmse(e).alias("e_rmse"), F.sqrt(F.avg(f)).alias("f_rmse"), F.count(F.lit(1)).alias("n"))


def error_mining(spark: SparkSession, d: str) -> DataFrame:
    """End to end for the triples of water: errors of their model, clusters by structure, problem clusters, and the records of highest loss chosen from them."""
    rows, models = _models(spark, d)
    model = next((m.model for m in models if m.labels == ("wat",) * 3), None)
    water = _water_triples(rows)
    if model is None:
        return water.select(F.lit(0).alias("cluster"), F.col("struct_id").alias("row_id"), F.lit(0.0).alias("loss"), F.lit(0).alias("place")).filter("false")
    told = search.errors(water, model).join(water.select("struct_id", "r"), "struct_id")
    return search.error_mining(told, 10, 100, 50)[1]


def nbody_decomposed(spark: SparkSession, d: str) -> DataFrame:
    """Energies by every model of all combinations in every record, null where the cutoff rejects."""
    rows, models = _models(spark, d)
    models = models or [nbody.NBodyModel(None, ("none",))]
    return nbody.decomposed(rows, models).select("struct_id", "nbody_order", "comb", F.round("spread", 6).alias("spread"), "e")


def nbody_totals(spark: SparkSession, d: str) -> DataFrame:
    """Energies, forces and virials summed over all models, orders and combinations of every record, and the energies once more with the first fragment's triples halved."""
    rows, models = _models(spark, d)
    models = models or [nbody.NBodyModel(None, ("none",))]
    rows = rows.select("struct_id", "r", "z", "entity_ids", "comp_ids")
    told = nbody.total(rows, models)
    scaled = nbody.total(rows, models, None, [(0, 3, 0.5)]).select("struct_id", F.col("e").alias("e_scaled"))
    trace = (F.get("virial", F.lit(0)) + F.get("virial", F.lit(4)) + F.get("virial", F.lit(8))) / 3
    return told.join(scaled, "struct_id").select("struct_id", "e", "e_scaled", F.sqrt(losses.mean_square(F.col("f"))).alias("f_rms"), trace.alias("pressure"), "combs", "accepted")


def model_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Every model trained, kept as tables, loaded again by its hash and used: its points, and the records whose predictions came out otherwise."""
    rows, models = _models(spark, d)
    if not models:
        return rows.select(F.lit("").alias("labels"), F.lit(0).alias("n_points"), F.lit(0).alias("records"), F.lit(0).alias("changed")).filter("false")
    folder = f"{shared_folder(spark)}/kept-{uuid.uuid4().hex}"
    kept.save_models(spark, models, folder)
    again = kept.load_models(spark, folder, [kernel.digest(m.model) for m in models])
    out = None
    for m in models:
        back = next(x for x in again if x.labels == m.labels)
        both = nbody.total(rows, [m], None, None).select("struct_id", "e", "combs").join(nbody.total(rows, [back]).select("struct_id", F.col("e").alias("e2")), "struct_id").filter("combs > 0")
        one = both.agg(F.count(F.lit(1)).alias("records"), F.sum(F.when(F.abs(F.col("e") - F.col("e2")) > 1e-6 * F.greatest(F.lit(1.0), F.abs("e")), 1).otherwise(0)).alias("changed"))
        one = one.select(F.lit(",".join(m.labels)).alias("labels"), F.lit(len(back.model.x)).alias("n_points"), "records", "changed")
        out = one if out is None else out.unionByName(one)
    return out


def _plain_models(spark: SparkSession, d: str) -> tuple[DataFrame, list[nbody.NBodyModel]]:
    """Records as stored, and models of two and three waters with weights sin(point + pair): nothing is trained, so SQL can tell the same."""
    rows = records(spark, d)
    points = _anchors(spark, d).filter("n_atoms = 9").orderBy("p").select("r").toPandas()  # POINTS rows
    models = []
    for order in (2, 3) if len(points) else ():
        x, _ = kernel.describe(np.stack([np.asarray(v, float) for v in points.r]).reshape(len(points), 9, 3)[:, : 3 * order])
        weights = np.sin(np.arange(len(points))[:, None] + np.arange(x.shape[1])[None])
        models.append(nbody.NBodyModel(kernel.Model((8, 1, 1) * order, SIGMA, x, weights), ("wat",) * order, CUTOFFS[order]))
    return rows, models or [nbody.NBodyModel(None, ("none",))]


def nbody_parts(spark: SparkSession, d: str) -> DataFrame:
    """Energies of all pairs and triples of water in every record by the plain models, null where the cutoff rejects."""
    rows, models = _plain_models(spark, d)
    parts = nbody.decomposed(rows, models)
    return parts.select("struct_id", "nbody_order", F.array_join("comb", ",").alias("comb"), F.round("spread", 5).alias("spread"), F.round("e", 6).alias("e"))


def nbody_sums(spark: SparkSession, d: str) -> DataFrame:
    """The same summed up by record, with the trace of the virial as a check on all forces."""
    rows, models = _plain_models(spark, d)
    trace = F.get("virial", F.lit(0)) + F.get("virial", F.lit(4)) + F.get("virial", F.lit(8))
    return nbody.total(rows, models).select("struct_id", F.round("e", 5).alias("e"), F.round(trace, 5).alias("trace"), "combs", "accepted")


def predictset_totals(spark: SparkSession, d: str) -> DataFrame:
    """Every predict set's energies from a stored one: the sum over its data set's records and those of its orders that have a model."""
    rows, models = _plain_models(spark, d)
    folder = f"{shared_folder(spark)}/predictions-{uuid.uuid4().hex}"
    kept.save_predictions(nbody.decomposed(rows, models, None, "dset_id"), folder)
    parts = kept.load_predictions(spark, folder)
    per_set = parts.groupBy("dset_id", "nbody_order").agg(F.count(F.lit(1)).alias("combs"), F.count("e").alias("accepted"), F.sum(F.coalesce("e", F.lit(0.0))).alias("e"))
    asked = first_delivery(table(spark, d, "predictsets").select("pset_id", "dset_id", "nbody_orders", "loaded_at"), "pset_id").select("pset_id", "dset_id", F.explode(F.array_distinct("nbody_orders")).alias("nbody_order"))
    return asked.join(per_set, ["dset_id", "nbody_order"]).groupBy("pset_id").agg(F.sum("combs").alias("combs"), F.sum("accepted").alias("accepted"), F.round(F.sum("e"), 3).alias("e"))


def strained_virial(spark: SparkSession, d: str) -> DataFrame:
    """Virial of every triple of water from the model's forces and from strained copies, and how far they are apart."""
    rows, models = _models(spark, d)
    water, model = _water_triples(rows), next((m.model for m in models if m.labels == ("wat",) * 3), None)
    if model is None:
        return water.select("struct_id", F.lit(0.0).alias("pressure"), F.lit(0.0).alias("apart"))
    told = kernel.predict(water, model, "struct_id", "r").select("struct_id", g.virial(F.col("r"), F.col("f_pred")).alias("w"))
    both = told.join(nbody.strained_virial(water.select("struct_id", "r"), model).withColumnRenamed("w", "w2"), "struct_id")
    apart = F.array_max(F.zip_with("w", "w2", lambda a, b: F.abs(a - b)))
    # a strain's (a, b) entry is the sum of f_a r_b: the transpose of r_a f_b, equal where no torque acts
    return both.select("struct_id", ((F.get("w", F.lit(0)) + F.get("w", F.lit(4)) + F.get("w", F.lit(8))) / 3).alias("pressure"), apart.alias("apart"))


def sigma_trials(spark: SparkSession, d: str) -> DataFrame:
    """Trials of a sigma grid for the three-body model, validated on all other triples."""
    water = materialise(_water_triples(_common(spark, d)), "water")
    kind = _kind(water)
    if kind is None:
        return water.select(F.lit(0.0).alias("sigma"), F.lit(0.0).alias("loss"), F.lit(0.0).alias("e_rmse"))
    return search.sigma_grid(water, materialise(_start(water, TRAIN), "start"), kind[0], [0.3, 1.0, 3.0, 10.0], 1e-6, kind[1])[1]


def active_rounds(spark: SparkSession, d: str) -> DataFrame:
    """Rounds of active learning: the records of highest loss join the training set."""
    water = materialise(_water_triples(_common(spark, d)), "water")
    kind = _kind(water)
    if kind is None:
        return water.select(F.lit(0).alias("round"), F.lit(0).alias("n_train"), F.lit(0.0).alias("f_rmse"), F.lit(0.0).alias("worst"))
    return search.active_learning(water, materialise(_start(water, TRAIN), "start"), kind[0], 1.0, 1e-6, 10, TRAIN + 20, kind[1])[1]


def nested_clusters(spark: SparkSession, d: str) -> DataFrame:
    """k-means on the pair distances of nine-atom records, then on the energies inside each cluster: ids and sizes."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = records(spark, d).filter("size(z) = 9 and e is not null").select("struct_id", "e", array_to_vector(g.pair_distances(F.col("r"))).alias("v"))
    rows = materialise(rows, "clusterable")
    if rows.limit(5).count() < 5:
        return rows.groupBy(F.lit(0).alias("outer"), F.lit(0).alias("inner")).agg(F.count(F.lit(1)).alias("n"), F.avg("e").alias("e_mean"))
    outer = KMeans(k=4, seed=1, featuresCol="v", predictionCol="outer", maxIter=10).fit(rows).transform(rows).select("struct_id", "e", "outer")
    outer = materialise(outer.withColumn("w", array_to_vector(F.array("e"))), "outer")
    out = None
    for c in range(4):  # a stage inside each of the few clusters of the stage before
        part = outer.filter(F.col("outer") == c)
        if part.limit(2).count() < 2:
            part = part.withColumn("inner", F.lit(0))
        else:
            part = KMeans(k=2, seed=1, featuresCol="w", predictionCol="inner", maxIter=10).fit(part).transform(part)
        out = part if out is None else out.unionByName(part)
    return out.groupBy("outer", "inner").agg(F.count(F.lit(1)).alias("n"), F.avg("e").alias("e_mean"))


QUERIES = {q.__name__: q for q in (matern_rows, kernel_energies, model_errors, error_mining, model_round_trip, nbody_decomposed, nbody_totals, nbody_parts, nbody_sums, predictset_totals, strained_virial, sigma_trials, active_rounds, nested_clusters)}

_POINTS = ATOMS + f""", sized as (select struct_id, len(z) as n_atoms from recs), pt as (select struct_id as sid, n_atoms, row_number() over (partition by n_atoms order by struct_id) - 1 as p from sized qualify p < {POINTS}),
x0 as (select n_atoms, p, i, j, 1 / dist as v from pairs join pt on struct_id = sid), x as (select struct_id, n_atoms, i, j, 1 / dist as v from pairs join sized using (struct_id))"""
_NBODY = ATOMS + f""", en as (select struct_id, dset_id, comp_ids, unnest(range(len(comp_ids)))::int as e from recs), wt as (select struct_id, dset_id, e from en where comp_ids[e + 1] = 'wat'),
cb as (select a.struct_id, 2 as o, [a.e, b.e] as c from wt a join wt b on a.struct_id = b.struct_id and a.e < b.e
  union all select a.struct_id, 3, [a.e, b.e, k.e] from wt a join wt b on a.struct_id = b.struct_id and a.e < b.e join wt k on a.struct_id = k.struct_id and b.e < k.e),
ca as (select cb.*, entity_id, mass, x, y, w, row_number() over (partition by cb.struct_id, c order by list_position(c, entity_id), a) - 1 as k from cb join atoms on cb.struct_id = atoms.struct_id and list_contains(c, entity_id)),
cw as (select struct_id, c, sum(mass * x) / sum(mass) as x, sum(mass * y) / sum(mass) as y, sum(mass * w) / sum(mass) as w from ca group by 1, 2),
ce as (select struct_id, o, c, entity_id, sum(mass * x) / sum(mass) as x, sum(mass * y) / sum(mass) as y, sum(mass * w) / sum(mass) as w from ca group by 1, 2, 3, 4),
sp as (select ce.struct_id, o, ce.c, sum(sqrt((ce.x - cw.x) ** 2 + (ce.y - cw.y) ** 2 + (ce.w - cw.w) ** 2)) as spread from ce join cw on ce.struct_id = cw.struct_id and ce.c = cw.c group by 1, 2, 3),
ok as (select *, spread < case o when 2 then {CUTOFFS[2]} else {CUTOFFS[3]} end as good from sp),
pr as (select p.struct_id, p.o, p.c, p.k * (p.k - 1) // 2 + q.k as d, 1 / sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.w - q.w) ** 2) as v from ca p join ca q on p.struct_id = q.struct_id and p.c = q.c and p.k > q.k),
pt as (select struct_id as sid, row_number() over (order by struct_id) - 1 as p from recs where len(z) = 9 qualify p < {POINTS}),
x0 as (select o, p, d, v from pr join pt on struct_id = sid where c = range(o)),
dd as (select pr.struct_id, pr.o, pr.c, p, sqrt(5 * sum((pr.v - x0.v) ** 2)) as n, sum((pr.v - x0.v) * sin(p + pr.d)) as a, sum(sin(p + pr.d) * pr.v) as wx, sum((pr.v - x0.v) * pr.v) as dx
  from pr join x0 on pr.o = x0.o and pr.d = x0.d group by 1, 2, 3, 4),
es as (select struct_id, c, -sum(5 / (3 * {SIGMA * SIGMA}) * exp(-n / {SIGMA}) * (1 + n / {SIGMA}) * a) as e,
  sum(5 / (3 * {SIGMA * SIGMA}) * exp(-n / {SIGMA}) * (5 / {SIGMA * SIGMA} * a * dx - (1 + n / {SIGMA}) * wx)) as trace from dd group by 1, 2),
told as (select ok.struct_id, o, ok.c, spread, good, case when good then e end as e, case when good then trace end as trace from ok join es on ok.struct_id = es.struct_id and ok.c = es.c)"""
ORACLE = {
    "nbody_parts": _NBODY + " select struct_id, o as nbody_order, array_to_string(c, ',') as comb, round(spread, 5) as spread, round(e, 6) as e from told",
    "nbody_sums": _NBODY + """ select recs.struct_id, round(coalesce(sum(told.e), 0), 5) as e, round(coalesce(sum(trace), 0), 5) as trace, count(o) as combs, coalesce(sum(good::int), 0)::bigint as accepted
        from recs left join told using (struct_id) group by 1""",
    "predictset_totals": _NBODY + """, ps as (select pset_id, dset_id, unnest(list_distinct(nbody_orders)) as o from (select * from predictsets qualify row_number() over (partition by pset_id order by loaded_at) = 1)),
        st as (select dset_id, o, count(*) as combs, sum(good::int) as accepted, sum(coalesce(told.e, 0)) as e from told join recs using (struct_id) group by 1, 2)
        select pset_id, sum(combs)::bigint as combs, sum(accepted)::bigint as accepted, round(sum(e), 3) as e from ps join st using (dset_id, o) group by 1""",
    "matern_rows": _POINTS + f""", dd as (select struct_id, p, sqrt(5 * sum((x.v - x0.v) ** 2)) / {SIGMA} as q from x join x0 using (n_atoms, i, j) group by 1, 2)
        select struct_id, p, round((1 + q + q * q / 3) * exp(-q), 6) as k from dd""",
    "kernel_energies": _POINTS + f""", dd as (select struct_id, p, sqrt(5 * sum((x.v - x0.v) ** 2)) as n, sum((x.v - x0.v) * sin(p + i * (i - 1) // 2 + j)) as a from x join x0 using (n_atoms, i, j) where n_atoms = 9 group by 1, 2)
        select struct_id, round(-sum(5 / (3 * {SIGMA} * {SIGMA}) * exp(-n / {SIGMA}) * (1 + n / {SIGMA}) * a), 6) as e from dd group by 1""",
}
