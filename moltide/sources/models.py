"""Models and predict sets as Parquet tables.

``<folder>/models`` has a row a model, ``<folder>/model_points`` one a training point (permutations
unrolled) with its descriptor and weights. A predict set is the table of
``plans.nbody.decomposed``, partitioned by order, so a sum over some orders reads no others.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moltide.operators import kernel
from moltide.plans.nbody import NBodyModel

_MODELS = "model_md5 string, model_type string, comp_ids array<string>, nbody_order int, cutoff double, z array<int>, sig double, sd double, c double, n_points int"
_POINTS = "model_md5 string, point int, desc array<double>, weights array<double>"


def save_models(spark: SparkSession, models: list[NBodyModel], folder: str) -> None:
    """Writes kernel models (at most kernel.MAX_POINTS points before permutations); models of other kinds raise ValueError."""
    rows, points = [], []
    for m in models:
        if not isinstance(m.model, kernel.Model):
            raise ValueError("only kernel models are kept as tables")
        md5 = kernel.digest(m.model)
        rows.append((md5, "gdml", list(m.labels), m.order, m.cutoff, [int(a) for a in m.model.z], float(m.model.sigma), float(m.model.sd), float(m.model.constant), len(m.model.x)))
        points += [(md5, i, x.tolist(), w.tolist()) for i, (x, w) in enumerate(zip(m.model.x, m.model.weights, strict=True))]
    spark.createDataFrame(rows, _MODELS).write.mode("append").parquet(f"{folder}/models")
    spark.createDataFrame(points, _POINTS).write.mode("append").parquet(f"{folder}/model_points")


def load_models(spark: SparkSession, folder: str, md5s: list[str] | None = None) -> list[NBodyModel]:
    """The models kept in a folder, or those with the given hashes, in the order of their hash; a hash that isn't there, or whose contents differ, raises ValueError."""
    rows, points = spark.read.parquet(f"{folder}/models"), spark.read.parquet(f"{folder}/model_points")
    if md5s is not None:
        rows, points = (x.filter(F.col("model_md5").isin(md5s)) for x in (rows, points))
    kept = {r.model_md5: r for r in rows.dropDuplicates(["model_md5"]).collect()}  # a model is bounded, and so are those that one prediction uses
    if md5s is not None and set(md5s) - kept.keys():
        raise ValueError(f"no such models: {sorted(set(md5s) - kept.keys())}")
    held: dict[str, dict[int, tuple]] = {}
    for p in points.collect():
        held.setdefault(p.model_md5, {})[p.point] = (p.desc, p.weights)
    out = []
    for md5, r in sorted(kept.items()):
        at = held.get(md5, {})
        x, w = (np.array([at[i][k] for i in sorted(at)], float) for k in (0, 1))
        model = kernel.Model(tuple(r.z), r.sig, x, w, r.sd, r.c)
        if len(at) != r.n_points or kernel.digest(model) != md5:
            raise ValueError(f"model {md5} is damaged")
        out.append(NBodyModel(model, tuple(r.comp_ids), r.cutoff))
    return out


def save_predictions(parts: DataFrame, folder: str) -> None:
    """Writes the rows of ``decomposed`` as a predict set."""
    parts.write.mode("append").partitionBy("nbody_order").parquet(folder)


def load_predictions(spark: SparkSession, folder: str, orders: list[int] | None = None) -> DataFrame:
    """The rows of a predict set, of the given orders only (None: all)."""
    rows = spark.read.parquet(folder)
    return rows if orders is None else rows.filter(F.col("nbody_order").isin(orders))
