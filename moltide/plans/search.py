"""Training searches: sigma grids and active learning. The driver holds the bounded training rows and a few numbers a trial; every probe is a Spark job."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moltide.operators import geometry, kernel, losses, sampling
from moltide.sources.tables import materialise


def training_rows(records: DataFrame, chosen: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Arrays of the chosen records (at most kernel.MAX_POINTS): r, f, e and ids."""
    ids = chosen.select("struct_id").limit(kernel.MAX_POINTS + 1)
    rows = records.join(F.broadcast(ids), "struct_id").orderBy("struct_id").select("struct_id", "r", "f", "e").toPandas()
    if len(rows) > kernel.MAX_POINTS:
        raise ValueError(f"more than {kernel.MAX_POINTS} training records")
    pack = lambda c: np.stack([np.asarray(v, float) for v in rows[c]]).reshape(len(rows), -1, 3)
    return pack("r"), pack("f"), rows.e.to_numpy(), rows.struct_id.tolist()


def errors(records: DataFrame, model: kernel.Model) -> DataFrame:
    """struct_id, e_error, loss: a record's own mean square force error."""
    told = kernel.predict(records, model, "struct_id", "e", "f")
    return told.select("struct_id", (F.col("e_pred") - F.col("e")).alias("e_error"), losses.mean_square(F.zip_with("f_pred", "f", lambda a, b: a - b)).alias("loss"))


def sigma_grid(records: DataFrame, chosen: DataFrame, z: tuple[int, ...], sigmas: list[float], ridge: float, perms: np.ndarray | None = None) -> tuple[kernel.Model, DataFrame]:
    """The best model by force RMSE on the records that aren't chosen, and the trials (sigma, loss, e_rmse) until the loss rose."""
    spark = records.sparkSession
    r, f, e, _ = training_rows(records, chosen)
    valid = sampling.split(records, chosen, "struct_id")
    seen = []

    def trial(sigma: float) -> tuple[kernel.Model, float]:
        model = kernel.train(spark, r, f, e, z, sigma, ridge, perms)
        row = errors(valid, model).agg(F.sqrt(F.avg("loss")).alias("f"), losses.rmse(F.col("e_error")).alias("e")).first()
        loss = float("inf") if row.f is None else row.f
        seen.append((sigma, loss, row.e))
        return model, loss

    best, _ = kernel.grid_search(sigmas, trial)
    return best, spark.createDataFrame(seen, "sigma double, loss double, e_rmse double")


def active_learning(records: DataFrame, start: DataFrame, z: tuple[int, ...], sigma: float, ridge: float, add: int, until: int, perms: np.ndarray | None = None) -> tuple[kernel.Model, DataFrame]:
    """Train, find the records of highest loss among groups of like energy, add them, until ``until`` rows; the model and its rounds."""
    spark = records.sparkSession
    chosen, log = start.select("struct_id"), []
    while True:
        r, f, e, ids = training_rows(records, chosen)
        model = kernel.train(spark, r, f, e, z, sigma, ridge, perms)
        rest = sampling.split(records, chosen, "struct_id")
        rows = errors(rest, model).join(rest.select("struct_id", "e"), "struct_id")
        row = rows.agg(F.sqrt(F.avg("loss")).alias("f"), F.max("loss").alias("worst")).first()
        log.append((len(log), len(ids), row.f, row.worst))
        if row.f is None or len(ids) + add > min(until, kernel.MAX_POINTS):
            return model, spark.createDataFrame(log, "round int, n_train int, f_rmse double, worst double")
        binned = sampling.strata(rows.withColumn("k", F.lit(0)), ["k"], "e", 20).withColumn("cluster", F.col("bin")).withColumnRenamed("struct_id", "row_id")
        clusters = binned.groupBy("cluster").agg(F.avg("loss").alias("loss"), F.count(F.lit(1)).alias("population"))  # at most 10 bins
        new = sampling.top_of_clusters(binned.select("cluster", "row_id", "loss"), sampling.cluster_quotas(clusters, add), add)
        more = [x.row_id for x in new.select("row_id").collect()]  # ``add`` ids
        chosen = spark.createDataFrame([(int(i),) for i in (*ids, *more)], "struct_id bigint")


def error_mining(told: DataFrame, n_clusters: int, least_rows: int, n_select: int) -> tuple[DataFrame, DataFrame]:
    """Where a model fails: records grouped by k-means on their pair distances, the groups of high loss, and the records to add from them.

    told: struct_id, loss, r of one kind of record (equal numbers of atoms). Gives (cluster, loss, population, bound, quota) of the
    problem clusters, and (cluster, row_id, loss, place) of the ``n_select`` records of highest loss shared out over them.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = materialise(told.select("struct_id", "loss", array_to_vector(geometry.pair_distances(F.col("r"))).alias("v")), "errors")
    if rows.limit(n_clusters + 1).count() > n_clusters:
        rows = KMeans(k=n_clusters, seed=1, featuresCol="v", predictionCol="cluster", maxIter=10).fit(rows).transform(rows)
    else:
        rows = rows.withColumn("cluster", F.lit(0))
    rows = materialise(rows.select("cluster", F.col("struct_id").alias("row_id"), "loss"), "clustered")
    clusters = rows.groupBy("cluster").agg(F.avg("loss").alias("loss"), F.count(F.lit(1)).alias("population"))  # n_clusters rows
    problems = sampling.problem_clusters(clusters, least_rows)
    quota = materialise(sampling.cluster_quotas(problems.select("cluster", "loss", "population"), n_select), "quotas")
    return problems.join(quota.select("cluster", "quota"), "cluster"), sampling.top_of_clusters(rows, quota, n_select)
