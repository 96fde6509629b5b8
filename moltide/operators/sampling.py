"""Stratified samples, hold-out splits, quotas and top-n selections; draws are hash ranks, so they repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def strata(rows: DataFrame, keys: list[str], value: str, n: int) -> DataFrame:
    """Adds bin (0 ...) by the Freedman-Diaconis rule for a sample of n rows of each key: width 2 IQR / n^(1/3), at most n / 2 bins.

    Exact quartiles; left-closed equal bins from the least value, the last one open to the right. Null values have no bin.
    """
    # one row a key; the quartiles aggregate per key without a window over its rows
    span = rows.groupBy(*keys).agg(F.percentile(value, F.lit(0.25)).alias("_q1"), F.percentile(value, F.lit(0.75)).alias("_q3"), F.min(value).alias("_min"), F.max(value).alias("_max"))
    width = 2.0 * (F.col("_q3") - F.col("_q1")) / F.pow(F.lit(float(n)), F.lit(1.0 / 3.0))
    bins = F.when(width > 0, F.least(F.ceil((F.col("_max") - F.col("_min")) / width), F.lit(max(n // 2, 1)))).otherwise(F.lit(1))
    span = span.withColumn("n_bins", F.greatest(bins, F.lit(1)).cast("int"))
    out = rows.join(span, keys)
    step = (F.col("_max") - F.col("_min")) / F.col("n_bins")
    at = F.when(step > 0, F.least(F.floor((F.col(value) - F.col("_min")) / step), F.col("n_bins") - 1)).otherwise(F.when(F.col(value).isNotNull(), F.lit(0)))
    return out.withColumn("bin", at.cast("int")).drop("_q1", "_q3", "_min", "_max")


def quotas(counts: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Adds quota to (keys, bin, count): shares of n by largest remainder, never above the count."""
    all_of = Window.partitionBy(*keys)
    share = F.col("count") * F.least(F.lit(n), F.sum("count").over(all_of)) / F.sum("count").over(all_of)
    rows = counts.withColumn("_share", F.round(share, 9)).withColumn("quota", F.floor("_share").cast("bigint"))
    rest = F.least(F.lit(n), F.sum("count").over(all_of)) - F.sum("quota").over(all_of)
    rows = rows.withColumns({"_rest": rest, "_rank": F.row_number().over(Window.partitionBy(*keys).orderBy((F.col("quota") - F.col("_share")).asc(), "bin"))})
    return rows.withColumn("quota", F.least(F.col("quota") + F.when(F.col("_rank") <= F.col("_rest"), 1).otherwise(0), F.col("count"))).drop("_share", "_rest", "_rank")


def hash_rank(keys: list[str], row_id: str) -> Column:
    """Place of a row in its group in the order of md5(row id): a draw without replacement that repeats everywhere."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(F.md5(F.col(row_id).cast("string")), row_id))


def stratified_sample(rows: DataFrame, keys: list[str], value: str, row_id: str, n: int) -> DataFrame:
    binned = strata(rows.filter(F.col(value).isNotNull()), keys, value, n)
    quota = quotas(binned.groupBy(*keys, "bin").count(), keys, n).select(*keys, "bin", "quota")
    ranked = binned.withColumn("_rank", hash_rank([*keys, "bin"], row_id)).filter(F.col("_rank") <= n)
    return ranked.join(quota, [*keys, "bin"]).filter(F.col("_rank") <= F.col("quota")).drop("_rank", "quota", "n_bins")


def uniform(row_id: str) -> Column:
    """A number in 0 ... 1 that belongs to the row: the first 32 bits of md5(row id)."""
    return (F.conv(F.substring(F.md5(F.col(row_id).cast("string")), 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)


def weighted_sample(rows: DataFrame, keys: list[str], weight: str, row_id: str, n: int) -> DataFrame:
    """n rows of each key without replacement, with chances by weight (the n largest u^(1/weight)); weights that aren't positive are never drawn."""
    lot = F.log(uniform(row_id)) / F.col(weight)
    ranked = rows.filter(F.col(weight) > 0).withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(lot.desc(), row_id)))
    return ranked.filter(F.col("_place") <= n).drop("_place")


def split(rows: DataFrame, train: DataFrame, row_id: str) -> DataFrame:
    """The rows that aren't in ``train``."""
    return rows.join(train.select(row_id), row_id, "left_anti")


def cluster_quotas(clusters: DataFrame, n: int) -> DataFrame:
    """Adds quota to (cluster, loss, population): weights loss share x population share.

    floor(weight * n) capped by the population; then, by falling loss, clusters without any get one while the sum is
    under n, and what is still missing goes one each to clusters with room.
    """
    every = Window.partitionBy()  # one row a cluster
    w = (F.col("loss") / F.sum("loss").over(every)) * (F.col("population") / F.sum("population").over(every))
    rows = clusters.withColumn("_w", w).withColumn("_w", F.col("_w") / F.sum("_w").over(every))
    rows = rows.withColumn("quota", F.least(F.floor(F.round(F.col("_w") * n, 9)), F.col("population")))
    missing = F.lit(n) - F.sum("quota").over(every)
    by_loss = Window.partitionBy("_zero").orderBy(F.col("loss").desc(), "cluster")
    rows = rows.withColumns({"_missing": missing, "_zero": F.col("quota") == 0}).withColumn("_place", F.row_number().over(by_loss))
    one = F.when(F.col("_zero") & (F.col("population") > 0) & (F.col("_place") <= F.col("_missing")), 1).otherwise(0)
    rows = rows.withColumn("quota", F.col("quota") + one)
    still = F.lit(n) - F.sum("quota").over(every)
    rows = rows.withColumns({"_missing": still, "_room": F.col("quota") < F.col("population")})
    rows = rows.withColumn("_place", F.row_number().over(Window.partitionBy("_room").orderBy(F.col("loss").desc(), "cluster")))
    return rows.withColumn("quota", F.col("quota") + F.when(F.col("_room") & (F.col("_place") <= F.col("_missing")), 1).otherwise(0)).drop("_w", "_missing", "_zero", "_place", "_room")


def problem_clusters(clusters: DataFrame, least_rows: int) -> DataFrame:
    """Clusters of high loss holding at least ``least_rows`` rows together: the bound falls from mean * (1 + 1/500) in steps of mean / 500."""
    by_loss = Window.orderBy(F.col("loss").desc(), "cluster").rowsBetween(Window.unboundedPreceding, 0)  # one row a cluster
    rows = clusters.withColumn("_held", F.sum("population").over(by_loss)).withColumn("_mean", F.avg("loss").over(Window.partitionBy()))
    enough = F.max(F.when(F.col("_held") >= least_rows, F.col("loss"))).over(Window.partitionBy())
    last = F.min("loss").over(Window.partitionBy())
    rows = rows.withColumn("_c", F.coalesce(enough, last))
    k = F.greatest(F.lit(0), F.ceil(F.round(1 + 500 * (1 - F.col("_c") / F.col("_mean")), 9)))
    rows = rows.withColumn("bound", F.col("_mean") * (1 + (1 - k) / 500))
    return rows.filter(F.col("loss") >= F.col("bound") - 1e-12).drop("_held", "_mean", "_c")


def top_of_clusters(rows: DataFrame, quota: DataFrame, most: int) -> DataFrame:
    """The quota's many rows of highest loss of each cluster; rows: cluster, row_id, loss. No quota is above ``most``, so ranks are cut before the shuffle."""
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy("cluster").orderBy(F.col("loss").desc(), "row_id"))).filter(F.col("place") <= most)
    return ranked.join(quota.select("cluster", "quota"), "cluster").filter(F.col("place") <= F.col("quota")).drop("quota")
