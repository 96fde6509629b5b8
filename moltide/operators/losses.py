"""Error aggregates over columns of errors; null errors are left out, NaN is not (filter it first)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mae(error: Column) -> Column:
    return F.avg(F.abs(error))


def mse(error: Column) -> Column:
    return F.avg(error * error)


def rmse(error: Column) -> Column:
    return F.sqrt(mse(error))


def sse(error: Column) -> Column:
    return F.sum(error * error)


LOSSES = {"mae": mae, "mse": mse, "rmse": rmse, "sse": sse}


def weighted(e_error: Column, f_error: Column, rho: float, n_atoms: Column) -> Column:
    """rho * MSE of energies + MSE of forces / atoms, from rows that carry both kinds of error."""
    return F.lit(rho) * mse(e_error) + mse(f_error) / F.max(n_atoms)


def by_group(rows: DataFrame, keys: list[str], error: Column) -> DataFrame:
    return rows.groupBy(*keys).agg(*[loss(error).alias(name) for name, loss in LOSSES.items()], F.count(error).alias("n"))


def mean_square(errors: Column) -> Column:
    """Mean square of an array of errors, as a row expression (a record's own loss)."""
    return F.aggregate(errors, F.lit(0.0), lambda s, x: s + x * x) / F.size(errors)
