"""Radial distribution functions: pair distances of two elements, binned, against an ideal gas.

Pairs are made inside each record (no join, no shuffle), and counts combine map-side,
so the shuffle carries one row a bin and task.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moltide.operators import geometry as g


def bin_of(x: Column, low: float, high: float, n_bins: int) -> Column:
    """Number of the bin, 0 ... n_bins - 1; the last bin holds its right edge, outside is null."""
    width = (high - low) / n_bins
    return F.when((x >= low) & (x < high), F.least(F.floor((x - low) / width).cast("int"), F.lit(n_bins - 1))).when(x == high, F.lit(n_bins - 1))


def distances_between(r: Column, z: Column, entity_ids: Column, first: int, second: int, inter_only: bool = True, cell: tuple[float, float, float] | None = None) -> Column:
    """Distances of all pairs of one atom of element ``first`` and one of ``second``; with ``inter_only`` not inside one fragment."""
    def wanted(i: Column, j: Column) -> Column:
        a, b = F.get(z, i), F.get(z, j)
        ok = ((a == first) & (b == second)) | ((a == second) & (b == first))
        return ok & (F.get(entity_ids, i) != F.get(entity_ids, j)) if inter_only else ok

    return F.filter(g.over_pairs(r, lambda i, j, d: F.when(wanted(i, j), g.norm(d)), cell), lambda x: x.isNotNull())


def pair_count(z: Column, first: int, second: int) -> Column:
    """Pairs of the two elements, those inside a fragment too: the normalisation counts all of them."""
    count = lambda e: F.size(F.filter(z, lambda x: x == e))
    a, b = count(first), count(second)
    return a * (a - 1) / 2 if first == second else a * b


def histogram(records: DataFrame, distances: Column, keys: list[str], low: float, high: float, n_bins: int) -> DataFrame:
    """keys, bin, n: additive counts."""
    rows = records.select(*keys, F.explode(distances).alias("x"))
    return rows.withColumn("bin", bin_of(F.col("x"), low, high, n_bins)).filter("bin is not null").groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))


def normalised(counts: DataFrame, frames: DataFrame, keys: list[str], low: float, high: float, n_bins: int, volume: float) -> DataFrame:
    """g of every bin, empty ones included. ``frames``: keys, n_frames, n_pairs (pairs of one frame)."""
    width = (high - low) / n_bins
    spine = frames.select(*keys, "n_frames", "n_pairs", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"))
    rows = spine.join(counts, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    left = F.lit(low) + F.col("bin") * width
    shell = 4.0 / 3.0 * math.pi * (F.pow(left + width, F.lit(3)) - F.pow(left, F.lit(3)))
    ideal = F.col("n_frames") * shell * F.col("n_pairs") / volume
    return rows.select(*keys, "bin", (left + width / 2).alias("r"), "n", F.when(ideal > 0, F.col("n") / ideal).otherwise(0.0).alias("g"))


Predictor = Callable[[Column], Column]
