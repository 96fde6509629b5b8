"""A varied subset of given size, by systematic selection along a Hilbert curve.

Each complete record with an energy gets four features: the coordinates of its
distance vector on the three directions of largest variance of its composition, and
its energy against the mean of its kind (total, 2-body, ...), all in standard
deviations x and brought into 0 ... 1 by 1/2 + arctan(x) / pi, which never ends: outliers keep cells of their
own. Quantised to BITS bits each they are a point of a grid, and the grid's
Hilbert curve numbers it; the first bits of that number are the cell of any coarser
grid. Per request the coarsest grid with at least CELLS_PER_PICK cells a pick is
taken, its distinct cells are sorted over the whole cluster, evenly spaced cells are chosen,
and of each the record nearest to the cell's middle. However many records share a
cell, it counts once: large groups of similar records are not over-represented.

Defined results: a request gets min(subset_size, records) records; if even the finest
grid has fewer cells than picks, cells give a second, third, ... record in turn.
Ties go to the smaller struct_id, repeated deliveries count once, a null or
non-positive size or a composition without records gives no rows. Compositions are
compared as multisets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moltide.llm.vectors import complete, distance_vectors, records
from moltide.sources.tables import materialise, table

DIMENSIONS, BITS = 4, 8
CELLS_PER_PICK = 2


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of integer points (n, d), each in 0 ... 2^bits - 1 (Skilling's transform, 2004)."""
    x = points.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(d):
            has = (x[i] & q) != 0
            x[0] = np.where(has, x[0] ^ low, x[0])
            swap = np.where(has, 0, (x[0] ^ x[i]) & low)
            x[0] ^= swap
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[d - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _moments(rows: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Mean vector and the directions of largest variance, each over its standard deviation, per group, from sums over all records."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list] = {}
        for batch in batches:
            for key, _, xyz in complete(batch):
                v = distance_vectors(xyz)
                s = sums.setdefault(key, [0, 0.0, 0.0])
                s[0], s[1], s[2] = s[0] + len(v), s[1] + v.sum(0), s[2] + v.T @ v
        for key, (n, s, ss) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([n]), pa.array([s.tobytes()], pa.binary()), pa.array([ss.tobytes()], pa.binary())], ["group_key", "n", "s", "ss"])

    def add(part: pa.Table) -> pa.Table:
        s = np.sum([np.frombuffer(b) for b in part["s"].to_pylist()], axis=0)
        ss = np.sum([np.frombuffer(b) for b in part["ss"].to_pylist()], axis=0)
        n = sum(part["n"].to_pylist())
        mean = s / n
        cov = ss.reshape(len(s), len(s)) / n - np.outer(mean, mean)
        value, vector = np.linalg.eigh(cov)
        top = np.argsort(value)[::-1][: DIMENSIONS - 1]
        axes = vector[:, top] * np.sign(vector[np.abs(vector[:, top]).argmax(0), top])
        axes = axes / np.sqrt(np.maximum(value[top], 1e-12))
        return pa.table({"group_key": [part["group_key"][0].as_py()], "mean": pa.array([mean.tobytes()], pa.binary()), "axes": pa.array([axes.tobytes()], pa.binary())})

    schema = "group_key string, n bigint, s binary, ss binary"
    fitted = rows.mapInArrow(partial, schema).groupBy("group_key").applyInArrow(add, "group_key string, mean binary, axes binary").collect()  # one row a requested composition's z
    return {key: (np.frombuffer(mean), np.frombuffer(axes).reshape(len(mean) // 8, -1)) for key, mean, axes in fitted}


def _features(rows: DataFrame) -> DataFrame:
    """request-independent features: comps, kind, struct_id, e, p0 ... (standard deviations)."""
    moments = _moments(rows.select("group_key", "r", "r_factor"))
    names = [f"p{i}" for i in range(DIMENSIONS - 1)]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, at, xyz in complete(batch):
                mean, axes = moments[key]
                p = (distance_vectors(xyz) - mean) @ axes
                if p.shape[1] < len(names):
                    p = np.pad(p, ((0, 0), (0, len(names) - p.shape[1])))
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)).take(take) for c in ("comps", "kind", "struct_id", "e")), *(pa.array(np.ascontiguousarray(p[:, i])) for i in range(len(names)))], ["comps", "kind", "struct_id", "e", *names])

    schema = "comps string, kind int, struct_id bigint, e double, " + ", ".join(f"{n} double" for n in names)
    return rows.mapInArrow(project, schema)


def _global_order(cells: DataFrame) -> DataFrame:
    """``cells`` with position and total per request: sorted over the cluster by request_id and cell, no request in one task."""
    ordered = cells.repartitionByRange("request_id", "cell").sortWithinPartitions("request_id", "cell")
    ordered = materialise(ordered.withColumn("part", F.spark_partition_id()), "ordered")
    counts = ordered.groupBy("request_id", "part").agg(F.count(F.lit(1)).alias("n"))  # a row a partition
    before = Window.partitionBy("request_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumns({"offset": F.coalesce(F.sum("n").over(before), F.lit(0)), "total": F.sum("n").over(Window.partitionBy("request_id"))}).drop("n")
    inside = F.row_number().over(Window.partitionBy("request_id", "part").orderBy("cell")) - 1
    return ordered.withColumn("_i", inside).join(counts, ["request_id", "part"]).withColumn("position", F.col("_i") + F.col("offset")).drop("_i", "offset", "part")


def _in_turn(celled: DataFrame, chosen: DataFrame) -> DataFrame:
    """Where even the finest grid has fewer cells than picks: first records of all cells, then second ones, ... until the size is reached.

    celled: request_id, cell, struct_id, off; chosen: the cells of such requests with subset_size, position, total, cell_rows. Whole levels are taken
    by their counts; only the last one's rows, fewer than the request's size, are put in order.
    """
    most = chosen.agg(F.max("subset_size")).first()[0]
    # the rank is cut before the shuffle; beyond the size no cell can need a record
    ranked = celled.withColumn("nth", F.row_number().over(Window.partitionBy("request_id", "cell").orderBy("off", "struct_id"))).filter(F.col("nth") <= int(most))
    rows = materialise(ranked.join(chosen.select("request_id", "cell", "subset_size", "position", "cell_rows"), ["request_id", "cell"]), "turns")
    levels = rows.groupBy("request_id", "nth").agg(F.count(F.lit(1)).alias("n"))  # at most subset_size rows a request
    before = Window.partitionBy("request_id").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(levels.withColumn("taken", F.coalesce(F.sum("n").over(before), F.lit(0))), ["request_id", "nth"]).filter("taken < subset_size")
    whole, last = rows.filter("taken + n <= subset_size"), rows.filter("taken + n > subset_size")
    last = last.withColumn("_place", F.row_number().over(Window.partitionBy("request_id").orderBy("position"))).filter("taken + _place <= subset_size")
    return whole.unionByName(last.drop("_place"))


def varied_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """request_id, struct_id, position of its cell on the curve, cell_rows (records that the pick stands for)."""
    requests = table(spark, sf_dir, "subset_requests").filter("subset_size > 0").select("request_id", "n_atoms", F.array_join(F.array_sort("comp_ids"), ",").alias("comps"), F.col("subset_size").cast("bigint").alias("subset_size")).dropDuplicates(["request_id"])
    rows = records(spark, sf_dir).withColumn("comps", F.array_join(F.array_sort(F.split("comps", ",")), ","))
    rows = rows.filter(F.col("e").isNotNull() & ~F.isnan("e")).withColumn("kind", F.coalesce("mb", F.lit(0)))
    wanted = requests.select("n_atoms", "comps").distinct()
    rows = rows.join(wanted, ["n_atoms", "comps"], "left_semi")
    features = materialise(_features(rows.select("comps", "kind", "struct_id", "e", "group_key", "r", "r_factor", "n_atoms")).dropDuplicates(["struct_id"]), "features")

    spread = features.groupBy("comps", "kind").agg(F.avg("e").alias("_mean"), F.stddev_pop("e").alias("_sd"))
    points = features.join(spread, ["comps", "kind"]).withColumn(f"p{DIMENSIONS - 1}", F.coalesce((F.col("e") - F.col("_mean")) / F.when(F.col("_sd") > 0, F.col("_sd")), F.lit(0.0)))
    unit = [F.least(F.atan(f"p{i}") / np.pi + 0.5, F.lit(1.0 - 1e-9)).alias(f"u{i}") for i in range(DIMENSIONS)]
    points = points.select("comps", "kind", "struct_id", *unit)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = np.stack([batch.column(f"u{i}").to_numpy() for i in range(DIMENSIONS)], 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hilbert_keys((u * (1 << BITS)).astype(np.int64), BITS))], [*batch.schema.names, "key"])

    schema = "comps string, kind int, struct_id bigint, " + ", ".join(f"u{i} double" for i in range(DIMENSIONS)) + ", key bigint"
    keyed = materialise(points.mapInArrow(encode, schema), "keyed").join(requests.select("request_id", "comps", "subset_size"), "comps")

    # the coarsest grid with enough cells; kinds have curves of their own, one after the other
    coarse = lambda b: F.shiftright("key", DIMENSIONS * (BITS - b))
    grids = keyed.select("request_id", "subset_size", "kind", "key").distinct().groupBy("request_id", "subset_size").agg(*[F.count_distinct("kind", coarse(b)).alias(f"n{b}") for b in range(1, BITS + 1)])
    bits = F.coalesce(*[F.when(F.col(f"n{b}") >= CELLS_PER_PICK * F.col("subset_size"), b) for b in range(1, BITS)], F.lit(BITS))
    keyed = keyed.join(grids.select("request_id", bits.alias("bits")), "request_id")
    side = F.pow(F.lit(2.0), F.col("bits"))
    off = sum((F.col(f"u{i}") * side - F.floor(F.col(f"u{i}") * side) - 0.5) ** 2 for i in range(DIMENSIONS))
    cell = (F.col("kind").cast("bigint") * (1 << (DIMENSIONS * BITS))) + F.expr(f"shiftright(key, int({DIMENSIONS} * ({BITS} - bits)))")
    celled = materialise(keyed.select("request_id", cell.alias("cell"), "struct_id", off.alias("off")), "celled")
    best = F.min(F.struct("off", "struct_id"))["struct_id"]
    cells = _global_order(celled.groupBy("request_id", "cell").agg(F.count(F.lit(1)).alias("cell_rows"), best.alias("struct_id")))
    cells = materialise(cells.join(requests.select("request_id", "subset_size"), "request_id"), "cells")
    step = lambda x: F.floor(x * F.col("subset_size") / F.col("total"))
    columns = ["request_id", "struct_id", "position", "cell_rows"]
    picks = cells.filter("total >= subset_size").filter(step(F.col("position") + 1) > step(F.col("position"))).select(*columns)
    few = cells.filter("total < subset_size")
    return picks.unionByName(_in_turn(celled, few).select(*columns)) if few.limit(1).count() else picks
