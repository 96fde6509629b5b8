"""Distance vectors of the records and the blocks in which they are compared.

A record's vector holds the distances (angstrom) of all atom pairs i < j. Records
of one ``z`` are compared with each other only. For that, each group's vectors are
put into cells around centroids (k-means on a bounded sample); a vector within
``radius`` of another lies at most ``radius`` beyond the bisector of the two
cells, so visiting the cells whose bisector is that near loses no pair.

Defined results: a record that is not complete (null ``r``, a null, NaN or infinite
coordinate, another number of coordinates than 3 per atom of ``z``) has no
vector and takes no part. A repeated struct_id counts once. Empty input gives
empty output.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moltide.functions.unit_grammar import ENERGY_UNITS
from moltide.operators.units import dataset_units, row_energy_unit, unit_factor
from moltide.sources.tables import join_dimension, table

#: Rows of the sample that centroids are fitted on: so many for each of a group's centroids, and at least (every row is then put into a cell).
SAMPLE_OF_CELL, SAMPLE_ROWS = 4, 5_000
#: Rows that a cell should hold.
CELL_ROWS = 1_000
#: Centroids of all groups together, at most. They go to the executors (65536 x 66 doubles are 35 MB), and the sample to the driver (262144 records of twelve atoms are 75 MB).
MAX_CENTROIDS = 65_536
#: A group of more centroids has them in two levels, so a row is compared with few of them.
FLAT = 8_192
#: Groups that may have cells of their own; the smaller ones beyond are one cell each.
MAX_GROUPS = 10_000

VECTOR_SCHEMA = T.StructType([
    T.StructField("group_key", T.StringType()), T.StructField("struct_id", T.LongType()), T.StructField("e", T.DoubleType()), T.StructField("xyz", T.BinaryType()),
])


def doubles(column: pa.Array, width: int) -> np.ndarray:
    """A binary column of packed doubles as a (rows, width) array."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64).reshape(-1, width)


def packed(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x, dtype=np.float64)
    n, width = x.shape
    offsets = np.arange(n + 1, dtype=np.int32) * (8 * width)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(x.tobytes())])


def distance_vectors(xyz: np.ndarray) -> np.ndarray:
    """(n, atoms, 3) coordinates -> (n, pairs) distances, pairs i < j in order."""
    i, j = np.triu_indices(xyz.shape[1], 1)
    d = xyz[:, i] - xyz[:, j]
    return np.sqrt(np.einsum("npc,npc->np", d, d))


def vectors_of(column: pa.Array, key: str) -> np.ndarray:
    """The distance vectors of packed coordinates of one group."""
    atoms = len(key.split(","))
    return distance_vectors(doubles(column, 3 * atoms).reshape(-1, atoms, 3))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """struct_id, group_key (z joined by commas), e in kcal/mol, r as stored and its factor to angstrom.

    Only what the vectors need is read; the join with the data sets' units is the only shuffle, or none.
    """
    structures = table(spark, sf_dir, "structures")
    units = dataset_units(structures, table(spark, sf_dir, "datasets"))
    units = units.select("dset_id", F.array_join(F.transform("z", lambda a: a.cast("string")), ",").alias("group_key"), F.array_join("comp_ids", ",").alias("comps"), F.size("z").alias("n_atoms"), "mb", "r_factor", "e_unit_real")
    rows = join_dimension(structures.select("struct_id", "dset_id", "r", "e", "row_note"), units, "dset_id")
    unit = F.coalesce(row_energy_unit(F.col("row_note")), F.col("e_unit_real"))
    return rows.select("struct_id", "group_key", "comps", "n_atoms", "mb", (F.col("e") * unit_factor(unit, ENERGY_UNITS)).alias("e"), "r", "r_factor")


def complete(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """The complete records of an Arrow batch by group: (group_key, row numbers, (rows, atoms, 3) coordinates in angstrom)."""
    r = batch.column(batch.schema.get_field_index("r"))
    keys = batch.column(batch.schema.get_field_index("group_key")).dictionary_encode()
    codes = keys.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    factor = batch.column(batch.schema.get_field_index("r_factor")).to_numpy(zero_copy_only=False)
    counts = r.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    for code, key in enumerate(keys.dictionary.to_pylist()):
        width = 3 * len(key.split(",")) if key else -1
        rows = np.flatnonzero((codes == code) & (counts == width))
        if width < 6 or not len(rows):  # one atom has no distance
            continue
        xyz = r.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(rows), width)
        good = np.isfinite(xyz).all(axis=1)
        rows, xyz = rows[good], xyz[good]
        if len(rows):
            yield key, rows, (xyz * factor[rows, None]).reshape(len(rows), -1, 3)


def _to_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, e = batch.column(batch.schema.get_field_index("struct_id")), batch.column(batch.schema.get_field_index("e"))
        for key, rows, xyz in complete(batch):
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(rows)), ids.take(at), e.take(at), packed(xyz.reshape(len(rows), -1))], ["group_key", "struct_id", "e", "xyz"])


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """group_key, struct_id, e (kcal/mol), xyz (angstrom, packed doubles) of all complete records; deliveries aren't deduplicated here.

    Coordinates are kept rather than the longer vectors, which ``vectors_of`` makes from them in a task.
    """
    return records(spark, sf_dir).select("struct_id", "group_key", "e", "r", "r_factor").mapInArrow(_to_vectors, VECTOR_SCHEMA)


def k_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """Lloyd's algorithm on a sample; the centroids, distinct and at most k."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = total[n > 0] / n[n > 0, None]
    return np.unique(c.round(6), axis=0)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2.0 * (x @ c.T), 0.0)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([squared(x[a : a + 4096], c).argmin(1) for a in range(0, len(x), 4096)]) if len(x) else np.empty(0, int)


def split_k_means(x: np.ndarray, k: int) -> np.ndarray:
    """About k centroids of a sample: k-means, for many of them in two levels."""
    if k <= FLAT:
        return k_means(x, k)
    top = k_means(x, max(2, round(k**0.5)))
    home, found = nearest(x, top), []
    for t in range(len(top)):
        part = x[home == t]
        if len(part):
            found.append(k_means(part, max(1, round(k * len(part) / len(x))), rounds=4))
    return np.unique(np.concatenate(found), axis=0)


class _Level:
    """One group's centroids: all distances at once for few; for many, clusters of centroids with their radius, so that far ones are never looked at."""

    def __init__(self, c: np.ndarray):
        self.c = c
        self.tops = None
        if len(c) > FLAT:
            self.tops = k_means(c, round(len(c) ** 0.5), rounds=4)
            home = nearest(c, self.tops)
            self.lists = [np.flatnonzero(home == t) for t in range(len(self.tops))]
            self.radius = np.array([np.sqrt(squared(c[at], self.tops[t : t + 1]).max()) if len(at) else -np.inf for t, at in enumerate(self.lists)])

    def near(self, x: np.ndarray, reach: float | None, most: int | None):
        """Home of each row, and other centroids (row, centroid) whose bisector with the home's is at most ``reach`` away (None: any), ``most`` of them at most."""
        if self.tops is None:
            d2 = squared(x, self.c)
            home = d2.argmin(1)
            own = d2[np.arange(len(x)), home]
            row, cell = self._nearest(d2, most) if reach is None else np.nonzero(np.sqrt(d2) <= np.sqrt(own)[:, None] + 2.0 * max(reach, 0.0) + 1e-6)
            far = d2[row, cell]
        else:
            to_top = np.sqrt(squared(x, self.tops))
            gap = np.maximum(to_top - self.radius[None], 0.0)
            home, own = np.zeros(len(x), int), np.full(len(x), np.inf)
            rows, cells, fars = [], [], []

            def look(t: int, who: np.ndarray, keep: float | None) -> None:
                """Distances of some rows to the centroids of cluster t: better homes, or those within the row's own distance and ``keep``."""
                d2 = squared(x[who], self.c[self.lists[t]])
                if keep is None:
                    at = d2.argmin(1)
                    best = d2[np.arange(len(who)), at]
                    better = best < own[who]
                    home[who[better]], own[who[better]] = self.lists[t][at[better]], best[better]
                else:
                    r, k = self._nearest(d2, most) if reach is None else np.nonzero(np.sqrt(d2) <= np.sqrt(own[who])[:, None] + keep)
                    rows.append(who[r])
                    cells.append(self.lists[t][k])
                    fars.append(d2[r, k])

            first = gap.argmin(1) if reach is not None else to_top.argmin(1)
            used = [t for t in range(len(self.tops)) if len(self.lists[t])]
            for t in used:
                if len(who := np.flatnonzero(first == t)):
                    look(t, who, None)
            for t in used:
                if len(who := np.flatnonzero((first != t) & (gap[:, t] < np.sqrt(own)))):
                    look(t, who, None)
            # the bisector of two centroids is at least half the difference of the distances away
            wide = 2.0 * max(reach, 0.0) + 1e-6 if reach is not None else np.inf
            close = to_top <= np.partition(to_top, 3, axis=1)[:, 3][:, None] if reach is None else None
            for t in used:
                inside = close[:, t] if reach is None else gap[:, t] <= np.sqrt(own) + wide
                if (reach is None or reach >= 0) and len(who := np.flatnonzero(inside)):
                    look(t, who, wide)
            row, cell, far = (np.concatenate(v) if v else np.empty(0, kind) for v, kind in ((rows, int), (cells, int), (fars, float)))
        if reach is not None and reach < 0:
            return home, np.empty(0, int), np.empty(0, int)
        between = np.sqrt(((self.c[home[row]] - self.c[cell]) ** 2).sum(1)) if len(row) < 4_000_000 else self._between(home[row], cell)
        other = between > 0
        row, cell, beyond = row[other], cell[other], ((far - own[row])[other]) / (2.0 * between[other])
        if reach is not None:
            keep = beyond <= reach + 1e-9
            row, cell, beyond = row[keep], cell[keep], beyond[keep]
        if most is not None:
            order = np.lexsort((cell, beyond, row))
            row, cell = row[order], cell[order]
            keep = np.arange(len(row)) - np.searchsorted(row, row) < most
            row, cell = row[keep], cell[keep]
        return home, row, cell

    @staticmethod
    def _nearest(d2: np.ndarray, most: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(row, column) of each row's nearest centroids, four times as many as are asked for: the bisectors then choose."""
        k = d2.shape[1] if most is None else min(4 * most + 1, d2.shape[1])
        return np.repeat(np.arange(len(d2)), k), np.argpartition(d2, k - 1, axis=1)[:, :k].ravel()

    def _between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.concatenate([np.sqrt(((self.c[a[i : i + 1_000_000]] - self.c[b[i : i + 1_000_000]]) ** 2).sum(1)) for i in range(0, len(a), 1_000_000)])


class Cells:
    """Centroids by group; made on the driver from counts and a bounded sample, sent to the executors."""

    def __init__(self, centroids: dict[str, np.ndarray]):
        self.centroids = {key: _Level(c) for key, c in centroids.items()}

    def of(self, key: str, x: np.ndarray, reach: float | None = None, most: int | None = None):
        """Home cell of each row, and the other cells to visit as (row, cell).

        ``reach``: all cells whose bisector with the home cell is at most so far away. ``most``: at most so many, the nearest first.
        """
        if key not in self.centroids:
            return np.zeros(len(x), np.int32), (np.empty(0, int), np.empty(0, np.int32))
        homes, rows, cells = [], [], []
        for a in range(0, len(x), 2048):
            home, row, cell = self.centroids[key].near(x[a : a + 2048], reach, most)
            homes.append(home)
            rows.append(row + a)
            cells.append(cell)
        return np.concatenate(homes).astype(np.int32), (np.concatenate(rows), np.concatenate(cells).astype(np.int32))


def fit_cells(vecs: DataFrame, cell_rows: int = CELL_ROWS, sample_rows: int = SAMPLE_ROWS) -> Cells:
    """Centroids for every group of more than ``cell_rows`` rows, at most MAX_GROUPS of them; other groups are one cell.

    The sample of a group is its rows of the lowest hash of struct_id: SAMPLE_OF_CELL for each of its centroids and at least ``sample_rows``, about; of all
    groups together at most SAMPLE_OF_CELL * MAX_CENTROIDS + MAX_GROUPS * 4.
    """
    counts = vecs.groupBy("group_key").count().filter(F.col("count") > cell_rows).orderBy(F.col("count").desc(), "group_key").limit(MAX_GROUPS).collect()
    if not counts:
        return Cells({})
    total = sum(n for _, n in counts)
    cell_rows = max(cell_rows, -(-total // MAX_CENTROIDS))
    most = SAMPLE_OF_CELL * MAX_CENTROIDS
    want = {key: max(SAMPLE_OF_CELL * -(-n // cell_rows), min(sample_rows, most * n // total)) for key, n in counts}
    spark = vecs.sparkSession
    shares = spark.createDataFrame([(key, min(1.0, want[key] / n)) for key, n in counts], "group_key string, share double")
    low = F.pmod(F.xxhash64("struct_id"), F.lit(1_000_000)) < F.col("share") * 1_000_000
    sample = vecs.select("group_key", "struct_id", "xyz").join(F.broadcast(shares), "group_key").filter(low).select("group_key", "xyz").toArrow()  # at most MAX_GROUPS rows are broadcast
    found, keys = {}, np.array(sample["group_key"].to_pylist(), dtype=object)
    for key, n in counts:
        at = np.flatnonzero(keys == key)
        if len(at):
            x = vectors_of(sample["xyz"].combine_chunks().take(pa.array(at)), key)
            found[key] = split_k_means(x, max(2, min(-(-n // cell_rows), max(1, len(at) // 2))))
    return Cells(found)


def by_group(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
    """Row numbers of an Arrow batch by group_key."""
    keys = batch.column("group_key").dictionary_encode()
    codes = keys.indices.to_numpy(zero_copy_only=False)
    for code, key in enumerate(keys.dictionary.to_pylist()):
        rows = np.flatnonzero(codes == code)
        if len(rows):
            yield key, rows


def spread(ids: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    """A block of each id, out of n, by a multiplicative hash."""
    mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
    return (mixed % np.asarray(n).astype(np.uint64)).astype(np.int32)
