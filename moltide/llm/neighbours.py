"""The k most similar vectors of every vector, by randomly rotated one-bit codes.

The vectors of a group lie in cells (``vectors.Cells``). In a block of a cell the
base vectors are taken relative to local centroids, rotated by a random orthogonal
matrix and kept as one sign bit a dimension plus two scalars: the residual's norm
and the inner product of the code with the unit residual. A query is rotated
alike and cut to 4-bit integers, so its inner product with a code is a few ANDs and
bit counts; divided by the code's scalar it is an unbiased estimate whose error
is bounded by EPSILON / sqrt(dimensions - 1) times the norms. Vectors whose lower
bound is above the k-th best distance so far are passed over, the others are reranked exactly.

With ``reach`` only neighbours up to that distance count, and all cells that can
hold one are visited: apart from the error bound's tail the result is exact. With
``probes`` each query visits its home cell and the so many nearest others.

Blocks bound what a task holds: a cell of many base rows, or of many queries, is
split by hashes of struct_id, every query block meeting every base block, and
the partial lists are merged by query.

Ties in distance go to the smaller struct_id. A vector that occurs under several
struct_ids counts once for each; repeated deliveries of one struct_id count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moltide.llm.vectors import Cells, by_group, k_means, nearest, spread, squared, vectors_of

#: Standard deviations of the estimate's error that the bounds allow for.
EPSILON = 2.5
BASE_BLOCK, QUERY_BLOCK = 8_192, 16_384
_BITS = 4

BLOCK_SCHEMA = T.StructType([
    T.StructField("group_key", T.StringType()), T.StructField("cell", T.IntegerType()), T.StructField("base_block", T.IntegerType()), T.StructField("query_block", T.IntegerType()),
    T.StructField("struct_id", T.LongType()), T.StructField("is_base", T.BooleanType()), T.StructField("is_query", T.BooleanType()), T.StructField("xyz", T.BinaryType()),
])
PAIR_SCHEMA = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("neighbour_id", T.LongType()), T.StructField("distance", T.DoubleType())])
_PAIR_ARROW = pa.schema([("query_id", pa.int64()), ("neighbour_id", pa.int64()), ("distance", pa.float64())])


def rotation(width: int, seed: int = 7) -> np.ndarray:
    """Random orthogonal map of ``width`` numbers into the next multiple of 64."""
    full = -(-width // 64) * 64
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((full, full)))
    return (q * np.sign(np.diag(r)))[:width]


def _words(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=-1, bitorder="little").view(np.uint64)


class Codes:
    """One-bit codes of base vectors relative to local centroids."""

    def __init__(self, base: np.ndarray, seed: int = 1):
        self.base, width = base, base.shape[1]
        self.turn = rotation(width)
        self.full = self.turn.shape[1]
        self.centroids = k_means(base, max(1, min(len(base) // 32, 192)), rounds=3, seed=seed)
        home = nearest(base, self.centroids)
        residual = base - self.centroids[home]
        norm = np.sqrt((residual * residual).sum(1))
        unit = (residual / np.where(norm > 0, norm, 1.0)[:, None]) @ self.turn
        bits = unit > 0
        # <code, unit residual>: the code is +-1/sqrt(full), so this is the mean absolute value times sqrt(full)
        aligned = np.abs(unit).sum(1) / np.sqrt(self.full)
        order = np.argsort(home, kind="stable")
        cuts = np.searchsorted(home[order], np.arange(len(self.centroids) + 1))
        self.lists = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        self.norm, self.aligned = norm, np.where(aligned > 0, aligned, 1.0)
        self.words, self.ones = _words(bits), bits.sum(1)
        spread = np.sqrt(np.maximum(1.0 - np.minimum(self.aligned, 1.0) ** 2, 0.0)) / self.aligned
        self.slack = EPSILON * spread / np.sqrt(self.full - 1)
        self.turned_centroids = self.centroids @ self.turn

    def bounds(self, turned: np.ndarray, c: int) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the squared distances of rotated queries to the vectors of list c."""
        rows = self.lists[c]
        q = turned - self.turned_centroids[c]
        q_norm = np.sqrt((q * q).sum(1))
        low = q.min(1)
        step = np.maximum((q.max(1) - low) / (2**_BITS - 1), 1e-12)
        ints = np.rint((q - low[:, None]) / step[:, None]).astype(np.uint8)
        words = self.words[rows]
        inner = np.zeros((len(q), len(rows)), np.uint16)
        for bit in range(_BITS):
            plane = _words((ints >> bit) & 1)
            for w in range(words.shape[1]):
                inner += np.left_shift(np.bitwise_count(plane[:, w, None] & words[None, :, w]), bit, dtype=np.uint16)
        # <code, q> with code = (2 bit - 1) / sqrt(full) and q = low + step * int, divided by <code, unit residual>
        norm, aligned = self.norm[rows].astype(np.float32), self.aligned[rows].astype(np.float32)
        cross = inner * (2.0 * step).astype(np.float32)[:, None]
        cross += (2.0 * low).astype(np.float32)[:, None] * self.ones[rows].astype(np.float32)
        cross -= (step * ints.sum(1, dtype=np.int64) + low * self.full).astype(np.float32)[:, None]
        cross *= 2.0 * norm / (aligned * np.float32(np.sqrt(self.full)))
        estimate = np.subtract((norm**2)[None], cross, out=cross)
        estimate += (q_norm**2).astype(np.float32)[:, None]
        quantised = EPSILON * 0.3 * step  # rounding error of the 4-bit query, as a standard deviation times EPSILON
        slack = q_norm.astype(np.float32)[:, None] * (2.0 * norm * self.slack[rows].astype(np.float32))
        slack += quantised.astype(np.float32)[:, None] * (2.0 * norm / aligned)
        slack += np.float32(1e-6) * (1 + (q_norm**2).astype(np.float32)[:, None])  # of single precision
        return estimate - slack, np.add(estimate, slack, out=estimate)

    def search(self, queries: np.ndarray, query_ids: np.ndarray, base_ids: np.ndarray, k: int, reach: float | None):
        """(query row, base row, distance) of the k nearest base vectors of each query, itself left out."""
        m = len(queries)
        limit = np.full(m, np.inf if reach is None else reach**2 + 1e-9)
        turned = queries @ self.turn
        to_centroid = np.sqrt(squared(queries, self.centroids))
        radius = np.array([self.norm[rows].max() if len(rows) else -np.inf for rows in self.lists])
        home = to_centroid.argmin(1)
        best_q, best_b, best_d = np.empty(0, int), np.empty(0, int), np.empty(0)

        def rerank(pairs: list[tuple[np.ndarray, np.ndarray]]) -> None:
            """Exact distances of the chosen pairs; the k best of each query and its limit."""
            nonlocal best_q, best_b, best_d
            q = np.concatenate([best_q, *(a for a, _ in pairs)])
            b = np.concatenate([best_b, *(x for _, x in pairs)])
            d = np.empty(len(q))
            d[: len(best_d)] = best_d
            for a in range(len(best_d), len(q), 65_536):
                gap = queries[q[a : a + 65_536]] - self.base[b[a : a + 65_536]]
                d[a : a + 65_536] = np.einsum("ij,ij->i", gap, gap)
            keep = d <= limit[q]
            q, b, d = q[keep], b[keep], d[keep]
            order = np.lexsort((base_ids[b], d, q))
            q, b, d = q[order], b[order], d[order]
            first = np.searchsorted(q, np.arange(m))
            place = np.arange(len(q)) - first[q]
            worst = np.flatnonzero(place == k - 1)
            limit[q[worst]] = d[worst]
            keep = place < k
            best_q, best_b, best_d = q[keep], b[keep], d[keep]

        def pairs_of(c: int, who: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            rows = self.lists[c]
            chunk = max(1, 400_000 // max(1, len(rows)))
            for a in range(0, len(who), chunk):
                at = who[a : a + chunk]
                lower, upper = self.bounds(turned[at], c)
                other = base_ids[rows][None] != query_ids[at][:, None]
                upper[~other] = np.inf
                top = np.partition(upper, k - 1, axis=1)[:, k - 1] if upper.shape[1] >= k else np.full(len(at), np.inf)
                q, b = np.nonzero((lower <= np.minimum(limit[at], top)[:, None]) & other)
                yield at[q], rows[b]

        for phase in (0, 1):
            waiting: list[tuple[np.ndarray, np.ndarray]] = []
            size = 0
            for c in range(len(self.centroids)):
                if not len(self.lists[c]):
                    continue
                inside = to_centroid[:, c] - radius[c] <= np.sqrt(limit) + 1e-9
                who = np.flatnonzero((home == c) if phase == 0 else (home != c) & inside)
                for pair in pairs_of(c, who):
                    waiting.append(pair)
                    size += len(pair[0])
                    if size > 2_000_000:
                        rerank(waiting)
                        waiting, size = [], 0
            rerank(waiting)
        return best_q, best_b, np.sqrt(best_d)


def cell_counts(vecs: DataFrame, cells: Cells) -> dict[tuple[str, int], int]:
    """Rows of each cell; at most vectors.MAX_CENTROIDS cells, and groups of one cell are left out if small."""

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, rows in by_group(batch):
                x = vectors_of(batch.column("xyz").take(pa.array(rows)), key)
                home, _ = cells.of(key, x, most=0, reach=-1.0)
                cell, n = np.unique(home, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(cell)), pa.array(cell, pa.int32()), pa.array(n, pa.int64())], ["group_key", "cell", "n"])

    counted = vecs.select("group_key", "xyz").mapInArrow(homes, "group_key string, cell int, n bigint").groupBy("group_key", "cell").agg(F.sum("n").alias("n"))
    return {(key, cell): n for key, cell, n in counted.filter(F.col("n") > BASE_BLOCK).collect()}


def to_blocks(vecs: DataFrame, cells: Cells, large: dict[tuple[str, int], int], reach: float | None, probes: int | None, every: int) -> DataFrame:
    """Each base row in its home cell's blocks and each query in the blocks it has to meet. Queries: struct_ids divisible by ``every``."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_ids = batch.column("struct_id").to_numpy(zero_copy_only=False)
            for key, rows in by_group(batch):
                v = batch.column("xyz").take(pa.array(rows))
                ids = all_ids[rows]
                home, (visitor, visited) = cells.of(key, vectors_of(v, key), reach, probes)
                asks = ids % every == 0
                visitor, visited = visitor[asks[visitor]], visited[asks[visitor]]
                at = np.concatenate([np.arange(len(ids)), visitor])
                cell = np.concatenate([home, visited]).astype(np.int32)
                base = np.concatenate([np.ones(len(ids), bool), np.zeros(len(visitor), bool)])
                query = np.concatenate([asks, np.ones(len(visitor), bool)])
                count = np.ones(len(cell), np.int64)
                for c in np.unique(cell):
                    if (n := large.get((key, int(c)))) is not None:
                        count[cell == c] = n
                n_base, n_query = -(-count // BASE_BLOCK), -(-count // QUERY_BLOCK)
                bb, qb = spread(ids[at], n_base), spread(ids[at] + 1, n_query)
                one = (n_base == 1) & (n_query == 1)
                out = [(at[one], cell[one], bb[one], qb[one], base[one], query[one])]
                for x in np.flatnonzero(~one):  # rows of large cells: base to every query block, query to every base block
                    if base[x]:
                        k = n_query[x]
                        out.append((np.full(k, at[x]), np.full(k, cell[x]), np.full(k, bb[x]), np.arange(k), np.ones(k, bool), np.zeros(k, bool)))
                    if query[x]:
                        k = n_base[x]
                        out.append((np.full(k, at[x]), np.full(k, cell[x]), np.arange(k), np.full(k, qb[x]), np.zeros(k, bool), np.ones(k, bool)))
                at, cell, bb, qb, base, query = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * len(at)), pa.array(cell, pa.int32()), pa.array(bb, pa.int32()), pa.array(qb, pa.int32()), pa.array(ids[at], pa.int64()), pa.array(base), pa.array(query), v.take(pa.array(at))],
                    [f.name for f in BLOCK_SCHEMA],
                )

    return vecs.select("group_key", "struct_id", "xyz").mapInArrow(emit, BLOCK_SCHEMA)


def _search_block(k: int, reach: float | None):
    def search(block: pa.Table) -> pa.Table:
        key = block["group_key"][0].as_py()
        ids = block["struct_id"].to_numpy()
        is_base, is_query = block["is_base"].to_numpy(), block["is_query"].to_numpy()
        x = vectors_of(block["xyz"].combine_chunks(), key)
        base, query = np.flatnonzero(is_base), np.flatnonzero(is_query)
        base, query = base[np.unique(ids[base], return_index=True)[1]], query[np.unique(ids[query], return_index=True)[1]]
        if not len(base) or not len(query):
            return _PAIR_ARROW.empty_table()
        q, b, d = Codes(x[base]).search(x[query], ids[query], ids[base], k, reach)
        return pa.table([pa.array(ids[query][q]), pa.array(ids[base][b]), pa.array(d)], schema=_PAIR_ARROW)

    return search


def neighbours(vecs: DataFrame, cells: Cells, k: int = 5, reach: float | None = None, probes: int | None = None, every: int = 1) -> DataFrame:
    """query_id, neighbour_id, distance, place (1 = nearest): up to k rows a query.

    ``vecs`` should be materialised, as it is read twice. Give ``reach`` (all cells that can hold a hit) or ``probes``.
    """
    blocks = to_blocks(vecs, cells, cell_counts(vecs, cells), reach, probes, every)
    found = blocks.groupBy("group_key", "cell", "base_block", "query_block").applyInArrow(_search_block(k, reach), PAIR_SCHEMA)
    # at most k rows a visited block: merging them per query is bounded by the probes
    lists = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "neighbour_id"))), 1, k).alias("l"))
    return lists.select("query_id", F.posexplode("l").alias("p", "x")).select("query_id", "x.neighbour_id", "x.distance", (F.col("p") + 1).alias("place"))


def similar_pairs(found: DataFrame) -> DataFrame:
    """struct_id_a < struct_id_b of all pairs of which one is among the other's neighbours."""
    a, b = F.least("query_id", "neighbour_id"), F.greatest("query_id", "neighbour_id")
    return found.select(a.alias("struct_id_a"), b.alias("struct_id_b")).distinct()


def exact_neighbours(vecs: DataFrame, k: int, every: int) -> DataFrame:
    """The same by brute force, the query set against all rows in blocks; to measure recall."""
    counts = {key: n for key, n in vecs.groupBy("group_key").count().filter(F.col("count") > BASE_BLOCK).collect()}
    large = {(key, 0): n for key, n in counts.items()}
    blocks = to_blocks(vecs, Cells({}), large, None, None, every)

    def search(block: pa.Table) -> pa.Table:
        key = block["group_key"][0].as_py()
        ids, x = block["struct_id"].to_numpy(), vectors_of(block["xyz"].combine_chunks(), key)
        base, query = np.flatnonzero(block["is_base"].to_numpy()), np.flatnonzero(block["is_query"].to_numpy())
        base = base[np.unique(ids[base], return_index=True)[1]]
        query = query[np.unique(ids[query], return_index=True)[1]]
        out = []
        for a in range(0, len(query), 512):
            at = query[a : a + 512]
            d = np.sqrt(squared(x[at], x[base]))
            d[ids[at][:, None] == ids[base][None]] = np.inf
            n = min(k, d.shape[1])
            near = np.argpartition(d, n - 1, axis=1)[:, :n]
            q, _ = np.nonzero(np.isfinite(np.take_along_axis(d, near, 1)) | True)
            out.append((ids[at][q], ids[base][near.ravel()], np.take_along_axis(d, near, 1).ravel()))
        if not out:
            return _PAIR_ARROW.empty_table()
        q, b, d = (np.concatenate(c) for c in zip(*out, strict=True))
        real = np.isfinite(d)
        return pa.table([pa.array(q[real]), pa.array(b[real]), pa.array(d[real])], schema=_PAIR_ARROW)

    found = blocks.groupBy("group_key", "cell", "base_block", "query_block").applyInArrow(search, PAIR_SCHEMA)
    lists = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "neighbour_id"))), 1, k).alias("l"))
    return lists.select("query_id", F.inline("l")).select("query_id", "neighbour_id", "distance")


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: queries, true neighbours, those found (a neighbour as near as the k-th true one counts), and their share."""
    worst = truth.groupBy("query_id").agg(F.max("distance").alias("worst"), F.count(F.lit(1)).alias("n"))
    hits = found.join(worst, "query_id", "right").groupBy("query_id", "n").agg(F.sum(F.when(F.col("distance") <= F.col("worst") + 1e-6, 1).otherwise(0)).alias("hit"))
    return hits.agg(F.count(F.lit(1)).alias("n_queries"), F.sum("n").alias("n_true"), F.sum(F.least("hit", "n")).alias("n_found")).withColumn("recall", F.round(F.col("n_found") / F.col("n_true"), 6))
