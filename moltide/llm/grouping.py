"""Grouping records into clusters of mutually similar records, by power-iteration spectral clustering.

Two records of one group are similar if their vectors are at most ``reach`` apart and
their energies at most ``window``. Steps, all as Spark jobs:

1. *Anchors.* Inside chunks of a cell the smallest struct_id without an anchor becomes
   one and takes the records similar to it; where a cell has several chunks its anchors
   are thinned the same way until one chunk holds them. So a group of copies, however
   large, costs one anchor a cell.
2. *Sparse affinities* exp(-d^2 / 2 reach^2) between anchors of one cell and its neighbours:
   links, never all pairs of a group.
3. *Power iteration* of the normalised affinities on six random vectors at once, each anchor
   counting for the records it took. STEPS steps are few enough that only strongly linked
   anchors meet: a link has an affinity of at least exp(-1/2), so the vectors of mutually linked
   anchors draw together by a factor of 4 a step (1e-5 after eight), while
   groups held together by few links stay apart.
4. *k-means on the embedding.* Centres start at the occupied cells of a grid over the
   embedding, an anchor takes the nearest centre in its cell or next to it, and centres within
   TOLERANCE are one, under the smallest id; repeated until nothing moves. The
   links play no part here: where anchors lie in the embedding decides their cluster.
5. *Check and ranks.* In every cluster all pairs are compared, in blocks: the mean affinity
   to the members ranks them. A cluster whose records aren't all similar is cut in
   two by the same method on its records: power iteration of their similarities with the trivial vector
   deflated, then 2-means of the vector; again until all parts hold. That is one
   rule for every size, in one task up to BLOCK records and by block jobs above.

Defined results: incomplete records and null or NaN energies take no part; repeated
deliveries count once; a record similar to none is a cluster of its own; ties go to
the smaller struct_id; an empty table gives no rows.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moltide.llm.neighbours import BLOCK_SCHEMA, cell_counts, to_blocks
from moltide.llm.vectors import Cells, by_group, squared, vectors_of
from moltide.sources.tables import join_dimension, materialise

CHUNK = 4_096
BLOCK = 8_192
VECTORS = ("x0", "x1", "x2", "x3", "x4", "x5")
#: Steps of the power iteration over anchors.
STEPS = 8
#: Centres of the embedding (numbers in 0 ... 1) that are so near are one; width of the grid's cells.
TOLERANCE, GRID = 0.002, 0.04
#: Steps of the power iteration inside a cluster that doesn't hold, and bins of its vector for 2-means.
CUT_STEPS, CUT_BINS = 8, 1_024

_MEMBER = T.StructType([
    T.StructField("group_key", T.StringType()), T.StructField("cell", T.IntegerType()), T.StructField("struct_id", T.LongType()), T.StructField("e", T.DoubleType()),
    T.StructField("xyz", T.BinaryType()), T.StructField("anchor", T.LongType()), T.StructField("distance", T.DoubleType()),
])
_MEMBER_ARROW = pa.schema([("group_key", pa.string()), ("cell", pa.int32()), ("struct_id", pa.int64()), ("e", pa.float64()), ("xyz", pa.binary()), ("anchor", pa.int64()), ("distance", pa.float64())])
_RANKED = T.StructType([
    T.StructField("struct_id", T.LongType()), T.StructField("label", T.LongType()), T.StructField("cluster_id", T.LongType()),
    T.StructField("affinity", T.DoubleType()),
])
_RANKED_ARROW = pa.schema([("struct_id", pa.int64()), ("label", pa.int64()), ("cluster_id", pa.int64()), ("affinity", pa.float64())])


def canopies(x: np.ndarray, e: np.ndarray, ids: np.ndarray, reach: float, window: float) -> tuple[np.ndarray, np.ndarray]:
    """Row of each row's anchor, and the distance to it: smallest ids first, an anchor takes all free rows similar to it."""
    order = np.argsort(ids, kind="stable")
    by_e = np.argsort(e, kind="stable")
    sorted_e = e[by_e]
    anchor, distance = np.full(len(ids), -1), np.zeros(len(ids))
    for i in order:
        if anchor[i] >= 0:
            continue
        near = by_e[np.searchsorted(sorted_e, e[i] - window, "left") : np.searchsorted(sorted_e, e[i] + window, "right")]
        near = near[anchor[near] < 0]
        gap = x[near] - x[i]
        d2 = np.einsum("ij,ij->i", gap, gap)
        hit = d2 <= reach * reach
        anchor[near[hit]], distance[near[hit]] = i, np.sqrt(d2[hit])
        anchor[i], distance[i] = i, 0.0
    return anchor, distance


def _anchors_of(reach: float, window: float):
    def of_chunk(chunk: pa.Table) -> pa.Table:
        key, ids = chunk["group_key"][0].as_py(), chunk["struct_id"].to_numpy()
        rows = np.unique(ids, return_index=True)[1]  # a repeated delivery lies in the same chunk
        chunk = chunk.take(pa.array(rows))
        ids, e = chunk["struct_id"].to_numpy(), chunk["e"].to_numpy()
        anchor, distance = canopies(vectors_of(chunk["xyz"].combine_chunks(), key), e, ids, reach, window)
        return pa.table([chunk["group_key"], chunk["cell"], chunk["struct_id"], chunk["e"], chunk["xyz"], pa.array(ids[anchor]), pa.array(distance)], schema=_MEMBER_ARROW)

    return of_chunk


def _homed(vecs: DataFrame, cells: Cells) -> DataFrame:
    """Adds the home cell of each row."""

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, rows in by_group(batch):
                at = pa.array(rows)
                home, _ = cells.of(key, vectors_of(batch.column("xyz").take(at), key), reach=-1.0)
                yield pa.RecordBatch.from_arrays([batch.column("group_key").take(at), pa.array(home, pa.int32()), *(batch.column(c).take(at) for c in ("struct_id", "e", "xyz"))], ["group_key", "cell", "struct_id", "e", "xyz"])

    return vecs.select("group_key", "struct_id", "e", "xyz").mapInArrow(homes, "group_key string, cell int, struct_id bigint, e double, xyz binary")


def _chunked(homed: DataFrame) -> tuple[DataFrame, bool]:
    """Adds a chunk of the cell so that about CHUNK rows share one; whether any cell has several."""
    counts = homed.groupBy("group_key", "cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CHUNK)
    full = materialise(counts.select("group_key", "cell", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")), "full")
    if not full.limit(1).count():
        return homed.withColumn("chunk", F.lit(0)), False
    rows = join_dimension(homed, full, ["group_key", "cell"], "left")
    return rows.withColumn("chunk", F.pmod(F.xxhash64("struct_id"), F.coalesce("chunks", F.lit(1))).cast("int")).drop("chunks"), True


def _anchored(vecs: DataFrame, cells: Cells, reach: float, window: float) -> tuple[DataFrame, DataFrame]:
    """Every record once with its anchor, and the anchors (group_key, struct_id, e, xyz), at most one chunk of them a cell."""
    chunked, split = _chunked(materialise(_homed(vecs, cells), "homed"))
    thin = lambda df: df.groupBy("group_key", "cell", "chunk").applyInArrow(_anchors_of(reach, window), _MEMBER)
    members = materialise(thin(chunked), "members")
    anchors, last = members.filter("struct_id = anchor").select("group_key", "cell", "struct_id", "e", "xyz"), None
    while split and (n := anchors.count()) != last:  # a cell of dissimilar anchors can't shrink further
        chunked, split = _chunked(anchors)
        # the salt of a cell's chunks changes with their number, so anchors that were apart meet
        thinner = materialise(thin(chunked), "thinner")
        moved = thinner.select(F.col("struct_id").alias("anchor"), F.col("anchor").alias("_to"))
        members = materialise(members.join(moved, "anchor").drop("anchor").withColumnRenamed("_to", "anchor"), "members")
        anchors, last = thinner.filter("struct_id = anchor").select("group_key", "cell", "struct_id", "e", "xyz"), n
    return members, anchors.drop("cell")


def _links(kept: DataFrame, cells: Cells, reach: float, window: float) -> DataFrame:
    """Similar anchors of one cell and its neighbours: a < b, distance."""
    blocks = to_blocks(kept, cells, cell_counts(kept, cells), reach, None, 1)
    schema = T.StructType([*BLOCK_SCHEMA.fields])
    energies = kept.select("struct_id", "e")
    blocks = blocks.select(*[f.name for f in schema]).join(energies, "struct_id")

    def link(block: pa.Table) -> pa.Table:
        key, ids, e = block["group_key"][0].as_py(), block["struct_id"].to_numpy(), block["e"].to_numpy()
        x = vectors_of(block["xyz"].combine_chunks(), key)
        base = np.flatnonzero(block["is_base"].to_numpy())
        out_a, out_b, out_d = [], [], []
        for start in range(0, len(ids), 1024):
            q = np.arange(start, min(start + 1024, len(ids)))
            d2 = squared(x[q], x[base])
            hit = (d2 <= reach * reach) & (np.abs(e[q][:, None] - e[base][None]) <= window) & (ids[q][:, None] != ids[base][None])
            i, j = np.nonzero(hit)
            out_a.append(np.minimum(ids[q][i], ids[base][j]))
            out_b.append(np.maximum(ids[q][i], ids[base][j]))
            out_d.append(np.sqrt(d2[i, j]))
        a, b, d = (np.concatenate(v) for v in (out_a, out_b, out_d))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "distance": pa.array(d, pa.float64())})

    found = blocks.groupBy("group_key", "cell", "base_block", "query_block").applyInArrow(link, "a bigint, b bigint, distance double")
    return found.groupBy("a", "b").agg(F.min("distance").alias("distance"))


def _embed(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes`` (anchor, group_key, members) with the vectors after the power iteration. ``edges``: a, b, w in both directions; each anchor has a loop of weight 1."""
    for seed, v in enumerate(VECTORS):
        nodes = nodes.withColumn(v, F.pmod(F.xxhash64(F.col("anchor"), F.lit(seed)), F.lit(1_000_003)) / 1_000_003.0)
    for step in range(1, STEPS + 1):
        # only linked anchors move; the loop is added to what their links send
        sent = edges.join(nodes.select(F.col("anchor").alias("b"), "members", *VECTORS), "b").withColumn("_m", F.col("w") * F.col("members"))
        sums = sent.groupBy("a").agg(F.sum("_m").alias("_all"), *[F.sum(F.col("_m") * F.col(v)).alias(f"_{v}") for v in VECTORS])
        moved = nodes.join(sums.withColumnRenamed("a", "anchor"), "anchor", "left")
        mean = lambda v: F.when(F.col("_all").isNull(), F.col(v)).otherwise((F.col(v) * F.col("members") + F.col(f"_{v}")) / (F.col("members") + F.col("_all"))).alias(v)
        nodes = moved.select("anchor", "group_key", "members", *[mean(v) for v in VECTORS])
        if step % 4 == 0:
            nodes = materialise(nodes, "embedding")
    return nodes


def _grid(values: list[Column], near: bool) -> Column:
    """Keys of the grid cells over the embedding: the own one, or as an array also those within TOLERANCE."""

    def crossed(keys: Column, cells: Column) -> Column:
        return F.flatten(F.transform(keys, lambda k: F.transform(cells, lambda c: F.xxhash64(k, c))))

    keys = F.array(F.xxhash64("group_key"))
    for x in values:
        own = F.floor(x / GRID)
        inside = x - own * GRID
        beside = [F.when(inside < TOLERANCE, own - 1), F.when(inside > GRID - TOLERANCE, own + 1)] if near else []
        keys = crossed(keys, F.array_compact(F.array(own, *beside)))
    return keys if near else F.get(keys, F.lit(0))


def _k_means(nodes: DataFrame) -> DataFrame:
    """anchor, members, label (the cluster's smallest anchor) by k-means on the embedding alone. ``nodes``: anchor, group_key, members, VECTORS."""
    placed = nodes.withColumn("cell", _grid([F.col(v) for v in VECTORS], False))
    placed = materialise(placed.join(placed.groupBy("cell").agg(F.min("anchor").alias("label")), "cell"), "placed")
    for _ in range(20):
        mean = [(F.sum(F.col(v) * F.col("members")) / F.sum("members")).alias(f"c_{v}") for v in VECTORS]
        centres = placed.groupBy("label").agg(F.min("group_key").alias("group_key"), *mean)
        centres = centres.select(F.col("label").alias("centre"), *[f"c_{v}" for v in VECTORS], F.explode(_grid([F.col(f"c_{v}") for v in VECTORS], True)).alias("cell"))
        far = F.greatest(*[F.abs(F.col(v) - F.col(f"c_{v}")) for v in VECTORS])
        rank = F.struct(F.when(far <= TOLERANCE, 0.0).otherwise(far).alias("d"), F.col("centre"))
        best = placed.join(centres, "cell").groupBy("anchor").agg(F.min(F.when(F.col("centre").isNotNull(), rank))["centre"].alias("nearest"))
        moved = placed.join(best, "anchor", "left").withColumn("now", F.coalesce("nearest", "label")).drop("nearest")
        moved = materialise(moved, "placed")
        changed = moved.filter("now <> label").limit(1).count()
        placed = moved.drop("label").withColumnRenamed("now", "label")
        if not changed:
            break
    else:
        warnings.warn("k-means on the embedding still moved anchors after 20 rounds; the exact check follows", stacklevel=2)
    return placed.select("anchor", "members", "label")


def _apart(x: np.ndarray, e: np.ndarray, base: np.ndarray, base_e: np.ndarray, reach: float, window: float) -> np.ndarray:
    return (squared(x, base) > reach * reach + 1e-12) | (np.abs(e[:, None] - base_e[None]) > window)


def _numbers_of(ids: np.ndarray) -> np.ndarray:
    """The start of a cluster's power iteration: a number in 0 ... 1 that belongs to each struct_id."""
    return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) / float(1 << 31)


def _bin_of(v: np.ndarray) -> np.ndarray:
    return np.clip(((v + 1.0) * (CUT_BINS / 2)).astype(np.int64), 0, CUT_BINS - 1)


def two_means(bins: np.ndarray, n: np.ndarray, total: np.ndarray) -> int:
    """First bin of the upper of two groups, least sum of squares: bins (rising) with their counts and sums. -1 if there is one bin only."""
    if len(bins) < 2:
        return -1
    left_n, left = np.cumsum(n)[:-1], np.cumsum(total)[:-1]
    gain = left**2 / left_n + (total.sum() - left) ** 2 / (n.sum() - left_n)
    return int(bins[gain.argmax() + 1])


def _cut(similar: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """One of two parts of records that aren't all similar, as a mask: power iteration, trivial vector deflated, 2-means."""
    degree, v = similar.sum(1).astype(float), _numbers_of(ids)
    for _ in range(CUT_STEPS):
        v = np.concatenate([similar[a : a + 512].astype(np.float32) @ v.astype(np.float32) for a in range(0, len(v), 512)]) / degree
        v = v - degree @ v / degree.sum()
        v = v / (np.abs(v).max() or 1.0)
    at = _bin_of(v)
    bins, where = np.unique(at, return_inverse=True)
    first = two_means(bins, np.bincount(where), np.bincount(where, v))
    return at >= first if first >= 0 else ids == ids.max()


def pieces(similar: np.ndarray, ids: np.ndarray) -> list[np.ndarray]:
    """Rows of the groups of mutually similar records that the cuts end at."""
    done, open_ = [], [np.arange(len(ids))]
    while open_:
        rows = open_.pop()
        part = similar[np.ix_(rows, rows)]
        if part.all():
            done.append(rows)
        else:
            upper = _cut(part, ids[rows])
            open_ += [rows[upper], rows[~upper]]
    return done


def reunited(names: list[int], sizes: list[int], fits) -> dict[int, int]:
    """Pieces of one cluster that are wholly similar after all, the largest first (then the smaller name): each name with that of the first piece it joins."""
    groups: list[list[int]] = []
    for i in sorted(range(len(names)), key=lambda i: (-sizes[i], names[i])):
        home = next((g for g in groups if all(fits(names[i], other) for other in g)), None)
        if home is None:
            groups.append([names[i]])
        else:
            home.append(names[i])
    return {name: g[0] for g in groups for name in g}


def divide(similar: np.ndarray, ids: np.ndarray) -> list[np.ndarray]:
    """The pieces of a cluster, those that are wholly similar put together."""
    found = {int(ids[m].min()): m for m in pieces(similar, ids)}
    home = reunited(list(found), [len(m) for m in found.values()], lambda a, b: bool(similar[np.ix_(found[a], found[b])].all()))
    return [np.concatenate([found[a] for a in home if home[a] == g]) for g in dict.fromkeys(home.values())]


def _check_cluster(x: np.ndarray, e: np.ndarray, ids: np.ndarray, reach: float, window: float) -> tuple[np.ndarray, np.ndarray]:
    """Cluster id (smallest struct_id) and mean affinity of each row of a cluster of at most BLOCK records."""
    n, ok = len(ids), float(e.max() - e.min()) <= window
    affinity = np.zeros(n)
    limit = reach * reach + 1e-12
    for a in range(0, n, 1024):
        d2 = squared(x[a : a + 1024], x)
        ok = ok and bool((d2 <= limit).all())
        affinity[a : a + 1024] = np.exp(-d2 / (2.0 * reach * reach)).mean(1)
    if ok:
        return np.full(n, ids.min()), affinity
    out = np.empty(n, np.int64)
    for m in divide(~_all_apart(x, e, reach, window), ids):
        out[m] = ids[m].min()
        affinity[m] = np.concatenate([np.exp(-squared(x[m[a : a + 1024]], x[m]) / (2.0 * reach * reach)).mean(1) for a in range(0, len(m), 1024)])
    return out, affinity


def _all_apart(x: np.ndarray, e: np.ndarray, reach: float, window: float) -> np.ndarray:
    return np.concatenate([_apart(x[a : a + 1024], e[a : a + 1024], x, e, reach, window) for a in range(0, len(x), 1024)])


def _ranked(reach: float, window: float):
    def of_bucket(bucket: pa.Table) -> pa.Table:
        label, ids, e = bucket["label"].to_numpy(), bucket["struct_id"].to_numpy(), bucket["e"].to_numpy()
        key = np.array(bucket["group_key"].to_pylist(), dtype=object)
        xyz = bucket["xyz"].combine_chunks()
        order = np.argsort(label, kind="stable")
        cuts = np.flatnonzero(np.diff(label[order])) + 1
        cluster, affinity = np.empty(len(ids), np.int64), np.empty(len(ids))
        for rows in np.split(order, cuts):
            x = vectors_of(xyz.take(pa.array(rows)), key[rows[0]])
            cluster[rows], affinity[rows] = _check_cluster(x, e[rows], ids[rows], reach, window)
        return pa.table([pa.array(ids), pa.array(label), pa.array(cluster), pa.array(affinity)], schema=_RANKED_ARROW)

    return of_bucket


def _rank_small(rows: DataFrame, total: int, reach: float, window: float) -> DataFrame:
    """Clusters of at most BLOCK records, ``total`` together, checked whole in buckets of about BLOCK records."""
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("label"), F.lit(max(1, total // BLOCK))))
    return rows.select("bucket", "label", "group_key", "struct_id", "e", "xyz").groupBy("bucket").applyInArrow(_ranked(reach, window), _RANKED)


def _block_pairs(rows: DataFrame, *extra: str) -> DataFrame:
    """Each record of clusters of any size in every pair (b1 asks, b2 answers) of blocks that it has to meet; rows carry ``size``."""
    blocked = rows.withColumn("_n", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("_own", F.pmod(F.xxhash64("struct_id"), F.col("_n")).cast("int"))
    left = blocked.select("*", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("other"))
    columns = ["label", "group_key", "struct_id", "e", "xyz", *extra]
    asking = left.select(*columns, F.col("_own").alias("b1"), F.col("other").alias("b2"), F.lit(True).alias("asks"))
    return asking.unionByName(left.select(*columns, F.col("other").alias("b1"), F.col("_own").alias("b2"), F.lit(False).alias("asks")))


def _compared(rows: DataFrame, reach: float, window: float) -> DataFrame:
    """Per record of clusters of any size: sum of affinities to the members and number of members apart. Pairs of blocks, each giving sums only."""

    def compare(pair: pa.Table) -> pa.Table:
        key, ids, e, asks = pair["group_key"][0].as_py(), pair["struct_id"].to_numpy(), pair["e"].to_numpy(), pair["asks"].to_numpy()
        x = vectors_of(pair["xyz"].combine_chunks(), key)
        q, b = np.flatnonzero(asks), np.flatnonzero(~asks)
        near, apart = np.zeros(len(q)), np.zeros(len(q), np.int64)
        for a in range(0, len(q), 1024):
            at = q[a : a + 1024]
            d2 = squared(x[at], x[b])
            near[a : a + 1024] = np.exp(-d2 / (2.0 * reach * reach)).sum(1)
            apart[a : a + 1024] = ((d2 > reach * reach + 1e-12) | (np.abs(e[at][:, None] - e[b][None]) > window)).sum(1)
        return pa.table({"label": pair["label"].take(pa.array(q)), "struct_id": pa.array(ids[q]), "near": pa.array(near), "apart": pa.array(apart)})

    sums = _block_pairs(rows).groupBy("label", "b1", "b2").applyInArrow(compare, "label bigint, struct_id bigint, near double, apart bigint")
    return materialise(sums.groupBy("label", "struct_id").agg(F.sum("near").alias("near"), F.sum("apart").alias("apart")), "large")


def _halved(rows: DataFrame, reach: float, window: float) -> DataFrame:
    """``rows`` (label, group_key, struct_id, e, xyz, size) with the label of the part that each falls to: ``_cut`` by block jobs, for clusters of any size."""

    def walk(pair: pa.Table) -> pa.Table:
        key, ids, e, asks = pair["group_key"][0].as_py(), pair["struct_id"].to_numpy(), pair["e"].to_numpy(), pair["asks"].to_numpy()
        x = vectors_of(pair["xyz"].combine_chunks(), key)
        v = pair["v"].to_numpy() if pair["v"].null_count == 0 else _numbers_of(ids)
        q, b = np.flatnonzero(asks), np.flatnonzero(~asks)
        near, total = np.zeros(len(q)), np.zeros(len(q))
        for a in range(0, len(q), 1024):
            similar = ~_apart(x[q[a : a + 1024]], e[q[a : a + 1024]], x[b], e[b], reach, window)
            near[a : a + 1024], total[a : a + 1024] = similar.sum(1), similar @ v[b]
        return pa.table({"label": pair["label"].take(pa.array(q)), "struct_id": pa.array(ids[q]), "degree": pa.array(near), "total": pa.array(total)})

    state = rows.withColumn("v", F.lit(None).cast("double"))
    for _ in range(CUT_STEPS):
        sums = _block_pairs(state, "v").groupBy("label", "b1", "b2").applyInArrow(walk, "label bigint, struct_id bigint, degree double, total double")
        sums = materialise(sums.groupBy("label", "struct_id").agg(F.sum("degree").alias("degree"), F.sum("total").alias("total")), "walk")
        mean = sums.groupBy("label").agg((F.sum("total") / F.sum("degree")).alias("_mean"), F.max(F.col("total") / F.col("degree")).alias("_high"), F.min(F.col("total") / F.col("degree")).alias("_low"))
        widest = F.greatest(F.col("_high") - F.col("_mean"), F.col("_mean") - F.col("_low"))
        v = (F.col("total") / F.col("degree") - F.col("_mean")) / F.when(widest > 0, widest).otherwise(1.0)
        state = materialise(rows.join(sums.join(mean, "label").select("label", "struct_id", v.alias("v")), ["label", "struct_id"]), "walk")
    at = F.least(F.greatest(F.floor((F.col("v") + 1.0) * (CUT_BINS / 2)), F.lit(0)), F.lit(CUT_BINS - 1))
    state = state.withColumn("bin", at.cast("int"))

    def boundary(label: pa.Table) -> pa.Table:
        label = label.sort_by("bin")
        return pa.table({"label": label["label"].slice(0, 1), "first": pa.array([two_means(label["bin"].to_numpy(), label["n"].to_numpy(), label["s"].to_numpy())], pa.int32())})

    bins = state.groupBy("label", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"))  # at most CUT_BINS rows a label
    first = bins.groupBy("label").applyInArrow(boundary, "label bigint, first int")
    last = state.groupBy("label").agg(F.max("struct_id").alias("_last"))
    upper = F.when(F.col("first") >= 0, F.col("bin") >= F.col("first")).otherwise(F.col("struct_id") == F.col("_last"))
    parts = materialise(state.join(first, "label").join(last, "label").select("label", upper.alias("upper"), "group_key", "struct_id", "e", "xyz"), "parts")
    names = parts.groupBy("label", "upper").agg(F.min("struct_id").alias("_name"), F.count(F.lit(1)).alias("size"))
    return materialise(parts.join(names, ["label", "upper"]).select(F.col("_name").alias("label"), "group_key", "struct_id", "e", "xyz", "size"), "parts")


_PIECE = "struct_id bigint, piece bigint"


def _pieces_small(rows: DataFrame, reach: float, window: float) -> DataFrame:
    """struct_id, piece: clusters of at most BLOCK records cut up, each in one task."""

    def cut(cluster: pa.Table) -> pa.Table:
        x, e, ids = vectors_of(cluster["xyz"].combine_chunks(), cluster["group_key"][0].as_py()), cluster["e"].to_numpy(), cluster["struct_id"].to_numpy()
        piece = np.empty(len(ids), np.int64)
        for m in pieces(~_all_apart(x, e, reach, window), ids):
            piece[m] = ids[m].min()
        return pa.table({"struct_id": pa.array(ids), "piece": pa.array(piece)})

    return rows.select("label", "group_key", "struct_id", "e", "xyz").groupBy("label").applyInArrow(cut, _PIECE)


def _reunited(rows: DataFrame, reach: float, window: float) -> DataFrame:
    """struct_id, name: ``divide``'s last step by block jobs; rows: label, group_key, struct_id, e, xyz, size, piece."""

    def fits(pair: pa.Table) -> pa.Table:
        key, e, asks, piece = pair["group_key"][0].as_py(), pair["e"].to_numpy(), pair["asks"].to_numpy(), pair["piece"].to_numpy()
        x = vectors_of(pair["xyz"].combine_chunks(), key)
        q, b = np.flatnonzero(asks), np.flatnonzero(~asks)
        b = b[np.argsort(piece[b], kind="stable")]
        mine, inverse = np.unique(piece[q], return_inverse=True)
        theirs, starts = np.unique(piece[b], return_index=True)
        apart = np.zeros((len(mine), len(theirs)), bool)
        for a in range(0, len(q) if len(b) else 0, 1024):
            at = q[a : a + 1024]
            any_apart = np.logical_or.reduceat(_apart(x[at], e[at], x[b], e[b], reach, window), starts, axis=1)
            np.logical_or.at(apart, inverse[a : a + 1024], any_apart)
        i, j = np.indices(apart.shape)
        return pa.table({"label": pa.array(np.full(i.size, pair["label"][0].as_py())), "a": pa.array(mine[i.ravel()]), "b": pa.array(theirs[j.ravel()]), "apart": pa.array(apart.ravel())})

    pairs = _block_pairs(rows, "piece").groupBy("label", "b1", "b2").applyInArrow(fits, "label bigint, a bigint, b bigint, apart boolean")
    pairs = pairs.filter("a <> b").groupBy("label", "a", "b").agg(F.max("apart").alias("apart")).filter("not apart")
    sizes = rows.groupBy("label", "piece").agg(F.count(F.lit(1)).alias("n"))
    pairs = materialise(pairs.join(sizes.withColumnRenamed("piece", "a"), ["label", "a"]).select("label", "a", "b", "n"), "fits")

    def join(label: pa.Table) -> pa.Table:
        fit = set(zip(label["a"].to_pylist(), label["b"].to_pylist(), strict=True))
        size = dict(zip(label["a"].to_pylist(), label["n"].to_pylist(), strict=True))
        home = reunited(list(size), list(size.values()), lambda a, b: (a, b) in fit)
        return pa.table({"piece": pa.array(list(home), pa.int64()), "name": pa.array(list(home.values()), pa.int64())})

    names = pairs.groupBy("label").applyInArrow(join, "piece bigint, name bigint")  # only pieces that fit another one
    return rows.select("struct_id", "piece").join(names, "piece", "left").select("struct_id", F.coalesce("name", "piece").alias("name"))


def _rank_large(rows: DataFrame, reach: float, window: float) -> DataFrame:
    """The same as ``_check_cluster`` for clusters of more than BLOCK records, by block jobs; what the cuts leave under that is cut in one task."""

    def compared(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Ranks of those that hold, and the labels of those that don't."""
        sums = _compared(rows, reach, window)
        state = sums.groupBy("label").agg(F.sum("apart").alias("pairs_apart"), F.min("struct_id").alias("cluster_id"), F.count(F.lit(1)).alias("n"))
        sums = materialise(sums.join(state, "label").withColumn("affinity", F.col("near") / F.col("n")), "large")
        return sums.filter("pairs_apart = 0").select("struct_id", "label", "cluster_id", "affinity"), state.filter("pairs_apart > 0").select("label")

    whole, loose = compared(rows)
    if not loose.limit(1).count():
        return whole
    start = materialise(rows.join(loose, "label", "left_semi").select("label", "group_key", "struct_id", "e", "xyz", "size"), "loose")
    open_, found = start, []
    while open_.limit(1).count():
        parts = _halved(open_, reach, window)
        found.append(_pieces_small(parts.filter(f"size <= {BLOCK}"), reach, window))
        large = parts.filter(f"size > {BLOCK}")
        holds, loose = compared(large)
        found.append(holds.select("struct_id", F.col("label").alias("piece")))
        open_ = materialise(large.join(loose, "label", "left_semi"), "loose")
    named = _reunited(start.join(materialise(reduce(DataFrame.unionByName, found), "pieces"), "struct_id"), reach, window)
    sizes = named.groupBy("name").agg(F.count(F.lit(1)).alias("size"))
    named = named.join(sizes, "name").select("struct_id", F.col("name").alias("label"), "size")
    again = materialise(start.select("struct_id", "group_key", "e", "xyz").join(named, "struct_id"), "divided")
    small = again.filter(f"size <= {BLOCK}")
    return whole.unionByName(_rank_small(small, small.count(), reach, window)).unionByName(compared(again.filter(f"size > {BLOCK}"))[0])


def clusters(vecs: DataFrame, cells: Cells, reach: float = 0.4, window: float = 1.0) -> DataFrame:
    """struct_id, cluster_id (its smallest struct_id) and affinity (mean to the members, itself included)."""
    usable = vecs.filter(F.col("e").isNotNull() & ~F.isnan("e"))
    members, anchors = _anchored(usable, cells, reach, window)
    weight = F.exp(-F.col("distance") ** 2 / (2.0 * reach * reach))
    pairs = materialise(_links(anchors, cells, reach, window).select("a", "b", weight.alias("w")), "edges")
    edges = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    nodes = materialise(members.groupBy("anchor").agg(F.min("group_key").alias("group_key"), F.count(F.lit(1)).alias("members")), "nodes")
    named = _k_means(_embed(nodes, edges))
    # anchors without a link never meet: were they in one label, the check would do the embedding's work at quadratic cost
    alone, labels = nodes.join(edges.select(F.col("a").alias("anchor")), "anchor", "left_anti").count(), named.select("label").distinct().count()
    if labels < alone:
        raise RuntimeError(f"the embedding does not separate: {labels} labels for {alone} anchors that are linked to none")

    sizes = named.groupBy("label").agg(F.sum("members").alias("size"))
    named = materialise(named.select("anchor", "label").join(sizes, "label"), "named")
    rows = members.select("group_key", "struct_id", "e", "xyz", "anchor").join(named, "anchor").drop("anchor")
    single = rows.filter("size = 1").select("struct_id", "label", F.col("struct_id").alias("cluster_id"), F.lit(1.0).alias("affinity"))
    total = sizes.filter(f"size between 2 and {BLOCK}").agg(F.sum("size")).first()[0] or 0
    ranked = _rank_small(rows.filter(f"size between 2 and {BLOCK}"), int(total), reach, window)
    if sizes.filter(f"size > {BLOCK}").limit(1).count():
        ranked = ranked.unionByName(_rank_large(rows.filter(f"size > {BLOCK}"), reach, window))
    return materialise(single.unionByName(ranked).select("struct_id", "cluster_id", "affinity"), "clusters")


def described(found: DataFrame, typical: int = 3) -> DataFrame:
    """One row a cluster: size, mean affinity and its ``typical`` most typical members, the highest mean affinity first.

    The rank is cut before the shuffle (a window group limit), so a large cluster is never gathered.
    """
    order = Window.partitionBy("cluster_id").orderBy(F.round("affinity", 9).desc(), "struct_id")
    best = found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= typical)
    best = best.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "struct_id"))), lambda x: x["struct_id"]).alias("typical_ids"))
    sizes = found.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"), F.round(F.avg("affinity"), 6).alias("mean_affinity"))
    return sizes.join(best, "cluster_id")
