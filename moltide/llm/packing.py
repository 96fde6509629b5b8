"""Filling containers of fixed capacity with documents, by optimal length buckets.

1. Every document is sized in tokens. One longer than the capacity is cut into full
   pieces, containers of their own, and a rest; no other is cut.
2. The histogram of item lengths over all data (at most ``capacity`` numbers) goes to
   the driver, where dynamic programming sets the BUCKETS boundaries that leave the least
   unused space if a container takes floor(capacity / upper boundary) items of its bucket.
3. Items are dealt into chunks by a hash, so each chunk is a random share of all
   buckets and of bounded size. In a chunk, bucket by bucket from the longest, a batch
   takes the bucket's items as they come (doc_id, piece) up to the token budget; only
   the rest of its container is topped up with the longest items of shorter buckets
   that fit.

Defined results: null and empty texts have no tokens and still get a place (in some
container of their chunk, or one of their own if nothing else is there); repeated
texts are separate items; a null or non-positive capacity gives no rows; of several
capacities under one pack_id the least counts; empty tables give no rows.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moltide.llm.tokens import token_counts
from moltide.sources.tables import materialise

BUCKETS = 16
CHUNK_ITEMS = 20_000


def optimal_boundaries(lengths: np.ndarray, counts: np.ndarray, capacity: int, buckets: int = BUCKETS) -> list[int]:
    """Upper boundaries of at most ``buckets`` buckets of the sorted distinct ``lengths`` that leave the least unused space."""
    n = len(lengths)
    if not n:
        return []
    items = np.concatenate([[0], np.cumsum(counts)]).astype(float)
    tokens = np.concatenate([[0], np.cumsum(counts * lengths)]).astype(float)
    per_item = capacity / np.maximum(capacity // np.maximum(lengths, 1), 1)  # room that an item takes in a bucket up to this length
    best = np.full(n + 1, np.inf)
    best[0] = 0.0
    cuts = []
    for _ in range(min(buckets, n)):
        new, cut = np.full(n + 1, np.inf), np.zeros(n + 1, int)
        for j in range(1, n + 1):
            cost = best[:j] + (items[j] - items[:j]) * per_item[j - 1] - (tokens[j] - tokens[:j])
            cut[j] = cost.argmin()
            new[j] = cost[cut[j]]
        cuts.append(cut)
        best = np.concatenate([[0.0], new[1:]])
    ends, j = [], n
    for cut in reversed(cuts):
        if j == 0:
            break
        ends.append(int(lengths[j - 1]))
        j = cut[j]
    return sorted(ends)


def fill(sizes: np.ndarray, capacity: int, boundaries: list[int]) -> np.ndarray:
    """Container number of each item of a chunk: token-budget batches bucket by bucket, topped up from shorter ones."""
    place = np.full(len(sizes), -1)
    bucket = np.searchsorted(boundaries, sizes)
    free: dict[int, list[int]] = {}
    for i in range(len(sizes) - 1, -1, -1):
        free.setdefault(int(sizes[i]), []).append(i)
    lengths = sorted(free)
    number = 0
    for b in range(len(boundaries), -1, -1):
        own = np.flatnonzero((bucket == b) & (place < 0)).tolist()
        low = boundaries[b - 1] if b else -1
        del lengths[bisect_right(lengths, low) :]  # what is left are shorter buckets' items
        at = 0
        while at < len(own):
            gap = capacity
            while at < len(own) and sizes[own[at]] <= gap:
                place[own[at]] = number
                gap -= int(sizes[own[at]])
                at += 1
            while (k := bisect_right(lengths, gap) - 1) >= 0:
                place[free[lengths[k]].pop()] = number
                gap -= lengths[k]
                if not free[lengths[k]]:
                    lengths.pop(k)
            number += 1
    return place


def pack(documents: DataFrame, capacities: DataFrame) -> DataFrame:
    """pack_id, container_id, doc_id, piece (0 if uncut), first_token, n_tokens: every document in containers of each capacity."""
    sized = materialise(token_counts(documents.select("doc_id", "text")), "sizes")
    asked = [(p, c) for p, c in capacities.filter("capacity_tokens > 0 and pack_id is not null").groupBy("pack_id").agg(F.min("capacity_tokens")).collect()]  # one row a pack, a few
    if not asked:
        return sized.sparkSession.createDataFrame([], "pack_id int, container_id bigint, doc_id bigint, piece int, first_token bigint, n_tokens bigint")
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("pack_id"), F.lit(c).cast("bigint").alias("capacity")) for p, c in asked]))
    rows = sized.select("doc_id", F.col("n_tokens").alias("total"), each.alias("_c")).select("doc_id", "total", "_c.*")
    last = F.greatest(F.ceil(F.col("total") / F.col("capacity")) - 1, F.lit(0)).cast("int")
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
    first = F.col("piece") * F.col("capacity")
    rows = rows.withColumns({"first_token": first, "n_tokens": F.least(F.col("total") - first, F.col("capacity"))})
    whole = rows.filter("n_tokens = capacity")
    items = rows.filter("n_tokens < capacity")

    histogram = items.groupBy("pack_id", "capacity", "n_tokens").count().toPandas()  # at most capacity rows a pack
    if histogram.empty:
        boundaries, chunks = {}, {}
    else:
        boundaries = {p: optimal_boundaries(h.n_tokens.to_numpy(), h["count"].to_numpy(), int(h.capacity.iloc[0])) for p, h in histogram.sort_values("n_tokens").groupby("pack_id")}
        chunks = {p: -(-int(h["count"].sum()) // CHUNK_ITEMS) for p, h in histogram.groupby("pack_id")}

    def fill_chunk(chunk: pa.Table) -> pa.Table:
        order = np.lexsort((chunk["piece"].to_numpy(), chunk["doc_id"].to_numpy()))
        chunk = chunk.take(pa.array(order))
        p, c, number = chunk["pack_id"][0].as_py(), chunk["capacity"][0].as_py(), chunk["chunk"][0].as_py()
        place = fill(chunk["n_tokens"].to_numpy(), c, boundaries[p])
        container = (np.int64(number) << np.int64(32)) + place
        return pa.table([chunk["pack_id"], pa.array(container, pa.int64()), *(chunk[x] for x in ("doc_id", "piece", "first_token", "n_tokens"))], names=["pack_id", "container_id", "doc_id", "piece", "first_token", "n_tokens"])

    schema = "pack_id int, container_id bigint, doc_id bigint, piece int, first_token bigint, n_tokens bigint"
    many = F.coalesce(F.create_map(*[F.lit(int(x)) for pair in chunks.items() for x in pair])[F.col("pack_id").cast("int")], F.lit(1)) if chunks else F.lit(1)
    items = items.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "piece"), many).cast("int")).withColumn("pack_id", F.col("pack_id").cast("int"))
    packed = items.select("pack_id", "capacity", "chunk", "doc_id", "piece", "first_token", "n_tokens").groupBy("pack_id", "chunk").applyInArrow(fill_chunk, schema)
    # a full piece is a container of its own: a negative number that holds the document (up to 2^43) and the piece (up to 2^20)
    own = -F.shiftleft(F.col("doc_id"), 20).bitwiseOR(F.col("piece").cast("bigint")) - 1
    return packed.unionByName(whole.select(F.col("pack_id").cast("int").alias("pack_id"), own.alias("container_id"), "doc_id", "piece", "first_token", "n_tokens"))


def report(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """Per pack: containers, tokens, share of the space that is used, and the fewest containers that could do."""
    held = packed.groupBy("pack_id").agg(F.countDistinct("container_id").alias("containers"), F.sum("n_tokens").alias("tokens"))
    held = held.join(capacities.filter("capacity_tokens > 0").groupBy(F.col("pack_id").cast("int").alias("pack_id")).agg(F.min("capacity_tokens").alias("capacity_tokens")), "pack_id")
    return held.select("pack_id", "capacity_tokens", "containers", "tokens", F.round(F.col("tokens") / F.col("containers") / F.col("capacity_tokens"), 6).alias("used_share"), F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("fewest"))
