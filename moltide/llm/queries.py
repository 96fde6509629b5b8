"""Queries of the problems tagged llm: p1, p2, p5, p6, p7, p8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moltide.llm import grouping, harm, mixing, neighbours, packing, subset, vectors
from moltide.sources.tables import materialise, table

#: Two records are the same place of the potential if their vectors are so close (angstrom).
REACH = 0.4
WINDOW = 1.0  # and their energies so close (kcal/mol)
K = 5


def _clusters(spark: SparkSession, d: str) -> DataFrame:
    v = materialise(vectors.vectors(spark, d), "vectors")
    return grouping.clusters(v, vectors.fit_cells(v), REACH, WINDOW)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Each record of a cluster with the cluster's smallest struct_id."""
    found = _clusters(spark, d).filter("struct_id <> cluster_id")
    return found.select(F.col("cluster_id").alias("struct_id_a"), F.col("struct_id").alias("struct_id_b"))


def p1_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Each cluster with its size and most typical members."""
    return grouping.described(_clusters(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs within REACH of which one is among the other's K nearest: every complete record asks, all cells within reach answer."""
    v = materialise(vectors.vectors(spark, d), "vectors")
    return neighbours.similar_pairs(neighbours.neighbours(v, vectors.fit_cells(v), K, reach=REACH))


def p2_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The K nearest of every record whose id is divisible by 20, against all rows, at any distance."""
    v = materialise(vectors.vectors(spark, d), "vectors")
    return neighbours.neighbours(v, vectors.fit_cells(v), K, probes=8, every=20).withColumn("distance", F.round("distance", 6))


def p2_recall(spark: SparkSession, d: str) -> DataFrame:
    """Share of the true neighbours that p2_neighbours finds; the truth by brute force in blocks."""
    v = materialise(vectors.vectors(spark, d), "vectors")
    found = neighbours.neighbours(v, vectors.fit_cells(v), K, probes=8, every=20)
    return neighbours.recall(found, neighbours.exact_neighbours(v, K, every=20))


def p5_subsets(spark: SparkSession, d: str) -> DataFrame:
    """The records chosen for every row of subset_requests."""
    return subset.varied_subsets(spark, d)


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every document, or piece of one, with its container for each capacity."""
    return packing.pack(table(spark, d, "documents"), table(spark, d, "pack_capacities"))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.report(p6_containers(spark, d), table(spark, d, "pack_capacities"))


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    """Copies of every document in each mix."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(p7_mixture(spark, d), table(spark, d, "mix_targets"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Posts with abusive, hateful or sexual content."""
    return harm.harmful(harm.scores(table(spark, d, "documents"), table(spark, d, "review_labels")))


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every document's score and its likeliest sentence."""
    return harm.scores(table(spark, d, "documents"), table(spark, d, "review_labels"), "source")


def p8_by_source(spark: SparkSession, d: str) -> DataFrame:
    return harm.by_source(p8_scores(spark, d))


QUERIES = {q.__name__: q for q in (p1_found, p1_clusters, p2_found, p2_neighbours, p2_recall, p5_subsets, p6_containers, p6_report, p7_mixture, p7_shares, p8_found, p8_scores, p8_by_source)}
ORACLE: dict[str, str] = {}
