"""Reading the parquet tables and cutting lineage in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors share: ``spark.checkpoint.dir``; where that is unset (tests), a folder of this session."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialise(df: DataFrame, what: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def first_delivery(df: DataFrame, key: str, order: str = "loaded_at") -> DataFrame:
    """Keep the first delivered row of each key (null ``order`` last). Use on narrow projections: it shuffles by key."""
    w = Window.partitionBy(key).orderBy(F.col(order).asc_nulls_last())
    return df.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth")


#: A dimension of at most so many rows (of a few numbers each, some 20 MB) may be broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 200_000


def join_dimension(facts: DataFrame, dimension: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """Join a materialised dimension table, broadcast only after its row count was checked."""
    small = dimension.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return facts.join(F.broadcast(dimension) if small else dimension.hint("merge"), on, how)


#: A table of fewer bytes is dealt out over the cores before row-wise work: it may lie in one piece, and the shuffle costs next to nothing.
SPREAD_BYTES = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many partitions as the session has cores if it is small; larger tables stay as they lie, so nothing of them is shuffled."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size < SPREAD_BYTES else df
