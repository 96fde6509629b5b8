"""Structured Streaming over arriving record files: RDF counts and arrivals per month.

Both are additive aggregates, so a stream gives the same result as a batch over the same
files. ``run_once`` processes what is there (trigger availableNow) into the shared folder,
from where the final state is read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moltide.operators import rdf
from moltide.operators.records import is_complete, sets
from moltide.sources.tables import shared_folder, table


def arriving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of ``structures`` as a stream."""
    schema = table(spark, sf_dir, "structures").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/structures.parquet*")


def run_once(stream: DataFrame, name: str) -> DataFrame:
    """Run until everything there is processed; the complete result of an aggregation, replaced whole by each batch."""
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch-{number}")
        last.append(number)

    last: list[int] = []
    query = stream.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    if not last:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{folder}/batch-{max(last)}")


def rdf_counts(spark: SparkSession, sf_dir: str, low: float, high: float, n_bins: int) -> DataFrame:
    """A stream of (n_atoms, bin, n): oxygen pairs of different fragments in each delivered complete record.

    The data sets are a static side. Deliveries are counted as they come; repeated ones count again.
    """
    static = sets(table(spark, sf_dir, "datasets")).select("dset_id", "z", "entity_ids")
    rows = arriving(spark, sf_dir).select("dset_id", "r").join(static, "dset_id").filter(is_complete(F.col("r"), F.col("z")))
    rows = rows.withColumn("n_atoms", F.size("z"))
    return rdf.histogram(rows, rdf.distances_between(F.col("r"), F.col("z"), F.col("entity_ids"), 8, 8), ["n_atoms"], low, high, n_bins)


def arrivals(spark: SparkSession, sf_dir: str, late_after: str = "30 days") -> DataFrame:
    """A stream of (month, rows, late_rows, without_energy): deliveries by the month of the record, late ones loaded more than ``late_after`` on."""
    rows = arriving(spark, sf_dir).select(F.col("created_at").cast("timestamp").alias("created_at"), F.col("loaded_at").cast("timestamp").alias("loaded_at"), "e").withWatermark("created_at", "3650 days")
    late = F.col("loaded_at") > F.col("created_at") + F.expr(f"interval {late_after}")
    return rows.groupBy(F.date_format("created_at", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.when(late, 1).otherwise(0)).alias("late_rows"), F.sum(F.when(F.col("e").isNull() | F.isnan("e"), 1).otherwise(0)).alias("without_energy")
    )
