"""Totals kept up incrementally by Structured Streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyloom.functions.keys import clean_key
from tallyloom.session import shared_dir


def outlet_totals_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 16) -> DataFrame:
    """A stream of order-line files as running rows and units per outlet key. ``path`` is a folder of files, or one file."""
    folder, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    single = [f.rstrip("/").endswith(f"/{name}") for f in spark.read.schema(schema).parquet(path).inputFiles()] == [True]
    lines = reader.option("pathGlobFilter", name).parquet(folder) if single else reader.parquet(path)
    return lines.select(clean_key("outlet_id").alias("outlet_id"), "qty_delivered").where("outlet_id IS NOT NULL").groupBy("outlet_id").agg(F.sum("qty_delivered").alias("units"), F.count(F.lit(1)).alias("n_rows"))


def running_outlet_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files of order_lines taken in as a stream; each batch's changed totals are written to the shared folder, and the last of each outlet is read back.

    The stream keeps its state and its progress in the shared folder, so a lost executor is recovered from there.
    """
    at = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/stream-{uuid.uuid4().hex}"
    source = f"{sf_dir}/order_lines.parquet"
    schema = spark.read.parquet(source).schema

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{at}/totals")

    running = outlet_totals_stream(spark, source, schema).writeStream.outputMode("update").option("checkpointLocation", f"{at}/progress").foreachBatch(keep).trigger(availableNow=True).start()
    running.awaitTermination()
    totals = spark.read.schema("outlet_id string, units long, n_rows long, batch int").parquet(f"{at}/totals")
    return totals.groupBy("outlet_id").agg(F.max(F.struct("batch", "units", "n_rows")).alias("r")).select("outlet_id", "r.units", "r.n_rows")
