"""Readers of the project's tables and the views every operator starts from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.keys import clean_key


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines_once(lines: DataFrame, **content: Column) -> DataFrame:
    """One row per line_id with the given content columns.

    A line may be sent several times; the row loaded last counts, and of equal ones the one with the largest content.
    A row without line_id counts as a line of its own. Only the named content travels through the shuffle.
    """
    picked = lines.select("line_id", "loaded_at", *[c.alias(n) for n, c in content.items()])
    named = (
        picked.where(F.col("line_id").isNotNull())
        .repartition("line_id")
        .groupBy("line_id")
        .agg(F.max(F.struct("loaded_at", *content)).alias("r"))
        .select("line_id", *[F.col(f"r.{n}").alias(n) for n in content])
    )
    return named.unionByName(picked.where(F.col("line_id").isNull()).select("line_id", *content))


def order_facts(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """Order lines, each once, with cleaned keys. ``names`` of: sku_id, outlet_id, order_date, qty_delivered, qty_ordered, unit_price, wd_id, order_id."""
    cleaned = {"sku_id", "outlet_id"}
    return lines_once(table(spark, sf_dir, "order_lines"), **{n: clean_key(n) if n in cleaned else F.col(n) for n in names})


def current_outlets(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """Outlets, each once by cleaned outlet_id, as in the row loaded last."""
    o = table(spark, sf_dir, "outlets").select(clean_key("outlet_id").alias("outlet_id"), "loaded_at", *names).where(F.col("outlet_id").isNotNull())
    return o.groupBy("outlet_id").agg(F.max(F.struct("loaded_at", *names)).alias("r")).select("outlet_id", *[F.col(f"r.{n}").alias(n) for n in names])
