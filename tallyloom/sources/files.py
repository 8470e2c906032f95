"""Readers and writers of CSV, Parquet, JSON and text files."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Schemas of the warehouse's CSV files.
CSV_SCHEMAS = {
    "geography": "unit_id string, unit_type string, unit_name string, parent_unit_id string, state_name string",
    "outlets": "outlet_id string, outlet_name string, se_id string, wd_id string, zone_id string, state_id string, state_name string, channel_type string, outlet_tier string, onboarded_date date, is_active boolean, closure_date date",
    "products": "sku_id string, sku_name string, franchise_name string, category_name string, pack_size string, unit_price double, launch_date date, is_active boolean",
    "visits": "visit_id string, visit_date date, se_id string, outlet_id string, visit_outcome string",
    "orders": "order_id string, line_id string, visit_id string, order_date date, outlet_id string, wd_id string, sku_id string, qty_ordered bigint, qty_delivered bigint, unit_price double",
    "inventory_snapshots": "snapshot_month date, wd_id string, sku_id string, opening_stock double, qty_received double, qty_sold double, closing_stock double, stockout_flag boolean",
}


_UNIT_KPIS = "productivity double, skus_per_transaction double, service_level double, dropsize double, inventory_turns double, inventory_days double"
_CATEGORY_KPIS = "numeric_distribution double, acv double, range_billing double"
#: Schemas of the KPI tables' CSV files; months stay text.
KPI_SCHEMAS = {
    "state_month": f"state_name string, month string, {_UNIT_KPIS}",
    "state_month_category": f"state_name string, month string, category_name string, {_CATEGORY_KPIS}, oos_pct double",
    "state_month_category_channel": f"state_name string, month string, category_name string, channel_type string, {_CATEGORY_KPIS}",
    "wd_month": f"wd_id int, month string, {_UNIT_KPIS}",
    "wd_month_category": f"wd_id int, month string, category_name string, {_CATEGORY_KPIS}, oos_pct double",
    "state_month_sku": "state_name string, month string, sku_id long, qty_ordered double, qty_delivered double, revenue double, service_level double, billed_outlets long, sku_name string, numeric_distribution double, oos_pct double",
}


def read_csv(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """A CSV table with a header, by an explicit schema; malformed cells are null."""
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", False).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_csv_tables(spark: SparkSession, folder: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """The warehouse's tables from folder/NAME.csv."""
    return {n: read_csv(spark, f"{folder}/{n}.csv", CSV_SCHEMAS[n]) for n in names or CSV_SCHEMAS}


def read_kpi_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The KPI tables that write_tables has written to folder/NAME as CSV."""
    return {n: read_csv(spark, f"{folder}/{n}", schema) for n, schema in KPI_SCHEMAS.items()}


def missing_tables(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """A critical violation for each table that the folder lacks."""
    lost = [(n,) for n in names if not read_table_if_there(spark, folder, n, "id string")[1]]
    rows = spark.createDataFrame(lost, "subject string")
    return rows.select(F.lit("missing_table").alias("check"), F.lit("critical").alias("severity"), "subject", F.lit("no such table").alias("detail"))


def write_tables(tables: Mapping[str, DataFrame], folder: str, kind: str = "parquet") -> None:
    """Each table to folder/NAME, as parquet, json or csv: one data set for each sheet of a report."""
    for name, df in tables.items():
        if kind == "csv":
            write_csv(df, f"{folder}/{name}")
        else:
            df.write.mode("overwrite").format(kind).save(f"{folder}/{name}")


def read_table_if_there(spark: SparkSession, folder: str, name: str, schema: str) -> tuple[DataFrame, bool]:
    """folder/NAME as parquet and True, or an empty table of the schema and False where there is none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.read.parquet(f"{folder}/{name}"), True
    return spark.createDataFrame([], schema), False


def write_documents(docs: DataFrame, folder: str) -> None:
    """doc_id and text as one row per document, partitioned by month, and the manifest (doc_id, state_name, month) beside them."""
    docs.write.mode("overwrite").partitionBy("month").parquet(f"{folder}/documents")
    docs.select("doc_id", "state_name", "month").write.mode("overwrite").option("header", True).csv(f"{folder}/manifest")


def read_text_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Whole text files: doc_id (file name), text, and the state and period of their head block (null without one)."""
    raw = spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("doc_id"), F.col("value").alias("text"))
    head = lambda field: F.nullif(F.regexp_extract("text", rf"(?m)^{field}:\s*(.+?)\s*$", 1), F.lit(""))
    return raw.select("doc_id", "text", head("State").alias("state_name"), head("Period").alias("period"))


def upsert(store: DataFrame, changes: DataFrame, key: str, gone: DataFrame | None = None) -> DataFrame:
    """A keyed store after changes: rows of ``changes`` replace those of the same key, and keys of ``gone`` are left out."""
    out = store.join(changes.select(key), key, "left_anti").unionByName(changes)
    return out if gone is None else out.join(gone.select(key), key, "left_anti")


def write_document_subset(docs: DataFrame, folder: str, wanted: DataFrame) -> None:
    """The documents of the wanted states and months (state_name, month) alone, without a manifest."""
    docs.join(wanted.select("state_name", "month").distinct(), ["state_name", "month"], "left_semi").write.mode("overwrite").partitionBy("month").parquet(f"{folder}/documents")


def write_text_files(docs: DataFrame, folder: str) -> None:
    """Each document as a text of its own: a folder for each doc_id that holds its text in one file, and the manifest beside them."""
    docs.select("doc_id", "text").write.mode("overwrite").option("lineSep", "\n").partitionBy("doc_id").text(f"{folder}/texts")
    docs.select("doc_id", "state_name", "month").write.mode("overwrite").option("header", True).csv(f"{folder}/manifest")


def write_preview(df: DataFrame, path: str, rows: int = 50) -> None:
    """The first rows of a table as one CSV file: a preview, whose limit is its purpose."""
    write_csv(df.limit(rows).coalesce(1), path)


def read_preview(spark: SparkSession, folder: str, name: str, rows: int = 50) -> DataFrame | None:
    """The first rows of folder/NAME, or None where there is none."""
    df, there = read_table_if_there(spark, folder, name, "id string")
    return df.limit(rows) if there else None


#: The tables of an index, and those that may be missing.
INDEX_TABLES, OPTIONAL_TABLES = ["entities", "relationships", "documents", "text_units", "communities", "community_reports"], ["covariates"]


def read_index(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of an index folder by name; a missing one raises, an optional one is just left out."""
    found = {n: read_table_if_there(spark, folder, n, "id string") for n in [*INDEX_TABLES, *OPTIONAL_TABLES]}
    if missing := [n for n in INDEX_TABLES if not found[n][1]]:
        raise FileNotFoundError(f"{folder} lacks {', '.join(missing)}")
    return {n: df for n, (df, there) in found.items() if there}


def write_violations(violations: DataFrame, path: str) -> int:
    """Violations as JSON lines; 1 if any is critical or high, else 0: the status to end with."""
    violations.write.mode("overwrite").json(path)
    return 1 if violations.where(F.col("severity").isin("critical", "high")).limit(1).count() else 0
