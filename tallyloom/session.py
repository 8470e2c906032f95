"""The shared folder of a session, tables written there, and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most bytes that any operator broadcasts.
BROADCAST_BYTES = 24 << 20

_own_folder: dict[str, str] = {}
_kept: dict[tuple[str, ...], tuple[str, DataFrame]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a temporary one, but only on a local master; a cluster must name its folder."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        _own_folder[app] = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
    return f"file://{_own_folder[app]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: its lineage ends there, and every later pass sees the same rows."""
    return _written_to(df, name)[1]


def _written_to(df: DataFrame, name: str) -> tuple[str, DataFrame]:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path, spark.read.schema(df.schema).parquet(path)


def written_once(spark: SparkSession, name: str, sf_dir: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A derived table of a data folder that several queries read, written at its first use in an application and read by the later ones, as long as it is there."""
    key = (spark.sparkContext.applicationId, name, sf_dir)
    if key not in _kept or not _hadoop_path(spark, _kept[key][0])[1]:
        _kept[key] = _written_to(make(), name)
    return _kept[key][1]


def _hadoop_path(spark: SparkSession, name: str) -> tuple:
    """A path with its file system, and whether it exists."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return (path, files), files.exists(path)


def _bytes_of(field: T.StructField) -> Column:
    """What a value takes in a row: its text's bytes, or those of its JSON for nested values, and a word."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 8
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) + 8
    return F.lit(8)


def measured(df: DataFrame) -> int:
    """Bytes that the rows of ``df`` take, 16 a row and what their values take; one aggregation."""
    row = F.lit(16).cast("long")
    for field in df.schema.fields:
        row = row + _bytes_of(field)
    return df.agg(F.coalesce(F.sum(row), F.lit(0))).first()[0]


def small(df: DataFrame, limit: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint if its rows, measured, stay under ``limit``; else as it is, for a shuffled join.

    ``df`` should be cheap to read, such as a written table.
    """
    return F.broadcast(df) if measured(df) <= (BROADCAST_BYTES if limit is None else limit) else df


#: Rows of one key that one task of a shuffled join may meet.
KEY_ROWS = 1_000_000


def looked_up(rows: DataFrame, table: DataFrame, on: Sequence[str], how: str = "inner", key_rows: int | None = None) -> DataFrame:
    """``rows`` joined (inner or left) with a written ``table`` that has each key ``on`` at most once, however often rows have it.

    A small table is broadcast. Else both are shuffled, but the few keys with over ``key_rows`` rows (of which there are at most all rows / key_rows) are met in as many places as they need: rows are dealt to them
    by a hash, and the table's row is copied to each.
    """
    few = small(table)
    if few is not table:
        return rows.join(few, list(on), how)
    most = key_rows or KEY_ROWS
    counts = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > most)
    hot = written(counts.select(*on, F.ceil(F.col("__n") / most).cast("int").alias("__copies")), "hot")
    one = F.coalesce("__copies", F.lit(1))
    salted = rows.join(small(hot), list(on), "left").withColumn("__salt", F.pmod(F.xxhash64(*rows.columns), one.cast("long")).cast("int")).drop("__copies")
    copied = table.join(small(hot), list(on), "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), one - 1))).drop("__copies")
    return salted.join(copied, [*on, "__salt"], how).drop("__salt")


def release(spark: SparkSession) -> None:
    """Deletes the tables that this application has written to the shared folder; results that still read them can't be used any more."""
    _kept.clear()
    (path, files), there = _hadoop_path(spark, f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")
    if there:
        files.delete(path, True)
