"""Exact row numbers, equal-sized chunks and ordered merging for keys of any size.

The rows of one key may be a third of all rows. Nothing here groups rows by key alone: rows are counted per partition and key,
the counts are prefix-summed to offsets, each row gets its exact number from its partition's offset, and the work is then done on
chunks of equally many rows whose states are merged in order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.session import BROADCAST_BYTES, measured, written

#: Rows of a chunk, however many rows there are: 10^12 rows of one key make 2 x 10^7 chunk states of a few bytes each, the most that one task sorts.
CHUNK_ROWS = 50_000


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column] = (), first: int | None = None) -> DataFrame:
    """As ``numbered``, without the count of the rows."""
    return numbered(df, keys, order, first)[0]


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column] = (), first: int | None = None) -> tuple[DataFrame, int]:
    """``df`` with ``row_no``, the row's number from 0 within its keys, and the number of all its rows.

    With ``order`` the rows are range-partitioned and sorted by keys and order over the whole cluster, so that a large key is spread
    over many partitions, and the numbers follow that order (which should be total; equal rows are numbered in any order). Without it they
    stay in their partitions and are numbered partition by partition. The partitions are written once to the shared folder with each row's
    position, since later passes must see the same ones. With ``first`` only rows numbered under it come out.

    Null keys form a group of their own; an empty input gives no rows. A column row_no of the input is replaced.
    """
    df = df.drop("row_no")
    by = [F.col(k).asc_nulls_first() for k in keys]
    # The last range key tells equal rows apart, so that any number of them can be spread.
    spread = df.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*by, *order, "__tie") if order else df
    laid = spread.sortWithinPartitions(*by, *order).select(*df.columns)
    at = F.monotonically_increasing_id()  # the partition above 33 bits of position
    rows = written(laid.select("*", F.shiftright(at, 33).cast("int").alias("__part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("__pos")), "rows")
    runs = written(rows.groupBy(*keys, "__part").agg(F.min("__pos").alias("__start"), F.count(F.lit(1)).alias("__n")), "runs")
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__part").alias("__p"), (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__start")).alias("__shift"))
    offsets = F.broadcast(offsets) if measured(runs) <= BROADCAST_BYTES else offsets
    same = F.col("__part") == F.col("__p")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"__k{i}"))
    out = rows.join(offsets, same).withColumn("row_no", F.col("__shift") + F.col("__pos")).select(*df.columns, "row_no")
    return (out if first is None else out.where(F.col("row_no") < first)), runs.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]


def chunked(df: DataFrame, keys: Sequence[str], order: Sequence[Column] = (), chunk_rows: int | None = None) -> tuple[DataFrame, int]:
    """Numbered rows with ``chunk_no``: chunk_rows rows of a key share one; and the number of all rows."""
    rows, n = numbered(df, keys, order)
    return rows.withColumn("chunk_no", F.floor(F.col("row_no") / (chunk_rows or CHUNK_ROWS))), n


def key_totals(df: DataFrame, keys: Sequence[str], value: str, chunk_rows: int | None = None) -> DataFrame:
    """Per key: n_rows and the total of ``value`` (nulls add nothing; 0 if all are null), by exact offset chunking."""
    return counted_totals(df, keys, value, chunk_rows)[0]


def counted_totals(df: DataFrame, keys: Sequence[str], value: str, chunk_rows: int | None = None) -> tuple[DataFrame, int]:
    """As ``key_totals``, with the number of all rows, which the numbering knows."""
    chunks, n = chunked(df.select(*keys, value), keys, (), chunk_rows)
    states = chunks.groupBy(*keys, "chunk_no").agg(F.count(F.lit(1)).alias("__n"), F.sum(value).alias("__t"))
    return states.groupBy(*keys).agg(F.sum("__n").alias("n_rows"), F.coalesce(F.sum("__t"), F.lit(0)).alias("total")), n


def running_totals(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, chunk_rows: int | None = None) -> DataFrame:
    """Every row of ``df`` with ``running_total`` of ``value`` over its key up to and including it in ``order``, and row_no.

    Each chunk is summed by itself; the chunks' totals, prefix-summed in order, are what a chunk starts from. Nulls add nothing.
    """
    rows, _ = chunked(df, keys, order, chunk_rows)
    states = rows.groupBy(*keys, "chunk_no").agg(F.sum(F.coalesce(F.col(value), F.lit(0))).alias("__t"))
    before = Window.partitionBy(*keys).orderBy("chunk_no").rowsBetween(Window.unboundedPreceding, -1)
    base = states.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("chunk_no").alias("__c"), F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__base"))
    same = F.col("chunk_no") == F.col("__c")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"__k{i}"))
    inside = Window.partitionBy(*keys, "chunk_no").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("__in", F.sum(F.coalesce(F.col(value), F.lit(0))).over(inside))
    return summed.join(base, same).select(*df.columns, "row_no", (F.col("__base") + F.col("__in")).alias("running_total"))
