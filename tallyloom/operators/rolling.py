"""Totals and averages over trailing periods for every entity and day."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import date, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def trailing_sums(days: np.ndarray, width: int) -> np.ndarray:
    """Sums over the ``width`` columns ending at each column of ``days`` (rows: entities, columns: days; before the first all is 0).

    The days are cut into blocks of ``width``. A trailing period is the tail of one block and the head of the next, so its total is one
    suffix sum plus one prefix sum, whatever the width.
    """
    n, d = days.shape
    blocks = -(-d // width)
    cut = np.zeros((n, blocks, width), days.dtype)
    cut.reshape(n, -1)[:, :d] = days
    head = cut.cumsum(axis=2).reshape(n, -1)[:, :d]
    tail = cut[:, :, ::-1].cumsum(axis=2)[:, :, ::-1].reshape(n, -1)
    out = head.copy()
    start = np.arange(d) - width + 1
    inner = (start > 0) & (start % width != 0)
    out[:, inner] += tail[:, start[inner]]
    return out


def rolling_totals(events: DataFrame, entities: DataFrame, entity: str, day: str, value: str, start: date, end: date, windows: Sequence[int] = (7, 30), report_days: Sequence[date] | None = None) -> DataFrame:
    """Per entity of ``entities`` and day from ``start`` to ``end``: total_W and avg_W of ``value`` over the W days ending that day, for each W.

    Days without events count as 0, and events before ``start`` count where a period reaches them. Null entities, days and values add nothing; events of unknown
    entities don't count. An average divides by W. Values are whole numbers. ``report_days`` restricts the rows to some days of the period; totals are still over all events.
    Events are first summed per entity and day, so that an entity brings at most one value a day into its row, however many events it has.
    Repeated entities count once; no entities give no rows.
    """
    lead = max(windows) - 1
    first, n = start - timedelta(days=lead), (end - start).days + 1 + lead
    wanted = range(lead, n) if report_days is None else {(d - first).days for d in report_days}
    at = sorted(i for i in wanted if lead <= i < n)
    per_day = (
        events.where(F.col(entity).isNotNull() & F.col(value).isNotNull() & F.col(day).between(F.lit(first), F.lit(end)))
        .groupBy(F.col(entity).alias("entity"), F.datediff(F.col(day), F.lit(first)).alias("d"))
        .agg(F.sum(value).cast("bigint").alias("v"))
    )
    known = entities.select(F.col(entity).alias("entity")).where(F.col("entity").isNotNull())
    rows = known.select("entity", F.lit(None).cast("int").alias("d"), F.lit(None).cast("bigint").alias("v")).unionByName(per_day)
    per_entity = rows.groupBy("entity").agg(
        F.count_if(F.col("d").isNull()).alias("known"),
        F.collect_list(F.when(F.col("d").isNotNull(), F.struct("d", "v"))).alias("s"),
    ).where("known > 0").select("entity", F.col("s.d").alias("d"), F.col("s.v").alias("v"))

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                batch = whole.slice(lo, 1024)
                ds, vs = batch.column(1), batch.column(2)
                grid = np.zeros((batch.num_rows, n), np.int64)
                row = np.repeat(np.arange(batch.num_rows), np.diff(ds.offsets.to_numpy()))
                grid[row, ds.flatten().to_numpy(zero_copy_only=False)] = vs.flatten().to_numpy(zero_copy_only=False)
                cols: list[pa.Array] = [batch.column(0)]
                edges = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(at))
                for w in windows:
                    cols.append(pa.ListArray.from_arrays(edges, pa.array(trailing_sums(grid, w)[:, at].reshape(-1))))
                yield pa.RecordBatch.from_arrays(cols, names=["entity", *[f"t{w}" for w in windows]])

    kind = events.schema[entity].dataType.simpleString()
    sums = per_entity.mapInArrow(totals, ", ".join([f"entity {kind}", *[f"t{w} array<bigint>" for w in windows]]))
    offsets = F.array(*map(F.lit, at)).cast("array<int>")
    long = sums.select("entity", F.explode(F.arrays_zip(offsets.alias("i"), *[F.col(f"t{w}") for w in windows])).alias("r"))
    return long.select(
        F.col("entity").alias(entity),
        F.date_add(F.lit(first), F.col("r.i")).alias("day"),
        *[c for w in windows for c in (F.col(f"r.t{w}").alias(f"total_{w}"), (F.col(f"r.t{w}") / F.lit(float(w))).alias(f"avg_{w}"))],
    )
