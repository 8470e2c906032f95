"""One row per entity with counts, recency and totals for each event type."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import date

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyloom.session import written

#: An entity with more than this share of all events is heavy; there can't be more than 1 / HEAVY_SHARE of them.
HEAVY_SHARE = 0.001
#: Most types of a feature table.
MOST_KINDS = 5_000
#: Days since the latest event of an entity without one.
NEVER = 2**31 - 1


def heavy_entities(events: DataFrame, entity: str) -> DataFrame:
    """The entities with more than HEAVY_SHARE of the events; at most 1 / HEAVY_SHARE rows, one column ``_heavy``."""
    counts = written(events.where(F.col(entity).isNotNull()).groupBy(entity).agg(F.count(F.lit(1)).alias("c")), "counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    return counts.where(F.col("c") > HEAVY_SHARE * total).select(F.col(entity).alias("_heavy"))


def feature_table(
    events: DataFrame, entities: DataFrame, kinds: Sequence[str], entity: str, kind: str, day: str, value: str, spread: str, as_of: date, heavy: DataFrame | None = None, salts: int = 32
) -> DataFrame:
    """One row per entity (of ``entities`` or of the events) with n, days and total over all events, and n_KIND, days_KIND and total_KIND for each of ``kinds``.

    n counts events, days is ``as_of`` minus the latest day (null without one), total sums the whole-number ``value`` (nulls add nothing). ``kinds`` is the
    complete, bounded list of types: each gets its columns, with 0 where there are no events. Events of other types, or of none, count only over all. Null
    entities are left out; repeated entities count once.

    Two stages: the events of heavy entities are spread over ``salts`` groups by a hash of the column ``spread`` and summed there; then the partial statistics are merged
    per entity, of which one can have at most types x salts, while the complete type list is laid out. ``heavy`` gives the heavy entities where they can be had more cheaply than from the events.
    """
    kinds = list(kinds)
    if len(kinds) > MOST_KINDS:
        raise ValueError(f"more than {MOST_KINDS} types")
    width = len(kinds) + 1  # the last place is for events of no listed type
    spark = events.sparkSession
    listed = spark.createDataFrame([(k, i) for i, k in enumerate(kinds)], "_kind string, _no int")
    heavy = heavy_entities(events, entity) if heavy is None else heavy
    salted = (
        events.where(F.col(entity).isNotNull())
        .select(F.col(entity).alias("_entity"), F.col(kind).alias("_kind"), F.datediff(F.lit(as_of), F.col(day)).alias("_ago"), F.col(value).alias("_value"), F.col(spread).alias("_spread"))
        .join(F.broadcast(listed), "_kind", "left")
        .join(F.broadcast(heavy), F.col("_entity") == F.col("_heavy"), "left")
        .withColumn("_salt", F.when(F.col("_heavy").isNotNull(), F.pmod(F.xxhash64("_spread"), F.lit(salts))).otherwise(F.lit(0)))
    )
    partial = salted.groupBy("_entity", F.coalesce("_no", F.lit(width - 1)).alias("k"), "_salt").agg(
        F.count(F.lit(1)).alias("n"), F.min("_ago").alias("d"), F.coalesce(F.sum("_value"), F.lit(0)).cast("bigint").alias("t")
    )
    known = entities.select(F.col(entity).alias("_entity")).where(F.col("_entity").isNotNull()).distinct()
    bare = known.select("_entity", F.lit(width - 1).alias("k"), F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("int").alias("d"), F.lit(0).cast("bigint").alias("t"))
    held = partial.drop("_salt").unionByName(bare).groupBy("_entity").agg(F.collect_list(F.struct("k", "n", F.coalesce("d", F.lit(NEVER)).alias("d"), "t")).alias("s"))

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                batch = whole.slice(lo, 1024)
                k, n, d, t = (batch.column(i) for i in range(1, 5))
                row = np.repeat(np.arange(batch.num_rows), np.diff(k.offsets.to_numpy()))
                at = (k.flatten().to_numpy(), row)
                counts, sums = np.zeros((width, batch.num_rows), np.int64), np.zeros((width, batch.num_rows), np.int64)
                ago = np.full((width, batch.num_rows), NEVER, np.int32)
                np.add.at(counts, at, n.flatten().to_numpy())
                np.add.at(sums, at, t.flatten().to_numpy())
                np.minimum.at(ago, at, d.flatten().to_numpy())
                days = lambda x: pa.array(x, mask=x == NEVER)
                cols = [batch.column(0), pa.array(counts.sum(axis=0)), days(ago.min(axis=0)), pa.array(sums.sum(axis=0))]
                for i in range(width - 1):
                    cols += [pa.array(counts[i]), days(ago[i]), pa.array(sums[i])]
                yield pa.RecordBatch.from_arrays(cols, schema=layout)

    names = [entity, "n", "days", "total", *[f"{what}_{k}" for k in kinds for what in ("n", "days", "total")]]
    types = [T.LongType(), T.IntegerType(), T.LongType()]
    schema = T.StructType([T.StructField(x, events.schema[entity].dataType if i == 0 else types[(i - 1) % 3]) for i, x in enumerate(names)])
    layout = to_arrow_schema(schema)
    return held.select("_entity", "s.k", "s.n", "s.d", "s.t").mapInArrow(expand, schema)
