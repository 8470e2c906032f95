"""The N highest-scoring items of every group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.positions import number_rows


def top_n(items: DataFrame, groups: Sequence[str], score: str, item: str, n: int) -> DataFrame:
    """The rows of ``items`` at the first ``n`` places of their group, with ``place`` from 1: highest score first, null scores last, of equal scores the smaller item first.

    The rows are range-partitioned and sorted by group, score and item over the whole cluster, so a group of any size is spread over as many partitions as it fills; the groups' counts
    per partition, prefix-summed, turn each row's position in its partition into its exact place. No group is ever gathered in one task. Repeated rows take a place each; null groups are a
    group of their own; an empty table or n < 1 gives no rows. A column place or row_no of the input is replaced.
    """
    ranked = number_rows(items.drop("place"), groups, [F.col(score).desc_nulls_last(), F.col(item).asc_nulls_last()], first=max(0, n))
    return ranked.withColumn("place", (F.col("row_no") + 1).cast("int")).drop("row_no")
