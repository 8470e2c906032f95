"""One surviving record for each group of duplicates, field by field."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How far an origin is trusted; any other origin, or none, less.
TRUST = {"review": 3, "extract": 2, "import": 1}


def trimmed(c: Column | str) -> Column:
    """Text without white space around it; null is empty."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), F.lit(""))


def trust(origin: Column | str) -> Column:
    origin = F.col(origin) if isinstance(origin, str) else origin
    rank = F.lit(0)
    for name, r in TRUST.items():
        rank = F.when(F.lower(trimmed(origin)) == name, r).otherwise(rank)
    return rank


def nulls_last(c: Column | str) -> list[Column]:
    """Sort keys of an ascending column with nulls last."""
    c = F.col(c) if isinstance(c, str) else c
    return [c.isNull(), c]


def surviving(records: DataFrame, group: str, record_id: str, fields: Mapping[str, tuple[Sequence[Column], Sequence[Column]]]) -> DataFrame:
    """One row per group of two or more distinct ids: the group, and for each field F the id and the values of the record that is best for it: F_id, F_1, F_2 ...

    ``fields`` maps a field to its sort keys, best lowest, and to the values to be taken over. Each is one minimum of a composite struct of sort keys, id and values, all of them
    in a single aggregation that is summed up before its shuffle, so a group may hold any number of records. Equal sort keys go to the lowest id. Rows without group or id are
    left out; a repeated row changes nothing; groups of one id, and empty tables, give no rows.
    """
    known = records.where(F.col(group).isNotNull() & F.col(record_id).isNotNull())
    best = []
    for name, (keys, values) in fields.items():
        parts = [*[k.alias(f"k{i}") for i, k in enumerate(keys)], F.col(record_id).alias("id"), *[v.alias(f"v{i}") for i, v in enumerate(values)]]
        best.append(F.min(F.struct(*parts)).alias(f"best_{name}"))
    held = known.groupBy(F.col(group).alias("group")).agg(F.min(record_id).alias("lo"), F.max(record_id).alias("hi"), *best).where("lo <> hi")
    return held.select("group", *[c for n, (_, values) in fields.items() for c in (F.col(f"best_{n}.id").alias(f"{n}_id"), *[F.col(f"best_{n}.v{i}").alias(f"{n}_{i + 1}") for i in range(len(values))])])


def surviving_observations(entities: DataFrame, folded: Column, with_values: bool = True) -> DataFrame:
    """The surviving record of each observation among entities: keep_id, title_id, title, description_id, description, title_key; without title and description where only the ids are wanted, so that no text is shuffled.

    keep_id has the lowest human_readable_id (nulls last); the title is the most trusted origin's, the description the longest one, trimmed; ties go to the latest loaded_at, then
    the lowest human_readable_id (nulls last), then the lowest id. Observations are entities whose type is OBSERVATION, however written; one is known by its title in ``folded`` spelling.
    """
    latest = [F.col("loaded_at").isNull(), -F.unix_micros(F.col("loaded_at").cast("timestamp")), *nulls_last("human_readable_id")]
    rows = entities.where(F.upper(trimmed("type")) == "OBSERVATION").withColumn("_key", folded)
    out = surviving(
        rows,
        "_key",
        "id",
        {
            "keep": (nulls_last("human_readable_id"), []),
            "title": ([-trust("origin"), *latest], [F.col("title")] if with_values else []),
            "description": ([-F.length(trimmed("description")), *latest], [trimmed("description")] if with_values else []),
        },
    )
    if not with_values:
        return out.select("keep_id", "title_id", "description_id", F.col("group").alias("title_key"))
    return out.select("keep_id", "title_id", F.col("title_1").alias("title"), "description_id", F.col("description_1").alias("description"), F.col("group").alias("title_key"))
