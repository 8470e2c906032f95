"""Roll-ups, shares, pivots, rankings and period comparisons over any fact table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.positions import number_rows, running_totals
from tallyloom.session import small, written

LAKH, CRORE = 1e5, 1e7


def units_revenue(facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Delivered units in lakh and revenue in crore by any keys."""
    return facts.groupBy(*keys).agg(F.round(F.sum("qty_delivered") / LAKH, 6).alias("units_lakh"), F.round(F.sum("revenue") / CRORE, 10).alias("revenue_crore"))


def with_super_group(facts: DataFrame, column: str, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """Each row once under its own value of ``column`` and once under every super-group its value is in: one scan and one aggregation serve both levels."""
    members = [F.when(F.col(column).isin(*values), F.lit(name)) for name, values in groups.items()]
    return facts.withColumn(column, F.explode(F.array_compact(F.array(F.col(column), *members))))


def pivot_sum(facts: DataFrame, keys: Sequence[str], column: str, values: Sequence[str], value: str, scale: float = 1.0, missing: float | None = None) -> DataFrame:
    """Sums of ``value`` with a column for each of the given values of ``column``; null, or ``missing``, where there are none."""
    wide = facts.groupBy(*keys).pivot(column, list(values)).agg(F.sum(value))
    cell = lambda v: F.round(F.col(f"`{v}`") / scale, 6)
    return wide.select(*keys, *[(cell(v) if missing is None else F.coalesce(cell(v), F.lit(missing))).alias(v.lower().replace(" ", "_")) for v in values])


def with_shares(df: DataFrame, shares: Mapping[str, str], digits: int = 4) -> DataFrame:
    """``df`` with a column for each of ``shares``: the percent that the named column has of its total. ``df`` is written once; the driver gets one row of totals."""
    held = written(df, "totals")
    total = held.agg(*[F.sum(c).cast("double").alias(n) for n, c in shares.items()]).first()
    return held.withColumns({n: F.round(F.try_divide(100 * F.col(c), F.lit(total[n])), digits) for n, c in shares.items()})


def rank_fraction(df: DataFrame, group: str, score: str, item: str) -> DataFrame:
    """``rank_no`` by falling score, ties by item, and ``rank_pct``, its fraction of the group. A global sort whose partitions are numbered, so a group may be of any size."""
    ranked = number_rows(df, [group], [F.col(score).desc_nulls_last(), F.col(item)])
    sizes = df.groupBy(F.col(group).alias("_group")).agg(F.count(F.lit(1)).alias("_n"))
    held = ranked.join(small(written(sizes, "sizes")), F.col(group).eqNullSafe(F.col("_group")))
    return held.withColumn("rank_no", (F.col("row_no") + 1).cast("int")).withColumn("rank_pct", F.round(F.col("rank_no") / F.col("_n"), 6)).drop("row_no", "_group", "_n")


def tier_by_rank(fraction: Column) -> Column:
    """Gold for the first 20 %, Silver for the next 35 %, else Bronze."""
    return F.when(fraction <= 0.20, "Gold").when(fraction <= 0.55, "Silver").otherwise("Bronze")


def pareto(totals: DataFrame, item: str, value: str) -> DataFrame:
    """Running share of ``value`` in percent by falling value, against the share of items so far. Items are sorted over the whole cluster and summed chunk by chunk, so there may be any number."""
    held = written(totals.select(item, value), "totals")
    all_ = held.agg(F.sum(value).cast("double").alias("t"), F.count(F.lit(1)).alias("n")).first()
    running = running_totals(held, [], [F.col(value).desc_nulls_last(), F.col(item)], value)
    share = lambda c, of: F.round(F.try_divide(100 * c, F.lit(of).cast("double")), 6)
    return running.select(item, share(F.col("running_total"), all_["t"]).alias("running_pct"), share(F.col("row_no") + 1, all_["n"]).alias("rank_pct"))


def extremes(df: DataFrame, score: str, item: str, n: int) -> DataFrame:
    """The n rows with the highest and the n with the lowest score, each as a top-k of the sort."""
    top = df.orderBy(F.col(score).desc_nulls_last(), F.col(item)).limit(n).withColumn("side", F.lit("top"))
    low = df.where(F.col(score).isNotNull()).orderBy(F.col(score).asc(), F.col(item)).limit(n).withColumn("side", F.lit("bottom"))
    return top.unionByName(low)


def against_previous_month(df: DataFrame, keys: Sequence[str], metrics: Sequence[str], flat: float = 1e-9) -> DataFrame:
    """Long form of the metrics with the value of the calendar month before, null where that month is missing, and the direction."""
    w = Window.partitionBy(*keys).orderBy("month")
    day = F.to_date(F.concat("month", F.lit("-01")))
    follows = F.add_months(F.to_date(F.concat(F.lag("month").over(w), F.lit("-01"))), 1) == day
    seen = df.select(*keys, "month", follows.alias("_follows"), *metrics, *[F.lag(m).over(w).alias(f"_{m}") for m in metrics])
    long = seen.select(*keys, "month", "_follows", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.col(f"_{m}").alias("before")) for m in metrics])).alias("r"))
    out = long.select(*keys, "month", "r.metric", "r.value", F.when(F.col("_follows"), F.col("r.before")).alias("previous"))
    change = F.col("value") - F.col("previous")
    return out.withColumn("direction", F.when(change > flat, "up").when(change < -flat, "down").when(change.isNotNull(), "flat"))


def deviations(members: DataFrame, peers: DataFrame, on: Sequence[str], rules: Mapping[str, str], limit: float = 10.0) -> DataFrame:
    """Members whose metric is off their peer group's pooled value by more than the limit, in long form: metric, value, peer_value, gap.

    A rule is lower (bad when lower, in points of 100), higher, or both (relative, in percent). The gap is absolute; nulls aren't flagged.
    """
    packed = lambda d: F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in rules])
    ids = [c for c in members.columns if c not in rules]
    a = members.select(*ids, F.explode(packed(members)).alias("a")).select(*ids, F.col("a.metric").alias("metric"), F.col("a.value").alias("value"))
    b = peers.select(*on, F.explode(packed(peers)).alias("b")).select(*on, F.col("b.metric").alias("metric"), F.col("b.value").alias("peer_value"))
    v, p = F.col("value"), F.col("peer_value")
    gap = None
    for m, rule in rules.items():
        g = {"lower": (p - v) * 100, "higher": (v - p) * 100, "both": F.abs(F.try_divide(v - p, p) * 100)}[rule]
        gap = F.when(F.col("metric") == m, g) if gap is None else gap.when(F.col("metric") == m, g)
    return a.join(b, [*on, "metric"]).withColumn("gap", F.round(gap, 4)).where(F.col("gap") > limit)
