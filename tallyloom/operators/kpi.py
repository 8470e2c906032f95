"""KPIs at any grain: every function takes the grain as a list of key columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.sources.warehouse import Warehouse

#: Weights of outlet tiers, days of a month.
TIER_WEIGHTS = {"Gold": 3, "Silver": 2, "Bronze": 1}
DAYS_IN_MONTH = 30


def ratio(a: Column, b: Column, digits: int = 6) -> Column:
    """a / b, null where b is 0, rounded for comparison."""
    return F.round(F.try_divide(a.cast("double"), b.cast("double")), digits)


def outer(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Full outer join of measures at one grain."""
    return reduce(lambda a, b: a.join(b, list(keys), "full_outer"), frames)


def productivity(w: Warehouse, keys: Sequence[str]) -> DataFrame:
    """Share of visits with an order."""
    return w.visits.groupBy(*keys).agg(ratio(F.count_if(F.col("visit_outcome") == "Order Placed"), F.count(F.lit(1))).alias("productivity"))


def order_level(w: Warehouse, keys: Sequence[str]) -> DataFrame:
    """Lines per order, and delivered over ordered quantity."""
    return w.order_lines.groupBy(*keys).agg(
        ratio(F.count(F.lit(1)), F.countDistinct("order_id")).alias("skus_per_transaction"), ratio(F.sum("qty_delivered"), F.sum("qty_ordered")).alias("service_level")
    )


def dropsize(w: Warehouse, keys: Sequence[str]) -> DataFrame:
    """Ordered quantity per productive visit; a group of either side alone is kept."""
    ordered = w.order_lines.groupBy(*keys).agg(F.sum("qty_ordered").alias("o"))
    productive = w.visits.where("visit_outcome = 'Order Placed'").groupBy(*keys).agg(F.count(F.lit(1)).alias("v"))
    return outer([ordered, productive], keys).select(*keys, ratio(F.col("o"), F.col("v")).alias("dropsize"))


def inventory_kpis(w: Warehouse, keys: Sequence[str]) -> DataFrame:
    """Turns: sold over mean stock; days: DAYS_IN_MONTH over turns."""
    turns = w.inventory.groupBy(*keys).agg(F.sum("qty_sold").alias("s"), F.sum((F.col("opening_stock") + F.col("closing_stock")) / 2).alias("m"))
    exact = F.try_divide(F.col("s"), F.col("m"))
    return turns.select(*keys, F.round(exact, 6).alias("inventory_turns"), F.round(F.try_divide(F.lit(float(DAYS_IN_MONTH)), exact), 6).alias("inventory_days"))


def oos(w: Warehouse, keys: Sequence[str]) -> DataFrame:
    """Share of stock snapshots that are out of stock."""
    return w.inventory.groupBy(*keys).agg(ratio(F.count_if("stockout"), F.count(F.lit(1))).alias("oos_pct"))


def _weight() -> Column:
    return reduce(lambda c, kv: F.when(F.col("outlet_tier") == kv[0], kv[1]).otherwise(c), TIER_WEIGHTS.items(), F.lit(None).cast("int"))


def active_outlets(w: Warehouse, keys: Sequence[str]) -> DataFrame:
    """Active outlets and their tier weights; the population that distribution is measured against."""
    return w.outlets.where("is_active").groupBy(*keys).agg(F.count(F.lit(1)).alias("outlets"), F.sum(_weight()).alias("weights"))


def distribution(w: Warehouse, keys: Sequence[str]) -> DataFrame:
    """Outlets billed in the category over active outlets: counted (numeric_distribution) and by tier weight (acv)."""
    unit = [k for k in keys if k not in ("month", "category_name")]
    billed = w.facts.select(*keys, "outlet_id", "outlet_tier").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("b"), F.sum(_weight()).alias("bw"))
    of = active_outlets(w, unit)
    return billed.join(of, unit, "left").select(*keys, ratio(F.col("b"), F.col("outlets")).alias("numeric_distribution"), ratio(F.col("bw"), F.col("weights")).alias("acv"))


def range_billing(w: Warehouse, keys: Sequence[str]) -> DataFrame:
    """Mean over billed outlets of the share of the category's SKUs that the outlet bought."""
    size = w.products.groupBy("category_name").agg(F.count(F.lit(1)).alias("size"))
    per_outlet = w.facts.groupBy(*keys, "outlet_id").agg(F.countDistinct("sku_id").alias("n"))
    return per_outlet.join(size, "category_name", "left").groupBy(*keys).agg(F.round(F.avg(F.col("n") / F.col("size")), 6).alias("range_billing"))


def unit_table(w: Warehouse, keys: Sequence[str]) -> DataFrame:
    """The six KPIs that need no category: one aggregation of each fact table, then one outer join."""
    visits = w.visits.groupBy(*keys).agg(F.count(F.lit(1)).alias("visits"), F.count_if(F.col("visit_outcome") == "Order Placed").alias("productive"))
    lines = w.order_lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("lines"), F.countDistinct("order_id").alias("orders"), F.sum("qty_ordered").alias("o"), F.sum("qty_delivered").alias("d"))
    c = F.col
    return outer([visits, lines, inventory_kpis(w, keys)], keys).select(
        *keys,
        ratio(c("productive"), c("visits")).alias("productivity"),
        ratio(c("lines"), c("orders")).alias("skus_per_transaction"),
        ratio(c("d"), c("o")).alias("service_level"),
        ratio(c("o"), c("productive")).alias("dropsize"),
        "inventory_turns",
        "inventory_days",
    )


def category_table(w: Warehouse, keys: Sequence[str], with_oos: bool = True) -> DataFrame:
    """The KPIs by category: what each outlet bought is aggregated once for distribution and range."""
    unit = [k for k in keys if k not in ("month", "category_name")]
    size = w.products.groupBy("category_name").agg(F.count(F.lit(1)).alias("size"))
    per_outlet = w.facts.groupBy(*keys, "outlet_id", "outlet_tier").agg(F.countDistinct("sku_id").alias("n"))
    billed = per_outlet.join(size, "category_name", "left").groupBy(*keys).agg(F.count(F.lit(1)).alias("b"), F.sum(_weight()).alias("bw"), F.round(F.avg(F.col("n") / F.col("size")), 6).alias("range_billing"))
    measured = billed.join(active_outlets(w, unit), unit, "left").select(*keys, ratio(F.col("b"), F.col("outlets")).alias("numeric_distribution"), ratio(F.col("bw"), F.col("weights")).alias("acv"), "range_billing")
    return outer([measured, oos(w, keys)], keys) if with_oos else measured


def sku_sales(w: Warehouse, keys: Sequence[str]) -> DataFrame:
    """Quantities, revenue, service level and billed outlets."""
    return w.facts.groupBy(*keys).agg(
        F.sum("qty_ordered").alias("qty_ordered"),
        F.sum("qty_delivered").alias("qty_delivered"),
        F.round(F.sum("revenue"), 4).alias("revenue"),
        ratio(F.sum("qty_delivered"), F.sum("qty_ordered")).alias("service_level"),
        F.countDistinct("outlet_id").alias("billed_outlets"),
    )


def sku_table(w: Warehouse) -> DataFrame:
    """SKU sales by state and month with distribution and out-of-stock rate; rows of either side alone are kept, without names where nothing was sold."""
    keys = ["state_name", "month", "sku_id"]
    sales = sku_sales(w, keys).join(active_outlets(w, ["state_name"]).drop("weights"), "state_name", "left").join(w.products.select("sku_id", "sku_name"), "sku_id", "left")
    sales = sales.withColumn("numeric_distribution", ratio(F.col("billed_outlets"), F.col("outlets"))).drop("outlets")
    return outer([sales, oos(w, keys)], keys)


def all_tables(w: Warehouse) -> dict[str, DataFrame]:
    """The six KPI tables: by state and by distributor, each also with category, the first also with channel, and by SKU."""
    state, wd = ["state_name", "month"], ["wd_id", "month"]
    return {
        "state_month": unit_table(w, state),
        "state_month_category": category_table(w, [*state, "category_name"]),
        "state_month_category_channel": category_table(w, [*state, "category_name", "channel_type"], False),
        "wd_month": unit_table(w, wd),
        "wd_month_category": category_table(w, [*wd, "category_name"]),
        "state_month_sku": sku_table(w),
    }
