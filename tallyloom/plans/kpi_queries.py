"""KPI queries at state, distributor, category, channel and SKU grain, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import kpi
from tallyloom.sources.warehouse import WAREHOUSE_SQL, Warehouse

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

STATE, WD = ["state_name", "month"], ["wd_id", "month"]
STATE_CATEGORY, WD_CATEGORY, CHANNEL = [*STATE, "category_name"], [*WD, "category_name"], [*STATE, "category_name", "channel_type"]


def _ratio(a: str, b: str) -> str:
    return f"round(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), 6)"


_WEIGHT = "CASE outlet_tier WHEN 'Gold' THEN 3 WHEN 'Silver' THEN 2 ELSE 1 END"


def _productivity(k: str) -> str:
    return f"SELECT {k}, {_ratio('count(*) FILTER (visit_outcome = $$Order Placed$$)', 'count(*)')} AS productivity FROM sd_visits GROUP BY {k}"


def _order_level(k: str) -> str:
    return f"SELECT {k}, {_ratio('count(*)', 'count(DISTINCT order_id)')} AS skus_per_transaction, {_ratio('sum(qty_delivered)', 'sum(qty_ordered)')} AS service_level FROM facts GROUP BY {k}"


def _dropsize(k: str) -> str:
    return f"""SELECT {k}, {_ratio('o', 'v')} AS dropsize FROM (SELECT {k}, sum(qty_ordered) AS o FROM facts GROUP BY {k}) a
FULL JOIN (SELECT {k}, count(*) AS v FROM sd_visits WHERE visit_outcome = 'Order Placed' GROUP BY {k}) b USING ({k})"""


def _inventory(k: str) -> str:
    return f"SELECT {k}, round(s / nullif(m, 0), 6) AS inventory_turns, round(30 / nullif(s / nullif(m, 0), 0), 6) AS inventory_days FROM (SELECT {k}, sum(qty_sold) AS s, sum((opening_stock + closing_stock) / 2) AS m FROM sd_inventory GROUP BY {k}) i"


def _oos(k: str) -> str:
    return f"SELECT {k}, {_ratio('count(*) FILTER (stockout)', 'count(*)')} AS oos_pct FROM sd_inventory GROUP BY {k}"


def _active(k: str) -> str:
    return f"SELECT {k}, count(*) AS outlets, CAST(sum({_WEIGHT}) AS BIGINT) AS weights FROM sd_outlets WHERE is_active GROUP BY {k}"


def _distribution(k: str) -> str:
    unit = ", ".join(x for x in k.split(", ") if x not in ("month", "category_name"))
    return f"""SELECT {k}, {_ratio('b', 'outlets')} AS numeric_distribution, {_ratio('bw', 'weights')} AS acv FROM (
  SELECT {k}, count(*) AS b, sum({_WEIGHT}) AS bw FROM (SELECT DISTINCT {k}, outlet_id, outlet_tier FROM facts) d GROUP BY {k}) x LEFT JOIN ({_active(unit)}) y USING ({unit})"""


def _range(k: str) -> str:
    return f"""SELECT {k}, round(avg(n / CAST(size AS DOUBLE)), 6) AS range_billing FROM (SELECT {k}, outlet_id, count(DISTINCT sku_id) AS n FROM facts GROUP BY {k}, outlet_id) x
LEFT JOIN (SELECT category_name, count(*) AS size FROM sd_products GROUP BY category_name) y USING (category_name) GROUP BY {k}"""


def _sales(k: str) -> str:
    return f"""SELECT {k}, sum(qty_ordered) AS qty_ordered, sum(qty_delivered) AS qty_delivered, round(sum(revenue), 4) AS revenue,
  {_ratio('sum(qty_delivered)', 'sum(qty_ordered)')} AS service_level, count(DISTINCT outlet_id) AS billed_outlets FROM facts GROUP BY {k}"""


def _outer(parts: list[str], k: str) -> str:
    return f"SELECT * FROM ({parts[0]}) " + " ".join(f"FULL JOIN ({p}) USING ({k})" for p in parts[1:])


def _unit_table(k: str) -> str:
    return _outer([_productivity(k), _order_level(k), _dropsize(k), _inventory(k)], k)


def _category_table(k: str, with_oos: bool = True) -> str:
    return _outer([_distribution(k), _range(k), *([_oos(k)] if with_oos else [])], k)


def _add(name: str, build: Callable[[Warehouse], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(Warehouse(spark, sf_dir))
    ORACLES[name] = WAREHOUSE_SQL + sql


for _name, _spark, _sql, _keys in (
    ("kpi_01_productivity", kpi.productivity, _productivity, STATE),
    ("kpi_02_order_level", kpi.order_level, _order_level, STATE),
    ("kpi_03_dropsize", kpi.dropsize, _dropsize, STATE),
    ("kpi_04_inventory", kpi.inventory_kpis, _inventory, STATE),
    ("kpi_05_state_month", kpi.unit_table, _unit_table, STATE),
    ("kpi_06_active_outlets", kpi.active_outlets, _active, ["state_name", "channel_type"]),
    ("kpi_07_distribution", kpi.distribution, _distribution, STATE_CATEGORY),
    ("kpi_08_oos", kpi.oos, _oos, STATE_CATEGORY),
    ("kpi_09_range_billing", kpi.range_billing, _range, STATE_CATEGORY),
    ("kpi_10_distribution_channel", kpi.distribution, _distribution, CHANNEL),
    ("kpi_11_range_channel", kpi.range_billing, _range, CHANNEL),
    ("kpi_12_state_month_channel", lambda w, k: kpi.category_table(w, k, False), lambda k: _category_table(k, False), CHANNEL),
    ("kpi_13_state_month_category", kpi.category_table, _category_table, STATE_CATEGORY),
    ("kpi_16_productivity_wd", kpi.productivity, _productivity, WD),
    ("kpi_17_order_level_wd", kpi.order_level, _order_level, WD),
    ("kpi_18_dropsize_wd", kpi.dropsize, _dropsize, WD),
    ("kpi_19_inventory_wd", kpi.inventory_kpis, _inventory, WD),
    ("kpi_20_wd_month", kpi.unit_table, _unit_table, WD),
    ("kpi_21_active_outlets_wd", kpi.active_outlets, _active, ["wd_id"]),
    ("kpi_22_distribution_wd", kpi.distribution, _distribution, WD_CATEGORY),
    ("kpi_23_oos_wd", kpi.oos, _oos, WD_CATEGORY),
    ("kpi_24_range_billing_wd", kpi.range_billing, _range, WD_CATEGORY),
    ("kpi_25_wd_month_category", kpi.category_table, _category_table, WD_CATEGORY),
    ("kpi_26_active_outlets_state", kpi.active_outlets, _active, ["state_name"]),
    ("kpi_27_sku_sales", kpi.sku_sales, _sales, [*STATE, "sku_id"]),
    ("kpi_28_sku_oos", kpi.oos, _oos, [*STATE, "sku_id"]),
):
    _add(_name, lambda w, f=_spark, k=_keys: f(w, k), _sql(", ".join(_keys)))

_K = "state_name, month, sku_id"
_add(
    "kpi_29_state_month_sku",
    kpi.sku_table,
    f"""SELECT * FROM (SELECT s.*, sku_name, {_ratio('billed_outlets', 'outlets')} AS numeric_distribution FROM ({_sales(_K)}) s LEFT JOIN ({_active('state_name')}) a USING (state_name)
LEFT JOIN sd_products p USING (sku_id)) x FULL JOIN ({_oos(_K)}) o USING ({_K})""",
)


def _year_means(w: Warehouse) -> DataFrame:
    """Distribution and out-of-stock rate of each SKU, averaged over the months of a year that have them."""
    mean = lambda c: F.round(F.avg(c), 6).alias(c)
    return kpi.sku_table(w).groupBy("state_name", F.substring("month", 1, 4).alias("year"), "sku_id").agg(mean("numeric_distribution"), mean("oos_pct"), F.count(F.lit(1)).alias("n_months"))


_add(
    "sk_02_state_year_means",
    _year_means,
    f"SELECT state_name, substr(month, 1, 4) AS year, sku_id, round(avg(numeric_distribution), 6) AS numeric_distribution, round(avg(oos_pct), 6) AS oos_pct, count(*) AS n_months FROM ({ORACLES['kpi_29_state_month_sku'].removeprefix(WAREHOUSE_SQL)}) t GROUP BY 1, 2, 3",
)
