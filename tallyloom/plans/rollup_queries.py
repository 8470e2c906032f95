"""Roll-ups, exploratory queries, rankings, deviations and period comparisons, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions.keys import month_words
from tallyloom.operators import kpi
from tallyloom.operators.rollup import against_previous_month, deviations, extremes, pareto, pivot_sum, rank_fraction, tier_by_rank, units_revenue, with_shares, with_super_group
from tallyloom.plans.kpi_queries import _category_table, _sales, _unit_table
from tallyloom.session import written
from tallyloom.sources.warehouse import WAREHOUSE_SQL, Warehouse

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Fixed domains of the base tables.
CATEGORIES = ["ECONOMY", "STANDARD", "PROMO", "SMALL", "MEDIUM", "LARGE"]
CHANNELS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
TIERS = ["Gold", "Silver", "Bronze"]
SUPER = {"Everyday": ["ECONOMY", "STANDARD"]}


def query(sql: str | None = None, views: bool = True) -> Callable:
    """Registers a function of the warehouse under its name, with its SQL."""

    def add(f: Callable[[Warehouse], DataFrame]) -> Callable[[Warehouse], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Warehouse(spark, sf_dir))
        if sql is not None:
            ORACLES[f.__name__] = (WAREHOUSE_SQL if views else "") + sql
        return f

    return add


_UR = "round(sum(qty_delivered) / 1e5, 6) AS units_lakh, round(sum(revenue) / 1e7, 10) AS revenue_crore"
_BOTH = "(SELECT * FROM facts UNION ALL SELECT * REPLACE ('Everyday' AS category_name) FROM facts WHERE category_name IN ('ECONOMY', 'STANDARD')) f"

for _name, _keys, _super in (
    ("rp_03_category_units", ["category_name"], True),
    ("rp_04_category_units_monthly", ["month", "category_name"], True),
    ("rp_05_state_units", ["state_name"], False),
    ("rp_06_state_units_monthly", ["month", "state_name"], False),
    ("rp_07_franchise_units", ["franchise_name", "category_name"], False),
    ("rp_08_franchise_units_monthly", ["month", "franchise_name", "category_name"], False),
):
    QUERIES[_name] = lambda spark, sf_dir, k=_keys, s=_super: units_revenue((lambda f: with_super_group(f, "category_name", SUPER) if s else f)(Warehouse(spark, sf_dir).facts), k)
    ORACLES[_name] = f"{WAREHOUSE_SQL} SELECT {', '.join(_keys)}, {_UR} FROM {_BOTH if _super else 'facts'} GROUP BY {', '.join(_keys)}"

for _name, _keys, _col, _values, _missing in (
    ("rp_09_channel_category_pivot", ["channel_type"], "category_name", CATEGORIES, None),
    ("rp_10_channel_category_pivot_monthly", ["month", "channel_type"], "category_name", CATEGORIES, None),
    ("rp_11_channel_tier_pivot", ["channel_type"], "outlet_tier", TIERS, None),
    ("rp_12_channel_tier_pivot_monthly", ["month", "channel_type"], "outlet_tier", TIERS, None),
    ("nb_12_tier_channel_pivot", ["outlet_tier"], "channel_type", CHANNELS, 0.0),
):
    QUERIES[_name] = lambda spark, sf_dir, a=(_keys, _col, _values, "qty_delivered", 1e5, _missing): pivot_sum(Warehouse(spark, sf_dir).facts, *a)
    _cells = ", ".join((f"round(sum(qty_delivered) FILTER ({_col} = '{v}') / 1e5, 6)" if _missing is None else f"coalesce(round(sum(qty_delivered) FILTER ({_col} = '{v}') / 1e5, 6), 0)") + f" AS {v.lower()}" for v in _values)
    ORACLES[_name] = f"{WAREHOUSE_SQL} SELECT {', '.join(_keys)}, {_cells} FROM facts GROUP BY {', '.join(_keys)}"


@query("SELECT order_id, month, outlet_id, sku_id, category_name, state_name, qty_delivered, round(revenue, 4) AS revenue FROM facts")
def io_10_fact_scan(w):
    return w.facts.select("order_id", "month", "outlet_id", "sku_id", "category_name", "state_name", "qty_delivered", F.round("revenue", 4).alias("revenue"))


@query("SELECT outlet_id, sum(qty_delivered) AS units FROM facts GROUP BY outlet_id")
def io_04_outlet_totals(w):
    """A pruned scan, partially summed before its shuffle."""
    return w.facts.groupBy("outlet_id").agg(F.sum("qty_delivered").alias("units"))


@query("SELECT count(*) AS n_lines, count(DISTINCT order_id) AS n_orders, sum(qty_delivered) AS units, round(sum(revenue), 2) AS revenue FROM facts")
def ag_12_global(w):
    return w.facts.agg(F.count(F.lit(1)).alias("n_lines"), F.countDistinct("order_id").alias("n_orders"), F.sum("qty_delivered").alias("units"), F.round(F.sum("revenue"), 2).alias("revenue"))


@query("SELECT month, category_name, sum(qty_delivered) AS units, CAST(grouping(month) AS INT) AS all_months FROM facts GROUP BY GROUPING SETS ((category_name), (month, category_name))")
def ag_18_grouping_sets(w):
    return w.facts.groupingSets([["category_name"], ["month", "category_name"]], "month", "category_name").agg(F.sum("qty_delivered").alias("units"), F.grouping("month").cast("int").alias("all_months"))


@query("SELECT state_name, round((v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()), 6) AS scaled FROM (SELECT state_name, sum(revenue) AS v FROM facts GROUP BY state_name)")
def ag_23_min_max(w):
    t = written(w.facts.groupBy("state_name").agg(F.sum("revenue").alias("v")), "totals")
    lo, hi = t.agg(F.min("v"), F.max("v")).first()
    return t.select("state_name", F.round(F.try_divide(F.col("v") - F.lit(lo), F.lit(hi) - F.lit(lo)), 6).alias("scaled"))


@query("SELECT state_name, sum(qty_delivered) AS units, count(DISTINCT month) AS n_months FROM facts WHERE starts_with(month, '1995-') GROUP BY 1")
def pf_06_year_prefix(w):
    """Units of one year, its months found by their prefix; the filter reaches the orders' scan as one on the month's text."""
    return w.facts.where(F.startswith("month", F.lit("1995-"))).groupBy("state_name").agg(F.sum("qty_delivered").alias("units"), F.countDistinct("month").alias("n_months"))


@query("SELECT DISTINCT outlet_id, sku_id FROM facts f WHERE EXISTS (SELECT 1 FROM sd_visits v WHERE v.visit_id = f.order_id AND v.visit_outcome = 'Order Placed')")
def j_14_semi_successful(w):
    placed = w.visits.where("visit_outcome = 'Order Placed'").select(F.col("visit_id").alias("order_id"))
    return w.facts.join(placed, "order_id", "left_semi").select("outlet_id", "sku_id").distinct()


@query("SELECT z.unit_id AS zone_id, z.unit_name AS zone_name, z.state_name, d.unit_id AS wd_id, d.unit_name AS wd_name FROM geography z JOIN geography d ON d.parent_unit_id = z.unit_id WHERE z.unit_type = 'Zone' AND d.unit_type = 'WD'", False)
def j_15_zone_wd_children(w):
    g = w._table("geography")
    zones = g.where("unit_type = 'Zone'").select(F.col("unit_id").alias("zone_id"), F.col("unit_name").alias("zone_name"), "state_name")
    wds = g.where("unit_type = 'WD'").select(F.col("unit_id").alias("wd_id"), F.col("unit_name").alias("wd_name"), F.col("parent_unit_id").alias("zone_id"))
    return zones.join(wds, "zone_id")


@query("SELECT s.unit_id AS se_id, d.unit_id AS wd_id, z.unit_id AS zone_id, t.unit_id AS state_id, t.unit_name AS state_name FROM geography s LEFT JOIN geography d ON s.parent_unit_id = d.unit_id LEFT JOIN geography z ON d.parent_unit_id = z.unit_id LEFT JOIN geography t ON z.parent_unit_id = t.unit_id WHERE s.unit_type = 'SE'", False)
def j_16_hierarchy_walk(w):
    """Three self joins: the hierarchy has a fixed depth."""
    g = w._table("geography").select("unit_id", "unit_type", "unit_name", "parent_unit_id")
    level = lambda kind, name: g.where(F.col("unit_type") == kind).select(F.col("unit_id").alias(name), F.col("parent_unit_id").alias(f"{name}_parent"), F.col("unit_name").alias(f"{name}_name"))
    out = level("SE", "se_id")
    for child, kind, name in (("se_id", "WD", "wd_id"), ("wd_id", "Zone", "zone_id"), ("zone_id", "State", "state_id")):
        up = level(kind, name)
        out = out.join(up, out[f"{child}_parent"] == up[name], "left")
    return out.select("se_id", "wd_id", "zone_id", "state_id", F.col("state_id_name").alias("state_name"))


@query("SELECT month, round(sum(revenue) / 1e7, 10) AS revenue_crore FROM facts GROUP BY month")
def nb_01_monthly_revenue(w):
    return w.facts.groupBy("month").agg(F.round(F.sum("revenue") / 1e7, 10).alias("revenue_crore"))


@query("SELECT category_name, round(100 * r / sum(r) OVER (), 4) AS revenue_pct, round(100 * u / sum(u) OVER (), 4) AS units_pct, round(r / u, 6) AS mean_price FROM (SELECT category_name, sum(revenue) AS r, sum(qty_delivered) AS u FROM facts GROUP BY 1)")
def nb_02_category_share(w):
    t = w.facts.groupBy("category_name").agg(F.sum("revenue").alias("r"), F.sum("qty_delivered").alias("u"))
    return with_shares(t, {"revenue_pct": "r", "units_pct": "u"}).select("category_name", "revenue_pct", "units_pct", F.round(F.try_divide(F.col("r"), F.col("u")), 6).alias("mean_price"))


def _mix(w, key):
    t = w.facts.groupBy(key).agg(F.sum("revenue").alias("r"), F.sum("qty_delivered").alias("u")).join(w.outlets.groupBy(key).agg(F.count(F.lit(1)).alias("outlets")), key)
    per = lambda c: F.round(F.col(c) / F.col("outlets"), 6)
    return with_shares(t, {"outlets_pct": "outlets", "revenue_pct": "r", "units_pct": "u"}).select(key, "outlets", "outlets_pct", "revenue_pct", "units_pct", per("r").alias("revenue_per_outlet"), per("u").alias("units_per_outlet"))


def _mix_sql(key):
    return f"""SELECT {key}, outlets, round(100 * outlets / sum(outlets) OVER (), 4) AS outlets_pct, round(100 * r / sum(r) OVER (), 4) AS revenue_pct, round(100 * u / sum(u) OVER (), 4) AS units_pct, round(r / outlets, 6) AS revenue_per_outlet, round(u / outlets, 6) AS units_per_outlet
FROM (SELECT {key}, sum(revenue) AS r, sum(qty_delivered) AS u FROM facts GROUP BY 1) JOIN (SELECT {key}, count(*) AS outlets FROM sd_outlets GROUP BY 1) USING ({key})"""


@query(_mix_sql("channel_type"))
def nb_03_channel_mix(w):
    return _mix(w, "channel_type")


@query(_mix_sql("outlet_tier"))
def nb_04_tier_mix(w):
    return _mix(w, "outlet_tier")


_SKU_TOTALS = "sku AS (SELECT sku_id, round(sum(revenue), 4) AS revenue, sum(qty_delivered) AS units FROM facts GROUP BY sku_id)"


def _sku_totals(w):
    return w.facts.groupBy("sku_id").agg(F.round(F.sum("revenue"), 4).alias("revenue"), F.sum("qty_delivered").alias("units"))


@query(f", {_SKU_TOTALS} (SELECT *, 'top' AS side FROM sku ORDER BY revenue DESC, sku_id LIMIT 10) UNION ALL (SELECT *, 'bottom' FROM sku ORDER BY revenue, sku_id LIMIT 10)")
def nb_05_top_bottom_sku(w):
    return extremes(_sku_totals(w), "revenue", "sku_id", 10)


@query(f", {_SKU_TOTALS} SELECT round(stddev_samp(units) / avg(units), 6) AS cv_units, round(stddev_samp(revenue) / avg(revenue), 6) AS cv_revenue FROM sku")
def nb_06_cv(w):
    cv = lambda c: F.round(F.stddev_samp(c) / F.avg(c), 6).alias(f"cv_{c}")
    return _sku_totals(w).agg(cv("units"), cv("revenue"))


@query(f", {_SKU_TOTALS} SELECT sku_id, round(100 * sum(revenue) OVER (ORDER BY revenue DESC, sku_id ROWS UNBOUNDED PRECEDING) / sum(revenue) OVER (), 6) AS running_pct, round(100 * row_number() OVER (ORDER BY revenue DESC, sku_id) / count(*) OVER (), 6) AS rank_pct FROM sku")
def nb_07_pareto(w):
    return pareto(_sku_totals(w), "sku_id", "revenue")


@query(f""", a AS ({_unit_table('state_name, month')}), b AS (SELECT state_name, month, avg(oos_pct) AS oos FROM ({_category_table('state_name, month, category_name')}) GROUP BY ALL)
SELECT round(corr(productivity, dropsize), 6) AS productivity_dropsize, round(corr(oos, service_level), 6) AS oos_service_level FROM a LEFT JOIN b USING (state_name, month)""")
def nb_08_corr(w):
    a = kpi.unit_table(w, ["state_name", "month"])
    b = kpi.oos(w, ["state_name", "month", "category_name"]).groupBy("state_name", "month").agg(F.avg("oos_pct").alias("oos"))
    return a.join(b, ["state_name", "month"], "left").agg(F.round(F.corr("productivity", "dropsize"), 6).alias("productivity_dropsize"), F.round(F.corr("oos", "service_level"), 6).alias("oos_service_level"))


@query("""SELECT count(*) FILTER (order_date >= closure_date) AS n_on_or_after, count(*) FILTER (order_date > closure_date) AS n_after, count(DISTINCT outlet_id) AS n_outlets
FROM (SELECT nullif(upper(trim(outlet_id, ' ' || chr(9) || chr(160))), '') AS outlet_id, max({'l': loaded_at, 'c': closure_date})['c'] AS closure_date FROM outlets GROUP BY 1) o
JOIN (SELECT line_id, max(nullif(upper(trim(outlet_id, ' ' || chr(9) || chr(160))), '')) AS outlet_id, max(order_date) AS order_date FROM order_lines GROUP BY 1) l USING (outlet_id) WHERE order_date >= closure_date""", False)
def nb_09_after_closure(w):
    """Orders on or after the day their outlet closed: an equi join with an inequality left over."""
    from tallyloom.sources.tables import current_outlets, order_facts

    closed = current_outlets(w.spark, w.sf_dir, "closure_date").where("closure_date IS NOT NULL")
    late = order_facts(w.spark, w.sf_dir, "outlet_id", "order_date").join(closed, "outlet_id").where("order_date >= closure_date")
    return late.agg(F.count(F.lit(1)).alias("n_on_or_after"), F.count_if(F.col("order_date") > F.col("closure_date")).alias("n_after"), F.countDistinct("outlet_id").alias("n_outlets"))


@query("SELECT outlet_id, category_name, sku_id, sum(qty_delivered) AS units, round(sum(revenue), 4) AS revenue FROM facts WHERE outlet_id IN (SELECT visit_outlet FROM (SELECT outlet_id AS visit_outlet FROM sd_visits WHERE visit_outcome = 'Order Placed')) GROUP BY ALL")
def nb_10_outlet_drill(w):
    placed = w.visits.where("visit_outcome = 'Order Placed'").select("outlet_id")
    return w.facts.join(placed, "outlet_id", "left_semi").groupBy("outlet_id", "category_name", "sku_id").agg(F.sum("qty_delivered").alias("units"), F.round(F.sum("revenue"), 4).alias("revenue"))


_PER_OUTLET = "o AS (SELECT outlet_id, outlet_tier, channel_type, sum(qty_delivered) AS u FROM facts GROUP BY ALL)"


def _spread(df, keys):
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_outlets"), F.round(F.avg("u"), 6).alias("mean_units"), F.median("u").alias("median_units"), F.min("u").alias("min_units"), F.max("u").alias("max_units"))


_SPREAD = "count(*) AS n_outlets, round(avg(u), 6) AS mean_units, median(u) AS median_units, min(u) AS min_units, max(u) AS max_units"


def _outlet_units(w):
    return w.facts.groupBy("outlet_id", "outlet_tier", "channel_type").agg(F.sum("qty_delivered").alias("u"))


@query(f", {_PER_OUTLET} SELECT outlet_tier, channel_type, {_SPREAD} FROM o GROUP BY 1, 2")
def nb_11_outlet_benchmark(w):
    return _spread(_outlet_units(w), ["outlet_tier", "channel_type"])


@query(f", {_PER_OUTLET} SELECT channel_type, {_SPREAD} FROM o GROUP BY 1")
def nb_14_channel_summary(w):
    return _spread(_outlet_units(w), ["channel_type"])


def _tier_order(w):
    t = _outlet_units(w).groupBy("channel_type", "outlet_tier").agg(F.avg("u").alias("m"))
    rank = F.when(F.col("outlet_tier") == "Gold", 1).when(F.col("outlet_tier") == "Silver", 2).otherwise(3)
    before = F.lag("m").over(Window.partitionBy("channel_type").orderBy(rank))
    return t.withColumn("falls", F.coalesce(before > F.col("m"), F.lit(True))).groupBy("channel_type").agg(F.bool_and("falls").alias("tiers_in_order"))


@query(f""", {_PER_OUTLET} SELECT channel_type, bool_and(f) AS tiers_in_order FROM (SELECT channel_type, coalesce(lag(m) OVER (PARTITION BY channel_type ORDER BY CASE outlet_tier WHEN 'Gold' THEN 1 WHEN 'Silver' THEN 2 ELSE 3 END) > m, true) AS f
FROM (SELECT channel_type, outlet_tier, avg(u) AS m FROM o GROUP BY 1, 2)) GROUP BY 1""")
def nb_15_tier_order_check(w):
    return _tier_order(w)


@query(f""", {_PER_OUTLET} SELECT bool_and(f) AS in_order, count(*) AS n_steps FROM (SELECT coalesce(lag(m) OVER (ORDER BY channel_type, CASE outlet_tier WHEN 'Gold' THEN 1 WHEN 'Silver' THEN 2 ELSE 3 END) > m, true) AS f
FROM (SELECT channel_type, outlet_tier, avg(u) AS m FROM o GROUP BY 1, 2))""")
def rp_16_cascade_check(w):
    """Whether means fall along one fixed order of channels and tiers, each step at most once per channel and tier."""
    t = _outlet_units(w).groupBy("channel_type", "outlet_tier").agg(F.avg("u").alias("m"))
    rank = F.when(F.col("outlet_tier") == "Gold", 1).when(F.col("outlet_tier") == "Silver", 2).otherwise(3)
    falls = F.coalesce(F.lag("m").over(Window.partitionBy(F.lit(0)).orderBy("channel_type", rank)) > F.col("m"), F.lit(True))
    return t.select(falls.alias("f")).agg(F.bool_and("f").alias("in_order"), F.count(F.lit(1)).alias("n_steps"))


_RANKED = """u AS (SELECT outlet_id, channel_type, outlet_tier, coalesce(q, 0) AS units FROM sd_outlets LEFT JOIN (SELECT outlet_id, sum(qty_delivered) AS q FROM facts GROUP BY 1) USING (outlet_id)),
ranked AS (SELECT *, row_number() OVER w AS rank_no, round(row_number() OVER w / count(*) OVER (PARTITION BY channel_type), 6) AS rank_pct FROM u WINDOW w AS (PARTITION BY channel_type ORDER BY units DESC, outlet_id)),
tiered AS (SELECT *, CASE WHEN rank_pct <= 0.20 THEN 'Gold' WHEN rank_pct <= 0.55 THEN 'Silver' ELSE 'Bronze' END AS new_tier FROM ranked)"""


def _tiered(w):
    units = w.outlets.select("outlet_id", "channel_type", "outlet_tier").join(io_04_outlet_totals(w), "outlet_id", "left").withColumn("units", F.coalesce("units", F.lit(0.0)))
    return rank_fraction(units, "channel_type", "units", "outlet_id").withColumn("new_tier", tier_by_rank(F.col("rank_pct")))


@query(f", {_RANKED} SELECT outlet_id, channel_type, rank_no, rank_pct FROM tiered")
def wn_01_pct_rank_first(w):
    return _tiered(w).select("outlet_id", "channel_type", "rank_no", "rank_pct")


@query(f", {_RANKED} SELECT outlet_id, units, outlet_tier, new_tier FROM tiered")
def rp_13_retier(w):
    return _tiered(w).select("outlet_id", "units", "outlet_tier", "new_tier")


@query(f", {_RANKED} SELECT channel_type, count(*) AS n_outlets, count(*) FILTER (new_tier <> outlet_tier) AS n_changed FROM tiered GROUP BY 1")
def rp_14_retier_changes(w):
    return _tiered(w).groupBy("channel_type").agg(F.count(F.lit(1)).alias("n_outlets"), F.count_if(F.col("new_tier") != F.col("outlet_tier")).alias("n_changed"))


@query(f", {_RANKED} SELECT channel_type, new_tier, round(avg(units), 6) AS mean_units, sum(units) AS total_units FROM tiered GROUP BY 1, 2")
def rp_15_tier_tables(w):
    return _tiered(w).groupBy("channel_type", "new_tier").agg(F.round(F.avg("units"), 6).alias("mean_units"), F.sum("units").alias("total_units"))


@query("SELECT franchise_name, min(sku_id) AS sku_id FROM sd_products GROUP BY franchise_name")
def dg_04_first_skus(w):
    return w.products.groupBy("franchise_name").agg(F.min("sku_id").alias("sku_id"))


_STATE_RULES = {"productivity": "lower", "service_level": "lower", "dropsize": "both"}
_CATEGORY_RULES = {"numeric_distribution": "lower", "acv": "lower", "range_billing": "lower", "oos_pct": "higher"}
_CHANNEL_RULES = {k: v for k, v in _CATEGORY_RULES.items() if k != "oos_pct"}


def _deviations_sql(member: str, peer: str, ids: str, on: str, rules: dict[str, str]) -> str:
    part = lambda m, r: f"SELECT {ids}, '{m}' AS metric, CAST(a.{m} AS DOUBLE) AS value, CAST(b.{m} AS DOUBLE) AS peer_value, round({ {'lower': f'(b.{m} - a.{m}) * 100', 'higher': f'(a.{m} - b.{m}) * 100', 'both': f'abs((a.{m} - b.{m}) / nullif(b.{m}, 0) * 100)'}[r] }, 4) AS gap FROM ({member}) a JOIN ({peer}) b USING ({on})"
    return "SELECT * FROM (" + " UNION ALL ".join(part(m, r) for m, r in rules.items()) + ") d WHERE gap > 10"


_HOME = "(SELECT DISTINCT wd_id, state_name FROM sd_outlets)"


def _wd_home(w):
    return w.outlets.select("wd_id", "state_name").distinct()


def _wd_state_deviations(w):
    return deviations(kpi.unit_table(w, ["wd_id", "month"]).select("wd_id", "month", *_STATE_RULES).join(_wd_home(w), "wd_id"), kpi.unit_table(w, ["state_name", "month"]), ["state_name", "month"], _STATE_RULES)


_WD_STATE_SQL = _deviations_sql(f"SELECT * FROM ({_unit_table('wd_id, month')}) JOIN {_HOME} USING (wd_id)", _unit_table("state_name, month"), "wd_id, month, state_name", "state_name, month", _STATE_RULES)


@query(_WD_STATE_SQL)
def dv_01_wd_state_metrics(w):
    """Distributors off their state's pooled KPIs."""
    return _wd_state_deviations(w)


@query(_deviations_sql(f"SELECT * FROM ({_category_table('wd_id, month, category_name')}) JOIN {_HOME} USING (wd_id)", _category_table("state_name, month, category_name"), "wd_id, month, category_name, state_name", "state_name, month, category_name", _CATEGORY_RULES))
def dv_01_wd_category_metrics(w):
    members = kpi.category_table(w, ["wd_id", "month", "category_name"]).join(_wd_home(w), "wd_id")
    return deviations(members, kpi.category_table(w, ["state_name", "month", "category_name"]), ["state_name", "month", "category_name"], _CATEGORY_RULES)


@query(_deviations_sql(_category_table("state_name, month, category_name, channel_type", False), _category_table("state_name, month, category_name"), "state_name, month, category_name, channel_type", "state_name, month, category_name", _CHANNEL_RULES))
def dv_03_channel_metrics(w):
    keys = ["state_name", "month", "category_name"]
    return deviations(kpi.category_table(w, [*keys, "channel_type"], False), kpi.category_table(w, keys, False), keys, _CHANNEL_RULES)


@query(_deviations_sql(_category_table("state_name, month, category_name, channel_type", False), _category_table("state_name, month, category_name"), "state_name, month, category_name, channel_type", "state_name, month, category_name", _CHANNEL_RULES).replace("gap > 10", "gap > 0.25"))
def dv_03_channel_metrics_near(w):
    """Channels off their category's value by more than a quarter of a point."""
    keys = ["state_name", "month", "category_name"]
    return deviations(kpi.category_table(w, [*keys, "channel_type"], False), kpi.category_table(w, keys, False), keys, _CHANNEL_RULES, 0.25)


@query(f""", hits AS ({_WD_STATE_SQL}) SELECT state_name, month, string_agg(metric, ', ' ORDER BY metric) AS quiet_metrics FROM (SELECT DISTINCT state_name, month FROM ({_unit_table('state_name, month')})) s
CROSS JOIN (SELECT unnest(['productivity', 'service_level', 'dropsize']) AS metric) m ANTI JOIN hits USING (state_name, month, metric) GROUP BY 1, 2""")
def dv_02_no_hit_labels(w):
    """The metrics in which no distributor of the state is off, as a list per state and month."""
    every = kpi.unit_table(w, ["state_name", "month"]).select("state_name", "month", F.explode(F.array(*map(F.lit, _STATE_RULES))).alias("metric"))
    quiet = every.join(_wd_state_deviations(w).select("state_name", "month", "metric"), ["state_name", "month", "metric"], "left_anti")
    return quiet.groupBy("state_name", "month").agg(F.array_join(F.array_sort(F.collect_list("metric")), ", ").alias("quiet_metrics"))


@query("SELECT state_name, string_agg(wd_id || ' ' || wd_name, '; ' ORDER BY wd_id) AS roster FROM (SELECT DISTINCT state_name, printf('%02d', wd_id) AS wd_id, wd_name FROM sd_outlets) GROUP BY 1")
def dv_04_roster(w):
    one = w.outlets.select("state_name", F.lpad(F.col("wd_id").cast("string"), 2, "0").alias("wd_id"), "wd_name").distinct()
    return one.groupBy("state_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("wd_id", "wd_name"))), lambda x: F.concat(x["wd_id"], F.lit(" "), x["wd_name"])), "; ").alias("roster"))


@query("SELECT category_name, string_agg(franchise_name, ', ' ORDER BY first) AS franchises FROM (SELECT category_name, franchise_name, min(sku_id) AS first FROM sd_products GROUP BY 1, 2) GROUP BY 1")
def dv_05_franchises(w):
    """Franchises of a category in order of first appearance."""
    first = w.products.groupBy("category_name", "franchise_name").agg(F.min("sku_id").alias("first"))
    return first.groupBy("category_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "franchise_name"))), lambda x: x["franchise_name"]), ", ").alias("franchises"))


_STATE_METRICS = ["productivity", "service_level", "skus_per_transaction", "dropsize", "inventory_turns", "inventory_days"]
_LONG = " UNION ALL ".join(f"SELECT state_name, month, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM a" for m in _STATE_METRICS)
_PREVIOUS = f""", a AS MATERIALIZED ({_unit_table('state_name, month')}), l AS MATERIALIZED ({_LONG}),
compared AS (SELECT x.state_name, x.month, x.metric, x.value, y.value AS previous, CASE WHEN x.value - y.value > 1e-9 THEN 'up' WHEN x.value - y.value < -1e-9 THEN 'down' WHEN x.value - y.value IS NOT NULL THEN 'flat' END AS direction
FROM l x LEFT JOIN l y ON x.state_name = y.state_name AND x.metric = y.metric AND y.month = strftime(strptime(x.month || '-01', '%Y-%m-%d') - INTERVAL 1 MONTH, '%Y-%m'))"""


def _compared(w):
    return against_previous_month(kpi.unit_table(w, ["state_name", "month"]), ["state_name"], _STATE_METRICS)


@query(f"{_PREVIOUS} SELECT * FROM compared")
def wn_06_previous_month(w):
    """Every state KPI beside its calendar predecessor."""
    return _compared(w)


@query(f"{_PREVIOUS} SELECT metric, direction, count(*) AS n, round(avg(value - previous), 6) AS mean_change FROM compared WHERE direction IS NOT NULL GROUP BY 1, 2")
def j_18_directions(w):
    return _compared(w).where("direction IS NOT NULL").groupBy("metric", "direction").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("value") - F.col("previous")), 6).alias("mean_change"))


@query(f"""{_PREVIOUS} SELECT state_name, month, claim, CASE WHEN count(direction) < 2 THEN 'insufficient_data' WHEN count(DISTINCT direction) > 1 OR max(direction) = 'flat' THEN 'mixed' WHEN max(direction) = claim THEN 'confirmed' ELSE 'contradicted' END AS status
FROM compared, (SELECT unnest(['down', 'up']) AS claim) c WHERE metric IN ('productivity', 'service_level') GROUP BY 1, 2, 3""")
def pr_01_premise_verdict(w):
    """Whether a claimed fall or rise of the headline metrics holds against the month before."""
    headline = _compared(w).where("metric IN ('productivity', 'service_level')").withColumn("claim", F.explode(F.array(F.lit("down"), F.lit("up"))))
    g = headline.groupBy("state_name", "month", "claim").agg(F.count("direction").alias("n"), F.countDistinct("direction").alias("d"), F.max("direction").alias("m"))
    status = F.when(F.col("n") < 2, "insufficient_data").when((F.col("d") > 1) | (F.col("m") == "flat"), "mixed").when(F.col("m") == F.col("claim"), "confirmed").otherwise("contradicted")
    return g.select("state_name", "month", "claim", status.alias("status"))


_E = f", e AS ({_sales('state_name, month, sku_id')})"


def _sku(w):
    return kpi.sku_sales(w, ["state_name", "month", "sku_id"])


@query(f"{_E} SELECT state_name, substr(month, 1, 4) AS year, sku_id, sum(qty_ordered) AS qty_ordered, sum(qty_delivered) AS qty_delivered, round(sum(revenue), 2) AS revenue, round(sum(qty_delivered) / nullif(sum(qty_ordered), 0), 6) AS service_level, count(DISTINCT month) AS n_months FROM e GROUP BY 1, 2, 3")
def sk_02_state_year(w):
    """SKU sales of a state and year; the ratio is recomputed from sums."""
    return _sku(w).groupBy("state_name", F.substring("month", 1, 4).alias("year"), "sku_id").agg(
        F.sum("qty_ordered").alias("qty_ordered"), F.sum("qty_delivered").alias("qty_delivered"), F.round(F.sum("revenue"), 2).alias("revenue"), kpi.ratio(F.sum("qty_delivered"), F.sum("qty_ordered")).alias("service_level"), F.countDistinct("month").alias("n_months")
    )


@query("SELECT state_name, min(month) AS first_month, max(month) AS last_month, count(DISTINCT month) AS n_months FROM facts GROUP BY 1")
def sk_04_latest(w):
    return w.facts.groupBy("state_name").agg(F.min("month").alias("first_month"), F.max("month").alias("last_month"), F.countDistinct("month").alias("n_months"))


def _ranked(w, descending=True):
    order = F.col("qty_delivered").desc() if descending else F.col("qty_delivered").asc()
    return _sku(w).withColumn("rank_no", F.row_number().over(Window.partitionBy("state_name", "month").orderBy(order, "sku_id")))


@query(f"{_E} SELECT state_name, month, sku_id, qty_delivered, rank_no FROM (SELECT *, row_number() OVER (PARTITION BY state_name, month ORDER BY qty_delivered DESC, sku_id) AS rank_no FROM e) WHERE rank_no <= 5")
def sk_06_topn(w):
    return _ranked(w).where("rank_no <= 5").select("state_name", "month", "sku_id", "qty_delivered", "rank_no")


@query(f"{_E} SELECT state_name, month, sku_id, qty_delivered, rank_no FROM (SELECT *, row_number() OVER (PARTITION BY state_name, month ORDER BY qty_delivered, sku_id) AS rank_no FROM e) WHERE rank_no <= 5")
def sk_06_bottomn(w):
    return _ranked(w, False).where("rank_no <= 5").select("state_name", "month", "sku_id", "qty_delivered", "rank_no")


@query(f"{_E}, r AS (SELECT *, row_number() OVER (PARTITION BY state_name, month ORDER BY qty_delivered DESC, sku_id) AS k FROM e) SELECT state_name, month, string_agg(k || '. ' || sku_id || ' (' || CAST(CAST(qty_delivered AS BIGINT) AS VARCHAR) || ')', '; ' ORDER BY k) AS ranking FROM r WHERE k <= 3 GROUP BY 1, 2")
def sk_07_ranking_text(w):
    """The first three SKUs of a state and month as one line of evidence."""
    top = _ranked(w).where("rank_no <= 3")
    line = F.format_string("%d. %d (%d)", "rank_no", "sku_id", F.col("qty_delivered").cast("bigint"))
    return top.groupBy("state_name", "month").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank_no", line.alias("t")))), lambda x: x["t"]), "; ").alias("ranking"))


@query(f"{_E}, r AS (SELECT *, row_number() OVER (PARTITION BY state_name, month ORDER BY qty_delivered DESC, sku_id) AS k FROM e) SELECT state_name, month, sku_id, lag(sku_id) OVER w AS before_sku, qty_delivered - lag(qty_delivered) OVER w AS change, coalesce(sku_id <> lag(sku_id) OVER w, false) AS new_leader FROM r WHERE k = 1 WINDOW w AS (PARTITION BY state_name ORDER BY month)")
def sk_08_rank1_change(w):
    s = Window.partitionBy("state_name").orderBy("month")
    before = F.lag("sku_id").over(s)
    return _ranked(w).where("rank_no = 1").select("state_name", "month", "sku_id", before.alias("before_sku"), (F.col("qty_delivered") - F.lag("qty_delivered").over(s)).alias("change"), F.coalesce(F.col("sku_id") != before, F.lit(False)).alias("new_leader"))


@query("SELECT DISTINCT month, strftime(strptime(month || '-01', '%Y-%m-%d'), '%B %Y') AS words, strftime(strptime(month || '-01', '%Y-%m-%d') - INTERVAL 1 MONTH, '%Y-%m') AS previous FROM facts")
def sc_02_month_words(w):
    """Months in words, and the month before."""
    m = w.facts.select("month").distinct()
    return m.select("month", month_words("month").alias("words"), F.date_format(F.add_months(F.to_date(F.concat("month", F.lit("-01"))), -1), "yyyy-MM").alias("previous"))
