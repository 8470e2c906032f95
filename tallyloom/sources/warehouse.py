"""The sales warehouse (outlets, products, geography, visits, orders, inventory) as views over the base tables.

Each function returns a lazy DataFrame; ``WAREHOUSE_SQL`` has the same views as common table expressions.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.sources.tables import table


@dataclass(frozen=True)
class Warehouse:
    """The warehouse of one data folder."""

    spark: SparkSession
    sf_dir: str

    def _table(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @cached_property
    def outlets(self) -> DataFrame:
        """Customers as outlets: region is the state, nation the distributor."""
        c, n, r = self._table("customer"), self._table("nation"), self._table("region")
        tier = F.when(F.col("c_acctbal") >= 6500, "Gold").when(F.col("c_acctbal") >= 3000, "Silver").otherwise("Bronze")
        units = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
        return c.join(F.broadcast(units), F.col("c_nationkey") == F.col("n_nationkey")).select(  # nations and regions have a fixed size
            F.col("c_custkey").alias("outlet_id"),
            F.col("c_name").alias("outlet_name"),
            (F.col("n_nationkey") * 10 + (F.col("c_custkey") % 4).cast("int")).alias("se_id"),
            F.col("n_nationkey").alias("wd_id"),
            F.col("n_name").alias("wd_name"),
            F.col("r_name").alias("state_name"),
            F.col("c_mktsegment").alias("channel_type"),
            tier.alias("outlet_tier"),
            (F.col("c_acctbal") >= 0).alias("is_active"),
        )

    @cached_property
    def products(self) -> DataFrame:
        return self._table("part").select(
            F.col("p_partkey").alias("sku_id"),
            F.concat("p_name", F.lit(" #"), F.col("p_partkey").cast("string")).alias("sku_name"),
            F.col("p_brand").alias("franchise_name"),
            F.col("p_type").alias("category_name"),
            F.col("p_size").alias("pack_size"),
            F.col("p_retailprice").alias("unit_price"),
        )

    @cached_property
    def visits(self) -> DataFrame:
        outcome = F.when(F.col("o_orderstatus") == "F", "Order Placed").when(F.col("o_orderstatus") == "O", "No Order").otherwise("Closed")
        o = self._table("orders").select(
            F.col("o_orderkey").alias("visit_id"), F.col("o_orderdate").alias("visit_date"), F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_custkey").alias("outlet_id"), outcome.alias("visit_outcome")
        )
        return o.join(self.outlets.select("outlet_id", "se_id", "wd_id", "state_name"), "outlet_id")

    @cached_property
    def order_lines(self) -> DataFrame:
        """Lines of placed orders with their outlet's distributor, state, channel and tier."""
        o = self._table("orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "o_orderdate")
        li = self._table("lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag", "l_extendedprice")
        delivered = F.when(F.col("l_returnflag") == "R", F.lit(0.0)).otherwise(F.col("l_quantity"))
        lines = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_orderdate").alias("order_date"),
            F.date_format("o_orderdate", "yyyy-MM").alias("month"),
            F.col("o_custkey").alias("outlet_id"),
            F.col("l_partkey").alias("sku_id"),
            F.col("l_quantity").alias("qty_ordered"),
            delivered.alias("qty_delivered"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
        )
        return lines.join(self.outlets.select("outlet_id", "wd_id", "wd_name", "state_name", "channel_type", "outlet_tier", "is_active"), "outlet_id")

    @cached_property
    def facts(self) -> DataFrame:
        """Order lines with their SKU's names and their revenue."""
        p = self.products.select("sku_id", "sku_name", "franchise_name", "category_name")
        return self.order_lines.join(p, "sku_id").withColumn("revenue", F.col("qty_delivered") * F.col("unit_price"))

    @cached_property
    def inventory(self) -> DataFrame:
        """Stock of each distributor, SKU and month, from what was shipped."""
        li = self._table("lineitem").select("l_orderkey", "l_partkey", "l_quantity", F.date_format("l_shipdate", "yyyy-MM").alias("month"))
        o = self._table("orders").select("o_orderkey", "o_custkey")
        sold = (
            li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(self.outlets.select("outlet_id", "wd_id", "state_name"), F.col("o_custkey") == F.col("outlet_id"))
            .groupBy("month", "wd_id", "state_name", F.col("l_partkey").alias("sku_id"))
            .agg(F.sum("l_quantity").alias("qty_sold"))
        )
        stock = sold.join(self.products.select("sku_id", "category_name", F.col("pack_size").cast("double").alias("base")), "sku_id")
        closing = F.greatest(3 * F.col("base") - F.col("qty_sold"), F.lit(0.0))
        return stock.withColumn("opening_stock", 2 * F.col("base")).withColumn("closing_stock", closing).withColumn("stockout", closing < 5)


WAREHOUSE_SQL = """WITH sd_outlets AS (
  SELECT c_custkey AS outlet_id, c_name AS outlet_name, n_nationkey * 10 + CAST(c_custkey % 4 AS INT) AS se_id, n_nationkey AS wd_id, n_name AS wd_name, r_name AS state_name, c_mktsegment AS channel_type,
    CASE WHEN c_acctbal >= 6500 THEN 'Gold' WHEN c_acctbal >= 3000 THEN 'Silver' ELSE 'Bronze' END AS outlet_tier, c_acctbal >= 0 AS is_active
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
sd_products AS (SELECT p_partkey AS sku_id, concat(p_name, ' #', CAST(p_partkey AS VARCHAR)) AS sku_name, p_brand AS franchise_name, p_type AS category_name, p_size AS pack_size FROM part),
sd_visits AS (
  SELECT o_orderkey AS visit_id, o_orderdate AS visit_date, strftime(o_orderdate, '%Y-%m') AS month, u.*,
    CASE o_orderstatus WHEN 'F' THEN 'Order Placed' WHEN 'O' THEN 'No Order' ELSE 'Closed' END AS visit_outcome
  FROM orders JOIN sd_outlets u ON o_custkey = outlet_id),
facts AS (
  SELECT o_orderkey AS order_id, o_orderdate AS order_date, strftime(o_orderdate, '%Y-%m') AS month, u.*, l_partkey AS sku_id, sku_name, franchise_name, category_name, l_quantity AS qty_ordered,
    CASE WHEN l_returnflag = 'R' THEN 0.0::DOUBLE ELSE l_quantity END AS qty_delivered, CASE WHEN l_returnflag = 'R' THEN 0.0::DOUBLE ELSE l_quantity END * (l_extendedprice / l_quantity) AS revenue
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN sd_outlets u ON o_custkey = outlet_id JOIN sd_products p ON l_partkey = p.sku_id WHERE o_orderstatus = 'F'),
sd_inventory AS (
  SELECT *, 2 * base AS opening_stock, greatest(3 * base - qty_sold, 0.0::DOUBLE) AS closing_stock, greatest(3 * base - qty_sold, 0.0::DOUBLE) < 5 AS stockout FROM (
    SELECT strftime(l_shipdate, '%Y-%m') AS month, wd_id, state_name, p.sku_id, category_name, CAST(max(pack_size) AS DOUBLE) AS base, sum(l_quantity) AS qty_sold
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN sd_outlets ON o_custkey = outlet_id JOIN sd_products p ON l_partkey = p.sku_id GROUP BY ALL) t)
"""
