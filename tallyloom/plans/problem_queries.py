"""Queries of the general problems: hot keys, trailing periods, feature tables, orphan references."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.keys import clean_key, fold_title, month_of
from tallyloom.operators.features import MOST_KINDS, feature_table, heavy_entities
from tallyloom.operators.orphans import find_orphans
from tallyloom.operators.positions import counted_totals, running_totals
from tallyloom.operators.rolling import rolling_totals
from tallyloom.sources.tables import order_facts, table

#: The calendar of the tables.
FIRST_DAY, LAST_DAY = date(2024, 8, 1), date(2026, 7, 31)
MONTH_ENDS = [d for d in (FIRST_DAY + timedelta(days=i) for i in range((LAST_DAY - FIRST_DAY).days + 1)) if (d + timedelta(days=1)).day == 1]
#: Share of all lines from which a SKU is hot.
HOT_SHARE = 0.04


def outlet_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "outlets").select(clean_key("outlet_id").alias("outlet_id")).where(F.col("outlet_id").isNotNull()).distinct()


def _sku_totals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    lines = order_facts(spark, sf_dir, "sku_id", "qty_delivered").where(F.col("sku_id").isNotNull())
    totals, n_lines = counted_totals(lines, ["sku_id"], "qty_delivered")
    return totals.select("sku_id", F.col("n_rows").alias("n_lines"), F.col("total").alias("qty_delivered")), n_lines


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SKUs on at least HOT_SHARE of the lines with a SKU key."""
    totals, n_lines = _sku_totals(spark, sf_dir)
    return totals.where(F.col("n_lines") >= HOT_SHARE * n_lines).select("sku_id")


def p1_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and delivered quantity of every SKU key."""
    return _sku_totals(spark, sf_dir)[0]


def p1_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line with the quantity delivered of its SKU so far, by order date and line."""
    lines = order_facts(spark, sf_dir, "sku_id", "order_date", "qty_delivered").where(F.col("sku_id").isNotNull() & F.col("order_date").isNotNull())
    out = running_totals(lines, ["sku_id"], [F.col("order_date"), F.col("line_id")], "qty_delivered")
    return out.select("line_id", "sku_id", F.col("row_no").alias("line_no"), F.col("running_total").alias("qty_so_far"))


def _outlet_rolling(spark: SparkSession, sf_dir: str, report_days: list[date] | None) -> DataFrame:
    lines = order_facts(spark, sf_dir, "outlet_id", "order_date", "qty_delivered")
    return rolling_totals(lines, outlet_keys(spark, sf_dir), "outlet_id", "order_date", "qty_delivered", FIRST_DAY, LAST_DAY, (7, 30), report_days)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlets and month ends with nothing delivered in 7 days but something in 30."""
    ends = _outlet_rolling(spark, sf_dir, MONTH_ENDS)
    return ends.where("total_7 = 0 AND total_30 > 0").select("outlet_id", F.date_format("day", "yyyy-MM-dd").alias("month_end"))


def p2_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals and averages of 7 and 30 days for every outlet and calendar day."""
    return _outlet_rolling(spark, sf_dir, None)


def p3_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per outlet: lines, days since the latest order and delivered quantity, over all and for each SKU of products."""
    skus = [r[0] for r in table(spark, sf_dir, "products").select(clean_key("sku_id").alias("k")).where("k IS NOT NULL").distinct().orderBy("k").limit(MOST_KINDS + 1).collect()]  # the bounded type list; feature_table refuses more
    lines = order_facts(spark, sf_dir, "outlet_id", "sku_id", "order_date", "qty_delivered")
    heavy = heavy_entities(table(spark, sf_dir, "order_lines").select(clean_key("outlet_id").alias("outlet_id")), "outlet_id")
    return feature_table(lines, outlet_keys(spark, sf_dir), skus, "outlet_id", "sku_id", "order_date", "qty_delivered", "line_id", LAST_DAY, heavy)


def p3_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature table with one row per outlet and SKU; the SKU is ALL over all lines."""
    wide = p3_features(spark, sf_dir)
    skus = [c[2:] for c in wide.columns if c.startswith("n_")]
    sets = [("ALL", "n", "days", "total"), *[(s, f"n_{s}", f"days_{s}", f"total_{s}") for s in skus]]
    packed = F.array(*[F.struct(F.lit(s).alias("sku_id"), F.col(n).alias("n_lines"), F.col(d).alias("days_since"), F.col(t).alias("qty_delivered")) for s, n, d, t in sets])
    return wide.select("outlet_id", F.explode(packed).alias("r")).select("outlet_id", "r.*")


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reference of order lines and relationships, one row per row sent."""
    lines = table(spark, sf_dir, "order_lines").select(
        F.lit("order_lines").alias("table_name"),
        F.col("line_id").alias("record_id"),
        F.col("loaded_at").alias("made_at"),
        F.explode(
            F.array(
                F.struct(F.lit("sku_id").alias("field_name"), F.lit("products").alias("target"), clean_key("sku_id").alias("key")),
                F.struct(F.lit("outlet_id").alias("field_name"), F.lit("outlets").alias("target"), clean_key("outlet_id").alias("key")),
            )
        ).alias("r"),
    )
    edges = table(spark, sf_dir, "relationships").select(
        F.lit("relationships").alias("table_name"),
        F.col("id").alias("record_id"),
        F.col("loaded_at").alias("made_at"),
        F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.lit("entities").alias("target"), fold_title(f).alias("key")) for f in ("source", "target")])).alias("r"),
    )
    return lines.unionByName(edges).select("table_name", "record_id", "made_at", "r.*")


def _parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    never = F.lit(None).cast("timestamp_ntz")
    rows = [
        table(spark, sf_dir, name).select(F.lit(name).alias("target"), key.alias("key"), F.col("loaded_at").alias("known_from"), until.alias("known_until"))
        for name, key, until in (
            ("products", clean_key("sku_id"), F.col("deleted_at")),
            ("outlets", clean_key("outlet_id"), F.col("deleted_at")),
            ("entities", fold_title("title"), never),
        )
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of lines and relationships that in some row name no product, outlet or entity in force."""
    found = find_orphans(_references(spark, sf_dir), _parents(spark, sf_dir))
    return found.select("table_name", "field_name", "record_id").distinct()


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references per table, field, month loaded and reason; a record counts once in a month."""
    found = find_orphans(_references(spark, sf_dir), _parents(spark, sf_dir)).withColumn("month", month_of("made_at"))
    once = found.select("table_name", "field_name", "month", "reason", "record_id").distinct()
    return once.groupBy("table_name", "field_name", "month", "reason").agg(F.count(F.lit(1)).alias("n_records"))


QUERIES = {f.__name__: f for f in (p1_found, p1_totals, p1_running, p2_found, p2_rolling, p3_features, p3_long, p6_found, p6_report)}

_BLANKS = "' ' || chr(9) || chr(160)"
_KEY = lambda c: f"nullif(upper(trim({c}, {_BLANKS})), '')"
#: Titles as the engine folds them; white space as Unicode has it.
_FOLD = lambda c: f"nullif(trim(regexp_replace(upper({c}), '[_\\s\\x{{0b}}\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g')), '')"
LINES_SQL = f"""lines AS (
  SELECT line_id, r.sku_id, r.outlet_id, r.order_date, r.qty_delivered, r.qty_ordered, r.unit_price FROM (
    SELECT line_id, max({{'loaded_at': loaded_at, 'sku_id': {_KEY('sku_id')}, 'outlet_id': {_KEY('outlet_id')}, 'order_date': order_date,
                          'qty_delivered': qty_delivered, 'qty_ordered': qty_ordered, 'unit_price': unit_price}}) AS r FROM order_lines GROUP BY line_id))"""
OUTLETS_SQL = f"known_outlets AS (SELECT DISTINCT {_KEY('outlet_id')} AS outlet_id FROM outlets WHERE {_KEY('outlet_id')} IS NOT NULL)"
_ROLLING = f"""WITH {LINES_SQL}, {OUTLETS_SQL},
days AS (SELECT CAST(d AS DATE) AS day FROM generate_series(DATE '2024-07-03', DATE '2026-07-31', INTERVAL 1 DAY) t(d)),
grid AS (SELECT o.outlet_id, d.day, coalesce(s.q, 0) AS q FROM known_outlets o CROSS JOIN days d
         LEFT JOIN (SELECT outlet_id, order_date, sum(qty_delivered) AS q FROM lines GROUP BY ALL) s ON s.outlet_id = o.outlet_id AND s.order_date = d.day),
rolled AS (SELECT outlet_id, day,
  CAST(sum(q) OVER (PARTITION BY outlet_id ORDER BY day ROWS 6 PRECEDING) AS BIGINT) AS total_7, CAST(sum(q) OVER (PARTITION BY outlet_id ORDER BY day ROWS 29 PRECEDING) AS BIGINT) AS total_30 FROM grid)"""
_ORPHANS = f"""WITH parents AS (
  SELECT target, k, min(a) AS a, min(u) AS u FROM (
    SELECT 'products' AS target, {_KEY('sku_id')} AS k, loaded_at AS a, deleted_at AS u FROM products
    UNION ALL SELECT 'outlets', {_KEY('outlet_id')}, loaded_at, deleted_at FROM outlets
    UNION ALL SELECT 'entities', {_FOLD('title')}, loaded_at, NULL FROM entities) p WHERE k IS NOT NULL GROUP BY target, k),
refs AS (
  SELECT 'order_lines' AS table_name, 'sku_id' AS field_name, line_id AS record_id, loaded_at, 'products' AS target, {_KEY('sku_id')} AS k FROM order_lines
  UNION ALL SELECT 'order_lines', 'outlet_id', line_id, loaded_at, 'outlets', {_KEY('outlet_id')} FROM order_lines
  UNION ALL SELECT 'relationships', 'source', id, loaded_at, 'entities', {_FOLD('source')} FROM relationships
  UNION ALL SELECT 'relationships', 'target', id, loaded_at, 'entities', {_FOLD('target')} FROM relationships),
cases AS (
  SELECT r.*, CASE WHEN p.k IS NULL THEN 'missing' WHEN p.a > r.loaded_at THEN 'early' WHEN p.u <= r.loaded_at THEN 'deleted' END AS reason
  FROM refs r LEFT JOIN parents p ON p.target = r.target AND p.k = r.k WHERE r.k IS NOT NULL)"""

_LONG = f"""WITH {LINES_SQL}, {OUTLETS_SQL}, ours AS (SELECT * FROM lines WHERE outlet_id IS NOT NULL),
everyone AS (SELECT outlet_id FROM known_outlets UNION SELECT outlet_id FROM ours), types AS (SELECT DISTINCT {_KEY('sku_id')} AS sku_id FROM products),
marks AS (SELECT outlet_id, sku_id, order_date, qty_delivered FROM ours WHERE sku_id IN (SELECT sku_id FROM types) UNION ALL SELECT outlet_id, 'ALL', order_date, qty_delivered FROM ours)
SELECT e.outlet_id, t.sku_id, count(m.outlet_id) AS n_lines, date_diff('day', max(m.order_date), DATE '2026-07-31') AS days_since, CAST(coalesce(sum(m.qty_delivered), 0) AS BIGINT) AS qty_delivered
FROM everyone e CROSS JOIN (SELECT sku_id FROM types UNION ALL SELECT 'ALL') t LEFT JOIN marks m ON m.outlet_id = e.outlet_id AND m.sku_id = t.sku_id GROUP BY e.outlet_id, t.sku_id"""
_NAMED = "CASE WHEN sku_id = 'ALL' THEN '{0}' ELSE '{0}_' || sku_id END"
_WIDE = f"""WITH cells AS MATERIALIZED ({_LONG}), named AS (SELECT outlet_id, {_NAMED.format('n')} AS name, n_lines AS v FROM cells UNION ALL SELECT outlet_id, {_NAMED.format('days')}, days_since FROM cells UNION ALL SELECT outlet_id, {_NAMED.format('total')}, qty_delivered FROM cells)
SELECT * FROM (PIVOT named ON name USING max(v) GROUP BY outlet_id)"""

ORACLES = {
    "p1_found": f"WITH {LINES_SQL} SELECT sku_id FROM lines WHERE sku_id IS NOT NULL GROUP BY sku_id HAVING count(*) >= {HOT_SHARE} * (SELECT count(*) FROM lines WHERE sku_id IS NOT NULL)",
    "p1_totals": f"WITH {LINES_SQL} SELECT sku_id, count(*) AS n_lines, CAST(coalesce(sum(qty_delivered), 0) AS BIGINT) AS qty_delivered FROM lines WHERE sku_id IS NOT NULL GROUP BY sku_id",
    "p1_running": f"""WITH {LINES_SQL} SELECT line_id, sku_id, row_number() OVER w - 1 AS line_no, CAST(sum(coalesce(qty_delivered, 0)) OVER w AS BIGINT) AS qty_so_far
FROM lines WHERE sku_id IS NOT NULL AND order_date IS NOT NULL WINDOW w AS (PARTITION BY sku_id ORDER BY order_date, line_id ROWS UNBOUNDED PRECEDING)""",
    "p2_found": f"{_ROLLING} SELECT outlet_id, strftime(day, '%Y-%m-%d') AS month_end FROM rolled WHERE day >= DATE '2024-08-01' AND day = last_day(day) AND total_7 = 0 AND total_30 > 0",
    "p2_rolling": f"{_ROLLING} SELECT outlet_id, day, total_7, CAST(total_7 AS DOUBLE) / 7 AS avg_7, total_30, CAST(total_30 AS DOUBLE) / 30 AS avg_30 FROM rolled WHERE day >= DATE '2024-08-01'",
    "p3_features": _WIDE,
    "p3_long": _LONG,
    "p6_found": f"{_ORPHANS} SELECT DISTINCT table_name, field_name, record_id FROM cases WHERE reason IS NOT NULL",
    "p6_report": f"""{_ORPHANS} SELECT table_name, field_name, strftime(loaded_at, '%Y-%m') AS month, reason, count(DISTINCT record_id) AS n_records
FROM cases WHERE reason IS NOT NULL GROUP BY ALL""",
}
