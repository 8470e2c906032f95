"""Queries that scan answers and texts: claim blocks, stems, value states, provenance, trends, rankings, evidence scope. With their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions.keys import month_words
from tallyloom.operators import documents, grounding, kpi
from tallyloom.plans.kpi_queries import _sales
from tallyloom.plans.rollup_queries import CATEGORIES
from tallyloom.plans.text_queries import _A, _NO, _STATES, _claims, rendered
from tallyloom.sources.warehouse import WAREHOUSE_SQL, Warehouse

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str, views: bool = True) -> Callable:
    def add(f: Callable[[Warehouse], DataFrame]) -> Callable[[Warehouse], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Warehouse(spark, sf_dir))
        ORACLES[f.__name__] = (WAREHOUSE_SQL if views else "") + sql
        return f

    return add


_E = f", e AS ({_sales('state_name, month, category_name')})"


def _sold(w):
    return kpi.sku_sales(w, ["state_name", "month", "category_name"])


@query("SELECT strftime(m, '%Y-%m') AS month, count(order_id) AS n_orders FROM generate_series((SELECT date_trunc('month', min(o_orderdate)) FROM orders), (SELECT date_trunc('month', max(o_orderdate)) FROM orders), INTERVAL 1 MONTH) t(m) LEFT JOIN (SELECT DISTINCT order_id, month FROM facts) f ON f.month = strftime(m, '%Y-%m') GROUP BY 1")
def sc_08_month_series(w):
    """Placed orders of every month from the first to the last, also of months without any."""
    o = w._table("orders").agg(F.date_trunc("month", F.min("o_orderdate")).cast("date").alias("a"), F.date_trunc("month", F.max("o_orderdate")).cast("date").alias("b"))
    months = o.select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 MONTH"))).alias("m")).select(F.date_format("m", "yyyy-MM").alias("month"))
    n = w.facts.groupBy("month").agg(F.countDistinct("order_id").alias("n"))
    return months.join(n, "month", "left").select("month", F.coalesce("n", F.lit(0)).alias("n_orders"))


_STEM = "CASE " + " ".join(f"WHEN w LIKE '%{e}' AND length(w) >= {len(e) + 3} THEN substr(w, 1, length(w) - {len(e)})" for e in grounding.STEM_ENDINGS) + " ELSE w END"


@query(f"SELECT {_STEM} AS stem, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(description), '[a-z]+')) AS w FROM relationships) GROUP BY 1", False)
def sc_26_stems(w):
    """Stems of the words of edge descriptions."""
    words = w._table("relationships").select(F.explode(grounding.tokens(F.col("description"))).alias("w"))
    return words.groupBy(grounding.stem(F.col("w")).alias("stem")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{_E} SELECT state_name || '_' || month AS answer_id, category_name AS claim_id, state_name AS entity, CASE WHEN {_NO} % 4 <> 0 THEN qty_delivered END AS value, {_NO} % 4 = 0 AS malformed, CASE WHEN {_NO} % 2 = 0 THEN 0 ELSE 1 END AS n_citations FROM e")
def sc_24_claim_blocks(w):
    """Answers written with a block of claims and parsed again; in every fourth month the values are no numbers, in every second one the citations are missing."""
    no = F.substring("month", 6, 2).cast("int")
    value = F.when(no % 4 == 0, F.lit("n/a")).otherwise(F.format_string("%.1f%%", F.col("qty_delivered")))
    cited = F.when(no % 2 != 0, F.array(F.lit("d1")))
    one = F.struct(F.col("category_name").alias("claim_id"), F.col("state_name").alias("entity"), value.alias("value"), cited.alias("citations"))
    answers = _sold(w).groupBy(F.concat_ws("_", "state_name", "month").alias("answer_id")).agg(F.concat(F.lit("Sales went well.\n\n```json\n"), F.to_json(F.collect_list(one)), F.lit("\n```")).alias("text"))
    found = grounding.claims_in(answers)
    return found.select("answer_id", "claim_id", "entity", "value", "malformed", F.size("citations").alias("n_citations"))


@query(f"{_A} SELECT state_name || '|' || month || '|' || metric AS claim_id, CASE WHEN {_NO} = 12 THEN 'unknown' WHEN {_NO} % 3 = 0 THEN 'contradicted' ELSE 'supported' END AS state FROM f")
def gr_27_value_states(w):
    """Claims against the facts of the documents, of which those of December are missing."""
    facts = documents.state_facts(rendered(w))
    known = facts.where("month NOT LIKE '%-12'")
    return grounding.value_states(_claims(w, facts), known, ["state_name", "month", "metric"]).select("claim_id", "state")


@query(f"{_A} SELECT state_name || '|' || month || '|' || metric AS claim_id, doc_id AS citation, true AS has_metric FROM f WHERE {_NO} % 5 <> 0 AND {_NO} % 3 <> 0")
def gr_45_provenance(w):
    """The sentence behind each supported claim."""
    docs = rendered(w)
    no = F.substring("month", 6, 2).cast("int")
    claims = _claims(w, documents.state_facts(docs)).where((no % 5 != 0) & (no % 3 != 0))
    found = grounding.provenance(claims, docs.select(F.col("doc_id").alias("id"), "text"))
    label = claims.select("claim_id", "metric_label")
    return found.join(label, "claim_id").select("claim_id", "citation", grounding.mentions(F.col("sentence"), F.col("metric_label")).alias("has_metric"))


@query(f"{_E} SELECT entity, state, category FROM (SELECT DISTINCT lower(state_name || ' ' || category_name) AS entity, lower(state_name) AS state, lower(category_name) AS category FROM e UNION SELECT DISTINCT category_name || ' ' || state_name, NULL, NULL FROM e)")
def gr_11_state_category(w):
    """Composite entities taken apart; the other way round they are none."""
    named = _sold(w).select(F.explode(F.array(F.lower(F.concat_ws(" ", "state_name", "category_name")), F.concat_ws(" ", "category_name", "state_name"))).alias("entity")).distinct()
    return named.withColumn("p", grounding.state_and_category(F.col("entity"), _STATES, CATEGORIES)).select("entity", "p.state", "p.category")


@query(f"{_E}, t AS (SELECT state_name, month, sum(qty_delivered) AS q FROM e GROUP BY 1, 2) SELECT state_name, month, q - lag(q) OVER (PARTITION BY state_name ORDER BY month) AS delta FROM t")
def gr_16_trend(w):
    """Changes between neighbouring months, named later month first."""
    s = Window.partitionBy("state_name").orderBy("month")
    t = _sold(w).groupBy("state_name", "month").agg(F.sum("qty_delivered").alias("q")).select("state_name", "month", "q", F.lag("q").over(s).alias("before"), F.lag("month").over(s).alias("earlier"))
    return t.select("state_name", "month", grounding.trend_delta(month_words("month"), F.col("q"), month_words("earlier"), F.col("before")).alias("delta"))


_RANKED = "r AS (SELECT *, row_number() OVER (PARTITION BY state_name, month ORDER BY qty_delivered DESC, category_name) AS k FROM e)"


@query(f"{_E}, {_RANKED} SELECT state_name, month, coalesce(string_agg(category_name, ', ' ORDER BY category_name) FILTER (k = 3), '') AS wrong, string_agg(category_name, ', ' ORDER BY category_name) FILTER (k = 1) AS left_out FROM r GROUP BY 1, 2 HAVING max(k) >= 2")
def gr_40_top_n(w):
    """An answer that names the second and third category as the first two: what it has wrong and leaves out."""
    ranked = _sold(w).withColumn("rank_no", F.row_number().over(Window.partitionBy("state_name", "month").orderBy(F.col("qty_delivered").desc(), "category_name")))
    return grounding.ranking_holds(ranked.where("rank_no IN (2, 3)"), ranked, ["state_name", "month"], "category_name", 2)


@query(f"""{_E}, m AS (SELECT DISTINCT state_name, month FROM e), q AS (SELECT s.state_name, strftime(d, '%Y-%m') AS asked FROM (SELECT DISTINCT state_name FROM m) s, generate_series(TIMESTAMP '1994-11-01', TIMESTAMP '2002-02-01', INTERVAL 3 MONTH) t(d))
SELECT state_name, asked, CASE WHEN EXISTS (SELECT 1 FROM m WHERE m.state_name = q.state_name AND m.month = asked) THEN 'month' WHEN EXISTS (SELECT 1 FROM m WHERE m.state_name = q.state_name AND substr(m.month, 1, 4) = substr(asked, 1, 4)) THEN 'year' ELSE 'latest' END AS scope FROM q""")
def sk_09_scope(w):
    """The scope that evidence for a month can be had in: the month, else its year, else the latest month."""
    have = w.facts.select("state_name", "month").distinct()
    days = F.sequence(F.to_date(F.lit("1994-11-01")), F.to_date(F.lit("2002-02-01")), F.expr("INTERVAL 3 MONTH"))
    asked = have.select("state_name").distinct().select("state_name", F.explode(F.transform(days, lambda d: F.date_format(d, "yyyy-MM"))).alias("asked"))
    in_month = have.select("state_name", F.col("month").alias("asked"), F.lit(True).alias("m"))
    in_year = have.select("state_name", F.substring("month", 1, 4).alias("y")).distinct().withColumn("has_year", F.lit(True))
    j = asked.withColumn("y", F.substring("asked", 1, 4)).join(in_month, ["state_name", "asked"], "left").join(in_year, ["state_name", "y"], "left")
    return j.select("state_name", "asked", F.when(F.col("m"), "month").when(F.col("has_year"), "year").otherwise("latest").alias("scope"))


@query(f"{_A} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY metric) AS fact_no, metric || '=' || CAST(value AS VARCHAR) AS fact FROM f")
def tx_10_numbered_facts(w):
    """The facts of each document as a numbered list."""
    f = documents.state_facts(rendered(w))
    return f.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("metric")).alias("fact_no"), F.concat_ws("=", "metric", F.col("value").cast("string")).alias("fact"))
