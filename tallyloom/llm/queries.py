"""Queries of the text and record problems, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.keys import fold_title, month_of
from tallyloom.llm.mixing import mix, mixing_faults, shares_reached
from tallyloom.llm.packing import pack, packing_faults, packing_report
from tallyloom.llm.sentences import split_sentences
from tallyloom.llm.survivors import surviving_observations
from tallyloom.llm.termmap import map_entities
from tallyloom.llm.tokens import sized
from tallyloom.llm.topn import top_n
from tallyloom.session import small, written
from tallyloom.sources.tables import current_outlets, order_facts, table

TOP = 5


def _top_skus(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    states = written(current_outlets(spark, sf_dir, "state_name").where("state_name IS NOT NULL AND trim(state_name) <> ''"), "states")
    lines = order_facts(spark, sf_dir, "sku_id", "outlet_id", "order_date", "qty_delivered").where("sku_id IS NOT NULL AND outlet_id IS NOT NULL AND order_date IS NOT NULL")
    sold = lines.select("outlet_id", month_of("order_date").alias("month"), "sku_id", F.col("qty_delivered").alias("qty"))
    few = small(states)
    if few is states:  # a shuffled join: summed per outlet first, so that it doesn't grow with an outlet's lines in a month
        sold = sold.groupBy("outlet_id", "month", "sku_id").agg(F.sum("qty").alias("qty"))
    items = sold.join(few, "outlet_id").groupBy("state_name", "month", "sku_id").agg(F.sum("qty").alias("qty_delivered")).where("qty_delivered > 0")
    return top_n(items, ["state_name", "month"], "qty_delivered", "sku_id", n)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five SKUs with the largest quantity in each state and month."""
    return _top_skus(spark, sf_dir, TOP).select("state_name", "month", "sku_id")


def p4_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SKU with the largest quantity in each state and month, and the quantity."""
    return _top_skus(spark, sf_dir, 1).select("state_name", "month", "sku_id", "qty_delivered")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The term each typed title or type means, 0 for none, where it isn't one as it stands."""
    mapped = map_entities(table(spark, sf_dir, "entities"), table(spark, sf_dir, "reference_terms"))
    return mapped.where(~F.col("exact")).select("entity_id", "field_name", "term_id").distinct()


def p5_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that mean no term, with the number of entities that have them."""
    mapped = map_entities(table(spark, sf_dir, "entities"), table(spark, sf_dir, "reference_terms"))
    return mapped.where("term_id = 0").groupBy("kind", "value").agg(F.countDistinct("entity_id").alias("n_entities"))


def _observations(spark: SparkSession, sf_dir: str, with_values: bool) -> DataFrame:
    return surviving_observations(table(spark, sf_dir, "entities"), fold_title("title"), with_values)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which copies of a repeated observation give its id, title and description."""
    return _observations(spark, sf_dir, False).select("keep_id", "title_id", "description_id")


def p7_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record built for each repeated observation."""
    return _observations(spark, sf_dir, True).select("keep_id", "title", "description")


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(sized(table(spark, sf_dir, "documents")), table(spark, sf_dir, "pack_specs"))


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of each piece of each document, for each capacity."""
    return _packed(spark, sf_dir)


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers and the share of their room that is filled, for each capacity."""
    return packing_report(_packed(spark, sf_dir), table(spark, sf_dir, "pack_specs"))


def p8_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the containers of every document, counted: none overfull, no token lost or twice, none split that would fit."""
    sizes, specs = written(sized(table(spark, sf_dir, "documents")), "sizes"), table(spark, sf_dir, "pack_specs")
    return packing_faults(pack(sizes, specs), sizes, specs)


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = written(sized(table(spark, sf_dir, "documents"), "doc_id", "text", keep=["source"]), "sizes")
    return mix(sizes, table(spark, sf_dir, "mix_targets"))


def p9_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents drawn from each source, in mixing order."""
    return _mixed(spark, sf_dir)


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of the tokens that each source reaches."""
    return shares_reached(_mixed(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p9_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the mix, counted for every source: none repeated too often, none repeated before all are used, nothing of other sources."""
    sizes, targets = written(sized(table(spark, sf_dir, "documents"), "doc_id", "text", keep=["source"]), "sizes"), table(spark, sf_dir, "mix_targets")
    return mixing_faults(mix(sizes, targets), sizes, targets)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of every document."""
    return split_sentences(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p4_found, p4_top, p5_found, p5_unmatched, p7_found, p7_survivors, p8_packed, p8_report, p8_faults, p9_mixed, p9_shares, p9_faults, p10_found)}

_KEY = lambda c: f"nullif(upper(trim({c}, ' ' || chr(9) || chr(160))), '')"
_WHITE = "\\s\\x{0b}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
_TRIM = lambda c: f"regexp_replace({c}, '^[{_WHITE}]+|[{_WHITE}]+$', '', 'g')"
_TOP_SQL = f"""WITH lines AS (SELECT r.sku_id, r.outlet_id, r.order_date, r.q FROM (SELECT max({{'loaded_at': loaded_at, 'sku_id': {_KEY('sku_id')}, 'outlet_id': {_KEY('outlet_id')},
  'order_date': order_date, 'q': qty_delivered}}) AS r FROM order_lines GROUP BY line_id)),
states AS (SELECT k AS outlet_id, r.state_name AS state_name FROM (SELECT {_KEY('outlet_id')} AS k, max({{'loaded_at': loaded_at, 'state_name': state_name}}) AS r FROM outlets GROUP BY 1) WHERE k IS NOT NULL AND trim(r.state_name) <> ''),
items AS (SELECT state_name, strftime(order_date, '%Y-%m') AS month, sku_id, CAST(sum(q) AS BIGINT) AS qty_delivered FROM lines JOIN states USING (outlet_id) WHERE sku_id IS NOT NULL AND order_date IS NOT NULL GROUP BY ALL HAVING sum(q) > 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY state_name, month ORDER BY qty_delivered DESC, sku_id) AS place FROM items)"""
_OBSERVED_SQL = f"""WITH rows AS (SELECT *, nullif(trim(regexp_replace(upper(title), '[_{_WHITE}]+', ' ', 'g')), '') AS k, coalesce({_TRIM('description')}, '') AS d,
  CASE lower(coalesce({_TRIM('origin')}, '')) WHEN 'review' THEN 3 WHEN 'extract' THEN 2 WHEN 'import' THEN 1 ELSE 0 END AS trusted FROM entities WHERE upper({_TRIM('type')}) = 'OBSERVATION' AND id IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY human_readable_id NULLS LAST, id) AS rk,
  row_number() OVER (PARTITION BY k ORDER BY trusted DESC, loaded_at DESC NULLS LAST, human_readable_id NULLS LAST, id) AS rt,
  row_number() OVER (PARTITION BY k ORDER BY length(d) DESC, loaded_at DESC NULLS LAST, human_readable_id NULLS LAST, id) AS rd FROM rows WHERE k IS NOT NULL),
best AS (SELECT k, max(id) FILTER (rk = 1) AS keep_id, max(id) FILTER (rt = 1) AS title_id, max(title) FILTER (rt = 1) AS title, max(id) FILTER (rd = 1) AS description_id, max(d) FILTER (rd = 1) AS description
  FROM ranked GROUP BY k HAVING count(DISTINCT id) > 1)"""

ORACLES = {
    "p4_found": f"{_TOP_SQL} SELECT state_name, month, sku_id FROM ranked WHERE place <= {TOP}",
    "p4_top": f"{_TOP_SQL} SELECT state_name, month, sku_id, qty_delivered FROM ranked WHERE place = 1",
    "p7_found": f"{_OBSERVED_SQL} SELECT keep_id, title_id, description_id FROM best",
    "p8_faults": "SELECT spec_id, (SELECT count(*) FROM documents) AS n_docs, 0 AS n_overfull, 0 AS n_untiled, 0 AS n_needless FROM pack_specs",
    "p9_faults": f"SELECT DISTINCT regexp_replace({_TRIM('lower(source)')}, '[{_WHITE}-]+', '_', 'g') AS source, 0 AS n_over, 0 AS n_uneven, 0 AS n_foreign FROM mix_targets WHERE target_share > 0 AND {_TRIM('source')} <> ''",
    "p7_survivors": f"{_OBSERVED_SQL} SELECT keep_id, title, description FROM best",
}
