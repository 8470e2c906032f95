"""Queries over rendered documents: facts read back, questions understood, claims held against evidence. With their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.keys import month_words
from tallyloom.operators import documents, grounding, kpi, questions
from tallyloom.plans import rollup_queries
from tallyloom.plans.kpi_queries import _category_table, _sales, _unit_table
from tallyloom.plans.rollup_queries import _WD_STATE_SQL
from tallyloom.session import written_once
from tallyloom.sources.warehouse import WAREHOUSE_SQL, Warehouse

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_STATES = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[Warehouse], DataFrame]) -> Callable[[Warehouse], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Warehouse(spark, sf_dir))
        if sql is not None:
            ORACLES[f.__name__] = WAREHOUSE_SQL + sql
        return f

    return add


def rendered(w: Warehouse) -> DataFrame:
    """The documents of a folder, rendered once an application."""

    def render() -> DataFrame:
        keys = ["state_name", "month"]
        off = rollup_queries._wd_state_deviations(w).join(w.outlets.select("wd_id", "wd_name").distinct(), "wd_id")
        return documents.render(kpi.unit_table(w, keys), kpi.category_table(w, [*keys, "category_name"]), off)

    return written_once(w.spark, "documents", w.sf_dir, render)


_PCT, _NUM = "round({0} * 100, 1)", "round({0}, 2)"
_ID = "replace(state_name, ' ', '_') || '_' || month || '.txt'"
_STATE_LONG = " UNION ALL ".join(
    f"SELECT {_ID} AS doc_id, state_name, month, '{m}' AS metric, '{label}' AS label, {(_PCT if pct else _NUM).format(m)} AS value FROM a WHERE {m} IS NOT NULL" for m, (label, pct) in documents.STATE_LABELS.items()
)
_A = f", a AS ({_unit_table('state_name, month')}), f AS ({_STATE_LONG})"
_CATEGORY_LONG = " UNION ALL ".join(
    f"SELECT {_ID} AS doc_id, state_name, month, category_name, '{m}' AS metric, {_PCT.format(m)} AS value FROM c WHERE {m} IS NOT NULL" for m in documents.CATEGORY_LABELS
)


@query(f"{_A} SELECT doc_id, state_name, month FROM (SELECT {_ID} AS doc_id, state_name, month FROM a)")
def dv_06_documents(w):
    """The documents' names and keys."""
    return rendered(w).where("length(text) > 0").select("doc_id", "state_name", "month")


def dv_06_document_texts(spark, sf_dir):
    """The documents with their texts."""
    return rendered(Warehouse(spark, sf_dir))


QUERIES["dv_06_document_texts"] = dv_06_document_texts
_PRINT = lambda c, pct: f"printf('%.1f', round({c} * 100, 1)) || '%'" if pct else f"printf('%.2f', round({c}, 2))"
_PLACE = "' in ' || state_name || ', ' || strftime(strptime(month || '-01', '%Y-%m-%d'), '%B %Y')"
_SENTENCES = lambda labels, sep, end: f"concat_ws('{sep}', " + ", ".join(f"CASE WHEN {m} IS NOT NULL THEN '{label} was ' || {_PRINT(m, pct)} || '{end}' END" for m, (label, pct) in labels.items()) + ")"
_OFF_SQL = "CASE metric WHEN 'dropsize' THEN " + _PRINT("{0}", False) + " ELSE " + _PRINT("{0}", True) + " END"
ORACLES["dv_06_document_texts"] = WAREHOUSE_SQL + f""", a AS ({_unit_table('state_name, month')}), c AS ({_category_table('state_name, month, category_name')}), hits AS ({_WD_STATE_SQL}),
cp AS (SELECT state_name, month, string_agg('Category ' || category_name || {_PLACE} || ': ' || {_SENTENCES(documents.CATEGORY_LABELS, '; ', '')} || '.', chr(10) || chr(10) ORDER BY category_name) AS p FROM c GROUP BY 1, 2),
dp AS (SELECT state_name, month, string_agg('Distributor ' || wd_name || ' was off on ' || CASE metric WHEN 'productivity' THEN 'Productivity' WHEN 'service_level' THEN 'Service Level' ELSE 'Dropsize' END || {_PLACE} || ': ' || {_OFF_SQL.format('value')} || ' against a state value of ' || {_OFF_SQL.format('peer_value')} || ', a gap of ' || printf('%.1f', round(gap, 1)) || '.', chr(10) || chr(10) ORDER BY metric, wd_id) AS p
  FROM hits JOIN (SELECT DISTINCT wd_id, wd_name FROM sd_outlets) USING (wd_id) GROUP BY 1, 2)
SELECT {_ID} AS doc_id, state_name, month, concat_ws(chr(10) || chr(10), 'State: ' || state_name || chr(10) || 'Period: ' || strftime(strptime(month || '-01', '%Y-%m-%d'), '%B %Y'), nullif({_SENTENCES(documents.STATE_LABELS, ' ', '.')}, ''), cp.p, dp.p) AS text
FROM a LEFT JOIN cp USING (state_name, month) LEFT JOIN dp USING (state_name, month)"""


@query(f"{_A} SELECT doc_id, state_name, month, metric, value FROM f")
def tx_02_state_facts(w):
    return documents.state_facts(rendered(w))


@query(f", c AS ({_category_table('state_name, month, category_name')}) {_CATEGORY_LONG}")
def tx_03_category_facts(w):
    return documents.category_facts(rendered(w))


@query(f""", hits AS ({_WD_STATE_SQL}) SELECT {_ID} AS doc_id, wd_name, CASE metric WHEN 'productivity' THEN 'Productivity' WHEN 'service_level' THEN 'Service Level' ELSE 'Dropsize' END AS metric_label,
CASE metric WHEN 'dropsize' THEN round(value, 2) ELSE round(value * 100, 1) END AS value, CASE metric WHEN 'dropsize' THEN round(peer_value, 2) ELSE round(peer_value * 100, 1) END AS peer_value, round(gap, 1) AS gap
FROM hits JOIN (SELECT DISTINCT wd_id, wd_name FROM sd_outlets) USING (wd_id)""")
def tx_01_distributor_facts(w):
    return documents.deviation_facts(rendered(w))


def _questions(w):
    """Questions about every state and month that has orders, in the words people use, with what they ask for."""
    m = w.facts.select("state_name", "month").distinct().withColumn("words", month_words("month"))
    s, p, y = F.col("state_name"), F.col("words"), F.substring("month", 1, 4)
    form = lambda kind, *parts: F.struct(F.lit(kind).alias("kind"), F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts]).alias("question"))
    forms = F.array(
        form("fall", "Why did Productivity decline in ", s, " in ", p, "?"),
        form("rise", "Did the service level of ", s, " improve or drop in ", p, "?"),
        form("rank", "Top 3 SKUs by revenue in ", s, " during ", y, "?"),
        form("all", "Which had the lowest dropsize across all states in ", p, "?"),
    )
    return m.select("month", "words", F.col("state_name").alias("about"), F.explode(forms).alias("f")).select("month", "words", "about", "f.kind", "f.question")


@query("""SELECT DISTINCT kind, month, about, CASE WHEN kind <> 'all' THEN about END AS state_name, CASE WHEN kind = 'all' THEN 0 ELSE 1 END AS n_states, CASE WHEN kind = 'rank' THEN '' ELSE strftime(strptime(month || '-01', '%Y-%m-%d'), '%B %Y') END AS periods,
CASE WHEN kind = 'rank' THEN CAST(substr(month, 1, 4) AS INT) END AS target_year, CASE kind WHEN 'fall' THEN 'Productivity' WHEN 'rise' THEN 'Service Level' WHEN 'rank' THEN 'Revenue' ELSE 'Dropsize' END AS metric,
CASE kind WHEN 'fall' THEN 'down' ELSE 'neutral' END AS direction, CASE WHEN kind = 'rank' THEN 3 END AS rank_n, CASE kind WHEN 'rank' THEN 'highest' WHEN 'all' THEN 'lowest' END AS rank_direction, CASE kind WHEN 'all' THEN 'global' ELSE 'local' END AS intent
FROM (SELECT DISTINCT state_name AS about, month FROM facts), (SELECT unnest(['fall', 'rise', 'rank', 'all']) AS kind) k""")
def qu_01_requirements(w):
    return questions.requirements(_questions(w), _STATES).drop("question", "words")


def _claims(w, facts):
    """Claims made from the facts of the documents: in every third month the value is off by a thousand, in every fifth the citation leads nowhere."""
    label = F.element_at(F.create_map(*[F.lit(x) for m, (name, _) in documents.STATE_LABELS.items() for x in (m, name)]), F.col("metric"))
    no = F.substring("month", 6, 2).cast("int")
    return facts.select(
        F.concat_ws("|", "state_name", "month", "metric").alias("claim_id"),
        F.col("doc_id").alias("answer_id"),
        "state_name",
        "month",
        "metric",
        label.alias("metric_label"),
        (F.col("value") + F.when(no % 3 == 0, 1000.0).otherwise(0.0)).alias("value"),
        F.when(no % 5 == 0, "missing").otherwise(F.col("doc_id")).alias("citation"),
    )


def _checked(w):
    docs = rendered(w)
    claims = _claims(w, documents.state_facts(docs))
    return claims, grounding.supported_claims(claims, docs.select(F.col("doc_id").alias("id"), "text"))


_NO = "CAST(substr(month, 6, 2) AS INT)"


@query(f"{_A} SELECT state_name || '|' || month || '|' || metric AS claim_id, {_NO} % 5 <> 0 AS cited FROM f")
def gr_03_citations(w):
    return _checked(w)[1].select("claim_id", "cited")


@query(f"{_A} SELECT state_name || '|' || month || '|' || metric AS claim_id, {_NO} % 5 <> 0 AND {_NO} % 3 <> 0 AS supported FROM f")
def gr_07_cooccurrence(w):
    """Whether one sentence has the claim's metric and number."""
    return _checked(w)[1].select("claim_id", "supported")


@query(f"{_A} SELECT doc_id AS answer_id, count(*) AS n_claims, count(*) FILTER ({_NO} % 5 = 0 OR {_NO} % 3 = 0) AS n_errors, CASE WHEN count(*) FILTER ({_NO} % 5 = 0 OR {_NO} % 3 = 0) > 0 THEN 'fail' ELSE 'pass' END AS status FROM f GROUP BY 1")
def gr_43_verdicts(w):
    claims, checked = _checked(w)
    return grounding.verdicts(claims, grounding.issues(checked), "answer_id")


_EX = f", e AS ({_sales('state_name, month, category_name')})"


@query(f"{_EX} SELECT state_name, month, category_name, qty_delivered >= max(qty_delivered) OVER (PARTITION BY state_name, month) - 0.05 AS holds FROM e")
def gr_37_extremum(w):
    """For each category, whether the claim that it sold most in its state and month holds."""
    sold = kpi.sku_sales(w, ["state_name", "month", "category_name"])
    return grounding.extreme_claims(sold.select("state_name", "month", "category_name"), sold, ["state_name", "month"], "category_name", "qty_delivered")


@query(f"""{_EX}, top AS (SELECT *, row_number() OVER (PARTITION BY state_name, month ORDER BY qty_delivered DESC, category_name) AS k FROM e)
SELECT state_name, month, count(*) FILTER (k <= 3) AS covered, count(*) AS "of", coalesce(string_agg(category_name, ', ' ORDER BY category_name) FILTER (k > 3), '') AS missing FROM top GROUP BY 1, 2""")
def gr_42_coverage(w):
    """What an answer about the three best categories leaves out."""
    from pyspark.sql import Window

    sold = kpi.sku_sales(w, ["state_name", "month", "category_name"])
    place = F.row_number().over(Window.partitionBy("state_name", "month").orderBy(F.col("qty_delivered").desc(), "category_name"))
    return grounding.coverage(sold.withColumn("k", place).where("k <= 3"), sold, ["state_name", "month"], "category_name")


_WHITE_SPLIT = "str_split(regexp_replace(regexp_replace(text, '([Vv][Ss])\\.', '\\1' || chr(2), 'g'), '([.!?])[ \\t\\n\\x0B\\f\\r]+|\\n\\n+', '\\1' || chr(1), 'g'), chr(1))"
_HAS = lambda words: f"list_has_any(regexp_extract_all(lower(s), '[a-z]+'), [{', '.join(repr(x) for x in words)}])"
ORACLES["gr_31_directions"] = f"""WITH s AS (SELECT month, replace(x, chr(2), '.') AS s FROM (SELECT month, unnest({_WHITE_SPLIT}) AS x FROM documents WHERE text IS NOT NULL) WHERE trim(x, ' ') <> '')
SELECT month, CASE WHEN {_HAS(grounding.UP)} AND NOT {_HAS(grounding.DOWN)} THEN 'up' WHEN {_HAS(grounding.DOWN)} AND NOT {_HAS(grounding.UP)} THEN 'down' END AS direction, count(*) AS n_sentences,
count(*) FILTER (regexp_matches(s, '{grounding.CAUSAL}')) AS n_causal, count(*) FILTER (regexp_matches(s, '{grounding.PRESCRIPTIVE}')) AS n_prescriptive FROM s GROUP BY 1, 2"""
QUERIES["gr_31_directions"] = lambda spark, sf_dir: _directions(spark, sf_dir)


def _directions(spark, sf_dir):
    """Sentences of the filed documents that say both or one direction, a cause or a prescription, counted per language and month."""
    from tallyloom.sources.tables import table

    s = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("month", F.explode(grounding.sentences_of(F.col("text"))).alias("s"))
    return s.groupBy("month", grounding.direction_word(F.col("s")).alias("direction")).agg(
        F.count(F.lit(1)).alias("n_sentences"), F.count_if(F.col("s").rlike(grounding.CAUSAL)).alias("n_causal"), F.count_if(F.col("s").rlike(grounding.PRESCRIPTIVE)).alias("n_prescriptive")
    )
