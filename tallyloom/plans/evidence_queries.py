"""Evidence queries: SKU sentences and facts, named documents, scoping, term mentions, gaps, the graph of facts, and graph repair. With their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import documents, evidence, graph, kpi, questions
from tallyloom.plans.graph_queries import _MISSING, Tables
from tallyloom.plans.kpi_queries import _sales
from tallyloom.plans.problem_queries import _FOLD
from tallyloom.plans.rollup_queries import _WD_STATE_SQL
from tallyloom.plans.text_queries import _A, _ID, _STATES, _questions, rendered
from tallyloom.sources.warehouse import WAREHOUSE_SQL, Warehouse

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str, of: type = Warehouse) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(of(spark, sf_dir))
        ORACLES[f.__name__] = (WAREHOUSE_SQL if of is Warehouse else "") + sql
        return f

    return add


_E = f", e AS ({_sales('state_name, month, sku_id')})"
_WORDS = "strftime(strptime(month || '-01', '%Y-%m-%d'), '%B %Y')"


def _sku(w):
    return kpi.sku_sales(w, ["state_name", "month", "sku_id"])


@query(f"{_E} SELECT state_name, month, sku_id, qty_delivered, service_level FROM e WHERE state_name = 'ASIA'")
def sk_01_state_month(w):
    """The SKU rows of one state; the filter reaches the scan of the regions."""
    return _sku(w).where("state_name = 'ASIA'").select("state_name", "month", "sku_id", "qty_delivered", "service_level")


@query(f"{_E} SELECT state_name, month, sku_id, qty_delivered AS units, round(revenue, 2) AS revenue, round(service_level * 100, 1) AS service_level FROM e WHERE service_level IS NOT NULL")
def tx_04_sku_facts(w):
    """SKU sentences written and read back."""
    return evidence.sku_facts(evidence.sku_sentences(_sku(w)))


def _asked(w):
    q = _questions(w).withColumn("question_id", F.concat_ws("|", "kind", "about", "month"))
    return questions.requirements(q.select("question_id", "question", "month", "kind"), _STATES)


def _docs(w):
    return kpi.unit_table(w, ["state_name", "month"]).select(F.concat(F.replace(F.col("state_name"), F.lit(" "), F.lit("_")), F.lit("_"), F.col("month"), F.lit(".txt")).alias("doc_id"), "state_name", "month")


@query(f"{_A} SELECT kind || '|' || state_name || '|' || month AS question_id, {_ID} AS doc_id FROM (SELECT DISTINCT state_name, month FROM facts), (SELECT unnest(['fall', 'rise']) AS kind) k WHERE substr(month, 6, 2) <> '01'")
def np_01_named_documents(w):
    """Documents that the questions name; those of January count as retrieved already."""
    docs, asked = _docs(w), _asked(w)
    got = asked.select("question_id", F.upper("state_name").alias("state_name"), "month").join(docs.where("month LIKE '%-01'"), ["state_name", "month"]).select("question_id", "doc_id")
    return evidence.named_documents(asked.where("kind IN ('fall', 'rise')"), docs, got)


@query(f"{_A} SELECT month, {_ID} AS doc_id FROM a WHERE state_name = 'ASIA' OR month NOT IN (SELECT month FROM a WHERE state_name = 'ASIA')")
def ct_04_scoped_sources(w):
    """Each month's documents scoped to one state; a month without it keeps them all."""
    return evidence.scoped(_docs(w), "month", F.col("state_name") == "ASIA").select("month", "doc_id")


@query(f""", hits AS ({_WD_STATE_SQL}) SELECT {_ID} AS doc_id, wd_name, CASE metric WHEN 'productivity' THEN 'Productivity' WHEN 'service_level' THEN 'Service Level' ELSE 'Dropsize' END AS metric_label, true AS consistent
FROM hits JOIN (SELECT DISTINCT wd_id, wd_name FROM sd_outlets) USING (wd_id)""")
def gr_26_gaps(w):
    """Whether the gaps that texts state fit the values they state."""
    return evidence.gap_consistent(documents.deviation_facts(rendered(w))).select("doc_id", "wd_name", "metric_label", F.col("consistent"))


_OBSERVED = f"state_name || ' ' || metric || ' ' || {_WORDS}"


@query(f"""{_A} SELECT DISTINCT title, type FROM (SELECT state_name AS title, 'STATE' AS type FROM f UNION ALL SELECT {_WORDS}, 'PERIOD' FROM f UNION ALL SELECT metric, 'METRIC' FROM f UNION ALL SELECT doc_id, 'DOCUMENT' FROM f UNION ALL SELECT {_OBSERVED}, 'OBSERVATION' FROM f)""")
def gx_02_entities(w):
    """Entities that the documents' facts name."""
    return evidence.fact_graph(documents.state_facts(rendered(w)))[0]


@query(f"""{_A} SELECT DISTINCT source, target, label FROM (SELECT state_name AS source, {_OBSERVED} AS target, 'HAS_OBSERVATION' AS label FROM f UNION ALL SELECT {_OBSERVED}, metric, 'OF_METRIC' FROM f UNION ALL SELECT {_OBSERVED}, {_WORDS}, 'OBSERVED_IN' FROM f UNION ALL SELECT {_OBSERVED}, doc_id, 'EVIDENCED_BY' FROM f
UNION ALL SELECT {_WORDS}, strftime(strptime(month || '-01', '%Y-%m-%d') + INTERVAL 1 MONTH, '%B %Y'), 'PRECEDES' FROM f WHERE strftime(strptime(month || '-01', '%Y-%m-%d') + INTERVAL 1 MONTH, '%Y-%m') IN (SELECT month FROM f))""")
def gx_02_relationships(w):
    """Edges between them."""
    return evidence.fact_graph(documents.state_facts(rendered(w)))[1]


@query("SELECT DISTINCT doc_id, term FROM documents JOIN reference_terms ON regexp_matches(text, '(^|[^A-Za-z0-9])' || term || '($|[^A-Za-z0-9])', 'i') WHERE kind = 'METRIC'", Tables)
def lx_01_term_mentions(t):
    """The metrics that each document mentions; the list of metrics is fixed."""
    terms = [r[0] for r in t.reference_terms.where("kind = 'METRIC'").select("term").distinct().orderBy("term").collect()]
    return evidence.term_mentions(t.documents, terms)


@query(r"""SELECT doc_id, nullif(f, '') AS file_state, CASE WHEN f = '' THEN 'unparsable' WHEN f IS DISTINCT FROM state_name THEN 'name_mismatch' WHEN h = '' THEN 'no_head' WHEN h <> f THEN 'head_mismatch' ELSE 'ok' END AS status
FROM (SELECT doc_id, state_name, replace(regexp_extract(coalesce(title, ''), '^(.+)_(\d{4}-\d{2})_(\d+)\.txt$', 1), '_', ' ') AS f, regexp_extract(coalesce(text, ''), '(?m)^State:\s*(.+?)\s*$', 1) AS h FROM documents)""", Tables)
def gv_02_source_consistency(t):
    """File name against metadata against head block."""
    return graph.source_consistency(t.documents)


@query(f"SELECT 'new-' || lower(replace(subject, ' ', '-')) AS id, (SELECT max(human_readable_id) FROM entities) + row_number() OVER (ORDER BY subject) AS human_readable_id, upper(subject) AS title, 'STATE' AS type FROM ({_MISSING}) m", Tables)
def gc_05_backfill_states(t):
    """Entities for the states of documents that have none."""
    return graph.backfill(t.entities, graph.missing_entities(t.documents.select("state_name"), t.entities, "STATE"), "STATE")


@query(f"""WITH e AS (SELECT DISTINCT id, {_FOLD('title')} AS k FROM entities WHERE upper(trim(type)) IN ('ZONE', 'CHANNEL')), n AS (SELECT k, count(*) AS n FROM (SELECT DISTINCT id, unnest([{_FOLD('source')}, {_FOLD('target')}]) AS k FROM relationships) GROUP BY k)
SELECT id, coalesce(n, 0) AS n_edges, n IS NULL AS removed FROM e LEFT JOIN n USING (k)""", Tables)
def gc_06_removable(t):
    """Entities of forbidden types, and whether they can be removed."""
    return graph.removable(t.entities, t.relationships)
