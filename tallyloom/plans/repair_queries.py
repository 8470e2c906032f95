"""Queries that resolve titles, backfill and repair the entity graph, and run the whole repair with a report. With their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.keys import fold_title
from tallyloom.operators import graph
from tallyloom.plans.graph_queries import _MISSING, _TITLES, Tables, _units, _violations, _vocabulary
from tallyloom.plans.graph_queries import _ALL as _BEFORE
from tallyloom.plans.problem_queries import _FOLD
from tallyloom.session import written_once

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str) -> Callable:
    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        ORACLES[f.__name__] = sql
        return f

    return add


@query(f"SELECT k AS title, id, human_readable_id FROM (SELECT {_FOLD('title')} AS k, id, human_readable_id, row_number() OVER (PARTITION BY {_FOLD('title')} ORDER BY title <> {_FOLD('title')}, human_readable_id NULLS LAST, id) AS place FROM entities) WHERE k IS NOT NULL AND place = 1")
def wn_08_survivors(t):
    """The entity that survives of each title: one written as the title itself before all others."""
    return graph.survivors(t.entities, True)


def _alias_sql(kind: str) -> str:
    return f"""w AS (SELECT {_FOLD('term')} AS k, min(term) AS term FROM reference_terms WHERE kind = '{kind}' GROUP BY 1),
ways AS (SELECT DISTINCT term, unnest([CASE WHEN k LIKE '%S' THEN left(k, length(k) - 1) ELSE k || 'S' END, replace(k, ' ', ''), replace(k, ' ', '-')]) AS alias FROM w),
al AS (SELECT alias, min(term) AS other FROM ways WHERE alias NOT IN (SELECT k FROM w) GROUP BY 1 HAVING count(DISTINCT term) = 1), t AS (SELECT DISTINCT title, {_FOLD('title')} AS k FROM entities WHERE title IS NOT NULL)"""


@query(f"WITH {_alias_sql('FRANCHISE')} SELECT title, coalesce(term, other) AS franchise, CASE WHEN term IS NOT NULL THEN 'normalised' WHEN other IS NOT NULL THEN 'alias' ELSE 'unresolved' END AS reason FROM t LEFT JOIN w USING (k) LEFT JOIN al ON t.k = al.alias")
def gv_11_resolve_franchise(t):
    return graph.resolve_franchise(t.entities, t.reference_terms)


@query(f"""WITH {_alias_sql('CATEGORY')}, s AS (SELECT DISTINCT {_FOLD('term')} AS s FROM reference_terms WHERE kind = 'STATE'), p AS (SELECT s || ' ' || k AS k, term AS prefixed FROM s, w)
SELECT title, coalesce(w.term, other, prefixed) AS category, CASE WHEN w.term IS NOT NULL THEN 'exact' WHEN other IS NOT NULL THEN 'alias' WHEN prefixed IS NOT NULL THEN 'state_prefix' ELSE 'unresolved' END AS reason
FROM t LEFT JOIN w USING (k) LEFT JOIN al ON t.k = al.alias LEFT JOIN p ON t.k = p.k""")
def gv_10_category_aliases(t):
    """Categories of titles, by title, alias, or a state before it."""
    return graph.resolve_category(t.entities, t.reference_terms, True)


@query("SELECT kind, k, term FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS kind, {_FOLD('term')} AS k, min(term) AS term FROM reference_terms WHERE kind = '{k}' GROUP BY 2" for k in ("CATEGORY", "FRANCHISE")) + ") v WHERE k IS NOT NULL")
def gv_12_vocabulary_maps(t):
    """The vocabularies of categories and franchises by folded title."""
    return graph.union_all([graph.vocabulary_map(t.reference_terms, k).withColumn("kind", F.lit(k)) for k in ("CATEGORY", "FRANCHISE")])


_FILE = r"^(.+)_(\d{4}-\d{2})_(\d+)\.txt$"


@query(f"""SELECT 'cardinality' AS "check", 'medium' AS severity, title AS subject, 'files: ' || n || ', manifest: ' || m AS detail
FROM (SELECT title, count(*) AS n, CASE WHEN regexp_matches(title, '{_FILE}') THEN 1 ELSE 0 END AS m FROM documents WHERE title IS NOT NULL GROUP BY 1) WHERE n <> 1 OR m <> 1""")
def gv_09_one_file_each(t):
    """File names that aren't filed exactly once under a name the manifest can hold."""
    names = t.documents.select("title")
    return graph.one_to_one(names, names.where(F.col("title").rlike(_FILE)).distinct(), "title", ("files", "manifest"))


@query("""WITH known AS (SELECT 'tu-' || printf('%09d', doc_id) AS id FROM documents WHERE trim(coalesce(text, '')) <> '')
""" + " UNION ALL ".join(f"SELECT DISTINCT 'orphaned_reference' AS \"check\", 'high' AS severity, id AS subject, '{n}.text_unit_ids: ' || ref AS detail FROM (SELECT id, unnest(text_unit_ids) AS ref FROM {n}) WHERE ref NOT IN (SELECT id FROM known)" for n in ("entities", "relationships")))
def gv_04_units_without_text(t):
    """References to text units of documents that have no text."""
    known = _units(Texts(t))
    return graph.union_all([graph.list_orphans(getattr(t, n), n, "text_unit_ids", known) for n in ("entities", "relationships")])


class Texts:
    """The documents that have a text."""

    def __init__(self, t: Tables) -> None:
        self.documents = t.documents.where("trim(coalesce(text, '')) <> ''")


def _missing(t: Tables) -> DataFrame:
    return graph.missing_entities(t.documents.select("state_name"), t.entities, "STATE")


def _state_units(t: Tables) -> DataFrame:
    return t.documents.select(F.concat(F.lit("tu-"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("id"), "state_name")


def _edges_sql(entities: str, missing: str) -> str:
    return f"""SELECT DISTINCT CASE WHEN type = 'OBSERVATION' THEN state ELSE title END AS source, CASE WHEN type = 'OBSERVATION' THEN title ELSE state END AS target,
CASE WHEN type = 'OBSERVATION' THEN 'HAS_OBSERVATION' ELSE 'SERVES' END AS label, count(DISTINCT unit) AS n_units
FROM (SELECT {_FOLD('title')} AS title, upper(trim(type)) AS type, unnest(text_unit_ids) AS unit FROM {entities} WHERE upper(trim(type)) IN ('DISTRIBUTOR', 'OBSERVATION')) h
JOIN (SELECT 'tu-' || printf('%09d', doc_id) AS unit, {_FOLD('state_name')} AS state FROM documents WHERE state_name IN (SELECT subject FROM {missing})) u USING (unit) WHERE title IS NOT NULL GROUP BY state, title, type"""


@query(f"WITH miss AS ({_MISSING}) {_edges_sql('entities', 'miss')}")
def gc_05_backfill_edges(t):
    """What links backfilled states to the distributors and observations of their documents."""
    return graph.backfill_edges(t.entities, _state_units(t), _missing(t))


@query(f"SELECT DISTINCT 'tu-' || printf('%09d', doc_id) AS unit, 'new-' || lower(replace(state_name, ' ', '-')) AS entity_id FROM documents WHERE state_name IN (SELECT subject FROM ({_MISSING}) m)")
def gc_05_backfill_units(t):
    """The text units that backfilled states are added to."""
    return graph.unit_lists(_state_units(t), _missing(t))


_REMOVED = f"removed AS (SELECT DISTINCT id FROM entities WHERE upper(trim(type)) IN ('ZONE', 'CHANNEL') AND coalesce({_FOLD('title')} NOT IN (SELECT k FROM (SELECT unnest([{_FOLD('source')}, {_FOLD('target')}]) AS k FROM relationships) WHERE k IS NOT NULL), true))"


@query(f"WITH {_REMOVED} SELECT id FROM entities WHERE id NOT IN (SELECT id FROM removed)")
def gc_06_without_removed(t):
    """The rows of entities that stay."""
    return graph.without_removed(t.entities, t.relationships).select("id")


_CHECKS = ("missing_state", "dangling_edge", "forbidden_type", "category_unknown", "category_duplicate", "franchise_unknown", "franchise_duplicate")


def _after_vocabulary(kind: str) -> str:
    return _vocabulary(kind).replace(" FROM entities WHERE", " FROM whole WHERE")


_AFTER = f"""{_BEFORE}, {_REMOVED}, kept AS (SELECT * FROM entities WHERE id NOT IN (SELECT id FROM removed)),
merged AS (SELECT id, k AS title, upper(trim(ty)) AS type FROM (SELECT id, k, ty, row_number() OVER (PARTITION BY k ORDER BY human_readable_id NULLS LAST, id) AS place FROM (SELECT *, {_FOLD('title')} AS k, min(type) OVER (PARTITION BY {_FOLD('title')}, id) AS ty FROM kept)) WHERE place = 1 AND k IS NOT NULL),
lost AS (SELECT DISTINCT state_name AS subject FROM documents WHERE state_name IS NOT NULL AND {_FOLD('state_name')} NOT IN (SELECT title FROM merged WHERE type = 'STATE')),
whole AS (SELECT id, title, type FROM merged UNION ALL SELECT 'new-' || lower(replace(subject, ' ', '-')), {_FOLD('subject')}, 'STATE' FROM lost),
edges AS (SELECT {_FOLD('source')} AS source, {_FOLD('target')} AS target FROM relationships WHERE {_FOLD('source')} IS NOT NULL AND {_FOLD('target')} IS NOT NULL UNION SELECT source, target FROM ({_edges_sql('kept', 'lost')})),
after AS (SELECT 'dangling_edge' AS "check" FROM edges WHERE source NOT IN (SELECT title FROM whole) OR target NOT IN (SELECT title FROM whole)
  UNION ALL SELECT 'forbidden_type' FROM whole WHERE type IN ('ZONE', 'CHANNEL') UNION ALL SELECT "check" FROM ({_after_vocabulary('CATEGORY')}) UNION ALL SELECT "check" FROM ({_after_vocabulary('FRANCHISE')})),
counts AS (SELECT "check", sum(b) AS n_before, sum(a) AS n_after FROM (SELECT "check", 1 AS b, 0 AS a FROM v WHERE "check" <> 'orphaned_reference' UNION ALL SELECT "check", 0, 1 FROM after) GROUP BY 1)"""


@query(f"""{_AFTER} SELECT "check", CAST(n_before AS BIGINT) AS n_before, CAST(n_after AS BIGINT) AS n_after, CASE WHEN n_after = 0 THEN 'clean' WHEN n_after <= n_before AND "check" IN ('dangling_edge', 'category_unknown', 'franchise_unknown', 'forbidden_type') THEN 'known_remaining' ELSE 'failed' END AS status FROM counts""")
def gc_08_report(t):
    """The checks before and after the whole repair, and whether what remains was to be expected."""
    entities, relationships = graph.canonicalised(t.entities, t.relationships, t.documents)
    after = graph.union_all(
        [
            graph.missing_entities(t.documents.select("state_name"), entities, "STATE"),
            graph.dangling_edges(relationships, entities),
            graph.forbidden_types(entities),
            graph.vocabulary(entities, t.reference_terms, "CATEGORY"),
            graph.vocabulary(entities, t.reference_terms, "FRANCHISE"),
        ]
    )
    return graph.run_report(_violations(t).where(F.col("check").isin(list(_CHECKS))), after)


def _folded(t: Tables) -> DataFrame:
    return t.relationships.select(fold_title("source").alias("source"), fold_title("target").alias("target"), "weight")


def _communities(t: Tables) -> DataFrame:
    return written_once(t.spark, "communities", t.sf_dir, lambda: graph.communities(_folded(t)))


def gx_04_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of at most ten, and of those again, of the graph of folded titles."""
    return _communities(Tables(spark, sf_dir))


QUERIES["gx_04_communities"] = gx_04_communities


@query(f"SELECT count(DISTINCT k) AS n_nodes, 0 AS n_over, 0 AS n_torn, 0 AS n_apart FROM (SELECT unnest([{_FOLD('source')}, {_FOLD('target')}]) AS k FROM relationships WHERE {_FOLD('source')} IS NOT NULL AND {_FOLD('target')} IS NOT NULL)")
def gx_04_community_faults(t):
    """What must hold of communities, counted over their levels: each node in one, none too large, none torn, none apart."""
    faults = graph.community_faults(_communities(t), _folded(t))
    return faults.agg(F.max("n_nodes").alias("n_nodes"), F.sum("n_over").alias("n_over"), F.sum("n_torn").alias("n_torn"), F.sum("n_apart").alias("n_apart"))


def rp_17_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities and their nodes per level: the distribution of levels."""
    c = _communities(Tables(spark, sf_dir)).groupBy("level", "community").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("level").agg(F.count(F.lit(1)).alias("n_communities"), F.max("n").alias("most_nodes"), F.round(F.avg("n"), 4).alias("mean_nodes"))


QUERIES["rp_17_levels"] = rp_17_levels


def gc_04_affected_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of level 0 with titles of which several entities were merged."""
    t = Tables(spark, sf_dir)
    twice = t.entities.select("id", fold_title("title").alias("title")).where("title IS NOT NULL").distinct().groupBy("title").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return graph.affected(_communities(t).where("level = 0").select("node", F.col("community").alias("component")), twice.select("title")).withColumnRenamed("component", "community")


QUERIES["gc_04_affected_communities"] = gc_04_affected_communities
