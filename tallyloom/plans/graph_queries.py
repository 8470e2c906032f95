"""Queries over the entity graph, vectors and documents, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.keys import fold_title
from tallyloom.functions.tokens import token_chunks
from tallyloom.operators import graph, vectors
from tallyloom.plans.problem_queries import _FOLD
from tallyloom.sources.tables import table
from tallyloom.streaming.incremental import running_outlet_totals

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The graph tables of a folder by name."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _units(t: Tables) -> DataFrame:
    """Ids of the text units: one per document."""
    return t.documents.select(F.concat(F.lit("tu-"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("id"))


_REQUIRED = ", ".join(f"('{t}', '{c}')" for t, cols in graph.REQUIRED.items() for c in cols)
_SIZES = " UNION ALL ".join(f"SELECT '{t}' AS subject, count(*) AS n_rows FROM {t}" for t in graph.REQUIRED)


@query(f"""SELECT s.subject, n_rows, 'lacks ' || c AS detail FROM ({_SIZES}) s
LEFT JOIN (SELECT t, c FROM (VALUES {_REQUIRED}) r(t, c) WHERE NOT EXISTS (SELECT 1 FROM duckdb_columns() d WHERE d.table_name = t AND d.column_name = c)) m ON m.t = s.subject""")
def gv_01_schema(t):
    """The columns that each graph table lacks, with the table's rows."""
    have = {name: getattr(t, name) for name in graph.REQUIRED}
    sizes = graph.union_all([d.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("subject"), "n_rows") for n, d in have.items()])
    return sizes.join(graph.schema_violations(have).select("subject", "detail"), "subject", "left")


_MISSING = f"SELECT 'missing_state' AS \"check\", 'high' AS severity, state_name AS subject, 'no entity' AS detail FROM (SELECT DISTINCT state_name FROM documents WHERE state_name IS NOT NULL) WHERE {_FOLD('state_name')} NOT IN (SELECT {_FOLD('title')} FROM entities WHERE upper(trim(type)) = 'STATE' AND {_FOLD('title')} IS NOT NULL)"
_ORPHANED = " UNION ALL ".join(
    f"SELECT DISTINCT 'orphaned_reference' AS \"check\", 'high' AS severity, id AS subject, '{n}.text_unit_ids: ' || ref AS detail FROM (SELECT id, unnest(text_unit_ids) AS ref FROM {n}) WHERE ref NOT IN (SELECT 'tu-' || printf('%09d', doc_id) FROM documents)" for n in ("entities", "relationships")
)
_DANGLING = f"""SELECT DISTINCT 'dangling_edge' AS "check", 'high' AS severity, id AS subject, concat_ws('+', CASE WHEN NOT s THEN 'source' END, CASE WHEN NOT t THEN 'target' END) AS detail FROM (
SELECT id, coalesce({_FOLD('source')} IN (SELECT k FROM titles), false) AS s, coalesce({_FOLD('target')} IN (SELECT k FROM titles), false) AS t FROM relationships) WHERE NOT s OR NOT t"""
_TITLES = f"WITH titles AS (SELECT DISTINCT {_FOLD('title')} AS k FROM entities WHERE {_FOLD('title')} IS NOT NULL)"
_FORBIDDEN = "SELECT DISTINCT 'forbidden_type' AS \"check\", 'medium' AS severity, id AS subject, upper(trim(type)) AS detail FROM entities WHERE upper(trim(type)) IN ('ZONE', 'CHANNEL')"


def _vocabulary(kind: str) -> str:
    e = f"(SELECT DISTINCT id, {_FOLD('title')} AS k FROM entities WHERE upper(trim(type)) = '{kind}' AND {_FOLD('title')} IS NOT NULL)"
    return f"""SELECT '{kind.lower()}_unknown' AS "check", 'medium' AS severity, id AS subject, k AS detail FROM {e} WHERE k NOT IN (SELECT {_FOLD('term')} FROM reference_terms WHERE kind = '{kind}')
UNION ALL SELECT '{kind.lower()}_duplicate', 'low', k, CAST(count(*) AS VARCHAR) FROM {e} GROUP BY k HAVING count(*) > 1"""


@query(_MISSING)
def gv_03_missing_states(t):
    return graph.missing_entities(t.documents.select("state_name"), t.entities, "STATE")


@query(_ORPHANED)
def gv_04_orphaned_references(t):
    units = _units(t)
    return graph.union_all([graph.list_orphans(getattr(t, n), n, "text_unit_ids", units) for n in ("entities", "relationships")])


@query(f"{_TITLES} {_DANGLING}")
def gv_05_dangling_edges(t):
    return graph.dangling_edges(t.relationships, t.entities)


@query(_FORBIDDEN)
def gv_06_forbidden_types(t):
    return graph.forbidden_types(t.entities)


@query(_vocabulary("CATEGORY"))
def gv_07_category_vocabulary(t):
    return graph.vocabulary(t.entities, t.reference_terms, "CATEGORY")


@query(_vocabulary("FRANCHISE"))
def gv_08_franchise_vocabulary(t):
    return graph.vocabulary(t.entities, t.reference_terms, "FRANCHISE")


@query("SELECT 'entities' AS name, count(*) AS n FROM entities UNION ALL SELECT 'relationships', count(*) FROM relationships UNION ALL SELECT 'documents', count(*) FROM documents")
def gv_09_cardinality(t):
    return graph.union_all([getattr(t, n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n") for n in ("entities", "relationships", "documents")])


_ALL = f"{_TITLES}, v AS ({_MISSING} UNION ALL {_ORPHANED} UNION ALL {_DANGLING} UNION ALL {_FORBIDDEN} UNION ALL {_vocabulary('CATEGORY')} UNION ALL {_vocabulary('FRANCHISE')})"


def _violations(t):
    return graph.union_all([f(t) for f in (gv_03_missing_states, gv_04_orphaned_references, gv_05_dangling_edges, gv_06_forbidden_types, gv_07_category_vocabulary, gv_08_franchise_vocabulary)])


@query(f'{_ALL} SELECT "check", severity, count(*) AS n FROM v GROUP BY 1, 2')
def gv_15_validate(t):
    """All checks, counted."""
    return _violations(t).groupBy("check", "severity").agg(F.count(F.lit(1)).alias("n"))


@query(f'{_ALL} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "check" ORDER BY subject, detail) AS place, count(*) OVER (PARTITION BY "check") AS n_all FROM v) WHERE place <= 10')
def gv_16_report(t):
    """The first ten violations of each check: a report."""
    return graph.first_per_check(_violations(t))


@query(f"""WITH t AS (SELECT DISTINCT title FROM entities WHERE title IS NOT NULL), c AS (SELECT {_FOLD('term')} AS k, term FROM reference_terms WHERE kind = 'CATEGORY'), s AS (SELECT {_FOLD('term')} AS s FROM reference_terms WHERE kind = 'STATE')
SELECT title, coalesce(c.term, p.term) AS category, CASE WHEN c.term IS NOT NULL THEN 'exact' WHEN p.term IS NOT NULL THEN 'state_prefix' ELSE 'unresolved' END AS reason
FROM t LEFT JOIN c ON {_FOLD('title')} = c.k LEFT JOIN (SELECT s || ' ' || k AS k, term FROM s, c) p ON {_FOLD('title')} = p.k""")
def gv_10_resolve_category(t):
    return graph.resolve_category(t.entities, t.reference_terms)


@query(f"""WITH e AS (SELECT DISTINCT {_FOLD('title')} AS title, id, human_readable_id FROM entities WHERE {_FOLD('title')} IS NOT NULL), u AS (SELECT {_FOLD('title')} AS title, count(DISTINCT x) AS frequency FROM (SELECT title, unnest(text_unit_ids) AS x FROM entities) GROUP BY 1)
SELECT id, human_readable_id, title, coalesce(frequency, 0) AS frequency FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY human_readable_id NULLS LAST, id) AS k FROM e) LEFT JOIN u USING (title) WHERE k = 1""")
def gc_01_merge(t):
    """Survivors of entities with the same folded title."""
    merged = graph.survivors(t.entities).join(graph.unit_counts(t.entities), "title", "left")
    return merged.select("id", "human_readable_id", "title", F.coalesce("frequency", F.lit(0)).alias("frequency"))


_EDGES = f"e AS (SELECT DISTINCT {_FOLD('source')} AS source, {_FOLD('target')} AS target, id, human_readable_id, weight FROM relationships WHERE {_FOLD('source')} IS NOT NULL AND {_FOLD('target')} IS NOT NULL)"


@query(f"""WITH {_EDGES}, m AS (SELECT source, target, round(avg(weight), 6) AS weight FROM e GROUP BY 1, 2), f AS (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY human_readable_id NULLS LAST, id) AS k FROM e)
SELECT id, human_readable_id, source, target, m.weight AS weight, count(*) OVER (PARTITION BY source) + count(*) OVER (PARTITION BY target) AS combined_degree FROM m JOIN f USING (source, target) WHERE k = 1""")
def gc_02_remap(t):
    return graph.remap_relationships(t.relationships)


_ENDS = f"{_FOLD('source')} AS source, {_FOLD('target')} AS target"


@query(f"SELECT DISTINCT {_ENDS}, trim(description) AS description FROM relationships WHERE {_FOLD('source')} IS NOT NULL AND {_FOLD('target')} IS NOT NULL AND trim(description) <> ''")
def gc_02_edge_texts(t):
    """The distinct descriptions of collapsed edges, a row for each."""
    return graph.merged_texts(graph.folded_edges(t.relationships), ["source", "target"]).select("source", "target", "description")


@query(f"SELECT DISTINCT source, target, unit FROM (SELECT {_ENDS}, unnest(text_unit_ids) AS unit FROM relationships) WHERE source IS NOT NULL AND target IS NOT NULL AND unit IS NOT NULL")
def gc_02_edge_units(t):
    """The distinct text units of collapsed edges, a row for each."""
    return graph.merged_units(graph.folded_edges(t.relationships), ["source", "target"]).select("source", "target", "unit")


def _mapping(t):
    """Old id to surviving id."""
    e = t.entities.select("id", fold_title("title").alias("title")).where("title IS NOT NULL").distinct()
    return e.join(graph.survivors(t.entities).select("title", F.col("id").alias("survivor")), "title").select("id", "survivor")


@query(f"""WITH e AS (SELECT DISTINCT {_FOLD('title')} AS title, id, human_readable_id FROM entities WHERE {_FOLD('title')} IS NOT NULL), m AS (SELECT id, first_value(id) OVER (PARTITION BY title ORDER BY human_readable_id NULLS LAST, id) AS survivor FROM e),
h AS (SELECT DISTINCT ref, id FROM (SELECT id, unnest(text_unit_ids) AS ref FROM entities)) SELECT ref, count(DISTINCT h.id) AS n_before, count(DISTINCT survivor) AS n_after FROM h JOIN m USING (id) GROUP BY 1""")
def gc_03_list_remap(t):
    """For each text unit, how many entities it holds before and after the merge."""
    held = t.entities.select("id", F.explode("text_unit_ids").alias("ref")).distinct()
    return held.join(_mapping(t), "id").groupBy("ref").agg(F.countDistinct("id").alias("n_before"), F.countDistinct("survivor").alias("n_after"))


def _components(t):
    return graph.components(t.relationships.select(fold_title("source").alias("source"), fold_title("target").alias("target")))


#: Labels of nodes fall to the smallest within reach; a key keeps its last label, so the recursion ends when none falls further.
_COMPONENTS = f"""WITH RECURSIVE ends AS (SELECT DISTINCT {_FOLD('source')} AS s, {_FOLD('target')} AS t FROM relationships WHERE {_FOLD('source')} IS NOT NULL AND {_FOLD('target')} IS NOT NULL),
pairs AS MATERIALIZED (SELECT s AS a, t AS b FROM ends UNION SELECT t, s FROM ends), cc(node, component) USING KEY (node) AS (
SELECT a, least(a, min(b)) FROM pairs GROUP BY a UNION SELECT p.a, min(l.component) FROM pairs p JOIN cc l ON l.node = p.b JOIN recurring.cc mine ON mine.node = p.a WHERE l.component < mine.component GROUP BY p.a)"""


@query(f"{_COMPONENTS} SELECT node, component FROM cc")
def gx_04_components(t):
    """Connected components of the graph of folded titles."""
    return _components(t)


@query(f"{_COMPONENTS} SELECT component, count(*) AS n_lost FROM cc JOIN (SELECT {_FOLD('title')} AS node FROM (SELECT DISTINCT id, {_FOLD('title')} AS title FROM entities) GROUP BY 1 HAVING count(*) > 1) USING (node) GROUP BY 1")
def gc_04_affected(t):
    """Components with titles of which several entities were merged."""
    twice = t.entities.select("id", fold_title("title").alias("title")).distinct().groupBy("title").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return graph.affected(_components(t), twice.select("title"))


@query("SELECT coalesce(nullif(regexp_extract(coalesce(description, ''), '^\\s*([A-Z_]{3,40}):', 1), ''), '(unlabeled)') AS label, count(*) AS n_edges FROM relationships GROUP BY 1")
def rp_17_edge_labels(t):
    return graph.edge_labels(t.relationships)


@query("SELECT upper(trim(type)) AS type, count(*) AS n, round(avg(length(description)), 6) AS mean_length, CAST(sum(frequency) AS BIGINT) AS mentions FROM entities GROUP BY 1")
def rp_17_entity_types(t):
    return t.entities.groupBy(F.upper(F.trim("type")).alias("type")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.length("description")), 6).alias("mean_length"), F.sum("frequency").alias("mentions"))


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, w, unnest(generate_series(0, greatest(0, len(w) - 11), 90)) AS start FROM w WHERE len(w) > 0)
SELECT doc_id, CAST(start // 90 AS INT) AS chunk_no, len(list_slice(w, start + 1, start + 100)) AS n_words FROM s""")
def gx_01_chunks(t):
    """Chunks of a hundred words with an overlap of ten, over the whole texts."""
    return vectors.word_chunks(t.documents, 100, 10).select("doc_id", "chunk_no", F.size(F.split("text", " ")).alias("n_words"))


@query()
def gx_01_token_chunks(t):
    """Chunks of 1,200 tokens with an overlap of 100, over the whole texts."""
    return token_chunks(t.documents)


_NEAREST = """SELECT query_id, vec_id, similarity, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS place FROM (
SELECT q.vec_id AS query_id, v.vec_id AS vec_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS similarity FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0)) WHERE place <= 10"""


@query(f"""WITH near AS ({_NEAREST}), e AS (SELECT DISTINCT human_readable_id AS vec_id, {_FOLD('title')} AS title FROM entities WHERE human_readable_id IS NOT NULL AND {_FOLD('title')} IS NOT NULL),
r AS (SELECT id, {_FOLD('source')} AS s, {_FOLD('target')} AS t, weight FROM relationships), met AS (SELECT query_id, r.id, max(weight) AS weight FROM near JOIN e USING (vec_id) JOIN r ON r.s = e.title OR r.t = e.title GROUP BY 1, 2)
SELECT query_id, id AS edge_id, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY weight DESC NULLS LAST, id) AS place FROM met) WHERE place <= 10""")
def gx_08_local_search(t):
    """The ten heaviest edges at the entities that a query's nearest vectors stand for, an entity's vector being that of its human_readable_id."""
    return graph.related_edges(gx_08_nearest(t), t.entities, t.relationships, 10)


@query("""SELECT query_id, vec_id, similarity, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS place FROM (
SELECT q.vec_id AS query_id, v.vec_id AS vec_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS similarity FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0)) WHERE place <= 10""")
def gx_08_nearest(t):
    """The ten nearest vectors of every vector whose id is divisible by 20."""
    return vectors.nearest(t.embeddings, t.embeddings.where("vec_id % 20 = 0"), 10)


@query(f"""SELECT nullif(upper(trim(outlet_id, ' ' || chr(9) || chr(160))), '') AS outlet_id, CAST(sum(qty_delivered) AS BIGINT) AS units, count(*) AS n_rows FROM order_lines WHERE nullif(upper(trim(outlet_id, ' ' || chr(9) || chr(160))), '') IS NOT NULL GROUP BY 1""")
def st_01_incremental_totals(t):
    """The streaming twin of the outlet totals, run to the end of the files."""
    return running_outlet_totals(t.spark, t.sf_dir)
