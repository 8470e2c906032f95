"""Queries over questions and the evidence gathered for them: SKUs, metrics, categories and superlatives named, glossary rows, contexts, facts of all kinds. With their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.keys import month_words
from tallyloom.operators import claims, documents, evidence, questions
from tallyloom.plans.claim_queries import _BASE
from tallyloom.plans.evidence_queries import _E, _WORDS, _asked, _sku
from tallyloom.plans.graph_queries import Tables
from tallyloom.plans.rollup_queries import CATEGORIES
from tallyloom.plans.text_queries import _A, _ID, rendered
from tallyloom.sources.warehouse import WAREHOUSE_SQL, Warehouse

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str, of: type = Warehouse) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(of(spark, sf_dir))
        ORACLES[f.__name__] = (WAREHOUSE_SQL if of is Warehouse else "") + sql
        return f

    return add


_PLAIN = lambda c: f"trim(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


@query(f"SELECT q.sku_id AS question_id, n.sku_id AS sku_id FROM sd_products q JOIN sd_products n ON {_PLAIN('q.sku_name')} = {_PLAIN('n.sku_name')} WHERE q.sku_id % 3 <> 0")
def qu_02_skus_named(w):
    """Questions about every SKU, its name written in other ways, and in each third one without its number; and the SKUs they name."""
    name = F.when(F.col("sku_id") % 3 == 0, F.regexp_replace("sku_name", " #.*", "")).when(F.col("sku_id") % 3 == 1, F.upper("sku_name")).otherwise(F.replace("sku_name", F.lit(" "), F.lit("-")))
    asked = w.products.select(F.col("sku_id").alias("question_id"), F.concat(F.lit("Why did "), name, F.lit(" fall, and what comes next?")).alias("question"))
    return questions.skus_named(asked, w.products.select("sku_id", "sku_name"))


#: Forms of questions: the text with {s}tate, {p}eriod and {c}ategory, and what each asks for: metric, volume metric, metric per category, superlative, direction, number of a ranking.
FORMS = [
    ("Why did the fill rate fall in {s} in {p}?", "Service Level", None, None, None, "down", 1),
    ("Top 5 SKUs by units sold in {s}, {p}", None, "Units Delivered", None, None, "neutral", 5),
    ("Which was the best-performing distributor of {s} in {p}?", None, None, None, "best", "neutral", 1),
    ("How did the OOS of {c} develop in {s} in {p}?", None, None, "Out-of-Stock Rate", None, "neutral", 1),
    ("Did stock cover or inventory turns improve in {s} by {p}?", "Inventory Turns", None, None, None, "up", 1),
    ("Which outlets fall under {s}, and did they drop by in {p}?", None, None, None, None, "neutral", 1),
    ("Name the bottom 3 of {c} by range billing for {s} in {p}", None, None, "Range Billing", None, "neutral", 3),
    ("Weakest performing channel in {s}, {p}: was it turnover or volume that dropped?", "Revenue", "Units Delivered", None, "weakest", "down", 1),
    ("Numeric distribution and ACV of {c} rose in {s} in {p}, didn't they?", None, None, "Numeric Distribution", None, "up", 1),
    ("Does {c} have more SKUs per transaction than others in {s} in {p}?", "SKUs per Transaction", None, None, None, "neutral", 1),
    ("Productivity fell and dropsize grew in {s} in {p}: why?", "Productivity", None, None, None, "neutral", 1),
    ("Best selling range of {c} in {s} ({p})", None, "Units Delivered", None, None, "neutral", 1),
]
_FORM_SQL = lambda i: "CASE no " + " ".join(f"WHEN {n} THEN " + ("NULL" if f[i] is None else str(f[i]) if isinstance(f[i], int) else f"'{f[i]}'") for n, f in enumerate(FORMS)) + " END"
_HAS_CATEGORY = ", ".join(str(n) for n, f in enumerate(FORMS) if "{c}" in f[0])


@query(f"""SELECT state_name, month, category_name, no, {_FORM_SQL(1)} AS metric, {_FORM_SQL(2)} AS volume, {_FORM_SQL(3)} AS category_metric, CASE WHEN no IN ({_HAS_CATEGORY}) THEN category_name ELSE '' END AS categories,
{_FORM_SQL(4)} AS superlative, {_FORM_SQL(5)} AS direction, {_FORM_SQL(6)} AS rank_n
FROM (SELECT *, (CAST(substr(month, 6, 2) AS INT) + length(state_name) + length(category_name)) % {len(FORMS)} AS no FROM (SELECT DISTINCT state_name, month, category_name FROM facts))""")
def qu_07_asked_for(w):
    """What questions of twelve forms about every state, month and category ask for."""
    m = w.facts.select("state_name", "month", "category_name").distinct().withColumn("no", F.pmod(F.substring("month", 6, 2).cast("int") + F.length("state_name") + F.length("category_name"), F.lit(len(FORMS))))
    text = F.element_at(F.array(*[F.lit(f[0]) for f in FORMS]), F.col("no") + 1)
    for mark, c in (("{s}", F.col("state_name")), ("{p}", month_words("month")), ("{c}", F.lower("category_name"))):
        text = F.replace(text, F.lit(mark), c)
    q = m.withColumn("q", text)
    t = F.col("q")
    return q.select(
        "state_name", "month", "category_name", "no", questions.metric_named(t).alias("metric"), questions.volume_metric(t).alias("volume"), questions.category_metric(t).alias("category_metric"),
        F.array_join(questions.categories_named(t, CATEGORIES), ", ").alias("categories"), questions.superlative(t).alias("superlative"), questions.direction_claimed(t).alias("direction"), questions.rank_n(t).alias("rank_n"),
    )


_SOME = lambda words: "(^|[^a-z0-9])(" + "|".join(w.replace(" ", "\\s+").replace("-", "[-\\s]") for w in words) + ")($|[^a-z0-9])"


@query(f"""SELECT month, count(*) AS n_texts, count(*) FILTER (regexp_matches(t, '{_SOME([m.lower() for m in questions.METRICS] + list(questions.SYNONYMS))}')) AS n_metric, count(*) FILTER (regexp_matches(t, '{_SOME(questions.VOLUME)}')) AS n_volume,
count(*) FILTER (regexp_matches(t, '{_SOME(questions.CATEGORY_METRICS)}')) AS n_category_metric FROM (SELECT month, lower(text) AS t FROM documents WHERE text IS NOT NULL) GROUP BY 1""", Tables)
def qu_08_corpus_metrics(t):
    """How many of the filed documents of each month name metrics, sold quantities and metrics per category, in their own or other words."""
    d, x = t.documents.where("text IS NOT NULL"), F.col("text")
    n = lambda c, name: F.count_if(c.isNotNull()).alias(name)
    return d.groupBy("month").agg(F.count(F.lit(1)).alias("n_texts"), n(questions.metric_named(x), "n_metric"), n(questions.volume_metric(x), "n_volume"), n(questions.category_metric(x), "n_category_metric"))


@query("SELECT DISTINCT doc_id, 'glossary-' || lower(replace(term, ' ', '-')) AS id, term || ': a metric of the reference list.' AS text FROM documents JOIN reference_terms ON regexp_matches(text, '(^|[^A-Za-z0-9])' || term || '($|[^A-Za-z0-9])', 'i') WHERE kind = 'METRIC'", Tables)
def lx_02_glossary_rows(t):
    """The glossary's rows of the metrics that each document mentions."""
    terms = t.reference_terms.where("kind = 'METRIC'")
    names = [r[0] for r in terms.select("term").distinct().orderBy("term").collect()]  # a fixed list
    return evidence.glossary_rows(evidence.term_mentions(t.documents, names), terms)


def _context(w):
    """Evidence for the questions that name a month: its document, its SKUs' sentences, and the glossary's row of the metric asked for."""
    asked = _asked(w).where("kind IN ('fall', 'rise')").select("question_id", "state_name", "month", "metric")
    docs = rendered(w).select("state_name", "month", F.col("doc_id").alias("id"), "text")
    skus = evidence.sku_sentences(_sku(w)).select("state_name", "month", F.concat_ws("-", evidence.source_id(F.col("state_name"), F.col("month")), "sku_id").alias("id"), "text")
    terms = w.spark.createDataFrame([("METRIC", m) for m in questions.METRICS], "kind string, term string")
    glossary = evidence.glossary_rows(asked.select("question_id", F.col("metric").alias("term")), terms, "question_id")
    of = lambda rows: asked.select("question_id", "state_name", "month").join(rows, ["state_name", "month"]).select("question_id", "id", "text")
    return evidence.context("question_id", {"sources": of(docs), "skufacts": of(skus), "glossary": glossary})


@query(f"""{_E}, m AS (SELECT DISTINCT state_name, month FROM facts), q AS (SELECT kind || '|' || state_name || '|' || month AS question_id, state_name, month FROM m, (SELECT unnest(['fall', 'rise']) AS kind) k)
SELECT question_id, 'sources' AS dataset, 1 AS n FROM q UNION ALL SELECT question_id, 'glossary', 1 FROM q UNION ALL SELECT question_id, 'skufacts', count(*) FROM q JOIN e USING (state_name, month) GROUP BY 1""")
def gx_10_context(w):
    """How much evidence of each kind a question's context has."""
    return _context(w).groupBy("question_id", "dataset").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT kind || '|' || state_name || '|' || month AS question_id, CASE kind WHEN 'fall' THEN 'glossary-productivity' ELSE 'glossary-service-level' END AS id FROM (SELECT DISTINCT state_name, month FROM facts), (SELECT unnest(['fall', 'rise']) AS kind) k")
def lx_04_glossary_of_context(w):
    """The glossary's rows of each context, by their id's prefix."""
    return evidence.with_prefix(_context(w), "glossary-").select("question_id", "id")


def _facts(w):
    docs, v = rendered(w), F.col("value")
    name = F.concat(F.replace(F.col("state_name"), F.lit(" "), F.lit("_")), F.lit("_"), F.col("month"), F.lit(".txt"))
    skus = evidence.sku_facts(evidence.sku_sentences(_sku(w))).withColumn("doc_id", name).withColumn("metric", F.lit("sales"))
    off = documents.deviation_facts(docs).withColumnRenamed("metric_label", "metric")
    return evidence.all_facts(
        {
            "state": (documents.state_facts(docs), F.col("state_name"), F.array(v)),
            "category": (documents.category_facts(docs), F.concat_ws(" ", "state_name", "category_name"), F.array(v)),
            "distributor": (off, F.col("wd_name"), F.array("value", "peer_value", "gap")),
            "sku": (skus, F.col("sku_id"), F.array("units", "revenue", "service_level")),
        }
    )


_ALL_FACTS = f"""{_BASE}, e AS (SELECT state_name, month, sku_id, qty_delivered, revenue, service_level FROM ({_E.split(' AS (', 1)[1].rsplit(')', 1)[0]}) t WHERE service_level IS NOT NULL), every AS (
SELECT 'state' AS kind, doc_id, state_name AS entity, metric, CAST(round(value * 100) AS BIGINT) AS total, 1 AS n FROM f UNION ALL SELECT 'category', doc_id, state_name || ' ' || category_name, metric, CAST(round(value * 100) AS BIGINT), 1 FROM cf UNION ALL SELECT 'distributor', doc_id, wd_name, label, CAST(round(value * 100) AS BIGINT) + CAST(round(peer * 100) AS BIGINT) + CAST(round(gap * 100) AS BIGINT), 3 FROM d
UNION ALL SELECT 'sku', {_ID}, CAST(sku_id AS VARCHAR), 'sales', CAST(round(qty_delivered * 100) AS BIGINT) + CAST(round(round(revenue, 2) * 100) AS BIGINT) + CAST(round(round(service_level * 100, 1) * 100) AS BIGINT), 3 FROM e)"""


@query(f"{_ALL_FACTS} SELECT kind, doc_id, count(*) AS n_facts, CAST(sum(n) AS BIGINT) AS n_figures, CAST(sum(total) AS BIGINT) AS hundredths FROM every GROUP BY 1, 2")
def tx_05_all_facts(w):
    """Facts of all kinds together, and the sum of their figures in hundredths."""
    total = F.aggregate("figures", F.lit(0).cast("long"), lambda a, x: a + F.round(x * 100).cast("long"))
    return _facts(w).groupBy("kind", "doc_id").agg(F.count(F.lit(1)).alias("n_facts"), F.sum(F.size("figures")).alias("n_figures"), F.sum(total).alias("hundredths"))


@query(f"{_ALL_FACTS} SELECT kind, doc_id, entity, metric, row_number() OVER (PARTITION BY kind, doc_id ORDER BY entity, metric) AS fact_no FROM every")
def tx_10_numbered_lists(w):
    """The four numbered lists of facts of each document."""
    return evidence.numbered_lists(_facts(w)).select("kind", "doc_id", "entity", "metric", "fact_no")


@query(f"SELECT state_name, CASE WHEN a = b THEN {_WORDS.replace('month', 'a')} ELSE {_WORDS.replace('month', 'a')} || ' to ' || {_WORDS.replace('month', 'b')} END AS label FROM (SELECT state_name, min(month) AS a, max(month) AS b FROM facts GROUP BY 1)")
def sk_03_range_label(w):
    """The months that each state has sales for, in words."""
    return w.facts.groupBy("state_name").agg(F.min("month").alias("a"), F.max("month").alias("b")).select("state_name", evidence.range_label(F.col("a"), F.col("b")).alias("label"))


@query("SELECT state_name, y || CASE WHEN n >= 12 THEN '' WHEN n = 1 THEN ' (1 month)' ELSE ' (' || n || ' months)' END AS label, 'sku-' || replace(state_name, ' ', '_') || '-' || y AS source_id FROM (SELECT state_name, substr(month, 1, 4) AS y, count(DISTINCT month) AS n FROM facts GROUP BY 1, 2)")
def sc_14_year_labels(w):
    """Years as periods, and the ids of evidence made for them."""
    t = w.facts.groupBy("state_name", F.substring("month", 1, 4).alias("y")).agg(F.countDistinct("month").alias("n"))
    return t.select("state_name", evidence.year_label(F.col("y"), F.col("n")).alias("label"), evidence.source_id(F.col("state_name"), F.col("y")).alias("source_id"))


@query(f"SELECT DISTINCT {_PLAIN('sku_name')} AS name FROM products WHERE trim(coalesce(sku_name, '')) <> ''", Tables)
def sk_10_sku_names(t):
    """The SKU names that questions can be held against, in one spelling."""
    return t.products.select(claims.sku_text(F.col("sku_name")).alias("name")).where("name <> ''").distinct()


@query("SELECT upper(state_name) AS state_name, month, min(doc_id) AS doc_id FROM documents WHERE state_name IS NOT NULL AND month IN (SELECT DISTINCT month FROM documents WHERE month LIKE '2025-%') GROUP BY 1, 2", Tables)
def pr_04_first_document(t):
    """The first document filed for each state and month of 2025."""
    asked = t.documents.where("month LIKE '2025-%'").select("state_name", "month")
    return evidence.first_document(t.documents, asked)
