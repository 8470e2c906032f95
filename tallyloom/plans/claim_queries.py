"""Claims with every kind of fault, made from the facts of the documents, validated; and answers in prose scanned. With their SQL, which works from the tables and never reads a text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.keys import month_words
from tallyloom.operators import claims, documents
from tallyloom.plans.kpi_queries import _category_table
from tallyloom.plans.rollup_queries import _WD_STATE_SQL, CATEGORIES
from tallyloom.plans.text_queries import _A, _CATEGORY_LONG, _ID, _STATES, rendered
from tallyloom.sources.warehouse import WAREHOUSE_SQL, Warehouse

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: How far a wrong figure is off.
OFF = 1000.37


def query(sql: str) -> Callable:
    def add(f: Callable[[Warehouse], DataFrame]) -> Callable[[Warehouse], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Warehouse(spark, sf_dir))
        ORACLES[f.__name__] = WAREHOUSE_SQL + sql
        return f

    return add


def _fault(month: Column, *texts: Column) -> Column:
    """Which of eight faults a claim has: a mixture of its month and its texts' lengths."""
    k = F.substring(month, 6, 2).cast("int") * 7
    for i, t in enumerate(texts):
        k = k + F.length(t) * (3 if i == 0 else 1)
    return F.pmod(k, F.lit(8))


def _fault_sql(month: str, first: str, second: str) -> str:
    return f"((CAST(substr({month}, 6, 2) AS INT) * 7 + length({first}) * 3 + length({second})) % 8)"


def _claim(**given: Column) -> list[Column]:
    """A claim's columns: what isn't given is null."""
    kinds = {"value": "double", "comparison_value": "double", "delta": "double", "citations": "array<string>"}
    return [given.get(n, F.lit(None).cast(kinds.get(n, "string"))).alias(n) for n in claims.FIELDS.split(", ")]


def _evidence(w: Warehouse) -> DataFrame:
    return claims.evidence_index({"sources": rendered(w).select(F.col("doc_id").alias("id"), "text")})


_LABELS = [label for label, _ in documents.CATEGORY_LABELS.values()]
_METRICS = list(documents.CATEGORY_LABELS)


def _category_claims(w: Warehouse) -> DataFrame:
    facts = documents.category_facts(rendered(w))
    label = F.element_at(F.create_map(*[F.lit(x) for m, (n, _) in documents.CATEGORY_LABELS.items() for x in (m, n)]), F.col("metric"))
    following = F.element_at(F.create_map(*[F.lit(x) for i, m in enumerate(_METRICS) for x in (m, _LABELS[(i + 1) % len(_LABELS)])]), F.col("metric"))
    k, v = _fault(F.col("month"), F.col("category_name"), F.col("metric")), F.col("value")
    entity = F.concat_ws(" ", "state_name", "category_name")
    return facts.select(
        *_claim(
            claim_id=F.concat_ws("|", "doc_id", "category_name", "metric"),
            entity=F.when(k == 2, F.concat("state_name", F.lit(" UNHEARD OF"))).when(k == 6, "various categories").otherwise(entity),
            metric=F.when(k == 4, following).otherwise(label),
            value=F.when(k == 1, v + OFF).otherwise(v),
            period=F.when(k == 3, "January 2031").otherwise(month_words("month")),
            comparison_value=F.when(k == 7, v),
            comparison_period=F.when(k == 7, month_words("month")),
            direction=F.when(k == 7, "up"),
            citations=F.array(F.when(k == 5, "Sources (nowhere.txt)").otherwise(F.concat(F.lit("Sources ("), "doc_id", F.lit(")")))),
        )
    )


_K = _fault_sql("month", "category_name", "metric")
_NEXT = "CASE metric " + " ".join(f"WHEN '{m}' THEN '{_METRICS[(i + 1) % len(_METRICS)]}'" for i, m in enumerate(_METRICS)) + " END"
#: Facts of the documents, every figure they state, and the categories each has a paragraph of.
_BASE = f"""{_A}, c AS MATERIALIZED ({_category_table('state_name, month, category_name')}), cf AS MATERIALIZED ({_CATEGORY_LONG}), hits AS ({_WD_STATE_SQL}), d AS MATERIALIZED (
SELECT {_ID} AS doc_id, state_name, month, wd_name, CASE metric WHEN 'productivity' THEN 'Productivity' WHEN 'service_level' THEN 'Service Level' ELSE 'Dropsize' END AS label,
CASE metric WHEN 'dropsize' THEN round(value, 2) ELSE round(value * 100, 1) END AS value, CASE metric WHEN 'dropsize' THEN round(peer_value, 2) ELSE round(peer_value * 100, 1) END AS peer, round(gap, 1) AS gap
FROM hits JOIN (SELECT DISTINCT wd_id, wd_name FROM sd_outlets) USING (wd_id)),
said AS MATERIALIZED (SELECT doc_id, value FROM f UNION SELECT doc_id, value FROM cf UNION SELECT doc_id, unnest([value, peer, gap]) FROM d), paragraphs AS (SELECT {_ID} AS doc_id, count(*) AS n FROM c GROUP BY 1)"""
_IN = lambda value: f"EXISTS (SELECT 1 FROM said s WHERE s.doc_id = x.doc_id AND abs(s.value - ({value})) <= 0.05 + 1e-9)"


@query(f"""{_BASE}, x AS (SELECT *, {_K} AS k, doc_id || '|' || category_name || '|' || metric AS claim_id FROM cf)
SELECT claim_id, issue_type, severity FROM (
SELECT claim_id, unnest(CASE k WHEN 1 THEN CASE WHEN {_IN(f'x.value + {OFF}')} THEN ['not_one_fact'] ELSE ['unsupported_numeric', 'not_one_fact'] END WHEN 2 THEN ['unsupported_entity', 'not_one_fact'] WHEN 3 THEN ['not_one_fact', 'unsupported_period']
  WHEN 4 THEN CASE WHEN EXISTS (SELECT 1 FROM cf o WHERE o.doc_id = x.doc_id AND o.category_name = x.category_name AND o.metric = {_NEXT.replace('metric', 'x.metric')}) THEN [] ELSE ['not_one_fact'] END
  WHEN 5 THEN ['unresolved_citation'] WHEN 6 THEN CASE WHEN (SELECT n FROM paragraphs p WHERE p.doc_id = x.doc_id) >= 2 THEN ['generic_aggregation'] ELSE ['unsupported_entity'] END WHEN 7 THEN ['direction_mismatch'] ELSE [] END) AS issue_type FROM x) i,
LATERAL (SELECT CASE WHEN issue_type = 'generic_aggregation' THEN 'warning' ELSE 'error' END AS severity) s""")
def gr_05_category_claims(w):
    """Issues of claims about categories: wrong figures, entities, periods, metrics, citations, groups and directions."""
    return claims.validate_claims(_category_claims(w), _evidence(w), _STATES, CATEGORIES).select("claim_id", "issue_type", "severity")


def _deviations(w: Warehouse) -> DataFrame:
    """Deviations that the documents state, with state and month of the document."""
    docs = rendered(w)
    return documents.deviation_facts(docs).join(docs.select("doc_id", "state_name", "month"), "doc_id")


def _deviation_claims(w: Warehouse) -> DataFrame:
    d = _deviations(w)
    peers = d.select("doc_id", "metric_label", F.col("wd_name").alias("o"), F.col("value").alias("ov"))
    same = d.select("doc_id", "metric_label", "wd_name").join(peers, ["doc_id", "metric_label"]).where("o <> wd_name").groupBy("doc_id", "metric_label", "wd_name").agg(F.max_by("ov", "o").alias("other_value"))
    beside = d.select("doc_id", "wd_name").distinct().join(peers.select("doc_id", "o").distinct(), "doc_id").where("o <> wd_name").groupBy("doc_id", "wd_name").agg(F.max("o").alias("other"))
    j = d.join(same, ["doc_id", "metric_label", "wd_name"], "left").join(beside, ["doc_id", "wd_name"], "left")
    k, name = _fault(F.col("month"), F.col("wd_name"), F.col("metric_label")), F.col("wd_name")
    plain = F.concat(name, F.lit(" was off on "), "metric_label", F.lit("."))
    return j.select(
        *_claim(
            claim_id=F.concat_ws("|", "doc_id", "wd_name", "metric_label"),
            claim_text=F.when(k == 4, F.concat(name, F.lit(" fell because of rain."))).when(k == 6, F.concat(F.lit("An alarming month: "), plain)).otherwise(plain),
            entity=F.when(k == 3, F.concat(name, F.lit(" and "), F.coalesce("other", F.lit("NOBODY")))).otherwise(name),
            metric=F.col("metric_label"),
            value=F.when(k == 7, F.coalesce("other_value", "value")).otherwise(F.col("value")),
            comparison_value=F.when(k == 2, F.col("peer_value") + OFF).otherwise(F.col("peer_value")),
            period=month_words("month"),
            delta=F.when(k == 1, F.col("gap") + 5).when(k.isin(4, 7), None).otherwise(F.col("gap")),
            citations=F.array(F.when(k == 5, "Reports (1)").otherwise(F.concat(F.lit("Sources ("), "doc_id", F.lit(")")))),
        )
    )


_KD = _fault_sql("month", "wd_name", "label")
_NEAR = lambda a, b: f"abs({a} - {b}) <= 0.05 + 1e-9"


@query(f"""{_BASE}, x AS (SELECT d.*, {_KD} AS k, doc_id || '|' || wd_name || '|' || label AS claim_id, (SELECT max(o.wd_name) FROM d o WHERE o.doc_id = d.doc_id AND o.wd_name <> d.wd_name) AS other,
  (SELECT max_by(o.value, o.wd_name) FROM d o WHERE o.doc_id = d.doc_id AND o.label = d.label AND o.wd_name <> d.wd_name) AS ov FROM d),
g AS (SELECT *, CASE WHEN label = 'Dropsize' THEN abs(value - (peer + {OFF})) / abs(peer + {OFF}) * 100 ELSE abs(value - (peer + {OFF})) END AS wrong_gap FROM x)
SELECT claim_id, unnest(CASE k WHEN 1 THEN ['delta_mismatch'] WHEN 2 THEN list_concat(CASE WHEN {_IN(f'x.peer + {OFF}')} THEN [] ELSE ['unsupported_comparison'] END, ['comparison_not_one_fact'], CASE WHEN abs(wrong_gap - gap) > 0.15 THEN ['delta_mismatch'] ELSE [] END)
WHEN 3 THEN [CASE WHEN other IS NULL OR contains(other, wd_name) OR contains(wd_name, other) THEN 'unsupported_entity' ELSE 'fused_entity' END, 'not_one_fact', 'comparison_not_one_fact'] WHEN 4 THEN ['unsupported_cause'] WHEN 5 THEN ['unresolved_citation'] WHEN 6 THEN ['unsupported_qualifier']
WHEN 7 THEN CASE WHEN ov IS NULL OR {_NEAR('ov', 'value')} OR {_NEAR('ov', 'peer')} OR {_NEAR('ov', 'gap')} THEN [] ELSE ['not_one_fact'] END ELSE [] END) AS issue_type FROM g x""")
def gr_05_deviation_claims(w):
    """Issues of claims about distributors: wrong differences and comparisons, fused names, causes, judging words, and figures of another distributor."""
    return claims.validate_claims(_deviation_claims(w), _evidence(w), _STATES, CATEGORIES).select("claim_id", "issue_type")


@query(f"""{_BASE}, x AS (SELECT d.*, {_KD} AS k FROM d) SELECT doc_id || '|' || wd_name || '|' || label AS claim_id, CASE WHEN k = 4 THEN 'causal' ELSE 'deviation' END AS claim_type FROM x""")
def gr_04_claim_types(w):
    return _deviation_claims(w).select("claim_id", claims.claim_type().alias("claim_type"))


@query(f"""{_BASE}, x AS (SELECT d.*, {_KD} AS k FROM d), n AS (SELECT doc_id, wd_name, (SELECT max(o.wd_name) FROM d o WHERE o.doc_id = x.doc_id AND o.wd_name <> x.wd_name) AS other FROM x WHERE k = 3 GROUP BY ALL)
SELECT DISTINCT doc_id, wd_name || ' and ' || other AS entity, least(wd_name, other) || ', ' || greatest(wd_name, other) AS fused FROM n WHERE other IS NOT NULL AND NOT contains(other, wd_name) AND NOT contains(wd_name, other)""")
def gr_15_fused_names(w):
    """Entities that fuse distributors of a document, taken apart."""
    c = _deviation_claims(w).where("entity LIKE '% and %'").select(F.split("claim_id", r"\|")[0].alias("doc_id"), "entity").distinct()
    return c.join(rendered(w).select("doc_id", "text"), "doc_id").select("doc_id", "entity", claims.fused_names(F.col("entity"), F.array_distinct(claims.off_names(F.col("text")))).alias("fused")).where("fused IS NOT NULL")


def _answers(w: Warehouse) -> DataFrame:
    """An answer for each document that states deviations: a sentence or two for each, some of them false, and remarks that differ by month. There are as many sentences as deviations in the document."""
    d = _deviations(w)
    peers = d.select("doc_id", "metric_label", F.col("wd_name").alias("o"), F.col("value").alias("ov"))
    same = d.select("doc_id", "metric_label", "wd_name").join(peers, ["doc_id", "metric_label"]).where("o <> wd_name").groupBy("doc_id", "metric_label", "wd_name").agg(F.max_by("ov", "o").alias("other_value"))
    k = F.pmod(_fault(F.col("month"), F.col("wd_name"), F.col("metric_label")), F.lit(4))
    tag = F.concat(F.lit(" [Data: Sources ("), "doc_id", F.lit(")]."))
    one = F.concat("wd_name", F.when(k == 3, " was looked at. It came to ").otherwise(" came to "), F.when(k == 1, F.lit(1234.56)).when(k == 2, F.coalesce("other_value", "value")).otherwise(F.col("value")).cast("string"), F.lit(" on "), "metric_label", F.lit(" in "), month_words("month"), tag)
    said = d.join(same, ["doc_id", "metric_label", "wd_name"], "left").groupBy("doc_id", "month").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("metric_label", "wd_name", one.alias("s")))), lambda x: x["s"]), " ").alias("text"))
    m = F.substring("month", 6, 2).cast("int") % 3
    remark = F.when(m == 0, "This was caused by rain").when(m == 1, "ACV stands for average customer value").otherwise("It should rise by 7777.25 next month, a remarkable plan")
    return said.select(F.col("doc_id").alias("answer_id"), F.concat("text", F.lit(" There is no evidence of a shared cause, so it may be due to rain. "), remark, tag).alias("text"))


_SAID = f"{_BASE}, x AS (SELECT d.*, {_KD} % 4 AS k, (SELECT max_by(o.value, o.wd_name) FROM d o WHERE o.doc_id = d.doc_id AND o.label = d.label AND o.wd_name <> d.wd_name) AS ov FROM d)"


@query(f"""{_SAID}, told AS (SELECT doc_id, wd_name, CASE k WHEN 1 THEN 1234.56 WHEN 2 THEN coalesce(ov, value) ELSE value END AS number, label FROM x),
off AS (SELECT * FROM told t WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.doc_id = t.doc_id AND d.wd_name = t.wd_name AND ({_NEAR('d.value', 't.number')} OR {_NEAR('d.peer', 't.number')} OR {_NEAR('d.gap', 't.number')}))),
kinds AS (SELECT doc_id, CASE WHEN EXISTS (SELECT 1 FROM d WHERE d.doc_id = off.doc_id AND d.wd_name <> off.wd_name AND ({_NEAR('d.value', 'off.number')} OR {_NEAR('d.peer', 'off.number')} OR {_NEAR('d.gap', 'off.number')})) THEN 'misattributed_number' ELSE 'unsupported_number' END AS issue_type FROM off)
SELECT doc_id AS answer_id, issue_type, count(*) AS n FROM kinds GROUP BY 1, 2""")
def gr_28_number_scan(w):
    """Numbers in answers that the nearest distributor before them doesn't have, and whether another one has."""
    facts = _deviations(w).select(F.col("doc_id").alias("answer_id"), F.col("wd_name").alias("entity"), F.explode(F.array("value", "peer_value", "gap")).alias("v")).groupBy("answer_id", "entity").agg(F.collect_set("v").alias("values"))
    found = claims.scan_numbers(claims.answer_sentences(_answers(w)), facts)
    return found.groupBy("answer_id", "issue_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"""{_BASE} SELECT DISTINCT doc_id AS answer_id, unnest(CASE CAST(substr(month, 6, 2) AS INT) % 3 WHEN 0 THEN ['unsupported_cause'] WHEN 1 THEN ['unsupported_definition', 'wrong_expansion']
ELSE CASE WHEN {_IN('7777.25').replace('x.doc_id', 'd.doc_id')} THEN ['unsupported_qualifier'] ELSE ['unsupported_qualifier', 'unsupported_advice_number'] END END) AS issue_type FROM d""")
def gr_29_language_scan(w):
    """Causes, definitions, judging words, advice and expansions in answers that the evidence doesn't bear out."""
    return claims.scan_language(claims.answer_sentences(_answers(w)), _evidence(w)).select("answer_id", "issue_type")


@query(f"""{_SAID} SELECT doc_id AS answer_id, CAST(sum(CASE WHEN k = 3 THEN 2 ELSE 1 END) + 2 AS BIGINT) AS n_sentences, CAST(sum(CASE WHEN k = 3 THEN 2 ELSE 1 END) + 2 AS BIGINT) AS n_cited FROM x GROUP BY 1""")
def sc_34_cited_sentences(w):
    """Sentences of each answer, and how many have citations of their own or of the next one."""
    s = claims.answer_sentences(_answers(w))
    return s.groupBy("answer_id").agg(F.count(F.lit(1)).alias("n_sentences"), F.count_if(F.size("tags") > 0).alias("n_cited"))
