"""What a question asks for: state, periods, metric, direction, ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.claims import sku_text
from tallyloom.operators.grounding import tokens
from tallyloom.session import small, written

#: Fixed word lists of questions.
DECLINE = ["decline", "declined", "drop", "dropped", "fall", "fell", "decrease", "decreased", "worsen", "worsened"]
IMPROVE = ["improve", "improved", "rise", "rose", "increase", "increased", "grow", "grew", "gain", "gained"]
HIGHEST, LOWEST = ["top", "best", "highest", "most", "leading"], ["bottom", "worst", "lowest", "least", "poorest"]
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
METRICS = ["SKUs per Transaction", "Inventory Turns", "Inventory Days", "Service Level", "Productivity", "Dropsize", "Units Delivered", "Revenue"]
GLOBAL = r"(?i)\b(overall|across all|all states|nationwide|every state)\b"


def one_of(text: Column, yes: Sequence[str], no: Sequence[str], names: tuple[str, str], neither: str | None) -> Column:
    """names[0] if words of ``yes`` alone occur, names[1] for ``no`` alone, else ``neither``."""
    has = lambda words: F.arrays_overlap(tokens(text), F.array(*map(F.lit, words)))
    return F.when(has(yes) & ~has(no), names[0]).when(has(no) & ~has(yes), names[1]).otherwise(F.lit(neither))


def shared_years(text: Column) -> Column:
    """'January and March 2026' with the year written out for each month."""
    return F.regexp_replace(text, rf"\b({MONTHS})(\s*(?:,|and|to|vs\.?)\s*)({MONTHS}) (\d{{4}})", "$1 $4$2$3 $4")


def requirements(questions: DataFrame, states: Sequence[str]) -> DataFrame:
    """questions (with question) and state_name, n_states, periods, target_year, metric, direction, rank_n, rank_direction, intent; the states are a bounded list.

    Longer names are tried first; a year counts only where no month is named, and the last one; directions and rankings named both ways are neutral.
    """
    q = F.col("question")
    named = "|".join(sorted(states, key=lambda s: (-len(s), s)))
    found = F.array_distinct(F.regexp_extract_all(q, F.lit(rf"(?i)\b({named})\b"), F.lit(1)))
    periods = F.array_distinct(F.regexp_extract_all(shared_years(q), F.lit(rf"\b((?:{MONTHS}) \d{{4}})"), F.lit(1)))
    years = F.regexp_extract_all(q, F.lit(r"\b(20\d\d|19\d\d)\b"), F.lit(1))
    metric = F.coalesce(*[F.when(F.lower(q).contains(m.lower()), m) for m in sorted(METRICS, key=len, reverse=True)])
    n = F.nullif(F.regexp_extract(q, r"(?i)\b(?:top|bottom)\s+(\d+)", 1), F.lit("")).cast("int")
    rank = one_of(q, HIGHEST, LOWEST, ("highest", "lowest"), None)
    intent = F.when(q.rlike(GLOBAL) | (F.size(found) > 1), "global").when(F.size(found) == 1, "local").otherwise("basic")
    return questions.select(
        "*",
        F.get(found, 0).alias("state_name"),
        F.size(found).alias("n_states"),
        F.array_join(periods, ", ").alias("periods"),
        F.when(F.size(periods) == 0, F.try_element_at(years, F.lit(-1)).cast("int")).alias("target_year"),
        metric.alias("metric"),
        one_of(q, DECLINE, IMPROVE, ("down", "up"), "neutral").alias("direction"),
        n.alias("rank_n"),
        rank.alias("rank_direction"),
        intent.alias("intent"),
    )


#: Other words for metrics, and words for sold quantity.
SYNONYMS = {
    "fill rate": "Service Level", "order fulfilment": "Service Level", "stock cover": "Inventory Days", "days of stock": "Inventory Days", "stock turns": "Inventory Turns", "stock rotation": "Inventory Turns",
    "drop size": "Dropsize", "order size": "Dropsize", "lines per order": "SKUs per Transaction", "skus per order": "SKUs per Transaction", "productive calls": "Productivity", "sales value": "Revenue", "turnover": "Revenue",
}
VOLUME = ["units sold", "units delivered", "quantity sold", "sales volume", "best selling", "best-selling", "most sold", "least sold", "volume"]
#: Metrics that are given per category, by the names that questions use.
CATEGORY_METRICS = {
    "numeric distribution": "Numeric Distribution", "distribution reach": "Numeric Distribution", "acv": "ACV", "weighted distribution": "ACV", "range billing": "Range Billing", "range billed": "Range Billing",
    "out-of-stock rate": "Out-of-Stock Rate", "out of stock rate": "Out-of-Stock Rate", "oos": "Out-of-Stock Rate", "stock-outs": "Out-of-Stock Rate",
}
#: Verbs with a particle that say nothing about a direction.
NO_DIRECTION = ["drop by", "drop in on", "drop off at", "fall under", "fall within", "fall into", "fell under", "fell within", "rise to the occasion", "grow up"]
_SUPERLATIVE = r"(?i)\b(best|worst|top|highest|lowest|strongest|weakest|poorest|least|most)[- ]performing\b"


def _words(phrase: str) -> str:
    return r"(?<![A-Za-z0-9])" + phrase.replace(" ", r"\s+").replace("-", r"[-\s]") + r"(?![A-Za-z0-9])"


def first_named(text: Column, names: dict[str, str]) -> Column:
    """What the longest of the names that a text has as whole words stands for; null without any. Names are a bounded list."""
    return F.coalesce(*[F.when(text.rlike("(?i)" + _words(n)), names[n]) for n in sorted(names, key=lambda n: (-len(n), n))])


def metric_named(text: Column) -> Column:
    """The metric a text names by its name or another word for it, the longest one."""
    return first_named(text, {**{m.lower(): m for m in METRICS}, **SYNONYMS})


def volume_metric(text: Column) -> Column:
    """Units Delivered where a text asks for sold quantity in other words."""
    return F.when(text.rlike("(?i)" + "|".join(map(_words, VOLUME))), "Units Delivered")


def category_metric(text: Column) -> Column:
    """The metric per category that a text names."""
    return first_named(text, CATEGORY_METRICS)


def categories_named(text: Column, categories: Sequence[str]) -> Column:
    """The categories a text names as whole words, in their own spelling, sorted; the categories are a bounded list."""
    return F.array_sort(F.array_compact(F.array(*[F.when(text.rlike("(?i)" + _words(c)), c) for c in categories])))


def superlative(text: Column) -> Column:
    """The superlative of a claim such as 'best performing', lower case; null without one."""
    return F.lower(F.nullif(F.regexp_extract(text, _SUPERLATIVE, 1), F.lit("")))


def direction_claimed(text: Column) -> Column:
    """up, down or neutral, as a question claims it; verbs with a particle that mean no direction don't count."""
    plain = F.regexp_replace(text, "(?i)" + "|".join(map(_words, sorted(NO_DIRECTION, key=len, reverse=True))), " ")
    return one_of(plain, DECLINE, IMPROVE, ("down", "up"), "neutral")


def rank_n(text: Column) -> Column:
    """How many items a ranking asks for; one where it doesn't say."""
    return F.coalesce(F.nullif(F.regexp_extract(text, r"(?i)\b(?:top|bottom|best|worst)\s+(\d+)", 1), F.lit("")).cast("int"), F.lit(1))


def skus_named(questions: DataFrame, skus: DataFrame, key: str = "question_id") -> DataFrame:
    """key and sku_id of each SKU whose name a question holds as whole words; of names within one another only the longest count.

    ``skus`` has sku_id and sku_name, any number of them: the runs of words of a question, as long as names can be, meet the names by equality, so no question is held against every name.
    Names are broadcast if few, by measured bytes. Beyond that both sides are sorted and merged whatever Spark estimates: it takes the runs for as few as the questions, and would gather them on the driver to broadcast them.
    """
    name = sku_text(F.col("sku_name"))
    known = written(skus.select("sku_id", name.alias("run")).where("run <> ''").distinct(), "skus")
    few = small(known)
    names = few if few is not known else known.hint("merge")
    widths = [r[0] for r in known.select(F.size(F.split("run", " ")).alias("n")).distinct().collect()]  # as many as names have lengths
    w = questions.select(key, F.split(sku_text(F.col("question")), " ").alias("w")).where("size(w) > 0")
    runs = w.select(key, "w", F.explode(F.array(*map(F.lit, sorted(widths))).cast("array<int>")).alias("n")).where("n <= size(w)").select(key, "w", "n", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)).alias("at"))
    met = runs.select(key, "at", "n", F.array_join(F.slice("w", F.col("at"), F.col("n")), " ").alias("run")).join(names, "run")
    held = met.groupBy(key).agg(F.collect_set(F.struct("at", (F.col("at") + F.col("n")).alias("to"), "n", "sku_id")).alias("ms"))  # at most as many as a question has runs of words
    alone = F.filter("ms", lambda m: ~F.exists("ms", lambda x: (x["at"] <= m["at"]) & (x["to"] >= m["to"]) & (x["n"] > m["n"])))
    return held.select(key, F.explode(alone).alias("m")).select(key, "m.sku_id").distinct()
