"""KPI tables rendered as text documents, and the documents parsed back to facts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.keys import month_words, words_month

#: Label of each metric in texts, and whether it is printed in percent.
STATE_LABELS = {
    "productivity": ("Productivity", True),
    "service_level": ("Service Level", True),
    "skus_per_transaction": ("SKUs per Transaction", False),
    "dropsize": ("Dropsize", False),
    "inventory_turns": ("Inventory Turns", False),
    "inventory_days": ("Inventory Days", False),
}
CATEGORY_LABELS = {"numeric_distribution": ("Numeric Distribution", True), "acv": ("ACV", True), "range_billing": ("Range Billing", True), "oos_pct": ("Out-of-Stock Rate", True)}
_NUMBER = r"(-?[\d,]+(?:\.\d+)?)%?"


def printed(c: Column, percent: bool) -> Column:
    """A metric as it is printed: rounded first, then formatted, so that every engine prints the same."""
    return F.concat(F.format_string("%.1f", F.round(c * 100, 1)), F.lit("%")) if percent else F.format_string("%.2f", F.round(c, 2))


def number(text: Column) -> Column:
    """A printed number as a double; null if it isn't one."""
    return F.regexp_replace(text, "[,%]", "").try_cast("double")


def _sentences(labels: Mapping[str, tuple[str, bool]], end: str) -> list[Column]:
    return [F.when(F.col(m).isNotNull(), F.concat(F.lit(f"{label} was "), printed(F.col(m), pct), F.lit(end))) for m, (label, pct) in labels.items()]


def render(states: DataFrame, categories: DataFrame, deviations: DataFrame) -> DataFrame:
    """One document per state and month: doc_id (file name), state_name, month, text.

    A head block, one sentence per state metric, one paragraph per category in alphabetical order, and one sentence per distributor off its state. A metric without value is left
    out. The parts of a document are gathered per state and month, of which there are at most as many as categories and distributors.
    """
    keys = ["state_name", "month"]
    place = F.concat(F.lit(" in "), F.col("state_name"), F.lit(", "), month_words("month"))
    per_category = categories.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("category_name", F.concat(F.lit("Category "), F.col("category_name"), place, F.lit(": "), F.concat_ws("; ", *_sentences(CATEGORY_LABELS, "")), F.lit(".")).alias("t")))).alias("c")
    )
    label = F.element_at(F.create_map(*[F.lit(x) for m, (name, _) in STATE_LABELS.items() for x in (m, name)]), F.col("metric"))
    percent = F.col("metric").isin([m for m, (_, p) in STATE_LABELS.items() if p])
    shown = lambda c: F.when(percent, printed(F.col(c), True)).otherwise(printed(F.col(c), False))
    off = F.concat(F.lit("Distributor "), F.col("wd_name"), F.lit(" was off on "), label, place, F.lit(": "), shown("value"), F.lit(" against a state value of "), shown("peer_value"), F.lit(", a gap of "), F.format_string("%.1f", F.round("gap", 1)), F.lit("."))
    per_wd = deviations.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("metric", "wd_id", off.alias("t")))).alias("d"))
    head = F.concat(F.lit("State: "), F.col("state_name"), F.lit("\nPeriod: "), month_words("month"))
    text = lambda c: F.transform(F.coalesce(c, F.array()), lambda x: x["t"])
    joined = states.join(per_category, keys, "left").join(per_wd, keys, "left")
    parts = F.concat(F.array(head, F.concat_ws(" ", *_sentences(STATE_LABELS, "."))), text(F.col("c")), text(F.col("d")))
    name = F.concat(F.replace(F.col("state_name"), F.lit(" "), F.lit("_")), F.lit("_"), F.col("month"), F.lit(".txt"))
    return joined.select(name.alias("doc_id"), *keys, F.array_join(F.filter(parts, lambda p: p != ""), "\n\n").alias("text"))


def header(text: Column, field: str) -> Column:
    """The value of a head line such as State: or Period:; null without one."""
    return F.nullif(F.regexp_extract(text, rf"(?m)^{field}:\s*(.+?)\s*$", 1), F.lit(""))


def state_facts(docs: DataFrame) -> DataFrame:
    """State metrics read from texts: doc_id, state_name, month, metric, value. A text without head, or a metric without sentence, gives no row."""
    found = [F.struct(F.lit(m).alias("metric"), number(F.nullif(F.regexp_extract("text", rf"(?m)(?:^|\. ){label} was {_NUMBER}", 1), F.lit(""))).alias("value")) for m, (label, _) in STATE_LABELS.items()]
    read = docs.select("doc_id", header(F.col("text"), "State").alias("state_name"), words_month(header(F.col("text"), "Period")).alias("month"), F.explode(F.array(*found)).alias("f"))
    return read.select("doc_id", "state_name", "month", "f.*").where("state_name IS NOT NULL AND month IS NOT NULL AND value IS NOT NULL")


def _all_groups(text: str, pattern: str, names: Sequence[str]) -> Column:
    """Every match of the pattern, as an array of structs of its groups."""
    return F.arrays_zip(*[F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(i)).alias(n) for i, n in enumerate(names, 1)])


def category_facts(docs: DataFrame) -> DataFrame:
    """Category metrics read from texts, with or without head block: doc_id, state_name, month, category_name, metric, value."""
    block = _all_groups("text", r"Category (.+?) in (.+?), (\w+ \d{4}): (.+?)\.(?=\s|$)", ["c", "s", "p", "body"])
    one = docs.select("doc_id", F.explode(block).alias("b"))
    found = [F.struct(F.lit(m).alias("metric"), number(F.nullif(F.regexp_extract("b.body", rf"{label} was {_NUMBER}", 1), F.lit(""))).alias("value")) for m, (label, _) in CATEGORY_LABELS.items()]
    return one.select("doc_id", F.col("b.s").alias("state_name"), words_month(F.col("b.p")).alias("month"), F.col("b.c").alias("category_name"), F.explode(F.array(*found)).alias("f")).select("doc_id", "state_name", "month", "category_name", "f.*").where("value IS NOT NULL")


def deviation_facts(docs: DataFrame) -> DataFrame:
    """Distributors off their state, read from texts: doc_id, wd_name, metric_label, value, peer_value, gap."""
    pattern = rf"Distributor (.+?) was off on (.+?) in .+?: {_NUMBER} against a state value of {_NUMBER}, a gap of ([\d.]+\d)"
    one = docs.select("doc_id", F.explode(_all_groups("text", pattern, ["w", "m", "v", "p", "g"])).alias("b"))
    return one.select("doc_id", F.col("b.w").alias("wd_name"), F.col("b.m").alias("metric_label"), number(F.col("b.v")).alias("value"), number(F.col("b.p")).alias("peer_value"), number(F.col("b.g")).alias("gap"))
