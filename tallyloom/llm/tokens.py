"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.tokens import TOKENIZER, token_count


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, keep: list[str] = (), pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the columns to keep, without the texts."""
    return docs.select(F.col(doc_id).alias("doc_id"), *keep, token_count(text, tokenizer, pattern).alias("n_tokens"))
