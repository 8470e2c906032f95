"""Tokens of a public tokenizer: a rank file and a pattern, both parameters."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranks of a byte-level BPE for many languages. On a cluster, give the file to the executors with addFile and name it without a folder.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


@lru_cache(2)
def encoding(path: str, pattern: str | None = None):
    """The tokenizer of a rank file, once per process. Without a pattern, the one that comes with the public rank files is taken; a path without a folder is a file added to the session."""
    import tiktoken

    if pattern is None:
        from public_tokenizers import PATTERN as pattern
    place = path if "/" in path else SparkFiles.get(path)
    ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, Path(place).read_bytes().splitlines())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column | str, tokenizer: str = TOKENIZER, pattern: str | None = None) -> Column:
    """Tokens of the whole text; 0 for null and empty ones."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        e = encoding(tokenizer, pattern)
        return pd.Series([len(e.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return count(text)


def token_chunks(docs: DataFrame, size: int = 1200, overlap: int = 100, tokenizer: str = TOKENIZER, pattern: str | None = None) -> DataFrame:
    """doc_id, chunk_no, n_tokens and text of overlapping chunks of ``size`` tokens; a last chunk that the one before holds whole is left out. Null, empty and blank texts have none.

    Whole texts, of any length, are cut where they lie, without a shuffle. A character that a chunk's edge cuts comes out as a replacement mark.
    """
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be less than a chunk")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoding(tokenizer, pattern)
        for b in batches:
            for doc_id, text in zip(b["doc_id"], b["text"]):
                ids = e.encode_ordinary(text)
                starts = range(0, max(1, len(ids) - overlap), size - overlap)
                parts = [ids[at : at + size] for at in starts]
                yield pd.DataFrame({"doc_id": [doc_id] * len(parts), "chunk_no": range(len(parts)), "n_tokens": list(map(len, parts)), "text": [e.decode(p) for p in parts]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").where(F.col("text").rlike(r"\S")).mapInPandas(cut, f"doc_id {kind}, chunk_no int, n_tokens int, text string")
