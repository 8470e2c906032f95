"""Nearest vectors and text chunks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors of a block, and rows of a part; each block is held against each part in a task of its own.
QUERY_BLOCK, PART_ROWS = 2_000, 20_000


def nearest(vectors: DataFrame, queries: DataFrame, k: int, block: int = QUERY_BLOCK, part_rows: int = PART_ROWS) -> DataFrame:
    """query_id, vec_id, similarity (cosine) and place of the k rows of ``vectors`` nearest to each query, itself left out; ties go to the lower vec_id.

    Both have vec_id and embedding. Exact, as every query must meet every row: queries are dealt to blocks and rows to parts of bounded size by a hash, and each pair of a block and a part is one task,
    which keeps the part's best k for each query of the block by a matrix product. These, k for each query and part, are ranked. Nothing passes through the driver but two counts.
    Null vectors, and vectors of no length, are left out.
    """
    rows = vectors.where("embedding IS NOT NULL").select("vec_id", "embedding")
    asked = queries.where("embedding IS NOT NULL").select("vec_id", "embedding")
    parts, blocks = max(1, -(-rows.count() // part_rows)), max(1, -(-asked.count() // block))
    dealt = lambda d, n, own, other, m: d.withColumn(own, F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    left, right = dealt(asked, blocks, "b", "p", parts), dealt(rows, parts, "p", "b", blocks)

    def units(b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        ids, m = b["vec_id"].to_numpy(), np.array(b["embedding"].tolist(), np.float64).reshape(len(b), -1)
        length = np.linalg.norm(m, axis=1)
        return ids[length > 0], m[length > 0] / length[length > 0, None]

    def best(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        (q_ids, q_rows), (v_ids, v_rows) = units(q), units(v)
        none = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "similarity": np.zeros(0)})
        if not len(q_ids) or not len(v_ids):
            return none
        found = [none]
        order = np.argsort(v_ids, kind="stable")
        v_ids, v_rows = v_ids[order], v_rows[order]
        for lo in range(0, len(q_ids), 256):  # a strip of the product at a time
            ids = q_ids[lo : lo + 256]
            s = np.round(q_rows[lo : lo + 256] @ v_rows.T, 6)
            s[ids[:, None] == v_ids[None, :]] = -np.inf
            top = np.argsort(-s, axis=1, kind="stable")[:, :k]
            found.append(pd.DataFrame({"query_id": np.repeat(ids, top.shape[1]), "vec_id": v_ids[top].reshape(-1), "similarity": np.take_along_axis(s, top, 1).reshape(-1)}))
        out = pd.concat(found)
        return out[np.isfinite(out["similarity"])]

    found = left.groupBy("b", "p").cogroup(right.groupBy("b", "p")).applyInPandas(best, "query_id long, vec_id long, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "vec_id")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def word_chunks(docs: DataFrame, size: int = 1200, overlap: int = 100) -> DataFrame:
    """doc_id, chunk_no and text of overlapping chunks of ``size`` words; a last chunk that the one before holds whole is left out. Null and blank texts have none."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    w = docs.select("doc_id", words.alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - F.lit(overlap + 1)), F.lit(size - overlap))
    cut = w.select("doc_id", "w", F.posexplode(starts).alias("chunk_no", "at"))
    return cut.select("doc_id", "chunk_no", F.array_join(F.slice("w", F.col("at") + 1, F.lit(size)), " ").alias("text"))
