"""Chunking documents into rows.

* ``chunk_documents`` -- the recursive splitter (a fold in one expression) +
  ``posexplode``; one row per chunk.
* ``chunk_fixed`` -- fixed character windows (size, size - overlap step), a
  pure Catalyst expression.

``chunk_id = doc_id * CHUNK_ID_STRIDE + chunk_no`` keeps ids stable and
local to the document, so re-chunking one domain never renumbers another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.splitter import chunks_of

CHUNK_ID_STRIDE = 1_000_000


def chunk_documents(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                    size: int = C.CHUNK_SIZE, overlap: int = C.CHUNK_OVERLAP,
                    keep=("domain", "source")) -> DataFrame:
    """docs(id, text, ...) -> chunks(<keep>, doc_id, chunk_no, chunk_id, content)."""
    keep = [c for c in keep if c in docs.columns]
    parts = docs.select(*keep, F.col(id_col).alias("doc_id"),
                        chunks_of(text_col, size, overlap).alias("parts"))
    # posexplode_outer: no inferred size(parts) > 0 filter, which would split twice
    parts = parts.select(*keep, "doc_id", F.posexplode_outer("parts").alias("chunk_no", "content"))
    return parts.filter(F.col("content").isNotNull()).select(
        *keep, "doc_id", F.col("chunk_no").cast("bigint").alias("chunk_no"),
        (F.col("doc_id") * CHUNK_ID_STRIDE + F.col("chunk_no")).alias("chunk_id"), "content")


def chunk_fixed(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                size: int = C.CHUNK_SIZE, overlap: int = C.CHUNK_OVERLAP,
                keep=("domain", "source")) -> DataFrame:
    """Windows starting every ``size - overlap`` characters; a text of length
    L > 0 yields max(1, ceil((L - overlap) / (size - overlap))) windows."""
    keep = [c for c in keep if c in docs.columns]
    step = size - overlap
    n = F.char_length(text_col)
    cnt = F.when(n > 0, F.greatest(F.lit(1), F.ceil((n - overlap) / F.lit(step)).cast("int"))).otherwise(0)
    starts = F.when(cnt > 0, F.sequence(F.lit(0), cnt - 1)).otherwise(F.array().cast("array<int>"))
    e = docs.select(*keep, F.col(id_col).alias("doc_id"), F.col(text_col).alias("_t"),
                    F.explode(starts).alias("chunk_no"))
    return e.select(*keep, "doc_id", F.col("chunk_no").cast("bigint").alias("chunk_no"),
                    (F.col("doc_id") * CHUNK_ID_STRIDE + F.col("chunk_no")).alias("chunk_id"),
                    F.expr(f"substring(_t, chunk_no * {step} + 1, {size})").alias("content"))
