"""Hybrid retrieval: normalise each hit list, fuse by 100-character
fingerprint with weights, top-k, normalise again.

Fusion is a ``unionByName`` + ``groupBy`` (cheaper than a full outer join and
exact when one list holds two hits with the same fingerprint)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.text import fingerprint
from .lexical import top_k

GROUP = ("query_id", "domain")


def min_max_normalize(df: DataFrame, score_col: str = "score", out_col: str = "norm",
                      part_cols=GROUP) -> DataFrame:
    """(s - min) / (max - min) within the group; all-equal groups get 1.0."""
    w = Window.partitionBy(*part_cols)
    lo, hi = F.min(score_col).over(w), F.max(score_col).over(w)
    return df.withColumn(out_col, F.when(hi == lo, F.lit(1.0))
                         .otherwise((F.col(score_col) - lo) / (hi - lo)))


def attach_chunks(hits: DataFrame, chunks: DataFrame, cols=("source", "content")) -> DataFrame:
    """Look up chunk columns for a hit list (k rows per query). No hint: the
    hit list is a derived intermediate, so AQE sizes it from runtime
    statistics and broadcasts it only if it is small."""
    return hits.join(chunks.select("domain", "chunk_id", *cols), ["domain", "chunk_id"])


def hybrid_fuse(vec_hits: DataFrame, lex_hits: DataFrame, chunks: DataFrame,
                vector_weight: float = C.VECTOR_WEIGHT, bm25_weight: float = C.BM25_WEIGHT) -> DataFrame:
    """-> (query_id, domain, fp, chunk_id, fused, first_list, first_rank).
    ``chunk_id`` is the first-seen hit of the fingerprint (vector list first).
    ``chunks`` have a fingerprint (fp) or their content."""
    v = min_max_normalize(vec_hits).select(*GROUP, "chunk_id", "rank", "norm",
                                           F.lit(0).alias("list_no"), F.lit(vector_weight).alias("w"))
    b = min_max_normalize(lex_hits).select(*GROUP, "chunk_id", "rank", "norm",
                                           F.lit(1).alias("list_no"), F.lit(bm25_weight).alias("w"))
    # only the 100-character fingerprint travels to the join, never the text
    fp = F.col("fp") if "fp" in chunks.columns else fingerprint("content", 100)
    fps = chunks.select("domain", "chunk_id", fp.alias("fp"))
    both = attach_chunks(v.unionByName(b), fps, ("fp",))
    first = F.min(F.struct("list_no", "rank", "chunk_id"))
    return (both.groupBy(*GROUP, "fp")
            .agg(F.round(F.sum(F.col("w") * F.col("norm")), 9).alias("fused"), first.alias("first"))
            .select(*GROUP, "fp", F.col("first.chunk_id").alias("chunk_id"), "fused",
                    F.col("first.list_no").alias("first_list"), F.col("first.rank").alias("first_rank")))


def hybrid_topk(vec_hits: DataFrame, lex_hits: DataFrame, chunks: DataFrame, k: int = C.TOP_K,
                vector_weight: float = C.VECTOR_WEIGHT, bm25_weight: float = C.BM25_WEIGHT) -> DataFrame:
    """-> (query_id, domain, rank, chunk_id, fused, score); the best hit scores 1.0."""
    fused = hybrid_fuse(vec_hits, lex_hits, chunks, vector_weight, bm25_weight)
    top = top_k(fused, k, [F.col("fused").desc(), F.col("first_list").asc(), F.col("first_rank").asc()])
    return min_max_normalize(top, "fused", "score")
