"""Retrieval score and fused answer confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.parse import fused_confidence, parse_rating


def retrieval_score(queries: DataFrame, hits: DataFrame, keys=("query_id", "domain")) -> DataFrame:
    """Rank-discounted mean of hit scores, weights 1/rank; a query with no
    hits scores 0.0 (left join from the query set)."""
    k = list(keys)
    agg = hits.groupBy(*k).agg(
        F.count(F.lit(1)).alias("n_hits"),
        (F.sum(F.col("score") * (1.0 / F.col("rank"))) / F.sum(1.0 / F.col("rank"))).alias("rs"))
    return (queries.select(*k).join(agg, k, "left")
            .select(*k, F.coalesce("n_hits", F.lit(0)).cast("bigint").alias("n_hits"),
                    F.coalesce("rs", F.lit(0.0)).alias("retrieval_score")))


def score(df: DataFrame, threshold: float = C.CONFIDENCE_THRESHOLD) -> DataFrame:
    """(router_confidence, retrieval_score, rating_text) -> llm_score,
    confidence, low_confidence. Empty rating text counts as 0.5."""
    llm = F.when(F.coalesce(F.col("rating_text"), F.lit("")) == "", F.lit(0.5)).otherwise(parse_rating("rating_text"))
    out = df.withColumn("llm_score", llm)
    out = out.withColumn("confidence", fused_confidence("router_confidence", "retrieval_score", "llm_score"))
    return out.withColumn("low_confidence", F.col("confidence") < threshold)


def low_confidence(audit: DataFrame, threshold: float = C.CONFIDENCE_THRESHOLD) -> DataFrame:
    """Records to review: confidence below the threshold (no confidence is 0)."""
    return audit.filter(F.coalesce("final_confidence", F.lit(0.0)) < threshold)
