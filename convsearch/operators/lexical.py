"""BM25 (Okapi) lexical retrieval as joins and aggregations.

Index layout (all partitionable by ``domain``):

* ``term_stats(domain, term, df, idf)``
* ``corpus_stats(domain, n, avgdl, avg_idf)``
* ``tokens(domain, chunk_id, toks)`` -- the tokenised chunks

``impacts`` (per-posting BM25 weight) can be materialised for a persisted,
query-independent index. Scoring a batch restricts postings to the batch's
vocabulary first; the vocabulary side is broadcast only behind a bounded row
count, otherwise the joins are shuffle joins where AQE splits skewed
(stop-word) keys.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.text import tokenize
from ..spark import DEFAULT_BROADCAST_ROWS, maybe_broadcast


def impact(tf, dl, idf, avgdl, k1: float = C.BM25_K1, b: float = C.BM25_B):
    """The weight of a term that occurs ``tf`` times among ``dl`` tokens."""
    return idf * (tf * (k1 + 1) / (tf + k1 * ((1 - b) + b * dl / avgdl)))


def idf_table(df: DataFrame, corpus: DataFrame, epsilon: float = C.BM25_EPSILON) -> tuple[DataFrame, DataFrame]:
    """(domain, term, df) and (domain, n, ...) -> (domain, term, df, idf) and
    (domain, avg_idf). A negative idf becomes a share of the domain's mean."""
    df = df.join(corpus.select("domain", "n"), "domain")
    df = df.withColumn("idf0", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    avg_idf = df.groupBy("domain").agg(F.avg("idf0").alias("avg_idf"))
    idf = F.when(F.col("idf0") < 0, F.lit(epsilon) * F.col("avg_idf")).otherwise(F.col("idf0"))
    return df.join(avg_idf, "domain").select("domain", "term", "df", F.round(idf, 12).alias("idf")), avg_idf


@dataclass
class LexicalIndex:
    tokens: DataFrame        # (domain, chunk_id, toks)
    term_stats: DataFrame    # (domain, term, df, idf)
    corpus_stats: DataFrame  # (domain, n, avgdl, avg_idf)
    k1: float = C.BM25_K1
    b: float = C.BM25_B

    def weight(self, tf, dl, idf, avgdl):
        return impact(tf, dl, idf, avgdl, self.k1, self.b)

    @property
    def impacts(self) -> DataFrame:
        """Query-independent postings with their BM25 weight, for persisting
        a reusable index (domain-partitioned) -- see ``sources.corpus``."""
        p = (self.tokens.select("domain", "chunk_id", F.size("toks").alias("dl"), F.explode_outer("toks").alias("term"))
             .filter(F.col("term").isNotNull()).groupBy("domain", "chunk_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.max("dl").alias("dl")))
        return (p.join(self.term_stats, ["domain", "term"])
                .join(F.broadcast(self.corpus_stats.select("domain", "avgdl")), "domain")
                .select("domain", "term", "chunk_id", "tf",
                        self.weight(F.col("tf"), F.col("dl"), F.col("idf"), F.col("avgdl")).alias("weight")))


def build_index(chunks: DataFrame, text_col: str = "content", k1: float = C.BM25_K1,
                b: float = C.BM25_B, epsilon: float = C.BM25_EPSILON) -> LexicalIndex:
    """``chunks(domain, chunk_id, <text_col>)`` -> LexicalIndex.

    Document frequencies come from each chunk's distinct terms, so the
    vocabulary aggregate combines map-side; the per-domain tables (corpus
    stats) have one row per domain and are broadcast by construction."""
    toks = chunks.select("domain", "chunk_id", tokenize(text_col).alias("toks"))
    corpus = (toks.groupBy("domain")
              .agg(F.count(F.lit(1)).alias("n"),
                   (F.sum(F.size("toks")).cast("double") / F.count(F.lit(1))).alias("avgdl")))
    # explode_outer + null filter: a plain explode makes Catalyst infer a
    # size(toks) > 0 filter and push the tokeniser below the rebalance
    df = (toks.select("domain", F.explode_outer(F.array_distinct("toks")).alias("term"))
          .filter(F.col("term").isNotNull()).groupBy("domain", "term").agg(F.count(F.lit(1)).alias("df")))
    term_stats, avg_idf = idf_table(df, corpus, epsilon)
    corpus_stats = corpus.join(avg_idf, "domain")
    return LexicalIndex(toks, term_stats, corpus_stats, k1, b)


def query_terms(queries: DataFrame, text_col: str = "query") -> DataFrame:
    """``queries(query_id, domain, query)`` -> (query_id, domain, term, qtf).
    Repeated query tokens count with multiplicity."""
    return (queries.select("query_id", "domain", F.explode(tokenize(text_col)).alias("term"))
            .groupBy("query_id", "domain", "term").agg(F.count(F.lit(1)).alias("qtf")))


def bm25_scores(queries: DataFrame, index: LexicalIndex, text_col: str = "query",
                broadcast_rows: int | None = None) -> DataFrame:
    """Score of every chunk sharing at least one term with the query (chunks
    sharing none score 0 and are never returned by top-k).

    Only the batch's vocabulary is needed: chunk tokens are semi-joined with
    the (size-checked, broadcast) query vocabulary *before* postings are
    aggregated, so the shuffle carries query-term postings only."""
    bound = broadcast_rows or DEFAULT_BROADCAST_ROWS
    qt = query_terms(queries, text_col)
    qvocab = qt.select("domain", "term").distinct()
    small_vocab = qvocab.limit(bound + 1).count() <= bound
    if small_vocab:
        qvocab = F.broadcast(qvocab)
    ts = index.term_stats.join(qvocab, ["domain", "term"])
    # term stats of the batch vocabulary: at most as many rows as the checked
    # vocabulary, so broadcasting them is bounded too
    ts = F.broadcast(ts) if small_vocab else ts
    qt = maybe_broadcast(qt, bound)
    postings = (index.tokens.select("domain", "chunk_id", F.size("toks").alias("dl"), F.explode_outer("toks").alias("term"))
                .filter(F.col("term").isNotNull()).join(qvocab, ["domain", "term"])
                .groupBy("domain", "chunk_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.max("dl").alias("dl")))
    w = (postings.join(ts, ["domain", "term"])
         .join(F.broadcast(index.corpus_stats.select("domain", "avgdl")), "domain")
         .select("domain", "term", "chunk_id",
                 index.weight(F.col("tf"), F.col("dl"), F.col("idf"), F.col("avgdl")).alias("weight")))
    return (qt.join(w, ["domain", "term"])
            .groupBy("query_id", "domain", "chunk_id")
            .agg(F.round(F.sum(F.col("qtf") * F.col("weight")), 9).alias("score")))


def top_k(scored: DataFrame, k: int, order_cols, part_cols=("query_id", "domain"),
          rank_col: str = "rank") -> DataFrame:
    """Deterministic top-k per group via ``row_number`` (Catalyst inserts a
    partial WindowGroupLimit before the shuffle, so a group never brings more
    than k rows per input partition to its task)."""
    w = Window.partitionBy(*part_cols).orderBy(*order_cols)
    return (scored.withColumn(rank_col, F.row_number().over(w))
            .filter(F.col(rank_col) <= k)
            .withColumn(rank_col, F.col(rank_col).cast("bigint")))


def bm25_topk(queries: DataFrame, index: LexicalIndex, k: int = C.TOP_K,
              text_col: str = "query") -> DataFrame:
    """Top-k lexical hits: score desc, ties by chunk order; scores <= 0 dropped
    (dropping before the slice equals slicing then dropping)."""
    s = bm25_scores(queries, index, text_col).filter(F.col("score") > 0)
    return top_k(s, k, [F.col("score").desc(), F.col("chunk_id").asc()])
