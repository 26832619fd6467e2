"""Exact lexical top-k over a persisted index, with score bounds.

Scoring every chunk that shares a term with a query means that stop words pair
each query with nearly all chunks. Here:

1. the heaviest postings of each term (the index keeps them) give some chunks
   of each query partial scores. The best of these chunks are scored in full;
   the k-th best score is a ``floor``: that of all chunks is not below it;
2. a query's terms are put in order of the most that they can add. The longest
   run of the least of them whose sum stays below the floor is left out: a
   chunk with no other term cannot be in the top k (the max-score rule);
3. only the postings of the other, essential terms make candidates; one whose
   score plus all that the left-out terms could add is below the floor goes;
4. what is left gets the weights of the left-out terms by an equi-join on
   (domain, term, chunk): their long lists are scanned, but pair with the few
   candidates only.

Negative weights (very frequent terms may have them) add nothing to a bound.
All steps are joins and combined
aggregates; the postings read are those of the buckets of the batch's terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..sources.lexstore import LexicalStore
from ..spark import cut_lineage, maybe_broadcast
from .lexical import impact, query_terms, top_k

#: Sums of floats in different orders differ by far less.
MARGIN = 1e-6


#: So many times k chunks of a query are scored in full for its floor.
SEEDS = 4
#: Queries whose terms have fewer postings are scored without bounds, which
#: would cost more than they save; the result is the same.
BOUND_FROM = 200_000
BY = ["query_id", "domain"]
TERM = ["term", "qtf", "idf", "avgdl"]


def bounded_terms(queries: DataFrame, store: LexicalStore, k: int = C.TOP_K, text_col: str = "query", bound_from: int = BOUND_FROM) -> DataFrame:
    """query_id, domain, bucket, term, qtf, df, essential, floor and rest (the
    most that the left-out terms of the query can add)."""
    per_query = Window.partitionBy(*BY)
    asked = maybe_broadcast(query_terms(queries, text_col)).join(store.table("terms").select("domain", "bucket", "term", "df", "idf", "most"), ["domain", "term"])
    asked = asked.join(F.broadcast(store.table("corpus").select("domain", "avgdl")), "domain")
    asked = asked.withColumn("adds", F.col("qtf") * F.greatest("most", F.lit(0.0))).withColumn("large", F.sum("df").over(per_query) >= bound_from)
    asked = cut_lineage(asked)
    cols = [*BY, "bucket", "term", "qtf", "idf", "avgdl", "df", "essential", "floor", "rest"]
    large = asked.filter("large")
    if not large.limit(1).count():
        return asked.select("*", F.lit(True).alias("essential"), F.lit(-MARGIN).alias("floor"), F.lit(0.0).alias("rest")).select(*cols)
    partial = (maybe_broadcast(large.select(*BY, *TERM)).join(store.table("champions").select("domain", "term", "chunk_id", "tf", "dl"), ["domain", "term"])
               .groupBy(*BY, "chunk_id").agg(F.sum(_adds()).alias("score")))
    best = [F.col("score").desc(), F.col("chunk_id").asc()]
    seeds = cut_lineage(top_k(partial, SEEDS * k, best).select(*BY, "chunk_id"))
    full = _completed(seeds, large, _postings(store, large)).groupBy(*BY, "chunk_id").agg(F.sum("score").alias("score"))
    kth = top_k(full, k, best).filter(F.col("rank") == k).select(*BY, F.col("score").alias("kth"))
    # chunks without a positive score are no hits, so 0 is a floor, too
    floor = F.greatest(F.coalesce(F.col("kth"), F.lit(0.0)), F.lit(0.0)) - MARGIN
    below = F.sum("adds").over(per_query.orderBy("adds", "term").rowsBetween(Window.unboundedPreceding, 0))
    marked = asked.join(kth, BY, "left").withColumn("floor", floor).withColumn("essential", below >= F.col("floor"))
    # leaving terms out must save more postings than the candidates may look up
    out = F.sum(F.when(~F.col("essential"), 1).otherwise(0)).over(per_query)
    saved, scored = (F.sum(F.when(F.col("essential") == e, F.col("df")).otherwise(0)).over(per_query) for e in (False, True))
    marked = marked.withColumn("worth", F.col("large") & (saved > out * scored)).withColumn("essential", F.col("essential") | ~F.col("worth"))
    rest = F.sum(F.when(~F.col("essential"), F.col("adds")).otherwise(0.0)).over(per_query)
    return cut_lineage(marked.withColumn("rest", rest).select(*cols))


def _completed(chunks: DataFrame, terms: DataFrame, postings: DataFrame) -> DataFrame:
    """What each of the query's ``terms`` adds to each of its ``chunks``. Up to
    a bounded number, the pairs are looked for where the postings are read."""
    pairs = cut_lineage(chunks.select(*BY, "chunk_id").join(terms.select(*BY, *TERM), BY))
    return (maybe_broadcast(pairs).join(postings, ["domain", "term", "chunk_id"])
            .select(*BY, "chunk_id", _adds().alias("score")))


def _adds() -> Column:
    """What a posting adds to a query's score."""
    return F.col("qtf") * impact(F.col("tf"), F.col("dl"), F.col("idf"), F.col("avgdl"))


def _postings(store: LexicalStore, terms: DataFrame) -> DataFrame:
    """The postings of the buckets that ``terms`` fall in: at most as many
    numbers as there are buckets come to the driver."""
    buckets = [r.bucket for r in terms.select("bucket").distinct().collect()]
    domains = [r.domain for r in terms.select("domain").distinct().collect()]
    return store.table("postings", domains).filter(F.col("bucket").isin(buckets)).drop("bucket")


def _candidates(terms: DataFrame, postings: DataFrame) -> DataFrame:
    some = maybe_broadcast(terms.filter("essential").select(*BY, *TERM, "floor", "rest"))
    scored = some.join(postings, ["domain", "term"]).groupBy(*BY, "chunk_id").agg(
        F.sum(_adds()).alias("score"), F.first("floor").alias("floor"), F.first("rest").alias("rest"))
    return scored.filter(F.col("score") + F.col("rest") >= F.col("floor")).select(*BY, "chunk_id", "score")


def bm25_topk(queries: DataFrame, store: LexicalStore, k: int = C.TOP_K, text_col: str = "query", bound_from: int = BOUND_FROM) -> DataFrame:
    """query_id, domain, chunk_id, score and rank of the k best chunks of each
    query: score descending, ties by chunk, none at 0 or below."""
    terms = bounded_terms(queries, store, k, text_col, bound_from)
    postings = _postings(store, terms)
    scored, left_out = _candidates(terms, postings), terms.filter("not essential")
    if left_out.limit(1).count():
        scored = cut_lineage(scored)
        scored = scored.unionByName(_completed(scored, left_out, postings))
    scored = scored.groupBy(*BY, "chunk_id").agg(F.round(F.sum("score"), 9).alias("score"))
    return top_k(scored.filter(F.col("score") > 0), k, [F.col("score").desc(), F.col("chunk_id").asc()])


def pairs_scored(queries: DataFrame, store: LexicalStore, k: int = C.TOP_K, text_col: str = "query", bound_from: int = BOUND_FROM) -> DataFrame:
    """For each query: its postings in all, those of its essential terms, and
    the candidates left by the bounds."""
    terms = bounded_terms(queries, store, k, text_col, bound_from)
    left = _candidates(terms, _postings(store, terms)).groupBy(*BY).agg(F.count(F.lit(1)).alias("candidates"))
    return (terms.groupBy(*BY).agg(F.sum("df").alias("postings"), F.sum(F.when(F.col("essential"), F.col("df")).otherwise(0)).alias("essential_postings"))
            .join(left, BY, "left").withColumn("candidates", F.coalesce("candidates", F.lit(0).cast("long"))))
