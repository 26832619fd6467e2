"""TF-IDF vectoriser (the default text -> vector function).

Fit: word 1-2-grams over the corpus plus the seed texts; keep the
``max_features`` most frequent by total count (ties by term); smoothed idf
``ln((1+n)/(1+df)) + 1``. Transform: sublinear tf ``1 + ln(tf)`` x idf, L2
normalised; an all-zero row becomes the uniform vector 1/sqrt(dim).

The vocabulary is bounded by ``max_features`` (512 by default), so
broadcasting it is safe by construction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..spark import cut_lineage, maybe_broadcast

# --- fixed values: seed texts added to the vocabulary fit ---
TFIDF_SEED = (
    "billing invoice charge payment subscription refund duplicate overpayment",
    "return exchange product window eligibility defective warranty unopened",
    "escalation complaint manager unresolved urgent priority sla ticket",
    "policy section refund timeline credit debit bank transfer paypal",
    "customer support order account email phone address receipt",
    "late fee retry suspend cancel annual monthly pro-rata",
    "dispute investigation hold resolution business days",
    "damage misuse final sale non-returnable condition packaging tags",
    "data privacy gdpr ccpa regulatory compliance officer",
    "compensation credit expedited shipping partial refund approval",
)

# Python's \w (letters, digits, underscore) written out so Java and RE2 agree;
# runs of two or more such characters are the tokens.
WORD_RUN2 = r"[\p{L}\p{N}_]{2,}"


def word_tokens(text) -> F.Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(c), F.lit(WORD_RUN2), 0)


def _gram_arrays(docs: DataFrame, text_col: str) -> DataFrame:
    """(doc_key, grams): all unigrams and bigrams of consecutive tokens of each
    row. explode_outer of a one-element array makes a column that is computed
    once and not inlined where it is used."""
    toks = docs.select("doc_key", F.explode_outer(F.array(word_tokens(text_col))).alias("toks"))
    n = F.greatest(F.size("toks") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("toks", 1, n), F.slice("toks", 2, n), lambda a, b: F.concat_ws(" ", a, b))
    return toks.select("doc_key", F.explode_outer(F.array(F.concat("toks", pairs))).alias("grams"))


def _grams(docs: DataFrame, text_col: str) -> DataFrame:
    """(doc_key, term) rows: unigrams and bigrams."""
    # explode_outer + null filter: no inferred filter on the array is pushed
    # below the rebalance (which would run the regex twice)
    return (_gram_arrays(docs, text_col).select("doc_key", F.explode_outer("grams").alias("term"))
            .filter(F.col("term").isNotNull()))


def _term_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(term, total, df): occurrences, and documents (``doc_key``) that hold
    the term. A document of one row counts a term once by the row's distinct
    terms, so only terms are shuffled, combined map-side; pairs of document and
    term are grouped for keys that come more than once."""
    again = docs.groupBy("doc_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("doc_key").alias("again"))
    again = cut_lineage(again)
    repeated = again.limit(1).count() > 0
    single = docs.join(maybe_broadcast(again), F.col("doc_key").eqNullSafe(F.col("again")), "left_anti") if repeated else docs
    both = F.array(F.struct(F.col("grams").alias("g"), F.lit(1).cast("bigint").alias("total"), F.lit(0).cast("bigint").alias("df")),
                   F.struct(F.array_distinct("grams").alias("g"), F.lit(0).cast("bigint").alias("total"), F.lit(1).cast("bigint").alias("df")))
    rows = (_gram_arrays(single, text_col).select(F.explode_outer(both).alias("b"))
            .select(F.explode_outer("b.g").alias("term"), F.col("b.total").alias("total"), F.col("b.df").alias("df")).filter(F.col("term").isNotNull()))
    if repeated:
        more = docs.join(maybe_broadcast(again), F.col("doc_key").eqNullSafe(F.col("again")), "left_semi")
        rows = rows.unionByName(_grams(more, text_col).groupBy("doc_key", "term").agg(F.count(F.lit(1)).alias("total"))
                                .select("term", "total", F.lit(1).cast("bigint").alias("df")))
    return rows.groupBy("term").agg(F.sum("total").alias("total"), F.sum("df").alias("df"))


def fit_vocab(corpus: DataFrame, text_col: str = "content", key_col: str = "chunk_id",
              max_features: int = C.TFIDF_MAX_FEATURES, seed_texts=TFIDF_SEED) -> DataFrame:
    """-> vocab(idx, term, total, df, idf). Totals and document frequencies
    are one aggregation with strong map-side combining (vocabulary-sized
    per task); the top ``max_features`` is a bounded TakeOrderedAndProject."""
    spark = corpus.sparkSession
    docs = corpus.select(F.col(key_col).cast("string").alias("doc_key"), F.col(text_col).alias("text"))
    if seed_texts:
        seeds = spark.createDataFrame([(f"seed-{i}", t) for i, t in enumerate(seed_texts)], "doc_key string, text string")
        docs = docs.unionByName(seeds)
    n_docs = docs.select(F.count(F.lit(1))).scalar()
    top = _term_counts(docs, "text").orderBy(F.col("total").desc(), F.col("term").asc()).limit(max_features)
    idf = F.log((1 + n_docs) / (1 + F.col("df"))) + 1
    return top.select((F.row_number().over(Window.orderBy("term")) - 1).cast("int").alias("idx"),
                      "term", "total", "df", idf.alias("idf"))


def transform(docs: DataFrame, vocab: DataFrame, text_col: str = "content", key_col: str = "chunk_id",
              dim: int = C.TFIDF_MAX_FEATURES, keep=("domain",)) -> DataFrame:
    """docs -> (<keep>, <key_col>, vec ARRAY<DOUBLE>[dim])."""
    keep = [c for c in keep if c in docs.columns and c != key_col]
    d = docs.select(*keep, F.col(key_col).alias("doc_key"), F.col(text_col).alias("text"))
    # vocabulary (<= max_features rows) joined before the per-document count
    tf = (_grams(d, "text")
          .join(F.broadcast(vocab.select("term", "idx", "idf")), "term")
          .groupBy("doc_key", "idx", "idf").agg(F.count(F.lit(1)).alias("tf")))
    sparse = (tf.groupBy("doc_key")
              .agg(F.map_from_entries(F.collect_list(
                  F.struct("idx", ((1 + F.log("tf")) * F.col("idf")).alias("w")))).alias("m")))
    dense = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)),
                        lambda i: F.coalesce(F.try_element_at(F.col("m"), i), F.lit(0.0)))
    out = d.select(*keep, "doc_key").join(sparse, "doc_key", "left").withColumn("raw", dense)
    # the norm is its own column, referenced twice, so it is computed once per row
    out = out.withColumn("nrm", F.sqrt(F.aggregate("raw", F.lit(0.0), lambda a, x: a + x * x)))
    uniform = F.array_repeat(F.lit(1.0) / F.sqrt(F.lit(float(dim))), dim)
    vec = F.when(F.col("nrm") == 0, uniform).otherwise(F.transform("raw", lambda x: x / F.col("nrm")))
    return out.select(*keep, F.col("doc_key").alias(key_col), vec.alias("vec"))
