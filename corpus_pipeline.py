"""The corpus pipeline: quality rules, toxicity, near duplicates, pseudonyms and
packing, one stage after the other. Each stage reads what its predecessor kept;
all but the last return the columns of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convsearch.llm import ngram_join, packing, pseudonyms, quality, toxicity
from convsearch.llm.common import stored, table
from convsearch.llm.queries import PSEUDONYM_KEY, TOXIC
from convsearch.llm.tokens import public_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failed lines go, and documents that the rules reject."""
    return quality.clean(docs)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of ``toxic`` reaches the threshold go."""
    chain = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, chain).filter(F.col("p_toxic") < TOXIC).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays: the first."""
    return ngram_join.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values become pseudonyms; ``n_chars`` follows the text."""
    out = pseudonyms.pseudonymise(docs, PSEUDONYM_KEY)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes among sequences of 4096 ids."""
    return packing.pack(stored(packing.token_pieces(docs, public_path("word_bpe_49k.json")), "pieces"))


STAGES = [
    ("quality", quality_rules),
    ("toxicity", drop_toxic),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", pack_sequences),
]

#: The toxicity stage trains a model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the whole table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
