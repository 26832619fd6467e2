"""Extension points for model calls (the engine itself runs no model).

* embedding provider: any Column function text -> ARRAY<FLOAT>, typically an
  Arrow-batched pandas UDF wrapping the user's encoder; the built-in default
  is the TF-IDF vectoriser (``operators.tfidf``).
* completion provider: a completions table joined by request id, or a
  Column function prompt -> text; a failed call (null) becomes the fixed
  apology text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from .vectors import normalize_column


def embed_with(df: DataFrame, text_col: str, provider: Callable[[Column], Column], out: str = "vec",
               normalize: bool = True) -> DataFrame:
    """Apply a user embedding function; L2-normalise (zero vectors unchanged)."""
    d = df.withColumn(out, provider(F.col(text_col)))
    return normalize_column(d, out) if normalize else d


def complete_with(df: DataFrame, prompt_col: str, provider: Callable[[Column], Column],
                  out: str = "raw") -> DataFrame:
    """Apply a user completion function; a null result is a failed call."""
    return df.withColumn(out, F.coalesce(provider(F.col(prompt_col)), F.lit(C.LLM_FAILURE_TEXT)))


def completions_from_table(df: DataFrame, completions: DataFrame, key: str = "query_id",
                           out: str = "raw") -> DataFrame:
    """Left join of a completions table; missing rows are failed calls."""
    c = completions.select(key, F.col(out).alias("_c"))
    return (df.join(c, key, "left").withColumn(out, F.coalesce("_c", F.lit(C.LLM_FAILURE_TEXT))).drop("_c"))
