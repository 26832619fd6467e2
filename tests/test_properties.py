"""Property tests (hypothesis) for the per-text helpers and tokenisers."""

from hypothesis import given, settings
from hypothesis import strategies as st

@settings(max_examples=50, deadline=None)
@given(st.lists(st.sampled_from(["ab", "é", " ", "\t", "\n", "X", " "]), max_size=40).map("".join))
def test_tokenize_equals_python_split(spark, text):
    from pyspark.sql import functions as F
    from convsearch.functions.text import tokenize
    got = spark.createDataFrame([(text,)], "t string").select(tokenize(F.col("t")).alias("x")).first()["x"]
    assert got == text.lower().split()
