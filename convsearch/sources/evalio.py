"""Eval-suite sources: case definitions and nested run results (JSON)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C

COMPONENT = T.StructType([T.StructField("pass", T.BooleanType()), T.StructField("score", T.DoubleType()),
                          T.StructField("reason", T.StringType())])
RESULTS_SCHEMA = T.StructType([T.StructField("results", T.StructType([T.StructField("results", T.ArrayType(
    T.StructType([
        T.StructField("description", T.StringType()),
        T.StructField("vars", T.MapType(T.StringType(), T.StringType())),
        T.StructField("gradingResult", T.StructType([
            T.StructField("pass", T.BooleanType()),
            T.StructField("componentResults", T.ArrayType(COMPONENT))])),
        T.StructField("response", T.StructType([T.StructField("metadata", T.StructType([
            T.StructField("latency_ms", T.DoubleType()), T.StructField("confidence", T.DoubleType())]))])),
    ])))]))])

CASES_SCHEMA = T.StructType([
    T.StructField("case_id", T.LongType()), T.StructField("category", T.StringType()),
    T.StructField("description", T.StringType()), T.StructField("query", T.StringType()),
    T.StructField("expected_agent", T.StringType()), T.StructField("min_confidence", T.DoubleType()),
    T.StructField("max_latency_ms", T.DoubleType()), T.StructField("match_type", T.StringType()),
    T.StructField("match_value", T.StringType()), T.StructField("custom_check", T.StringType()),
])


def read_eval_cases(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Cases with the suite's default variables filled in."""
    df = spark.read.schema(CASES_SCHEMA).format(fmt).load(path)
    return (df.withColumn("min_confidence", F.coalesce("min_confidence", F.lit(C.EVAL_MIN_CONFIDENCE)))
            .withColumn("max_latency_ms", F.coalesce("max_latency_ms", F.lit(C.EVAL_MAX_LATENCY_MS).cast("double"))))


def read_eval_results(spark: SparkSession, path: str) -> DataFrame:
    """One row per test of a nested results file (``results.results[]``);
    a missing or empty file is an error, as in the report script."""
    raw = spark.read.schema(RESULTS_SCHEMA).option("multiLine", True).json(path)
    tests = raw.select(F.posexplode(F.coalesce("results.results", F.array())).alias("test_no", "t"))
    if tests.limit(1).count() == 0:
        raise ValueError(f"no test results in {path}")
    return tests.select(
        "test_no", F.coalesce("t.description", F.col("t.vars")["query"], F.lit("unknown")).alias("description"),
        F.coalesce("t.gradingResult.pass", F.lit(False)).alias("pass"),
        F.coalesce("t.gradingResult.componentResults", F.array().cast(T.ArrayType(COMPONENT))).alias("components"),
        F.col("t.response.metadata.latency_ms").alias("latency_ms"),
        F.col("t.response.metadata.confidence").alias("confidence"))
