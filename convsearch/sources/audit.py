"""Audit log: JSON lines partitioned by UTC date; tail reads; report sinks."""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C

AUDIT_SCHEMA = T.StructType([
    T.StructField("audit_id", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("raw_query", T.StringType()),
    T.StructField("redacted_query", T.StringType()),
    T.StructField("routed_to", T.StringType()),
    T.StructField("router_confidence", T.DoubleType()),
    T.StructField("retrieved_sources", T.ArrayType(T.StringType())),
    T.StructField("final_confidence", T.DoubleType()),
    T.StructField("low_confidence_flag", T.BooleanType()),
    T.StructField("response_latency_ms", T.LongType()),
    T.StructField("cache_hit", T.BooleanType()),
])


def to_audit(resp: DataFrame, keep_raw: bool = False) -> DataFrame:
    """Response rows -> audit records. Confidences rounded to 4 places; a
    cached response lacking fields defaults to sources [], confidence 1.0,
    low-confidence false. ``raw_query`` is dropped unless ``keep_raw``."""
    cached = F.coalesce(F.col("cache_hit"), F.lit(False))
    cols = [
        (F.col("audit_id") if "audit_id" in resp.columns else F.expr("uuid()")).alias("audit_id"),
        (F.col("timestamp") if "timestamp" in resp.columns else F.current_timestamp()).alias("timestamp"),
        "session_id",
        *([F.col("raw_query")] if keep_raw and "raw_query" in resp.columns else []),
        "redacted_query", "routed_to",
        F.round("router_confidence", 4).alias("router_confidence"),
        F.when(cached, F.coalesce("sources", F.array().cast("array<string>"))).otherwise(F.col("sources"))
        .alias("retrieved_sources"),
        F.round(F.when(cached, F.coalesce("confidence", F.lit(1.0))).otherwise(F.col("confidence")), 4)
        .alias("final_confidence"),
        F.when(cached, F.coalesce("low_confidence", F.lit(False))).otherwise(F.col("low_confidence"))
        .alias("low_confidence_flag"),
        F.col("latency_ms").cast("bigint").alias("response_latency_ms"),
        cached.alias("cache_hit"),
    ]
    out = resp.select(*cols)
    return out.withColumn("date", F.to_date("timestamp"))


def write_audit(audit: DataFrame, path: str) -> None:
    """Append JSON lines, one folder per UTC day."""
    audit.write.mode("append").partitionBy("date").json(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """Schemaless-tolerant read with the service's defaults for missing
    fields (cache_hit/low flag false, latency/confidence 0, agent 'unknown').
    A missing log folder gives no records."""
    schema = T.StructType(AUDIT_SCHEMA.fields + [T.StructField("date", T.DateType())])
    try:
        df = spark.read.schema(schema).json(path)
    except AnalysisException as gone:
        if gone.getCondition() != "PATH_NOT_FOUND":
            raise
        df = spark.createDataFrame([], schema)
    return with_read_defaults(df)


def with_read_defaults(df: DataFrame) -> DataFrame:
    return (df.withColumn("cache_hit", F.coalesce("cache_hit", F.lit(False)))
            .withColumn("low_confidence_flag", F.coalesce("low_confidence_flag", F.lit(False)))
            .withColumn("response_latency_ms", F.coalesce("response_latency_ms", F.lit(0).cast("bigint")))
            .withColumn("final_confidence", F.coalesce("final_confidence", F.lit(0.0)))
            .withColumn("routed_to", F.coalesce("routed_to", F.lit("unknown"))))


def audit_tail(audit: DataFrame, date: dt.date | str, limit: int = C.AUDIT_READ_LIMIT) -> DataFrame:
    """Last ``limit`` records of one day in append (timestamp) order, with
    their position ``pos`` (1 = oldest returned). ``limit`` 0 returns none."""
    return audit_tail_per_day(_days(audit, date, 1), limit)


def _days(audit: DataFrame, last_day, days: int) -> DataFrame:
    """Records of the ``days`` UTC days ending ``last_day``. The date
    predicate prunes date partitions; the equivalent timestamp range is a
    plain column predicate that reaches the file scan as a pushed filter."""
    end = F.lit(str(last_day)).cast("date")
    lo = F.date_sub(end, days - 1)
    out = audit.filter((F.col("date") <= end) & (F.col("date") >= lo))
    ts = F.col("timestamp")
    ts_type = dict(audit.dtypes).get("timestamp")
    if ts_type in ("timestamp", "timestamp_ntz"):
        out = out.filter((ts >= lo.cast(ts_type)) & (ts < F.date_add(end, 1).cast(ts_type)))
    return out


def audit_tail_per_day(audit: DataFrame, limit: int) -> DataFrame:
    """Last ``limit`` records of every day present (partition = day; the
    row_number limit runs partially before the shuffle)."""
    w = Window.partitionBy("date").orderBy(F.col("timestamp").desc(), F.col("audit_id").desc())
    tail = audit.withColumn("_back", F.row_number().over(w)).filter(F.col("_back") <= limit)
    w2 = Window.partitionBy("date").orderBy(F.col("timestamp").asc(), F.col("audit_id").asc())
    return tail.withColumn("pos", F.row_number().over(w2).cast("bigint")).drop("_back")


def audit_window(audit: DataFrame, today: dt.date | str, days: int = C.KPI_DAYS,
                 per_day: int = C.KPI_PER_DAY) -> DataFrame:
    """Union of the last ``per_day`` records of each of the ``days`` days
    ending ``today`` (the date range prunes partitions)."""
    return audit_tail_per_day(_days(audit, today, days), per_day)


def seeded_sample(df: DataFrame, n: int, key: str = "audit_id", seed: str = "42") -> DataFrame:
    """Deterministic shuffle-then-take: the n rows with the smallest
    md5(key || seed). A global top-n (TakeOrderedAndProject), never a sort of
    the whole input on one task."""
    return df.withColumn("_h", F.md5(F.concat(F.col(key).cast("string"), F.lit(seed)))) \
             .orderBy("_h").limit(n).drop("_h")


def write_report(df: DataFrame, path: str, mode: str = "append") -> None:
    """One-row report sink (KPI reports append; optimizer 'latest' overwrites)."""
    df.coalesce(1).write.mode(mode).json(path)
