"""KPI metrics over audit records, targets, routing distribution.

Percentiles are exact rank statistics, selected from a value histogram by
descending into the one range of values that holds the rank -- never a global
sort, nor a window over all distinct values in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values: KPI targets (metric, target, lower_is_better) ---
KPI_TARGETS = (
    ("cache_hit_rate", 0.40, False),
    ("low_confidence_rate", 0.15, True),
    ("avg_latency_ms", 1500.0, True),
    ("p95_latency_ms", 3500.0, True),
    ("avg_confidence", 0.80, False),
)


def rank_index(n, form: str = "kpi"):
    """0-based rank of the 95th percentile: kpi form max(0, int(0.95 n) - 1),
    suite form floor(0.95 n)."""
    if form == "kpi":
        return F.greatest(F.lit(0), F.floor(F.lit(0.95) * n) - 1)
    return F.floor(n * F.lit(0.95))


#: Value ranges that one descent counts.
RANGES = 4096


def _beside(df: DataFrame, one: DataFrame, grouped: bool) -> DataFrame:
    """``df`` with the columns of ``one``, which holds one row a group (a
    single row, read by a scalar subquery, if there are no groups)."""
    if grouped:
        return df.join(one, "_g")
    names = one.columns
    return (df.withColumn("_one", one.select(F.struct(*names)).scalar())
            .select(*df.columns, *[F.col(f"_one.{c}").alias(c) for c in names]))


def _about(rows: DataFrame, rank, grouped: bool) -> DataFrame:
    """Smallest and largest value and the rank looked for, of each group."""
    return rows.groupBy(*["_g"] * grouped).agg(F.min("_v").cast("double").alias("_lo"), F.max("_v").cast("double").alias("_hi"), rank.alias("_k"))


def _descend(hist: DataFrame, about: DataFrame, grouped: bool, ranges: int) -> DataFrame:
    """Keep, of each group's (value, count) rows, those of the one range of
    values that holds the row of the rank looked for, with that rank ``_k``
    less the rows below that range.

    The span from smallest to largest value is cut into ``ranges`` equal
    ranges; the range number never falls as the value grows, so the result is
    exact whatever the distribution. Counting is a combined aggregate; what is
    folded in one place is at most ``ranges`` counts a group."""
    g = ["_g"] if grouped else []
    at = (F.col("_v").cast("double") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * ranges
    # not a number: the span is infinite or holds NaN (the last range), or is one value (the first)
    number = (F.when(F.col("_lo") == F.col("_hi"), 0).when(F.isnan(at), ranges - 1)
              .otherwise(F.least(F.lit(ranges - 1), F.floor(at))).cast("int"))
    cut = _beside(hist, about, grouped).filter(F.col("_k") > 0).withColumn("_range", number)
    counts = cut.groupBy(*g, "_range").agg(F.sum("_c").alias("_n"), F.max("_k").alias("_k"))
    held = counts.groupBy(*g).agg(F.sort_array(F.collect_list(F.struct("_range", "_n"))).alias("_all"), F.max("_k").alias("_k"))
    found = F.aggregate(
        "_all", F.struct(F.lit(0).cast("bigint").alias("below"), F.lit(None).cast("int").alias("hit")),
        lambda s, x: F.when(s["hit"].isNotNull(), s)
        .when(s["below"] + x["_n"] >= F.col("_k"), F.struct(s["below"].alias("below"), x["_range"].alias("hit")))
        .otherwise(F.struct((s["below"] + x["_n"]).alias("below"), s["hit"].alias("hit"))))
    pick = held.select(*g, found.alias("_f")).select(*g, F.col("_f.hit").alias("_hit"), F.col("_f.below").alias("_below"))
    return (_beside(cut, pick, grouped).filter(F.col("_range") == F.col("_hit"))
            .select(*g, "_v", "_c", (F.col("_k") - F.col("_below")).alias("_k")))


def percentile_by_rank(df: DataFrame, value_col: str, group_cols=(), form: str = "kpi",
                       out_col: str = "p95", ranges: int = RANGES, descents: int = 1) -> DataFrame:
    """Exact value at the rank given by ``rank_index`` within each group, by
    radix selection: the histogram (value -> count) is counted by value range,
    and only the range that holds the rank is looked into, ``descents`` times.
    What is then left, one range out of ``ranges ** descents``, is put in
    order. Each descent reads the histogram four times as often, so take more
    than one only where a few far values stretch the span over many others. Null values rank first, as in an ascending sort. One row with null
    if there are no rows and no groups."""
    g = list(group_cols)
    grouped = bool(g)
    key = [F.struct(*g).alias("_g")] if grouped else []
    gk = ["_g"] if grouped else []
    hist = df.select(*key, F.col(value_col).alias("_v")).groupBy(*gk, "_v").agg(F.count(F.lit(1)).alias("_c"))
    # nulls come first: past them, the rank is that among the values
    nulls = F.sum(F.when(F.col("_v").isNull(), F.col("_c")).otherwise(0))
    first = about = _about(hist, (rank_index(F.sum("_c"), form) + 1 - nulls).cast("bigint"), grouped)
    left = hist.filter(F.col("_v").isNotNull())
    for i in range(descents):
        if i:
            about, left = _about(left, F.max("_k"), grouped), left.drop("_k")
        left = _descend(left, about, grouped, ranges)
    if not descents:
        left = _beside(left, about, grouped).filter(F.col("_k") > 0)
    w = Window.partitionBy(*gk, "_k").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    hit = left.withColumn("_cum", F.sum("_c").over(w)).filter(F.col("_cum") >= F.col("_k"))
    if not grouped:
        return hit.agg(F.min("_v").alias(out_col))
    hit = hit.groupBy("_g").agg(F.min("_v").alias(out_col))
    return first.select("_g").join(hit, "_g", "left").select("_g.*", out_col)


def kpi_metrics(audit: DataFrame, group_cols=()) -> DataFrame:
    """total_queries, cache_hit_rate, low_confidence_rate, avg_latency_ms,
    p95_latency_ms, avg_confidence (per group; one row if no group)."""
    g = list(group_cols)
    a = audit.select(*g,
                     F.coalesce("cache_hit", F.lit(False)).alias("hit"),
                     F.coalesce("low_confidence_flag", F.lit(False)).alias("low"),
                     F.coalesce("response_latency_ms", F.lit(0).cast("bigint")).alias("lat"),
                     F.coalesce("final_confidence", F.lit(0.0)).alias("conf"))
    n = F.count(F.lit(1))
    m = a.groupBy(*g).agg(
        n.alias("total_queries"),
        F.round(F.sum(F.col("hit").cast("int")) / n, 4).alias("cache_hit_rate"),
        F.round(F.sum(F.col("low").cast("int")) / n, 4).alias("low_confidence_rate"),
        F.round(F.sum("lat") / n, 1).alias("avg_latency_ms"),
        F.round(F.sum("conf") / n, 4).alias("avg_confidence"))
    p = percentile_by_rank(a, "lat", g, "kpi", "p95_latency_ms")
    return m.join(p, g, "left") if g else _attach_scalar(m, p)


def _attach_scalar(m: DataFrame, p: DataFrame) -> DataFrame:
    """Attach the single p95 value to the single metrics row via a scalar
    subquery (no join needed for one-row results)."""
    return m.withColumn("p95_latency_ms", p.select("p95_latency_ms").scalar())


def routing_distribution(audit: DataFrame) -> DataFrame:
    return (audit.groupBy(F.coalesce("routed_to", F.lit("unknown")).alias("agent"))
            .agg(F.count(F.lit(1)).alias("n")))


def kpi_targets(metrics: DataFrame) -> DataFrame:
    """One row per target metric: value, target, pass (targets use <= / >=)."""
    spark = metrics.sparkSession
    targets = spark.createDataFrame(list(KPI_TARGETS), "metric string, target double, lower_is_better boolean")
    names = [t[0] for t in KPI_TARGETS]
    long = metrics.select(*[F.col(c).cast("double").alias(c) for c in names]).unpivot(
        [], names, "metric", "value")
    return (long.join(F.broadcast(targets), "metric")
            .withColumn("passed", F.when(F.col("lower_is_better"), F.col("value") <= F.col("target"))
                        .otherwise(F.col("value") >= F.col("target"))))
