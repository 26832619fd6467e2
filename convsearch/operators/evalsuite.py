"""Eval-suite scoring: per-case assertions, suite summary, failures.

Cases and outputs are tables (the model run itself is an input). Each case
gets the four default assertions, then either its custom check or the agent
check plus its substring match, exploded to one row per assertion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import assertions as A
from .kpi import percentile_by_rank


def exact_mean_3dp(c: str):
    """Mean rounded half-up to 3 decimals, from an exact integer sum of
    micro-units and integral division: independent of summation order (a
    floating mean can sit on a .0005 tie and flip with partitioning)."""
    return F.expr(f"CASE WHEN count({c}) > 0 THEN ((sum(CAST(round({c} * 1000000) AS BIGINT)) + count({c}) * 500) "
                  f"div (count({c}) * 1000)) / CAST(1000 AS DOUBLE) END")


def assertion_rows(cases: DataFrame, outputs: DataFrame, extra=()) -> DataFrame:
    """cases(case_id, description, expected_agent, match_type, match_value,
    custom_check, min_confidence, max_latency_ms) x outputs(case_id, output)
    -> (case_id, ord, assertion, pass, score, reason).

    ``extra`` are a user's own assertions: functions of the columns ``output``
    and ``meta`` that return ``assertions.result`` (null: not for this case);
    they may refer to all columns of the cases and come after the others."""
    j = cases.join(outputs, "case_id", "left").withColumn("meta", A.parse_meta("output"))
    own = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in cases.columns else F.lit(default)
    defaults = [A.has_source("meta"), A.latency_at_most("meta", own("max_latency_ms", C.EVAL_MAX_LATENCY_MS)),
                A.confidence_at_least("meta", own("min_confidence", C.EVAL_MIN_CONFIDENCE)),
                A.no_fabricated_facts("output")]
    specific_custom = [A.custom_check(F.col("custom_check"), "output", "meta")]
    specific_std = [A.correct_agent("meta", "expected_agent"),
                    F.when(F.col("match_type") == "icontains", A.contains("output", "match_value", True))
                    .otherwise(A.contains("output", "match_value", False))]
    specific_std[1] = F.when(F.col("match_type").isNotNull(), specific_std[1])
    arr = F.when(F.col("custom_check").isNotNull(), F.array(*defaults, *specific_custom)).otherwise(
        F.array(*defaults, *specific_std))
    if extra:
        arr = F.concat(arr, F.array(*[own(F.col("output"), F.col("meta")) for own in extra]))
    arr = F.filter(arr, lambda x: x.isNotNull())
    e = j.select("case_id", F.posexplode(arr).alias("ord", "a"))
    return e.select("case_id", (F.col("ord") + 1).cast("bigint").alias("ord"), "a.assertion",
                    F.coalesce(F.col("a.pass"), F.lit(False)).alias("pass"), "a.score", "a.reason")


def case_results(cases: DataFrame, outputs: DataFrame, rows: DataFrame | None = None, extra=()) -> DataFrame:
    rows = rows if rows is not None else assertion_rows(cases, outputs, extra)
    passed = rows.groupBy("case_id").agg(F.min(F.col("pass").cast("int")).alias("_p"))
    meta = outputs.select("case_id", A.parse_meta("output").alias("meta"))
    return (cases.select("case_id", "description", "expected_agent").join(passed, "case_id", "left")
            .join(meta, "case_id", "left")
            .select("case_id", "description", "expected_agent", F.coalesce(F.col("_p") == 1, F.lit(False)).alias("pass"),
                    F.col("meta.latency_ms").alias("latency_ms"), F.col("meta.confidence").alias("confidence")))


def summary(cases: DataFrame, outputs: DataFrame, compat: bool = False, extra=()) -> DataFrame:
    """One row: total_tests, passed, accuracy, routing_total/correct/accuracy,
    hallucination_total/count/rate, avg/p95 latency, avg confidence.
    Default classification is by assertion type; ``compat`` classifies by
    the substrings of the reasons as the original report script does."""
    rows = assertion_rows(cases, outputs, extra)
    res = case_results(cases, outputs, rows)
    if compat:
        routing = (F.col("reason").contains("Correctly routed") | F.col("reason").contains("Wrong agent")
                   | F.col("reason").contains("expected_agent"))
        halluc = (F.col("reason").contains("hallucination") | F.col("reason").contains("fabricated")
                  | F.col("reason").contains("No source"))
    else:
        routing = (F.col("assertion") == "correct_agent") & (F.col("reason") != "No expected_agent set")
        halluc = F.col("assertion").isin("has_source", "no_fabricated_facts")
    a = rows.agg(
        F.sum(routing.cast("int")).cast("bigint").alias("routing_total"),
        F.sum((routing & F.col("pass")).cast("int")).cast("bigint").alias("routing_correct"),
        F.sum(halluc.cast("int")).cast("bigint").alias("hallucination_total"),
        F.sum((halluc & ~F.col("pass")).cast("int")).cast("bigint").alias("hallucinations"))
    t = res.agg(F.count(F.lit(1)).alias("total_tests"),
                F.sum(F.col("pass").cast("int")).cast("bigint").alias("passed"),
                F.round(F.avg("latency_ms")).cast("bigint").alias("avg_latency_ms"),
                exact_mean_3dp("confidence").alias("avg_confidence"))
    p95 = percentile_by_rank(res.filter(F.col("latency_ms").isNotNull()), "latency_ms", (), "suite", "p95")
    out = _attach_counts(t.withColumn("p95_latency_ms", p95.select("p95").scalar()), a)
    return out.select(
        "total_tests", "passed", F.round(F.col("passed") / F.col("total_tests") * 100, 1).alias("accuracy_pct"),
        "routing_total", "routing_correct",
        F.when(F.col("routing_total") > 0, F.round(F.col("routing_correct") / F.col("routing_total") * 100, 1))
        .alias("routing_accuracy_pct"),
        "hallucination_total", "hallucinations",
        F.when(F.col("hallucination_total") > 0,
               F.round(F.col("hallucinations") / F.col("hallucination_total") * 100, 1)).alias("hallucination_rate_pct"),
        "avg_latency_ms", "p95_latency_ms", "avg_confidence")


def _attach_counts(one_row: DataFrame, counts: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate through a single scalar
    subquery returning a struct (one evaluation, no join)."""
    cols = counts.columns
    s = counts.select(F.struct(*cols).alias("s")).scalar()
    for c in cols:
        one_row = one_row.withColumn(c, s.getField(c))
    return one_row


def failures(cases: DataFrame, outputs: DataFrame, extra=()) -> DataFrame:
    """Failed cases with their failing reasons in assertion order."""
    rows = assertion_rows(cases, outputs, extra).filter(~F.col("pass"))
    r = (rows.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("ord", "reason"))).alias("_r"))
         .select("case_id", F.transform("_r", lambda x: x["reason"]).alias("reasons")))
    return cases.select("case_id", "description").join(r, "case_id")


def summary_from_results(tests: DataFrame) -> DataFrame:
    """Suite summary from a nested results file (``sources.evalio``), with
    the report script's own rules: assertions classified by substrings of
    their reasons, latency/confidence from the response metadata."""
    comps = (tests.select("test_no", F.explode_outer("components").alias("c"))
             .filter(F.col("c").isNotNull())
             .select("test_no", F.coalesce("c.reason", F.lit("")).alias("reason"),
                     F.coalesce("c.pass", F.lit(False)).alias("pass")))
    r = F.col("reason")
    routing = r.contains("Correctly routed") | r.contains("Wrong agent") | r.contains("expected_agent")
    halluc = r.contains("hallucination") | r.contains("fabricated") | r.contains("No source")
    a = comps.agg(F.sum(routing.cast("int")).cast("bigint").alias("routing_total"),
                  F.sum((routing & F.col("pass")).cast("int")).cast("bigint").alias("routing_correct"),
                  F.sum(halluc.cast("int")).cast("bigint").alias("hallucination_total"),
                  F.sum((halluc & ~F.col("pass")).cast("int")).cast("bigint").alias("hallucinations"))
    t = tests.agg(F.count(F.lit(1)).alias("total_tests"), F.sum(F.col("pass").cast("int")).cast("bigint").alias("passed"),
                  F.round(F.avg("latency_ms")).cast("bigint").alias("avg_latency_ms"),
                  exact_mean_3dp("confidence").alias("avg_confidence"))
    p95 = percentile_by_rank(tests.filter(F.col("latency_ms").isNotNull()), "latency_ms", (), "suite", "p95")
    out = _attach_counts(t.withColumn("p95_latency_ms", p95.select("p95").scalar()), a)
    return out.withColumn("accuracy_pct", F.round(F.col("passed") / F.col("total_tests") * 100, 1))
