"""Each case's own thresholds hold, latencies may be fractions, and a missing
match value fails."""

import pytest

from convsearch.functions import assertions as A
from convsearch.operators import evalsuite

CASES = ("case_id long, description string, expected_agent string, match_type string, match_value string, custom_check string, "
         "min_confidence double, max_latency_ms double")


def rows_of(spark, cases, outputs):
    rows = evalsuite.assertion_rows(spark.createDataFrame(cases, CASES), spark.createDataFrame(outputs, "case_id long, output string")).collect()
    assert all(r["pass"] is not None for r in rows)
    return {(r.case_id, r.assertion): r for r in rows}


def output(latency, confidence="0.7"):
    return f'ok\n<!--CXMETA:{{"agent": "billing", "confidence": {confidence}, "latency_ms": {latency}, "sources": ["a"]}}-->'


def test_case_thresholds_and_null_match(spark):
    cases = [(1, "strict", "billing", "contains", "ok", None, 0.9, 100.0), (2, "lenient", "billing", "contains", None, None, None, None),
             (3, "own", "returns", "icontains", "OK", None, 0.7, 900.0)]
    got = rows_of(spark, cases, [(i, output(900)) for i in (1, 2, 3)])
    assert (got[1, "confidence"]["pass"], got[1, "confidence"].score, got[1, "confidence"].reason) == (False, 0.7, "Low confidence: 0.700 < 0.9")
    assert (got[2, "confidence"]["pass"], got[2, "confidence"].reason) == (True, "Confidence 0.700 ≥ 0.6")
    assert (got[1, "latency"]["pass"], got[1, "latency"].score, got[1, "latency"].reason) == (False, 0.0, "Slow: 900ms > 100ms")
    assert (got[2, "latency"]["pass"], got[2, "latency"].reason) == (True, "Latency 900ms ≤ 8000ms")
    assert got[3, "confidence"]["pass"] and got[3, "latency"]["pass"] and got[3, "icontains"]["pass"]
    assert got[1, "correct_agent"]["pass"] and not got[3, "correct_agent"]["pass"]
    assert not [r for (c, _), r in got.items() if c == 2][-1]["pass"]


@pytest.mark.parametrize("latency,limit,passed,score,reason", [
    ("9000.5", None, False, 1 - 1000.5 / 8000, "Slow: 9000.5ms > 8000ms"), ("8000.0", None, True, 1.0, "Latency 8000ms ≤ 8000ms"),
    ("8000.25", 8000.5, True, 1.0, "Latency 8000.25ms ≤ 8000.5ms"), ("null", None, True, 1.0, "Latency 0ms ≤ 8000ms"), ("1", 0.0, False, None, "Slow: 1ms > 0ms")])
def test_fractional_latency(spark, latency, limit, passed, score, reason):
    got = rows_of(spark, [(1, "c", None, None, None, None, None, limit)], [(1, output(latency))])[1, "latency"]
    assert (got["pass"], got.reason) == (passed, reason) and (score is None or got.score == pytest.approx(score))


def test_summary_and_failures_see_the_thresholds(spark):
    cases = spark.createDataFrame([(i, f"case {i}", "billing", "contains", "ok", None, 0.5, 9000.0 + i) for i in range(3)], CASES)
    outs = spark.createDataFrame([(i, output("9000.5")) for i in range(3)], "case_id long, output string")
    s = evalsuite.summary(cases, outs).first()
    assert (s.total_tests, s.passed, s.avg_latency_ms) == (3, 2, 9001)
    assert [(r.case_id, r.reasons) for r in evalsuite.failures(cases, outs).collect()] == [(0, ["Slow: 9000.5ms > 9000ms"])]


def test_only_the_first_metadata_block_is_stripped(spark):
    df = spark.createDataFrame([("a\n\n<!--CXMETA:{}-->\nb\n<!--CXMETA:x-->",), ("plain ",), (None,)], "o string")
    assert [r[0] for r in df.select(A.clean_output("o")).collect()] == ["a\nb\n<!--CXMETA:x-->", "plain", ""]


def test_user_assertions_count_like_the_others(spark):
    cases = spark.createDataFrame([(i, f"case {i}", "billing", "contains", "ok", None, None, None) for i in range(3)], CASES)
    outs = spark.createDataFrame([(0, output(1)), (1, output(1).replace("ok", "ok, sorry")), (2, output(1))], "case_id long, output string")

    def polite(out, meta):
        ok = A.F.contains(out, A.F.lit("sorry"))
        return A.F.when(A.F.col("case_id") < 2, A.result("polite", ok, ok.cast("double"), A.F.when(ok, A.F.lit("Polite")).otherwise(A.F.lit("No apology"))))

    rows = evalsuite.assertion_rows(cases, outs, [polite]).filter("assertion = 'polite'").collect()
    assert sorted((r.case_id, r["pass"], r.score, r.reason) for r in rows) == [(0, False, 0.0, "No apology"), (1, True, 1.0, "Polite")]
    assert evalsuite.summary(cases, outs).first().passed == 3 and evalsuite.summary(cases, outs, extra=[polite]).first().passed == 2
    assert [(r.case_id, r.reasons) for r in evalsuite.failures(cases, outs, [polite]).collect()] == [(0, ["No apology"])]
