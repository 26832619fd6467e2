"""The request flow: what hits, misses, invalid and unrouted requests yield."""

from pyspark.sql import functions as F

from convsearch import config as C
from convsearch.operators import requests as REQ

T = "2024-01-30 12:00:00"


def test_branches(spark):
    requests = spark.createDataFrame([
        (1, "s", "refund me, a@b.example", 11), (2, "s", "hello", 12), (3, "s", "old one", 13), (4, "", "no session", 14), (5, "s", None, 15),
        (6, "s", "unrouted", 16), (7, "s", "no answer", 17), (8, "s", "x" * 2001, 18), (9, "t", "bare entry", 19)],
        "query_id long, session_id string, query string, latency_ms long").withColumn("ts", F.lit(T).cast("timestamp_ntz"))
    router = spark.createDataFrame([(i, '{"category": "billing", "confidence": 0.9}') for i in (1, 2, 3, 7, 9)] + [(8, "ignored")], "query_id long, raw string")
    entry = "domain string, query string, at string, response struct<" + ", ".join(f.replace(" ", ": ", 1) for f in REQ.RESPONSE.split(", ")) + ">"
    full = lambda text: (text, "returns", ["p.txt"], 0.8, True, "d")
    cache = spark.createDataFrame([
        ("billing", "refund me, <EMAIL>", "2024-01-30 11:30:00", full("older")), ("billing", "refund me, <EMAIL>", "2024-01-30 11:59:59", full("latest")),
        ("billing", "old one", "2024-01-30 11:00:00", full("expired")), ("returns", "hello", "2024-01-30 11:59:00", full("other domain")),
        ("billing", "bare entry", "2024-01-30 11:59:00", (None, None, None, None, None, None))], entry).select(
            "domain", "query", F.col("at").cast("timestamp_ntz").alias("stored_at"), "response")
    seen = []

    def answer(misses):
        seen.extend(misses.select("query_id", "query", "category", "router_confidence").collect())
        return misses.filter("query_id <> 7").select("query_id", F.concat(F.lit("re: "), "query").alias("answer"), F.col("category").alias("agent"), F.array(F.lit("doc")).alias("sources"),
                                                     F.lit(0.7).alias("confidence"), F.lit(False).alias("low_confidence"), F.lit("!").alias("disclaimer"))

    p = REQ.process_requests(requests, router, cache, answer)
    assert {r.query_id: r.reject_reason for r in p.rejected.collect()} == {4: "session_id_too_short", 5: "query_missing", 8: "query_too_long"}
    assert sorted((r.query_id, r.category, r.router_confidence) for r in seen) == [(2, "billing", 0.9), (3, "billing", 0.9), (6, "escalation", 0.5), (7, "billing", 0.9)]
    got = {r.query_id: r for r in p.responses.collect()}
    assert (got[1].answer, got[1].agent, got[1].confidence, got[1].low_confidence, got[1].cache_hit, got[1].latency_ms) == ("latest", "returns", 0.8, True, True, 11)
    assert (got[9].answer, got[9].agent, got[9].sources, got[9].confidence, got[9].low_confidence, got[9].disclaimer) == ("", "billing", [], 1.0, False, "")
    assert got[3].answer == "re: old one" and not got[3].cache_hit and got[7].answer == C.LLM_FAILURE_TEXT and got[7].low_confidence
    records = {r.audit_id: r for r in p.audit.collect()}
    assert set(records) == {"1", "2", "3", "6", "7", "9"} and records["1"].redacted_query == "refund me, <EMAIL>"
    assert records["6"].routed_to == "escalation" and records["1"].cache_hit and not records["2"].cache_hit
    turns = sorted((r.query_id, r.seq, r.role, r.content) for r in p.turns.collect())
    assert turns[:2] == [(2, 0, "user", "hello"), (2, 1, "assistant", "re: hello")] and {t[0] for t in turns} == {2, 3, 6, 7} and len(turns) == 8
    rows = {r["query"]: r for r in p.cached.collect()}
    assert set(rows) == {"hello", "old one", "unrouted", "no answer"} and rows["unrouted"].domain == "escalation" and rows["hello"].response.answer == "re: hello"


def test_an_empty_batch(spark):
    none = spark.createDataFrame([], "query_id long, session_id string, query string, latency_ms long, ts timestamp_ntz")
    router = spark.createDataFrame([], "query_id long, raw string")
    cache = spark.createDataFrame([], "domain string, query string, stored_at timestamp_ntz, response struct<" + ", ".join(f.replace(" ", ": ", 1) for f in REQ.RESPONSE.split(", ")) + ">")
    p = REQ.process_requests(none, router, cache, lambda m: m.select("query_id", *[F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in REQ.RESPONSE.split(", ")]))
    assert [d.count() for d in (p.rejected, p.responses, p.audit, p.turns, p.cached)] == [0] * 5
