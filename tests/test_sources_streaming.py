"""Sources, sinks, validation and the streaming operators."""

import datetime as dt
import os

from pyspark.sql import functions as F

from convsearch.operators import kpi
from convsearch.operators import sessions as SES
from convsearch.plans import views as V
from convsearch.sources import audit as AUD
from convsearch.sources import corpus as COR
from convsearch.sources import ingest
from convsearch.streaming import cache_state, jobs, session_state
from tests.conftest import SF001


def test_read_corpus_and_placeholder(spark, tmp):
    os.makedirs(f"{tmp}/docs/billing")
    os.makedirs(f"{tmp}/docs/returns")
    open(f"{tmp}/docs/billing/a.txt", "w").write("Pay within 30 days.\nCall 555-123-4567.")
    open(f"{tmp}/docs/billing/b.md", "w").write("# Fees\nLate fee 1.5%.")
    open(f"{tmp}/docs/billing/c.pdf", "w").write("ignored")
    docs = COR.read_corpus(spark, f"{tmp}/docs", ("billing", "returns", "escalation"))
    rows = docs.collect()
    assert sorted(os.path.basename(r["source"]) for r in rows) == ["a.txt", "b.md"]
    full = COR.with_placeholder(COR.redact_documents(docs), COR.domain_list(spark, ["billing", "returns", "escalation"]))
    ph = {r["domain"]: r["text"] for r in full.filter(F.col("source") == "placeholder").collect()}
    assert ph == {"returns": "No documents loaded for returns.", "escalation": "No documents loaded for escalation."}
    assert any("<PHONE>" in r["text"] for r in full.collect())


def test_partitioned_tables_overwrite_one_domain(spark, tmp):
    path = f"{tmp}/chunks"
    a = spark.createDataFrame([("billing", 1, "x"), ("returns", 2, "y")], "domain string, chunk_id long, content string")
    COR.write_partitioned(a, path)
    COR.write_partitioned(spark.createDataFrame([("billing", 3, "z")], "domain string, chunk_id long, content string"), path)
    got = sorted((r["domain"], r["chunk_id"]) for r in COR.read_partitioned(spark, path).collect())
    assert got == [("billing", 3), ("returns", 2)]


def test_audit_sink_tail_and_reports(spark, tmp):
    a = V.audit_v(spark, SF001).limit(300)
    AUD.write_audit(a, f"{tmp}/audit")
    back = AUD.read_audit(spark, f"{tmp}/audit")
    assert back.count() == 300
    tail = AUD.audit_tail(back, "2024-01-01", limit=5).collect()
    assert [r["pos"] for r in sorted(tail, key=lambda r: r["pos"])] == [1, 2, 3, 4, 5]
    from convsearch.operators import kpi
    AUD.write_report(kpi.kpi_metrics(back).withColumn("evaluated_at", F.current_timestamp()), f"{tmp}/kpi")
    assert spark.read.json(f"{tmp}/kpi").count() == 1


def test_validate_uploads_goldens(spark):
    rows = [("bad", "a.txt", 10, "x"), ("billing", "dir/a.pdf", 10, "x"), ("billing", "a.txt", 6 * 1024 * 1024, "x"),
            ("billing", "a.txt", 10, " \n\t"), ("billing", "NOTES.MD", 10, "ok"), ("billing", ".md", 10, "x")]
    up = spark.createDataFrame(rows, "domain string, filename string, size_bytes long, content string")
    got = [r["reject_reason"] for r in ingest.validate_uploads(up).collect()]
    assert got == ["invalid_domain", "unsupported_type", "too_large", "empty", None, "unsupported_type"]


def _write_turns(spark, path):
    """Three time-ordered files (days 1-10, 11-20, 21-31) appended in order,
    so the stream sees them as three micro-batches in event-time order."""
    t = V.turns_v(spark, SF001).withColumn("ts", F.col("ts").cast("timestamp"))
    day = F.dayofmonth("ts")
    for lo, hi in ((1, 10), (11, 20), (21, 31)):
        t.filter((day >= lo) & (day <= hi)).orderBy("ts", "seq").coalesce(1).write.mode("append").parquet(path)
    return t.schema


def test_session_stream_matches_batch_twin(spark, tmp):
    schema = _write_turns(spark, f"{tmp}/turns")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp}/turns")
    q = (session_state.session_memory(stream, ttl_seconds=6 * 3600).writeStream.format("memory")
         .queryName("sess_out").outputMode("append").option("checkpointLocation", f"{tmp}/ck")
         .trigger(availableNow=True).start())
    q.awaitTermination(300)
    q.stop()
    got = {(r["session_id"], r["seq"]): (r["n_history"], r["history_text"]) for r in spark.sql("select * from sess_out").collect()}
    batch = SES.history(SES.sessionize(V.turns_v(spark, SF001), 6 * 3600))
    want = {(r["session_id"], r["seq"]): (r["n"], r["txt"]) for r in
            batch.select("session_id", "seq", F.size("history").alias("n"), SES.format_history("history").alias("txt")).collect()}
    assert len(got) == len(want) and got == want


def test_a_long_session_in_any_order(spark, tmp):
    """25,000 shuffled turns of one session in one micro-batch: several Arrow
    batches, none of them in order, equal the batch twin."""
    turns = spark.range(25_000).select(
        F.lit("s").alias("session_id"), (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(secs=F.col("id") * 60 + F.when(F.col("id") % 500 == 0, 3600).otherwise(0))).alias("ts"),
        F.col("id").alias("seq"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("content"))
    turns.orderBy(F.xxhash64("seq")).coalesce(1).write.parquet(f"{tmp}/turns")
    stream = spark.readStream.schema(turns.schema).parquet(f"{tmp}/turns")
    q = (session_state.session_memory(stream, ttl_seconds=1800).writeStream.format("memory").queryName("long_out").outputMode("append")
         .option("checkpointLocation", f"{tmp}/ck").trigger(availableNow=True).start())
    q.awaitTermination(300)
    q.stop()
    got = {r["seq"]: (r["n_history"], r["history_text"]) for r in spark.sql("select * from long_out").collect()}
    batch = SES.history(SES.sessionize(turns.withColumn("ts", F.col("ts").cast("timestamp_ntz")), 1800))
    want = {r["seq"]: (r["n"], r["txt"]) for r in batch.select("seq", F.size("history").alias("n"), SES.format_history("history").alias("txt")).collect()}
    assert len(want) == 25_000 and got == want


def test_cache_replay_stream(spark, tmp):
    lk = V.lookup_v(spark, SF001).withColumn("query", F.concat(F.lit("q"), F.col("lookup_id").cast("string")))
    lk.withColumn("ts", F.col("ts").cast("timestamp")).orderBy("ts").coalesce(1).write.parquet(f"{tmp}/lk")
    src = spark.readStream.schema(spark.read.parquet(f"{tmp}/lk").schema).parquet(f"{tmp}/lk")
    q = (cache_state.cache_replay(src, 0.92, 3600).writeStream.format("memory").queryName("cache_out")
         .option("checkpointLocation", f"{tmp}/ck2").trigger(availableNow=True).start())
    q.awaitTermination(300)
    q.stop()
    res = spark.sql("select * from cache_out")
    n, hits = res.count(), res.filter("hit").count()
    assert n == lk.count() and 0 < hits < n


def test_kpi_stream_and_audit_stream_sink(spark, tmp):
    V.audit_v(spark, SF001).withColumn("timestamp", F.col("timestamp").cast("timestamp")).write.parquet(f"{tmp}/a")
    schema = spark.read.parquet(f"{tmp}/a").schema
    q = (jobs.kpi_daily_stream(spark.readStream.schema(schema).parquet(f"{tmp}/a")).writeStream.format("memory")
         .queryName("kpi_out").outputMode("append").option("checkpointLocation", f"{tmp}/ck3")
         .trigger(availableNow=True).start())
    q.awaitTermination(300)
    q.stop()
    got = {r["date"]: r.asDict() for r in spark.sql("select * from kpi_out").collect()}
    a = spark.read.parquet(f"{tmp}/a").withColumn("date", F.to_date("timestamp"))
    want = {r["date"]: r.asDict() for r in kpi.kpi_metrics(a, ["date"]).collect()}
    # all days but those that the watermark, one day behind, has not passed
    newest = max(want)
    assert set(want) - set(got) <= {newest, newest - dt.timedelta(days=1)} and len(got) > 3
    for day, row in got.items():
        assert row["p95_latency_ms"] == want[day]["p95_latency_ms"] and row["total_queries"] == want[day]["total_queries"]
        assert all(abs(row[c] - want[day][c]) <= 1e-4 + (c == "avg_latency_ms") * 0.1 for c in row if c != "date")
    s = jobs.audit_sink(spark.readStream.schema(schema).parquet(f"{tmp}/a"), f"{tmp}/audit_out", f"{tmp}/ck4")
    s.awaitTermination(300)
    s.stop()
    assert spark.read.json(f"{tmp}/audit_out").count() == spark.read.parquet(f"{tmp}/a").count()


def test_reindex_stream_touches_only_landed_domain(spark, tmp):
    os.makedirs(f"{tmp}/land/billing")
    open(f"{tmp}/land/billing/p.txt", "w").write("word " * 300)
    q = jobs.reindex_stream(f"{tmp}/land", f"{tmp}/chunks", f"{tmp}/ck5")
    q.awaitTermination(300)
    q.stop()
    got = spark.read.parquet(f"{tmp}/chunks")
    assert {r["domain"] for r in got.select("domain").distinct().collect()} == {"billing"}
    assert got.count() >= 3


def test_eval_results_source_and_compat_summary(spark, tmp):
    import json
    from convsearch.operators import evalsuite
    from convsearch.sources import evalio
    doc = {"results": {"results": [
        {"description": "a", "gradingResult": {"pass": True, "componentResults": [
            {"pass": True, "score": 1, "reason": "Correctly routed to billing"},
            {"pass": True, "score": 1, "reason": "Cited 1 source(s): x"}]},
         "response": {"metadata": {"latency_ms": 100, "confidence": 0.9}}},
        {"description": "b", "gradingResult": {"pass": False, "componentResults": [
            {"pass": False, "score": 0, "reason": "No source documents cited — potential hallucination"},
            {"pass": True, "score": 1, "reason": "No expected_agent set"}]},
         "response": {"metadata": {"latency_ms": 300, "confidence": 0.5}}}]}}
    open(f"{tmp}/latest.json", "w").write(json.dumps(doc))
    s = evalsuite.summary_from_results(evalio.read_eval_results(spark, f"{tmp}/latest.json")).first()
    assert (s["total_tests"], s["passed"], s["routing_total"], s["routing_correct"]) == (2, 1, 2, 2)
    assert (s["hallucination_total"], s["hallucinations"], s["p95_latency_ms"]) == (1, 1, 300)
    open(f"{tmp}/empty.json", "w").write(json.dumps({"results": {"results": []}}))
    import pytest
    with pytest.raises(ValueError):
        evalio.read_eval_results(spark, f"{tmp}/empty.json")
