"""The request flow over a batch: validate, redact, route, look into the cache,
answer what it does not hold, and give what is to be appended.

A branching dataflow. Nothing after the first step sees an unredacted query. A
hit takes its response from the cache: it is not answered, reads no history and
appends nothing but its audit record. A miss is answered with its history and
yields two session turns and one cache row. The cache and the history are those
before the batch; requests of one batch do not see each other's."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import parse as P
from ..functions.text import redact
from ..sources import ingest
from ..sources.audit import to_audit
from ..spark import cut_lineage
from .cache import cache_exact, cache_key

RESPONSE = "answer string, agent string, sources array<string>, confidence double, low_confidence boolean, disclaimer string"


@dataclass
class Processed:
    rejected: DataFrame   # query_id, reject_reason
    responses: DataFrame  # query_id, session_id, ts, category, the fields of RESPONSE, latency_ms, cache_hit
    audit: DataFrame      # one record for each response
    turns: DataFrame      # session_id, ts, seq (0 user, 1 assistant), query_id, role, content
    cached: DataFrame     # domain, key, query, stored_at, response


def routed_requests(valid: DataFrame, router: DataFrame) -> DataFrame:
    """``valid`` with category and router_confidence by router(query_id, raw).
    A request without router output counts as a failed call: escalation, 0.5."""
    routes = router.select("query_id", P.route(P.parse_router("raw")).alias("_r"))
    return valid.join(routes, "query_id", "left").select(
        *valid.columns, F.coalesce("_r.category", F.lit("escalation")).alias("category"),
        F.coalesce("_r.confidence", F.lit(0.5)).alias("router_confidence"))


def process_requests(requests: DataFrame, router: DataFrame, cache: DataFrame, answer: Callable[[DataFrame], DataFrame],
                     ttl_seconds: int = C.CACHE_TTL_SECONDS) -> Processed:
    """requests(query_id, ts, session_id, query, latency_ms, ...),
    router(query_id, raw), cache(domain, query, stored_at, response struct of
    RESPONSE) -> Processed.

    ``answer`` gets the misses (columns of the requests, the query redacted,
    with category and router_confidence) and gives query_id and the fields of
    RESPONSE; a miss that it has no row for gets the fixed apology. Of several
    live entries with the key of a request the latest counts."""
    checked = ingest.validate_requests(requests)
    rejected = checked.filter(~F.col("valid")).select("query_id", "reject_reason")
    clean = checked.filter("valid").drop("valid", "reject_reason").withColumn("query", redact("query"))
    routed = cut_lineage(routed_requests(clean, router))

    entries = cache.withColumn("entry_id", F.struct(*[F.col(f"response.{f}") for f in _fields()]))
    lookups = routed.select(F.col("query_id").alias("lookup_id"), F.col("category").alias("domain"), "query", "ts")
    found = cut_lineage(cache_exact(lookups, entries, ttl_seconds).filter("exact_hit").select(F.col("lookup_id").alias("query_id"), F.col("entry_id").alias("_e")))

    hits = routed.join(found, "query_id").select(
        "query_id", "session_id", "ts", "query", "category", "router_confidence", F.coalesce("_e.answer", F.lit("")).alias("answer"),
        F.coalesce("_e.agent", "category").alias("agent"), F.coalesce("_e.sources", F.array().cast("array<string>")).alias("sources"),
        F.coalesce("_e.confidence", F.lit(1.0)).alias("confidence"), F.coalesce("_e.low_confidence", F.lit(False)).alias("low_confidence"),
        F.coalesce("_e.disclaimer", F.lit("")).alias("disclaimer"), F.col("latency_ms").cast("long").alias("latency_ms"), F.lit(True).alias("cache_hit"))
    misses = routed.join(found.select("query_id"), "query_id", "left_anti")
    made = cut_lineage(answer(misses).select("query_id", *[F.col(f).alias(f"_{f}") for f in _fields()]))
    answered = misses.join(made, "query_id", "left").select(
        "query_id", "session_id", "ts", "query", "category", "router_confidence", F.coalesce("_answer", F.lit(C.LLM_FAILURE_TEXT)).alias("answer"),
        F.coalesce("_agent", "category").alias("agent"), F.coalesce("_sources", F.array().cast("array<string>")).alias("sources"),
        F.coalesce("_confidence", F.lit(0.0)).alias("confidence"), F.coalesce("_low_confidence", F.lit(True)).alias("low_confidence"),
        F.coalesce("_disclaimer", F.lit("")).alias("disclaimer"), F.col("latency_ms").cast("long").alias("latency_ms"), F.lit(False).alias("cache_hit"))
    responses = hits.unionByName(answered)

    audit = to_audit(responses.select(
        F.col("query_id").cast("string").alias("audit_id"), F.col("ts").alias("timestamp"), "session_id", F.col("query").alias("redacted_query"),
        F.col("category").alias("routed_to"), "router_confidence", "sources", "confidence", "low_confidence", "latency_ms", "cache_hit"))
    say = F.array(*[F.struct(F.lit(i).alias("seq"), F.lit(role).alias("role"), F.col(text).alias("content")) for i, (role, text) in enumerate((("user", "query"), ("assistant", "answer")))])
    turns = answered.select("session_id", "ts", "query_id", F.explode(say).alias("t")).select("session_id", "ts", "t.seq", "query_id", "t.role", "t.content")
    cached = answered.select(F.col("category").alias("domain"), cache_key(F.col("category"), F.col("query")).alias("key"), "query", F.col("ts").alias("stored_at"),
                             F.struct(*_fields()).alias("response"))
    return Processed(rejected, responses.drop("query", "router_confidence"), audit, turns, cached)


def _fields() -> list[str]:
    return [part.split()[0] for part in RESPONSE.split(", ")]
