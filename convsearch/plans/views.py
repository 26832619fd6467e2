"""Derived views over the driver tables that give every operator real input.

Each view is a pure DataFrame derivation of the given tables, so its size
grows with them; ``plans/sqlviews.py`` holds the same definitions as SQL for
the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import normalize_column
from ..sources.tables import table

# --- fixed values for the derived audit view ---
EVENT_AGENT = {"click": "billing", "view": "billing", "purchase": "returns",
               "signup": "returns", "error": "escalation"}


def corpus_v(spark: SparkSession, sf: str) -> DataFrame:
    """chunks(domain, chunk_id, source, content): one chunk per document."""
    return table(spark, sf, "documents").select(
        F.col("lang").alias("domain"), F.col("doc_id").alias("chunk_id"),
        "source", F.col("text").alias("content"))


def query_v(spark: SparkSession, sf: str) -> DataFrame:
    """queries(query_id, domain, query): benchmark items, each routed to the
    domain of the document with the same id."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("query_id"),
                                                 F.col("lang").alias("domain"))
    return (table(spark, sf, "benchmark")
            .select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
            .join(docs, "query_id"))


def vec_v(spark: SparkSession, sf: str) -> DataFrame:
    """vectors(domain, chunk_id, vec): embeddings of documents."""
    emb = table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"),
                                                 F.col("embedding").alias("vec"))
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"),
                                                 F.col("lang").alias("domain"))
    return emb.join(docs, "chunk_id").select("domain", "chunk_id", "vec")


def query_vec_v(spark: SparkSession, sf: str) -> DataFrame:
    """query vectors(query_id, domain, qvec): item i uses embedding i and must
    not hit its own document (``exclude_id``)."""
    emb = table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"),
                                                 F.col("embedding").alias("qvec"))
    return (query_v(spark, sf).join(emb, "query_id")
            .select("query_id", "domain", "query", "qvec",
                    F.col("query_id").alias("exclude_id")))


def audit_v(spark: SparkSession, sf: str) -> DataFrame:
    """Audit records derived from ``events`` (one per event)."""
    ev = table(spark, sf, "events")
    agent = F.create_map(*[x for kv in EVENT_AGENT.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    final_conf = ((F.col("event_id") * 7919) % 1000) / 1000.0
    router_conf = ((F.col("event_id") * 104729) % 1000) / 1000.0
    k = F.get_json_object("props", "$.k").cast("bigint")
    return ev.select(
        F.col("event_id").cast("string").alias("audit_id"),
        F.col("ts").alias("timestamp"),
        F.to_date("ts").alias("date"),
        F.col("user_id").cast("string").alias("session_id"),
        F.concat(F.lit("query about "), F.col("event_type"), F.lit(" "), F.col("props")).alias("redacted_query"),
        F.element_at(agent, F.col("event_type")).alias("routed_to"),
        router_conf.alias("router_confidence"),
        F.array(F.concat(F.lit("documents/"), F.col("event_type"), F.lit(".txt"))).alias("retrieved_sources"),
        final_conf.alias("final_confidence"),
        (final_conf < 0.65).alias("low_confidence_flag"),
        F.floor(F.col("value") * 10).cast("bigint").alias("response_latency_ms"),
        ((k % 5) < 2).alias("cache_hit"),
    )


def policy_v(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks with cross-references: every 10th document ends with
    ' See section <id % 7>'; documents with id % 5 = 1 start with
    'Section <id % 7> '. Whole texts."""
    d = table(spark, sf, "documents")
    sec = (F.col("doc_id") % 7).cast("string")
    content = F.concat(
        F.when(F.col("doc_id") % 5 == 1, F.concat(F.lit("Section "), sec, F.lit(" "))).otherwise(F.lit("")),
        F.col("text"),
        F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit(" See section "), sec)).otherwise(F.lit("")))
    return d.select(F.col("lang").alias("domain"), F.col("doc_id").alias("chunk_id"),
                    "source", content.alias("content"))


def turns_v(spark: SparkSession, sf: str) -> DataFrame:
    """Events as conversation turns."""
    return table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("session_id"), "ts",
        F.col("event_id").alias("seq"),
        F.when(F.col("event_id") % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.col("event_type").alias("content"))


def cache_v(spark: SparkSession, sf: str) -> DataFrame:
    """Cache entries: one per embedding, domain = label, stored a minute apart."""
    e = table(spark, sf, "embeddings")
    return e.select(
        F.col("label").cast("string").alias("domain"),
        F.col("vec_id").alias("entry_id"),
        F.col("embedding").alias("vec"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
         + F.make_dt_interval(mins=F.col("vec_id").cast("int"))).alias("stored_at"))


def lookup_v(spark: SparkSession, sf: str) -> DataFrame:
    """Cache lookups: one per embedding, the base vector perturbed by its pair
    partner (vec_id xor 1) with weight (vec_id % 10) * 0.1, asked 30 + (vec_id % 90)
    minutes after the base entry was stored."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding", "label")
    partner = e.select(F.col("vec_id").alias("pid"), F.col("embedding").alias("pvec"))
    j = e.join(partner, F.col("pid") == F.col("vec_id").bitwiseXOR(F.lit(1)), "left")
    w = (F.col("vec_id") % 10) * 0.1
    mixed = F.when(F.col("pvec").isNull(), F.transform("embedding", lambda x: x.cast("double"))).otherwise(
        F.zip_with("embedding", "pvec", lambda a, b: a.cast("double") + w * b.cast("double")))
    j = normalize_column(j.withColumn("mixed", mixed), "mixed", "vec")
    return j.select(
        F.col("vec_id").alias("lookup_id"),
        F.col("label").cast("string").alias("domain"),
        "vec",
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
         + F.make_dt_interval(mins=(F.col("vec_id") + 30 + F.col("vec_id") % 90).cast("int"))).alias("ts"))


def _agent_of(event_type):
    return F.element_at(F.create_map(*[x for kv in EVENT_AGENT.items() for x in (F.lit(kv[0]), F.lit(kv[1]))]),
                        event_type)


def router_raw_v(spark: SparkSession, sf: str) -> DataFrame:
    """Router model outputs, one per event, in eight shapes by event_id % 8:
    JSON; JSON with capitalised category and string confidence; unknown
    category; JSON inside prose; no JSON; bad number; null confidence;
    JSON array."""
    ev = table(spark, sf, "events")
    cat = _agent_of(F.col("event_type"))
    c = F.concat(F.lit("0."), F.lpad(((F.col("event_id") * 104729) % 1000).cast("string"), 3, "0"))
    cap = F.concat(F.upper(F.substring(cat, 1, 1)), F.substring(cat, 2, 100))
    k = F.col("event_id") % 8
    out = (F.when(k == 0, F.concat(F.lit('{"category": "'), cat, F.lit('", "confidence": '), c, F.lit("}")))
           .when(k == 1, F.concat(F.lit('{"category": "'), cap, F.lit(' ", "confidence": "'), c, F.lit('"}')))
           .when(k == 2, F.concat(F.lit('{"category": "shipping", "confidence": '), c, F.lit("}")))
           .when(k == 3, F.concat(F.lit('Sure! {"category": "'), cat, F.lit('", "confidence": '), c,
                                  F.lit("} Hope that helps.")))
           .when(k == 4, F.concat(F.lit("I think this is about "), cat, F.lit(".")))
           .when(k == 5, F.concat(F.lit('{"category": "'), cat, F.lit('", "confidence": 1.2.3}')))
           .when(k == 6, F.concat(F.lit('{"category": "'), cat, F.lit('", "confidence": null}')))
           .otherwise(F.concat(F.lit("["), c, F.lit("]"))))
    return ev.select("event_id", out.alias("raw"))


def model_out_v(spark: SparkSession, sf: str) -> DataFrame:
    """Answer-model outputs, one per document (whole text): by doc_id % 4
    both lines, answer only, rating only, neither; five rating shapes."""
    d = table(spark, sf, "documents")
    i = F.col("doc_id")
    rating = (F.when(i % 5 == 0, F.concat(F.lit("0."), F.lpad(((i * 37) % 100).cast("string"), 2, "0")))
              .when(i % 5 == 1, F.lit("0.85/1.0")).when(i % 5 == 2, F.lit("1.5"))
              .when(i % 5 == 3, F.lit("85%"))
              .otherwise(F.concat(F.lit("about 0.7 or 0."), (i % 10).cast("string"))))
    out = (F.when(i % 4 == 0, F.concat(F.lit("ANSWER: "), F.col("text"), F.lit("\nCONFIDENCE: "), rating))
           .when(i % 4 == 1, F.concat(F.lit("ANSWER: "), F.col("text")))
           .when(i % 4 == 2, F.concat(F.lit("CONFIDENCE: "), rating))
           .otherwise(F.col("text")))
    return d.select("doc_id", out.alias("raw"))


def eval_cases_v(spark: SparkSession, sf: str) -> DataFrame:
    """One eval case per benchmark item: expected agent by item_id % 3; every
    11th item is an edge case with a custom check instead; substring match on
    the item's third word (case-insensitive for odd items). Two of five cases
    have a confidence floor of their own, two of seven a latency limit."""
    b = table(spark, sf, "benchmark")
    i = F.col("item_id")
    agents = F.array(F.lit("billing"), F.lit("returns"), F.lit("escalation"))
    word = F.try_element_at(F.split(F.col("text"), " "), F.lit(3))
    edge = i % 11 == 0
    return b.select(
        i.alias("case_id"), F.concat(F.lit("case "), i.cast("string")).alias("description"),
        F.col("text").alias("query"),
        F.when(~edge, F.element_at(agents, (i % 3 + 1).cast("int"))).alias("expected_agent"),
        F.when(~edge, F.when(i % 2 == 0, "contains").otherwise("icontains")).alias("match_type"),
        F.when(~edge, F.when(i % 2 == 0, word).otherwise(F.upper(word))).alias("match_value"),
        F.when(edge, F.element_at(F.array(F.lit("has_sources"), F.lit("ood_handled"), F.lit("min_length_20")),
                                  (F.floor(i / 11) % 3 + 1).cast("int"))).alias("custom_check"),
        F.when(i % 5 == 1, F.lit(0.25)).when(i % 5 == 2, F.lit(0.9)).alias("min_confidence"),
        F.when(i % 7 == 1, F.lit(300.5)).when(i % 7 == 2, F.lit(100.0)).alias("max_latency_ms"))


def eval_outputs_v(spark: SparkSession, sf: str) -> DataFrame:
    """Model outputs with embedded metadata: agent by item_id % 4 (3 -> escalation),
    confidence and latency (with half milliseconds for every 4th) from the matching event, no sources for every 6th
    item, invented '90 days' for every 5th (with a known '30 days' for every 10th)."""
    b = table(spark, sf, "benchmark")
    ev = table(spark, sf, "events").select(F.col("event_id").alias("item_id"), "value")
    i = F.col("item_id")
    agents = F.array(F.lit("billing"), F.lit("returns"), F.lit("escalation"))
    actual = F.element_at(agents, (F.least(i % 4, F.lit(2)) + 1).cast("int"))
    conf = F.concat(F.lit("0."), F.lpad(((i * 7919) % 1000).cast("string"), 3, "0"))
    lat = F.concat((F.floor(F.col("value") * 10) * 3).cast("bigint").cast("string"), F.when(i % 4 == 3, F.lit(".5")).otherwise(F.lit("")))
    srcs = F.when(i % 6 == 0, F.lit("[]")).otherwise(
        F.concat(F.lit('["documents/'), actual, F.lit('/policy.txt"]')))
    meta = F.concat(F.lit('{"agent": "'), actual, F.lit('", "sources": '), srcs, F.lit(', "confidence": '), conf,
                    F.lit(', "latency_ms": '), lat, F.lit("}"))
    answer = F.concat(F.col("text"), F.when(i % 5 == 0, F.lit(" Refunds take 90 days.")).otherwise(F.lit("")),
                      F.when(i % 10 == 0, F.lit(" Returns within 30 days.")).otherwise(F.lit("")))
    return (b.join(ev, "item_id", "left")
            .select(i.alias("case_id"), F.concat(answer, F.lit("\n<!--CXMETA:"), meta, F.lit("-->")).alias("output")))


def completions_v(spark: SparkSession, sf: str) -> DataFrame:
    """Model answers per (audit record, prompt variant), derived from the
    audit view: lengths vary with the id, every 4th 'empathetic' answer
    admits missing information, every 5th 'structured' call failed (no row)."""
    a = audit_v(spark, sf).select("audit_id", "redacted_query")
    k = F.col("audit_id").cast("bigint")
    p = a.select("audit_id", F.lit("precise").alias("variant"),
                 F.concat(F.col("redacted_query"), F.repeat(F.lit(" detail"), (k % 90).cast("int"))).alias("completion"))
    e = a.select("audit_id", F.lit("empathetic").alias("variant"),
                 F.when(k % 4 == 0, F.lit("I don't have enough information."))
                 .otherwise(F.concat(F.lit("Sure, "), F.col("redacted_query"), F.repeat(F.lit(" more"), (k % 120).cast("int"))))
                 .alias("completion"))
    s = (a.filter(k % 5 != 0)
         .select("audit_id", F.lit("structured").alias("variant"), F.repeat(F.lit("x"), (k % 60).cast("int")).alias("completion")))
    return p.unionByName(e).unionByName(s)


def requests_v(spark: SparkSession, sf: str) -> DataFrame:
    """Requests built from documents: session id = source (every 13th
    repeated past 128 characters, every 17th empty), query = whole text."""
    d = table(spark, sf, "documents")
    sid = (F.when(F.col("doc_id") % 17 == 0, F.lit(""))
           .when(F.col("doc_id") % 13 == 0, F.repeat(F.col("source"), 40)).otherwise(F.col("source")))
    return d.select(F.col("doc_id").alias("request_id"), sid.alias("session_id"), F.col("text").alias("query"))


def uploads_v(spark: SparkSession, sf: str) -> DataFrame:
    """Uploads built from pages: domain by page_id % 4 (one unknown), file
    name from the url's last segment with five suffix shapes, size scaled up
    for every 7th page, blank content for every 9th."""
    p = table(spark, sf, "pages")
    i = F.col("page_id")
    doms = F.array(F.lit("billing"), F.lit("returns"), F.lit("escalation"), F.lit("shipping"))
    stem = F.regexp_replace(F.element_at(F.split(F.regexp_replace("url", r"\?.*$", ""), "/"), -1), "[^A-Za-z0-9_-]", "")
    name = (F.when(i % 5 == 0, F.concat(stem, F.lit(".txt")))
            .when(i % 5 == 1, F.concat(F.lit("notes/"), stem, F.lit(".md")))
            .when(i % 5 == 2, F.concat(F.upper(stem), F.lit(".MD")))
            .when(i % 5 == 3, F.concat(stem, F.lit(".pdf")))
            .otherwise(F.lit(".md")))
    size = (F.octet_length("html") * F.when(i % 7 == 0, F.lit(10000)).otherwise(F.lit(1))).cast("bigint")
    content = F.when(i % 9 == 0, F.lit(" \n\t ")).otherwise(F.col("html"))
    return p.select(i.alias("upload_id"), F.element_at(doms, (i % 4 + 1).cast("int")).alias("domain"),
                    name.alias("filename"), size.alias("size_bytes"), content.alias("content"))


def service_requests_v(spark: SparkSession, sf: str) -> DataFrame:
    """Requests of the service: the benchmark queries a second apart; every
    4th holds an e-mail address, every 9th has no session, every 14th no text."""
    i = F.col("query_id")
    text = F.concat(F.col("query"), F.when(i % 4 == 1, F.concat(F.lit(" Write to user"), i.cast("string"), F.lit("@example.com please."))).otherwise(F.lit("")))
    return query_v(spark, sf).select(
        "query_id", "domain", (F.lit("2024-01-30 12:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=i)).alias("ts"),
        F.when(i % 9 == 4, F.lit("")).otherwise(F.concat(F.lit("session-"), (i % 7).cast("string"))).alias("session_id"),
        F.when(i % 14 == 6, F.lit("")).otherwise(text).alias("query"), (i * 37 % 2000).alias("latency_ms"))


def response_cache_v(spark: SparkSession, sf: str) -> DataFrame:
    """A cache of responses: for every third benchmark item one entry in each
    domain, half of them stored hours ago, every 12th without a confidence."""
    i = F.col("item_id")
    response = F.struct(F.concat(F.lit("cached answer "), i.cast("string")).alias("answer"), F.col("domain").alias("agent"),
                        F.array(F.concat(F.lit("documents/"), F.col("domain"), F.lit(".txt"))).alias("sources"),
                        F.when(i % 12 != 0, F.lit(0.9)).alias("confidence"), F.lit(False).alias("low_confidence"), F.lit("").alias("disclaimer"))
    stored = F.when(i % 6 == 0, F.lit("2024-01-30 11:50:00")).otherwise(F.lit("2024-01-30 09:00:00")).cast("timestamp_ntz")
    return (table(spark, sf, "benchmark").filter(i % 3 == 0)
            .select("item_id", "text", F.explode(F.array(*[F.lit(d) for d in ("billing", "returns", "escalation")])).alias("domain"))
            .select("domain", F.col("text").alias("query"), stored.alias("stored_at"), response.alias("response")))
