"""Ids of the corpus build and of the re-index, missing folders, added domains."""

import os

import pytest
from pyspark.sql import functions as F

from convsearch.functions import domains as DOM
from convsearch.functions import parse as P
from convsearch.plans import build as BUILD
from convsearch.sources import audit as AUD
from convsearch.sources import corpus as COR
from convsearch.streaming import jobs
from tests.conftest import SF001


def test_chunk_ids_are_unique_on_given_documents(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select(F.col("lang").alias("domain"), "source", "text", "doc_id")
    chunks = BUILD.build_corpus(docs, domains=["en", "de", "fr", "es", "none yet"]).chunks
    n = chunks.agg(F.count("*"), F.countDistinct("chunk_id"), F.countDistinct("doc_id")).first()
    assert n[0] == n[1] > 0
    want = docs.filter("text is not null and trim(text) <> ''").count() + 1
    assert n[2] == want
    assert [r["content"] for r in chunks.filter("domain = 'none yet'").collect()] == ["No documents loaded for none yet."]


def test_vocabulary_counts_whole_documents(spark):
    text = " ".join(f"alpha{i}" for i in range(200))
    docs = spark.createDataFrame([("d", "s", text)], "domain string, source string, text string")
    b = BUILD.build_corpus(docs)
    assert b.chunks.count() > 1  # chunks overlap, so words recur in them
    assert {(r["total"], r["df"]) for r in b.vocab.filter("term like 'alpha%' and term not like '% %'").collect()} == {(1, 1)}


def test_meeting_chunk_ids_are_an_error(spark, tmp):
    docs = spark.createDataFrame([("d", "a", "one", 7), ("d", "b", "two", 7)], "domain string, source string, text string, doc_id long")
    with pytest.raises(ValueError, match="not unique"):
        BUILD.write_corpus(BUILD.build_corpus(docs), f"{tmp}/corpus")


def test_reindex_gives_the_ids_of_the_build(spark, tmp):
    os.makedirs(f"{tmp}/land/billing")
    for name in ("a b.txt", "c+d.md"):
        with open(f"{tmp}/land/billing/{name}", "w") as f:
            f.write(f"text of {name}")
    docs = COR.read_corpus(spark, f"{tmp}/land")
    assert {os.path.basename(r["source"]) for r in docs.collect()} == {"a b.txt", "c+d.md"}
    built = {(r["doc_id"], r["chunk_id"], r["content"]) for r in BUILD.build_corpus(docs).chunks.collect()}
    q = jobs.reindex_stream(f"{tmp}/land", f"{tmp}/chunks", f"{tmp}/ck")
    q.awaitTermination(300)
    q.stop()
    assert {(r["doc_id"], r["chunk_id"], r["content"]) for r in spark.read.parquet(f"{tmp}/chunks").collect()} == built


def test_missing_folders_give_no_rows(spark, tmp):
    assert COR.read_corpus(spark, f"{tmp}/none").count() == 0
    assert COR.read_corpus(spark, f"file://{tmp}/none").count() == 0
    assert AUD.read_audit(spark, f"{tmp}/none").count() == 0


def test_added_domain_is_routed_and_dispatched(spark):
    domains = DOM.domains_table(spark).unionByName(
        spark.createDataFrame([("shipping", "ship", "later")], "domain string, system_prompt string, disclaimer string"))
    raw = spark.createDataFrame([(1, '{"category": "shipping", "confidence": 0.9}'), (2, '{"category": "other", "confidence": 0.9}')], "id long, raw string")
    parsed = raw.select("id", P.parse_router("raw", (*P.CATEGORIES, "shipping"))["category"].alias("category"))
    got = {r["id"]: (r["agent"], r["disclaimer"]) for r in DOM.dispatch(parsed, domains=domains).collect()}
    assert got == {1: ("shipping", "later"), 2: ("escalation", DOM.DISCLAIMERS["escalation"])}
    assert [r["agent"] for r in DOM.dispatch(parsed).collect()] == ["escalation"] * 2
