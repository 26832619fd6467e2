"""The corpus store: batches of uploads, committed once with all they change."""

import pytest

from convsearch.operators import refgraph, tfidf
from convsearch.operators.chunk import chunk_documents
from convsearch.operators.maxscore import bm25_topk
from convsearch.sources.corpstore import CorpusStore
from convsearch.sources.ingest import landing_names
from convsearch.sources.lexstore import LexicalStore
from convsearch.streaming import jobs

SCHEMA = "domain string, filename string, size_bytes long, content string"
FIRST = [
    ("billing", "a.txt", 60, "Invoices are due in 30 days. See section 4 for late fees."),
    ("billing", "up/a.txt", 50, "Section 4 late fees apply. Write to ann@example.com."),
    ("returns", "r.md", 40, "Section 4 of returns is unrelated to billing."),
    ("sales", "s.txt", 5, "hello"), ("billing", "x.exe", 5, "hello"), ("billing", "e.txt", 2, " \n"),
    ("returns", "big.txt", 99_000_000, "hello"), (None, None, None, None),
]
SECOND = [("billing", "a.txt", 30, "A third text on invoices and refunds. " * 30), ("billing", ".txt", 3, "abc")]
TABLES = ("documents", "contents", "vectors", "node_refs", "node_words", "chunks", "terms", "postings", "champions", "corpus")


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def state(store):
    return {t: sorted(map(str, (r.asDict() for r in store.table(t).collect()))) for t in TABLES}


@pytest.fixture(scope="module")
def straight(spark, tmp_path_factory):
    """Both batches, without any fault."""
    store = CorpusStore(spark, str(tmp_path_factory.mktemp("straight")), buckets=2, champions=4)
    assert store.table("documents").count() == 0 and store.refit() is None and store.done("s") == -1
    assert store.ingest(frame(spark, FIRST), 0, "s") == ["billing", "returns"]
    returns = store.live()["returns"]
    assert store.ingest(frame(spark, SECOND), 1, "s") == ["billing"]
    assert store.live()["returns"] == returns  # another domain's tables stay
    return store


def test_names_rejects_and_redaction(straight):
    docs = straight.table("documents").collect()
    names = sorted((d.domain, d.source) for d in docs)
    assert len(names) == len(set(names)) == 4 and ("billing", "a.txt") in names and ("returns", "r.md") in names
    other = [n for d, n in names if d == "billing" and n != "a.txt"]
    assert len(other) == 2 and all(n.startswith("a_") and n.endswith(".txt") and len(n) == len("a_12345678.txt") for n in other)
    assert not any("ann@example.com" in d.text for d in docs)
    reasons = sorted(r.reject_reason for r in straight.quarantine().collect())
    assert reasons == sorted(["invalid_domain", "unsupported_type", "empty", "too_large", "invalid_domain", "unsupported_type"])


def test_tables_equal_a_batch_build(spark, straight, tmp):
    docs = straight.table("documents")
    chunks = chunk_documents(docs)
    assert sorted(r.content for r in chunks.collect()) == sorted(r.content for r in straight.table("contents").collect())
    plain = LexicalStore(spark, tmp, buckets=2, champions=4)
    plain.build(chunks)
    for t in ("chunks", "terms", "postings", "champions", "corpus"):
        assert sorted(map(str, plain.table(t).collect())) == sorted(map(str, straight.table(t).collect()))
    graph = refgraph.build_graph(chunks)
    for t, want in (("node_refs", graph.node_refs), ("node_words", graph.node_words)):
        own = ["domain", "chunk_id", "word"]
        assert sorted(want.select(own).collect()) == sorted(straight.table(t).select(own).collect())
    want = {r.chunk_id: r.vec for r in tfidf.transform(chunks, straight.vocabulary()).collect()}
    assert {r.chunk_id: pytest.approx(r.vec) for r in straight.table("vectors").collect()} == want
    hits = bm25_topk(spark.createDataFrame([(1, "billing", "late fees")], "query_id long, domain string, query string"), straight).collect()
    assert hits


def test_a_repeated_batch_changes_nothing(spark, straight):
    before, version = state(straight), straight.live()
    assert straight.ingest(frame(spark, SECOND), 1, "s") == [] and straight.ingest(frame(spark, FIRST), 0, "s") == []
    assert straight.live() == version and state(straight) == before
    assert straight.quarantine().count() == 6


def test_a_batch_that_fails_before_its_commit_is_run_again(spark, straight, tmp, monkeypatch):
    store = CorpusStore(spark, tmp, buckets=2, champions=4)
    store.ingest(frame(spark, FIRST), 0, "s")
    before = state(store)

    def broken(*_, **__):
        raise OSError("lost")

    for step in ("commit", "_derive"):
        with monkeypatch.context() as m:
            m.setattr(store, step, broken)
            with pytest.raises(OSError):
                store.ingest(frame(spark, SECOND), 1, "s")
        assert state(store) == before and store.done("s") == 0
    store.ingest(frame(spark, SECOND), 1, "s")
    assert state(store) == state(straight)  # names, ids, vectors and statistics alike
    store.vacuum()
    assert state(store) == state(straight) and store.vocabulary().count() > 0
    store.refit()
    assert store.table("documents").count() == 4 and set(store.live()) == {"billing", "returns"}
    fitted = tfidf.fit_vocab(store.table("documents"), "text", "doc_id")
    assert sorted(r.term for r in store.vocabulary().collect()) == sorted(r.term for r in fitted.collect())


def test_a_batch_without_a_valid_row(spark, tmp):
    store = CorpusStore(spark, tmp)
    assert store.ingest(frame(spark, [("sales", "s.txt", 5, "hello")]), 0, "s") == [] and store.done("s") == 0
    assert store.ingest(frame(spark, []), 1, "s") == [] and store.done("s") == 1 and store.live() == {}
    assert store.quarantine().count() == 1


def test_landing_names_that_meet(spark):
    rows = spark.createDataFrame([("d", "n.txt", ".txt", c) for c in ("x", "x", "y", "z")], "domain string, safe_name string, ext string, content string")
    none = spark.createDataFrame([], "domain string, name string")
    once = [r.final_name for r in landing_names(rows, none, "b").collect()]
    assert len(set(once)) == 4 and once.count("n.txt") == 1
    assert sorted(once) == sorted(r.final_name for r in landing_names(rows.repartition(3), none, "b").collect())
    taken = spark.createDataFrame([("d", n) for n in once], "domain string, name string")
    again = [r.final_name for r in landing_names(rows, taken, "b").collect()]  # the same digits are taken
    assert len(set(again)) == 4 and not set(again) & set(once)


def test_ingest_as_a_stream(spark, straight, tmp):
    store = CorpusStore(spark, f"{tmp}/store", buckets=2, champions=4)
    for rows in (FIRST, SECOND):
        frame(spark, rows).coalesce(1).write.mode("append").json(f"{tmp}/in")
        q = jobs.ingest_stream(spark.readStream.schema(SCHEMA).json(f"{tmp}/in"), store, f"{tmp}/ck")
        q.awaitTermination(300)
        assert q.exception() is None
    assert store.done(str(q.id)) == 1
    texts = lambda s: sorted(r.content for r in s.table("contents").collect())
    assert texts(store) == texts(straight) and store.quarantine().count() == 6
