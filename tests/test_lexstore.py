"""The persisted lexical index and the bounded search over it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from convsearch.operators import lexical, maxscore
from convsearch.plans import catalog
from convsearch.sources.lexstore import LexicalStore, input_version
from tests.conftest import SF001


def corpus(spark, n=400, seed=0, domain=lambda i: "a" if i % 4 else "b"):
    """Skewed words: `the` in nearly all chunks, rare ones in few."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        words = ["the"] * int(rng.integers(0, 4)) + ["of"] * int(rng.integers(0, 2)) + [f"w{int(x)}" for x in rng.zipf(1.4, int(rng.integers(0, 30))) if x < 500]
        rng.shuffle(words)
        rows.append((domain(i), i, f"s{i % 3}", " ".join(words)))
    return spark.createDataFrame(rows, "domain string, chunk_id long, source string, content string")


def queries(spark, n=60):
    rng = np.random.default_rng(7)
    rows = [(i, "ab"[i % 2], " ".join(["the", "of", "the"][: int(rng.integers(0, 4))] + [f"w{int(x)}" for x in rng.zipf(1.3, int(rng.integers(0, 6))) if x < 600])) for i in range(n)]
    return spark.createDataFrame(rows + [(n, "c", "the w1"), (n + 1, "a", None), (n + 2, "a", "nowhere")], "query_id long, domain string, query string")


def hits(df):
    return sorted((r.query_id, r.domain, r["rank"], r.chunk_id, round(r.score, 6)) for r in df.collect())


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    store = LexicalStore(spark, str(tmp_path_factory.mktemp("lex")), buckets=4, champions=8)
    store.build(corpus(spark))
    return store


def test_bounded_search_equals_scoring_all(spark, built):
    want = hits(lexical.bm25_topk(queries(spark), lexical.build_index(corpus(spark)), 5))
    assert want and hits(maxscore.bm25_topk(queries(spark), built, 5)) == want
    assert hits(maxscore.bm25_topk(queries(spark), built, 5, bound_from=0)) == want
    assert hits(maxscore.bm25_topk(queries(spark), built, 1, bound_from=0)) == hits(lexical.bm25_topk(queries(spark), lexical.build_index(corpus(spark)), 1))


def test_stop_words_pair_with_few_candidates(spark, tmp):
    """A word of half the chunks beside a rare one: the long list is left out."""
    rows = [("a", i, "s", ("common " if i % 2 else "") + f"x{i} y{i % 7} " + ("rare rare" if i % 100 == 0 else "")) for i in range(2000)]
    store = LexicalStore(spark, tmp, buckets=4)
    chunks = spark.createDataFrame(rows, "domain string, chunk_id long, source string, content string")
    store.build(chunks)
    q = spark.createDataFrame([(i, "a", "common rare") for i in range(5)], "query_id long, domain string, query string")
    told = maxscore.pairs_scored(q, store, 5, bound_from=0).collect()
    assert all(r.postings == 1020 and r.essential_postings == 20 and r.candidates <= 20 for r in told)
    assert hits(maxscore.bm25_topk(q, store, 5, bound_from=0)) == hits(lexical.bm25_topk(q, lexical.build_index(chunks), 5))


def test_a_missing_domain_is_built_on_first_use(spark, tmp):
    store, asked = LexicalStore(spark, tmp), []

    def load(names):
        asked.append(names)
        return corpus(spark).filter(F.col("domain").isin(names))

    assert store.live() == {} and store.table("postings").count() == 0
    assert store.ensure(["a"], load) == ["a"] and store.ensure(["a"], load) == [] and asked == [["a"]]
    before = store.live()
    assert store.ensure(["a", "b", None], load) == ["b"] and asked[1:] == [["b"]]
    assert store.live()["a"] == before["a"] and set(store.live()) == {"a", "b"}
    again = LexicalStore(spark, tmp)  # by another process
    assert again.live() == store.live()
    want = hits(lexical.bm25_topk(queries(spark), lexical.build_index(corpus(spark)), 5))
    assert hits(maxscore.bm25_topk(queries(spark), again, 5)) == want


def test_a_rebuild_replaces_one_domain_at_once(spark, tmp):
    store = LexicalStore(spark, tmp)
    store.build(corpus(spark))
    old, held = store.live(), store.table("chunks", ["b"])
    n = held.count()
    new = corpus(spark, 40, 5, lambda i: "b")
    store.build(new)
    live = store.live()
    assert live["a"] == old["a"] and live["b"] != old["b"]
    assert held.count() == n and store.table("chunks", ["b"]).count() == 40  # a reader keeps what it opened
    assert store.table("corpus").filter("domain = 'b'").first().n == 40
    assert hits(maxscore.bm25_topk(queries(spark).filter("domain = 'b'"), store)) == hits(lexical.bm25_topk(queries(spark).filter("domain = 'b'"), lexical.build_index(new)))
    store.build(new.limit(0), domains=["b"])  # its documents are gone
    assert set(store.live()) == {"a"}
    store.vacuum()
    assert store.table("postings").count() > 0 and store.vacuum() == []


def test_a_failed_build_commits_nothing(spark, tmp):
    store = LexicalStore(spark, tmp)
    store.build(corpus(spark, 20))
    live = store.live()
    broken = corpus(spark, 20).withColumn("content", F.when(F.col("chunk_id") < 19, F.col("content")).otherwise(F.raise_error(F.lit("broken"))))
    with pytest.raises(Exception, match="broken"):
        store.build(broken)
    assert store.live() == live and store.table("chunks").count() == 20


def test_commits_that_meet_keep_both(spark, tmp):
    store = LexicalStore(spark, tmp)
    store.commit("v1", ["a"])
    other = LexicalStore(spark, tmp)
    real, stale = other._last, iter([0])
    other._last = lambda: next(stale, real())  # believes once that no commit was made
    other.commit("v2", ["b"])
    assert store.live() == {"a": "v1", "b": "v2"}


def test_registered_search_scans_no_text(spark):
    docs = f"{SF001}/documents.parquet"
    assert input_version(spark, docs) == input_version(spark, docs)
    for name in ("bm25_topk", "hybrid_topk"):
        df = catalog.QUERIES[name](spark, SF001)
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        # documents are still read for the languages of ids, never for their texts
        assert "regexp_extract_all" not in plan
        scans = [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in line and "documents.parquet" in line]
        assert all("text" not in line.split("ReadSchema:")[1] for line in scans)


def test_term_counts_need_no_shuffle_unless_chunk_ids_repeat(spark):
    from convsearch.sources import lexstore

    schema = "domain string, chunk_id long, toks array<string>"
    once = [("a", 1, ["x", "y", "x"]), ("a", 2, []), ("b", 1, ["y"]), ("b", 3, None), ("a", None, ["z"])]
    twice = [*once, ("a", 1, ["x"]), ("a", None, ["z", "u"])]
    for rows in (once, twice):
        toks = spark.createDataFrame(rows, schema)
        got = lexstore.term_counts(toks, toks.select("domain", "chunk_id"))
        want, longest = {}, {}
        for d, c, ts in rows:
            for t in ts or ():
                want[d, c, t] = want.get((d, c, t), 0) + 1
                longest[d, c, t] = max(longest.get((d, c, t), 0), len(ts))
        assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(str((*k, n, longest[k])) for k, n in want.items())
        assert ("Aggregate" in got._jdf.queryExecution().optimizedPlan().toString()) == (rows is twice)
