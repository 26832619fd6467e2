"""Reference graph, sessions and cache on hand-made rows."""

import datetime as dt
import math
import random
import re

from pyspark.sql import functions as F

from convsearch.operators import cache as CACHE
from convsearch.operators import kpi, refgraph
from convsearch.operators import sessions as SES

POLICY = [
    ("billing", 1, "a.txt", "Invoices are due in 30 days. See section 4 for late fees."),
    ("billing", 2, "a.txt", "Section 4 late fees apply after the due date."),
    ("billing", 3, "b.txt", "Refunds go back to the card used."),
    ("billing", 4, "b.txt", "Section 4 late fees apply after the due date."),  # same 80-char prefix as 2
    ("returns", 5, "r.txt", "Section 4 of returns is unrelated to billing."),
]


def chunks(spark):
    return spark.createDataFrame(POLICY, "domain string, chunk_id long, source string, content string")


def test_edges_no_self_and_domain_local(spark):
    g = refgraph.build_graph(chunks(spark))
    edges = {(r["domain"], r["src"], r["dst"]) for r in refgraph.reference_edges(g).collect()}
    assert ("billing", 1, 2) in edges and ("billing", 1, 4) in edges
    assert all(s != d for _, s, d in edges)
    assert not any(dm == "returns" for dm, _, _ in edges)


def test_expand_hops_and_prefix_dedupe(spark):
    g = refgraph.build_graph(chunks(spark))
    seeds = spark.createDataFrame([(7, "billing", 1, 2)], "query_id int, domain string, rank int, chunk_id long")
    zero = refgraph.expand(seeds, g, hops=0).collect()
    assert [r["chunk_id"] for r in zero] == [2]
    one = sorted(refgraph.expand(seeds, g, hops=1).collect(), key=lambda r: r["pos"])
    # 2 is a successor target of 1 (undirected walk reaches 1); 4 shares 2's prefix
    assert [r["chunk_id"] for r in one] == [2, 1]
    assert one[0]["seed"] and not one[1]["seed"]


def turns(spark, rows):
    return spark.createDataFrame(rows, "session_id string, ts timestamp_ntz, seq long, role string, content string, clear boolean")


def test_sessionize_gap_and_clear(spark):
    t0 = dt.datetime(2024, 1, 1, 0, 0, 0)
    rows = [("s", t0, 1, "user", "a", False),
            ("s", t0 + dt.timedelta(seconds=1799), 2, "assistant", "b", False),
            ("s", t0 + dt.timedelta(seconds=3599), 3, "user", "c", False),   # gap 1800 -> new
            ("s", t0 + dt.timedelta(seconds=3600), 4, None, "clear", True),
            ("s", t0 + dt.timedelta(seconds=3601), 5, "user", "d", False),
            ("s", t0 + dt.timedelta(days=1, seconds=5), 6, "user", "e", False)]  # next bucket
    out = sorted((r["seq"], r["epoch"], r["turn_no"])
                 for r in SES.sessionize(turns(spark, rows), 1800, clear_col="clear").collect())
    assert out == [(1, 0, 1), (2, 0, 2), (3, 1, 1), (5, 2, 1), (6, 3, 1)]


def test_history_window_and_format(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("s", t0 + dt.timedelta(seconds=i), i, "ASSISTANT" if i % 2 else None, f"m{i}", False)
            for i in range(1, 24)]
    s = SES.sessionize(turns(spark, rows), 1800)
    h = SES.history(s).withColumn("txt", SES.format_history("history"))
    last = h.filter(F.col("seq") == 23).first()
    assert len(last["history"]) == 20
    lines = last["txt"].split("\n")
    assert lines == [f"{'Assistant' if i % 2 else 'User'}: m{i}" for i in range(3, 23)]
    assert h.filter(F.col("seq") == 1).first()["txt"] == ""


def test_cache_lookup_rules(spark):
    t0 = dt.datetime(2024, 1, 1)
    entries = spark.createDataFrame([
        ("d", 1, [1.0, 0.0], t0),
        ("d", 2, [0.0, 1.0], t0 - dt.timedelta(hours=2)),  # expired
        ("e", 3, [1.0, 0.0], t0)], "domain string, entry_id long, vec array<double>, stored_at timestamp_ntz")
    look = spark.createDataFrame([
        (10, "d", [0.92, 0.0], t0 + dt.timedelta(minutes=1)),   # exactly 0.92 -> hit
        (11, "d", [0.0, 1.0], t0 + dt.timedelta(minutes=1)),    # only expired entry matches -> miss
        (12, "d", [-1.0, 0.0], t0 + dt.timedelta(minutes=1)),   # similarity <= 0 -> miss
        (13, "f", [1.0, 0.0], t0 + dt.timedelta(minutes=1))],   # other domain -> miss
        "lookup_id long, domain string, vec array<double>, ts timestamp_ntz")
    got = {r["lookup_id"]: r["hit"] for r in CACHE.cache_lookup(look, entries, 0.92, 3600).collect()}
    assert got == {10: True, 11: False, 12: False, 13: False}
    misses = {r["lookup_id"] for r in CACHE.cache_misses(look, CACHE.cache_lookup(look, entries)).collect()}
    assert misses == {11, 12, 13}


def test_p95_forms(spark):
    for n, kpi_pos, suite_pos in ((1, 1, 1), (10, 9, 10), (20, 19, 20)):
        df = spark.createDataFrame([(i,) for i in range(1, n + 1)], "v long")
        assert kpi.percentile_by_rank(df, "v", (), "kpi").first()["p95"] == kpi_pos
        assert kpi.percentile_by_rank(df, "v", (), "suite").first()["p95"] == suite_pos


def test_percentile_by_rank_equals_sorting(spark):
    rng = random.Random(4)
    values = ([rng.gauss(0, 1) for _ in range(300)] + [0.5] * 200 + [1e300, -1e300, float("inf"), -2.0]
              + [10.0 ** rng.randint(-8, 8) for _ in range(200)])
    rows = ([("a", v) for v in values] + [("b", float(i)) for i in range(1, 21)] + [(None, 7.0), (None, 8.0)]
            + [("nulls", None)] * 3 + [("half", None), ("half", 1.0), ("half", 2.0)])
    df = spark.createDataFrame(rows, "g string, v double")

    def brute(vs, form):
        vs = sorted(vs, key=lambda v: (v is not None, v if v is not None else 0.0))
        at = max(0, int(0.95 * len(vs)) - 1) if form == "kpi" else math.floor(0.95 * len(vs))
        return vs[at]

    for form in ("kpi", "suite"):
        for ranges, descents in ((4096, 1), (16, 2), (2, 1), (2, 0)):
            got = {r["g"]: r["p95"] for r in kpi.percentile_by_rank(df, "v", ["g"], form, ranges=ranges, descents=descents).collect()}
            assert got == {g: brute([v for k, v in rows if k == g], form) for g in ("a", "b", None, "nulls", "half")}
            one = kpi.percentile_by_rank(df.filter("g = 'a'"), "v", (), form, ranges=ranges, descents=descents).collect()
            assert [r["p95"] for r in one] == [brute(values, form)]
    big = [2 ** 60 + i for i in range(100)]
    whole = spark.createDataFrame([(v,) for v in big], "v long")
    assert kpi.percentile_by_rank(whole, "v", ()).first()["p95"] == big[94]
    empty = whole.limit(0)
    assert [r["p95"] for r in kpi.percentile_by_rank(empty, "v", ()).collect()] == [None]
    assert kpi.percentile_by_rank(empty, "v", ["v"]).count() == 0


def test_percentile_has_no_window_over_one_partition(spark):
    df = spark.range(1000).selectExpr("id * 7 % 997 as v")
    plan = kpi.percentile_by_rank(df, "v", ())._jdf.queryExecution().executedPlan().toString()
    below = [plan[m.start():].split("\n")[:4] for m in re.finditer(r"\bWindow \[", plan)]
    assert below and not any("SinglePartition" in line for lines in below for line in lines)


def test_edges_are_made_once_and_counted_without_them(spark):
    """Equal to all pairs that share a word; no pair of chunks is aggregated."""
    texts = ["see section 3", "Section 3 rules", "see section 3", "nothing here", "see policy x.", "policy x. see", "refer to the late fee policy"]
    rows = [(d, 10 * i + k, "s", t) for i, d in enumerate(("a", "b")) for k, t in enumerate(texts)] + [("a", 0, "s", "see clause 9"), (None, 99, "s", "see section 3")]
    g = refgraph.build_graph(spark.createDataFrame(rows, "domain string, chunk_id long, source string, content string"))
    refs, words = [(r.domain, r.chunk_id, r.word) for r in g.node_refs.collect()], [(r.domain, r.chunk_id, r.word) for r in g.node_words.collect()]
    want = {(d, i, j) for d, i, w in refs for e, j, v in words if d is not None and d == e and w == v and i != j}
    edges = refgraph.reference_edges(g)
    got = [(r.domain, r.src, r.dst) for r in edges.collect()]
    assert want and len(got) == len(want) and set(got) == want
    assert "Aggregate" not in edges._jdf.queryExecution().optimizedPlan().toString()
    nodes = {d: sum(r[0] == d for r in rows) for d in ("a", "b", None)}
    stats = {r.domain: (r.nodes, r.edges) for r in refgraph.graph_stats(g).collect()}
    assert stats == {d: (n, sum(e[0] == d for e in want)) for d, n in nodes.items()}


def test_edges_take_few_bytes_of_a_file(spark, tmp_path):
    """The rows of many chunks that refer to each other are whole, and written
    list by list; a task's rows are never held at once."""
    ids = [i * 7919 % 100003 for i in range(1501)]
    rows = [("a", i, "s", "see section 3" if k % 3 else "Section 3, see section 3") for k, i in enumerate(ids)] + [("a", 200000 + i, "s", "Section 3 rules") for i in range(700)]
    g = refgraph.build_graph(spark.createDataFrame(rows, "domain string, chunk_id long, source string, content string"))
    edges = refgraph.reference_edges(g)
    edges.write.parquet(path := str(tmp_path / "edges"))
    back, n = spark.read.parquet(path), len(ids) * (len(rows) - 1)
    first = back.agg(F.count(F.lit(1)), F.countDistinct("src", "dst"), F.countDistinct("src"), F.countDistinct("dst"), F.sum((F.col("src") == F.col("dst")).cast("int"))).first()
    assert tuple(first) == (n, n, len(ids), len(rows), 0)
    assert sum(f.stat().st_size for f in (tmp_path / "edges").glob("*.parquet")) < 0.5 * n
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = refgraph.reference_edges(g)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert re.search(r"\*\(\d+\) Generate explode\(srcs", plan) and re.search(r"[-] Generate explode\(transform\(dsts", plan)


def test_edges_of_large_kinds_and_many_tasks(spark, monkeypatch):
    """Kinds of several buckets and lists, kinds of one chunk, small tasks and
    sources that are not broadcast give every pair once."""
    rng = random.Random(8)
    text = lambda: rng.choice(["see section 3", "Section 3", "see policy x.", "refer to the late fee policy", f"see clause {rng.randint(1, 9)}", "nothing"])
    rows = [(d, 1000 * i + k, "s", text()) for i, d in enumerate(("a", "b")) for k in range(150)]
    g = refgraph.build_graph(spark.createDataFrame(rows, "domain string, chunk_id long, source string, content string"))
    refs, words = [tuple(r) for r in g.node_refs.collect()], [tuple(r) for r in g.node_words.select("domain", "chunk_id", "word").collect()]
    want = {(d, i, j) for d, i, w in refs for e, j, v in words if d == e and w == v and i != j}
    monkeypatch.setattr(refgraph, "TILE", 1)
    monkeypatch.setattr(refgraph, "TASK_EDGES", 100)
    for most in (2_000_000, 10):
        monkeypatch.setattr(refgraph, "DEFAULT_BROADCAST_ROWS", most)
        got = [tuple(r) for r in refgraph.reference_edges(g).collect()]
        assert len(got) == len(want) and set(got) == want
