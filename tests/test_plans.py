"""Plan-shape checks: the physical choices the scale design relies on."""

from convsearch.operators import lexical, vector
from convsearch.plans import views as V
from convsearch.sources import audit as AUD
from tests.conftest import SF001


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_topk_uses_partial_window_group_limit(spark):
    ix = lexical.build_index(V.corpus_v(spark, SF001))
    p = plan(lexical.bm25_topk(V.query_v(spark, SF001), ix, k=5))
    assert "WindowGroupLimit" in p and "Partial" in p


def test_bm25_scan_prunes_columns(spark):
    ix = lexical.build_index(V.corpus_v(spark, SF001))
    p = plan(lexical.bm25_topk(V.query_v(spark, SF001), ix, k=5))
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string>" in p
    assert "source" not in p.split("ReadSchema: struct<doc_id:bigint,text:string")[1].split(">")[0]


def test_vector_search_broadcasts_query_side(spark):
    p = plan(vector.vector_topk(V.query_vec_v(spark, SF001), V.vec_v(spark, SF001)))
    assert "BroadcastHashJoin" in p or "BroadcastExchange" in p


def test_audit_tail_pushes_time_range_to_scan(spark):
    p = plan(AUD.audit_tail(V.audit_v(spark, SF001), "2024-01-30", 100))
    scan = [line for line in p.split("\n") if "FileScan parquet" in line and "events" in line]
    pushed = scan[0].split("PushedFilters: [")[1].split("]")[0] if scan else ""
    assert "GreaterThanOrEqual(ts" in pushed and "LessThan(ts" in pushed
