"""Answering a batch of requests: retrieve -> expand -> context + history ->
prompt -> (completions table) -> parse -> confidence -> sources.

Every step is a join/aggregate keyed by the request id; per-request lists
(hits, expanded chunks, history) are bounded: k hits, the first five
expanded chunks for the context, 2N history turns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import domains as DOM
from ..functions import parse as P
from ..functions import prompts as PR
from . import confidence as CONF
from ..spark import cut_lineage
from . import hybrid, lexical, refgraph, vector


@dataclass
class Corpus:
    chunks: DataFrame    # (domain, chunk_id, source, content)
    vectors: DataFrame   # (domain, chunk_id, vec)


def context_blocks(expanded: DataFrame, chunks: DataFrame, keys=("query_id",), n: int = 5) -> DataFrame:
    """'[i] (Source: s)\\ncontent' for the first n expanded chunks, joined by
    blank lines."""
    k = list(keys)
    first = expanded.filter(F.col("pos") <= n + 0).join(chunks.select("domain", "chunk_id", "content"),
                                                        ["domain", "chunk_id"])
    w = Window.partitionBy(*k).orderBy("pos")
    first = first.withColumn("_i", F.row_number().over(w)).filter(F.col("_i") <= n)
    block = F.concat(F.lit("["), F.col("_i").cast("string"), F.lit("] (Source: "),
                     F.coalesce("source", F.lit("unknown")), F.lit(")\n"), F.col("content"))
    g = first.groupBy(*k).agg(F.array_sort(F.collect_list(F.struct("_i", block.alias("b")))).alias("_b"))
    return g.select(*k, F.size("_b").cast("bigint").alias("n_chunks"),
                    F.array_join(F.transform("_b", lambda x: x["b"]), "\n\n").alias("context"))


def answer_sources(expanded: DataFrame, keys=("query_id",)) -> DataFrame:
    """Distinct sources in first-seen order ('unknown' when missing)."""
    k = list(keys)
    first = (expanded.groupBy(*k, F.coalesce("source", F.lit("unknown")).alias("src"))
             .agg(F.min("pos").alias("_p")))
    g = first.groupBy(*k).agg(F.array_sort(F.collect_list(F.struct("_p", "src"))).alias("_s"))
    return g.select(*k, F.transform("_s", lambda x: x["src"]).alias("sources"))


def answer_batch(requests: DataFrame, corpus: Corpus, qvecs: DataFrame, completions: DataFrame,
                 history: DataFrame | None = None, k: int = C.TOP_K, hops: int = 1) -> DataFrame:
    """requests(query_id, domain, query, category, router_confidence),
    qvecs(query_id, domain, qvec[, exclude_id]), completions(query_id, raw),
    history(query_id, history_text) -> answers."""
    index = lexical.build_index(corpus.chunks)
    lex = lexical.bm25_topk(requests.select("query_id", "domain", "query"), index, k)
    vec = vector.vector_topk(qvecs, corpus.vectors, k)
    # The hit list (k rows per request) and the expanded list feed several
    # branches below; checkpointing them into the shared checkpoint folder
    # computes each once and keeps the downstream plans small (lineage cut,
    # survives executor loss).
    hits = cut_lineage(hybrid.hybrid_topk(vec, lex, corpus.chunks, k))
    graph = refgraph.build_graph(corpus.chunks)
    expanded = cut_lineage(refgraph.expand(hits.select("query_id", "domain", "rank", "chunk_id"), graph, hops))
    ctx = context_blocks(expanded, corpus.chunks)
    srcs = answer_sources(expanded)
    rs = CONF.retrieval_score(requests.select("query_id", "domain"), hits)
    r = DOM.dispatch(requests, "category")
    if history is not None:
        r = r.join(history, "query_id", "left")
    else:
        r = r.withColumn("history_text", F.lit(""))
    r = (r.join(ctx, "query_id", "left").join(srcs, "query_id", "left")
         .join(rs.select("query_id", "retrieval_score"), "query_id", "left")
         .withColumn("context", F.coalesce("context", F.lit("")))
         .withColumn("prompt", PR.answer_prompt("system_prompt", "history_text", "context", "query")))
    comp = completions.select("query_id", F.coalesce("raw", F.lit(C.LLM_FAILURE_TEXT)).alias("raw"))
    r = r.join(comp, "query_id", "left").withColumn("raw", F.coalesce("raw", F.lit(C.LLM_FAILURE_TEXT)))
    r = r.withColumn("_pa", P.parse_answer("raw"))
    r = r.withColumn("answer", F.col("_pa.answer")).withColumn("rating_text", F.col("_pa.rating_text"))
    r = CONF.score(r.withColumn("retrieval_score", F.coalesce("retrieval_score", F.lit(0.0))))
    return r.select("query_id", "domain", "query", "agent", "router_confidence", "prompt", "context", "answer",
                    "rating_text", "retrieval_score", "llm_score", "confidence", "low_confidence",
                    F.coalesce("sources", F.array().cast("array<string>")).alias("sources"), "disclaimer")
