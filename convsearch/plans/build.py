"""Corpus build job: documents -> redacted -> placeholder rows for empty
domains -> chunks -> lexical index, TF-IDF vectors, reference graph tables,
all written partitioned by domain (one job; derived tables rebuilt together).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..operators import lexical, refgraph, tfidf
from ..operators.chunk import chunk_documents
from ..sources import corpus as COR
from ..spark import stored


@dataclass
class BuiltCorpus:
    chunks: DataFrame
    index: lexical.LexicalIndex
    vocab: DataFrame
    vectors: DataFrame
    graph: refgraph.RefGraph


def build_corpus(docs: DataFrame, domains=None, size: int = C.CHUNK_SIZE,
                 overlap: int = C.CHUNK_OVERLAP) -> BuiltCorpus:
    """docs(domain, source, text[, doc_id]) -> BuiltCorpus: the chunks are
    written once, what is derived from them is lazy. Given document ids are kept; the vocabulary is fitted on the whole documents as
    given, not on their overlapping chunks."""
    d = COR.redact_documents(docs)
    if domains is not None:
        d = COR.with_placeholder(d, COR.domain_list(docs.sparkSession, list(domains)))
    # redacting and splitting are the bulk of the work and all derived tables
    # read the chunks, some twice
    chunks = stored(chunk_documents(COR.with_doc_id(d), size=size, overlap=overlap), "chunks")
    vocab = tfidf.fit_vocab(COR.with_doc_id(docs), "text", "doc_id")
    return BuiltCorpus(chunks, lexical.build_index(chunks), vocab, tfidf.transform(chunks, vocab),
                       refgraph.build_graph(chunks))


def write_corpus(b: BuiltCorpus, root: str) -> None:
    """Persist the derived tables under ``root`` (dynamic partition overwrite,
    so a re-build of some domains leaves the others in place). Chunk ids that
    meet (equal document ids, or equal hashes of two sources) are an error."""
    COR.write_partitioned(b.chunks, f"{root}/chunks")
    written = COR.read_partitioned(b.chunks.sparkSession, f"{root}/chunks")
    if written.groupBy("chunk_id").count().filter("count > 1").limit(1).count():
        raise ValueError(f"chunk ids are not unique in {root}/chunks")
    COR.write_partitioned(b.vectors, f"{root}/vectors")
    COR.write_partitioned(b.index.term_stats, f"{root}/term_stats")
    COR.write_partitioned(b.index.impacts, f"{root}/impacts")
    COR.write_partitioned(b.graph.node_refs, f"{root}/node_refs")
    COR.write_partitioned(b.graph.node_words, f"{root}/node_words")
    b.vocab.coalesce(1).write.mode("overwrite").parquet(f"{root}/vocab")


def corpus_stats(b: BuiltCorpus) -> DataFrame:
    """Per domain: documents, chunks, chunk length, vocabulary size, avgdl."""
    c = b.chunks.groupBy("domain").agg(
        F.countDistinct("doc_id").alias("n_docs"), F.count(F.lit(1)).alias("n_chunks"),
        F.max(F.char_length("content")).cast("bigint").alias("max_chunk_chars"),
        F.round(F.avg(F.char_length("content")), 6).alias("avg_chunk_chars"))
    v = b.index.term_stats.groupBy("domain").agg(F.count(F.lit(1)).alias("vocab_terms"))
    return (c.join(v, "domain", "left")
            .join(b.index.corpus_stats.select("domain", F.round("avgdl", 6).alias("avgdl")), "domain", "left"))
