"""The corpus as one store: documents and everything derived from them,
re-indexed domain by domain, every change committed by one manifest.

Tables beside those of ``lexstore``, each in versions and by domain:

* ``documents``   doc_id, source, text (redacted)
* ``contents``    chunk_id, doc_id, source, content
* ``vectors``     chunk_id, vec, by the vocabulary ``vocab/v=``
* ``node_refs``, ``node_words``  chunk_id, word: the reference graph

``ingest`` takes one batch of uploads: valid ones become documents, the others
go to ``quarantine/<stream>-<epoch>`` with their reason. It writes new versions
of the touched domains only and commits their tables, the vocabulary's version
and the batch's number in one manifest. A batch whose number is already
committed does nothing, and one that failed before its commit left nothing
that is read, so batches may be repeated.

The vocabulary is fitted with the first batch and kept, so that vectors of all
domains stay comparable; ``refit`` fits it anew and renews all vectors."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..operators import refgraph, tfidf
from ..operators.chunk import chunk_documents
from . import corpus as COR
from .ingest import landing_names, validate_uploads
from .lexstore import SCHEMAS, LexicalStore


class CorpusStore(LexicalStore):
    schemas = SCHEMAS | {
        "documents": "doc_id long, source string, text string, v string, domain string",
        "contents": "chunk_id long, doc_id long, source string, content string, v string, domain string",
        "vectors": "chunk_id long, vec array<double>, v string, domain string",
        "node_refs": "chunk_id long, word string, v string, domain string",
        "node_words": "chunk_id long, word string, v string, domain string",
    }

    def _put(self, df: DataFrame, name: str, v: str) -> DataFrame:
        """Write ``df`` as version ``v`` of a table and read it back."""
        own = [f.strip().split(" ")[0] for f in self.schemas[name].split(", ")]
        df.select(*[c for c in own if c != "v"]).write.partitionBy("domain").parquet(f"{self.root}/{name}/v={v}")
        return self._read(name, [v]).drop("v")

    def vocabulary(self) -> DataFrame | None:
        v = self._state().get("/vocab")
        return self.spark.read.parquet(f"{self.root}/vocab/v={v}") if v else None

    def done(self, stream: str) -> int:
        """The last batch of a stream that was committed; -1 before the first."""
        return int(self._state().get(f"/epoch/{stream}", -1))

    def ingest(self, uploads: DataFrame, epoch: int, stream: str = "uploads", domains: Iterable[str] = C.DOMAINS,
               size: int = C.CHUNK_SIZE, overlap: int = C.CHUNK_OVERLAP) -> list[str]:
        """Add a batch of uploads(domain, filename, size_bytes, content); the
        domains re-indexed. Batches of a stream come in the order of their
        numbers, one at a time."""
        if epoch <= self.done(stream):
            return []
        v = uuid.uuid4().hex
        checked_at = f"{self.root}/quarantine/{stream}-{epoch:012d}"
        validate_uploads(uploads, tuple(domains)).write.mode("overwrite").parquet(checked_at)
        good = self.spark.read.parquet(checked_at).filter(F.col("valid"))
        touched = sorted(r.domain for r in good.select("domain").distinct().collect())  # valid domains only, a handful
        marks = {f"/epoch/{stream}": epoch}
        if touched:
            old = self.table("documents", touched)
            named = landing_names(good, old.select("domain", F.col("source").alias("name")), f"{stream}-{epoch}")
            new = COR.with_doc_id(COR.redact_documents(named.select("domain", F.col("final_name").alias("source"), F.col("content").alias("text"))))
            docs = self._put(old.unionByName(new), "documents", v)
            self._check_ids(docs, [d for d in self.live() if d not in touched])
            if self.vocabulary() is None:
                self._fit(docs, v)
                marks["/vocab"] = v
            self._derive(docs, v, marks.get("/vocab") or self._state()["/vocab"], size, overlap)
        self.commit(v, touched, marks=marks)
        return touched

    def refit(self, size: int = C.CHUNK_SIZE, overlap: int = C.CHUNK_OVERLAP) -> str | None:
        """Fit the vocabulary on all documents and index all domains anew; not
        to be run beside ``ingest``."""
        domains = sorted(self.live())
        if not domains:
            return None
        v = uuid.uuid4().hex
        docs = self._put(self.table("documents"), "documents", v)
        self._fit(docs, v)
        self._derive(docs, v, v, size, overlap)
        self.commit(v, domains, marks={"/vocab": v})
        return v

    def _check_ids(self, docs: DataFrame, others: list[str]) -> None:
        """Document ids are hashes; two that meet stop the batch uncommitted."""
        ids = docs.select("doc_id")
        if others:
            ids = ids.unionByName(self.table("documents", others).select("doc_id"))
        if ids.groupBy("doc_id").count().filter("count > 1").limit(1).count():
            raise ValueError("document ids are not unique")

    def _fit(self, docs: DataFrame, v: str) -> None:
        tfidf.fit_vocab(docs, "text", "doc_id").coalesce(1).write.parquet(f"{self.root}/vocab/v={v}")

    def _derive(self, docs: DataFrame, v: str, vocab: str, size: int, overlap: int) -> None:
        """Write all tables derived from ``docs`` as version ``v``."""
        contents = self._put(chunk_documents(docs, size=size, overlap=overlap), "contents", v)
        self.write(contents, v)
        self._put(tfidf.transform(contents, self.spark.read.parquet(f"{self.root}/vocab/v={vocab}")), "vectors", v)
        graph = refgraph.build_graph(contents)
        self._put(graph.node_refs, "node_refs", v)
        self._put(graph.node_words, "node_words", v)

    def quarantine(self) -> DataFrame:
        """All rejected uploads, with their reason."""
        return self.spark.read.parquet(f"{self.root}/quarantine/*").filter("not valid")
