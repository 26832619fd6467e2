"""Streaming jobs: audit log sink, daily KPIs, incremental re-indexing,
ingest of uploads into the corpus store.

All take the checkpoint location from the caller (a shared folder on a
cluster); triggers are the caller's choice (``availableNow`` in tests)."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.chunk import chunk_documents
from ..operators.kpi import rank_index
from ..sources.corpstore import CorpusStore
from ..sources.corpus import file_domain, read_corpus, redact_documents, with_doc_id, write_partitioned


def audit_sink(audit: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Append audit records as JSON lines, one folder per UTC day."""
    a = audit if "date" in audit.columns else audit.withColumn("date", F.to_date("timestamp"))
    w = (a.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint)
         .partitionBy("date").outputMode("append"))
    return w.trigger(**(trigger or {"availableNow": True})).start()


def kpi_daily_stream(audit: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Per UTC day: total, cache-hit and low-confidence rates, average and
    exact 95th percentile latency, average confidence -- the columns of the
    batch ``kpi_daily``; a day is emitted once the watermark passes it.

    The first aggregate's state is the day's latency histogram, one row per
    (day, latency), with the other sums on the same rows; it is merged by the
    state store and combined before the shuffle, so a day's rows are never
    held together. When a day is complete, the second aggregate folds its
    histogram rows: sums are added up, and the percentile is the first latency
    whose running count reaches the rank."""
    a = audit.withWatermark("timestamp", watermark)
    n = F.count(F.lit(1))
    by_latency = (a.groupBy(F.window("timestamp", "1 day").alias("day"),
                            F.coalesce("response_latency_ms", F.lit(0)).cast("bigint").alias("lat"))
                  .agg(n.alias("n"),
                       F.sum(F.coalesce("cache_hit", F.lit(False)).cast("int")).alias("hits"),
                       F.sum(F.coalesce("low_confidence_flag", F.lit(False)).cast("int")).alias("low"),
                       F.sum(F.coalesce("final_confidence", F.lit(0.0))).alias("conf")))
    total = F.sum("n")
    per_day = by_latency.groupBy("day").agg(
        total.alias("total_queries"),
        F.round(F.sum("hits") / total, 4).alias("cache_hit_rate"),
        F.round(F.sum("low") / total, 4).alias("low_confidence_rate"),
        F.round(F.sum(F.col("lat") * F.col("n")) / total, 1).alias("avg_latency_ms"),
        F.round(F.sum("conf") / total, 4).alias("avg_confidence"),
        F.sort_array(F.collect_list(F.struct("lat", "n"))).alias("hist"))
    rank = rank_index(F.col("total_queries"), "kpi") + 1
    p95 = F.aggregate("hist", F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("bigint").alias("hit")),
                      lambda s, x: F.struct((s["seen"] + x["n"]).alias("seen"),
                                            F.coalesce(s["hit"], F.when(s["seen"] + x["n"] >= rank, x["lat"])).alias("hit")))
    return per_day.select(F.to_date(F.col("day.start")).alias("date"), "total_queries", "cache_hit_rate",
                          "low_confidence_rate", "avg_latency_ms", "avg_confidence", p95["hit"].alias("p95_latency_ms"))


def reindex_stream(landing_root: str, chunks_path: str, checkpoint: str, trigger: dict | None = None):
    """Watch ``<landing_root>/<domain>/`` for new .txt/.md files; for every
    micro-batch re-chunk only the domains that received files (all of their
    documents, redacted) and overwrite those domain partitions of the chunk
    table. Other domains are untouched (dynamic partition overwrite). Document
    ids are those of the build job; only the chunk table is rewritten, tables
    derived from it are left to the next build."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()

    def rebuild(batch: DataFrame, epoch_id: int) -> None:
        # the touched domain names (one per domain folder, a handful) pick
        # the folders to re-read
        touched = [r["domain"] for r in batch.select("domain").distinct().collect()]
        if not touched:
            return
        docs = read_corpus(batch.sparkSession, landing_root, touched)
        write_partitioned(chunk_documents(with_doc_id(redact_documents(docs))), chunks_path)

    src = (spark.readStream.option("pathGlobFilter", "*.{txt,md}")
           .option("recursiveFileLookup", True).text(landing_root, wholetext=True)
           .select(file_domain().alias("domain")))
    return (src.writeStream.foreachBatch(rebuild).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def ingest_stream(uploads: DataFrame, store: CorpusStore, checkpoint: str, trigger: dict | None = None, **options):
    """Stream of uploads(domain, filename, size_bytes, content) into a corpus
    store: every micro-batch is validated, landed and committed with all
    derived tables of the domains it touches (``CorpusStore.ingest``, which
    takes ``options``). The store's ledger goes by the query's id, which stays
    with the checkpoint, so a micro-batch run again after a failure is added
    once, and a query with a new checkpoint starts a ledger of its own."""
    started, running = threading.Event(), []

    def land(batch: DataFrame, epoch_id: int) -> None:
        started.wait()
        store.ingest(batch, epoch_id, str(running[0].id), **options)

    q = (uploads.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)
         .trigger(**(trigger or {"availableNow": True})).start())
    running.append(q)
    started.set()
    return q
