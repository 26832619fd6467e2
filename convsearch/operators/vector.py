"""Vector retrieval.

* ``vector_topk`` -- exact flat-L2 search: the (size-checked) query batch is
  broadcast to the vector scan, so vectors are never shuffled; the partial
  WindowGroupLimit keeps at most k rows per query per task before the only
  shuffle.
* ``vector_topk_lsh`` -- scale variant for query batches too large to
  broadcast: random-hyperplane signature bands turn the search into an
  equi-join on (domain, band, bucket), followed by an exact re-rank of the
  candidates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.vectors import sq_l2
from .lexical import top_k


def vector_scores(qvecs: DataFrame, vectors: DataFrame, broadcast_rows: int = 100_000,
                  vector_blocks: int | None = None) -> DataFrame:
    """qvecs(query_id, domain, qvec[, exclude_id]) x vectors(domain, chunk_id, vec)
    within the domain -> (query_id, domain, chunk_id, dist, score).

    A query batch within ``broadcast_rows`` (bounded count) is broadcast to
    the vector scan. A larger batch is not joined on the domain alone (a few
    keys, one task per domain): queries are hashed into B blocks of about
    ``broadcast_rows`` and vectors into V blocks, each side is replicated
    across the other side's blocks, and the equi-join on (domain, qblock,
    vblock) gives tasks of (Q/B) x (N/V) pairs, however hot a domain is."""
    n_probe = qvecs.limit(broadcast_rows + 1).count()
    if n_probe <= broadcast_rows:
        j = F.broadcast(qvecs).join(vectors, "domain")
    else:
        n_q = qvecs.count()
        nb = -(-n_q // broadcast_rows)
        nv = vector_blocks or qvecs.sparkSession.sparkContext.defaultParallelism
        qb = (qvecs.withColumn("_qb", F.pmod(F.xxhash64("query_id"), F.lit(nb)))
              .withColumn("_vb", F.explode(F.sequence(F.lit(0), F.lit(nv - 1)))))
        vb = (vectors.withColumn("_vb", F.pmod(F.xxhash64("chunk_id"), F.lit(nv)))
              .withColumn("_qb", F.explode(F.sequence(F.lit(0), F.lit(nb - 1)))))
        j = qb.join(vb, ["domain", "_qb", "_vb"]).drop("_qb", "_vb")
    if "exclude_id" in qvecs.columns:
        j = j.filter(F.col("exclude_id").isNull() | (F.col("chunk_id") != F.col("exclude_id")))
    d = sq_l2("qvec", "vec")
    return j.select("query_id", "domain", "chunk_id", d.alias("dist"),
                    (1.0 / (1.0 + d)).alias("score"))


def vector_topk(qvecs: DataFrame, vectors: DataFrame, k: int = C.TOP_K,
                broadcast_rows: int = 100_000) -> DataFrame:
    """Top-k nearest chunks by squared L2 distance (ties by chunk id)."""
    s = vector_scores(qvecs, vectors, broadcast_rows)
    return top_k(s, k, [F.col("dist").asc(), F.col("chunk_id").asc()])


def _planes(dim: int, n_bits: int, seed: int):
    import numpy as np
    rng = np.random.default_rng(seed)
    return rng.standard_normal((n_bits, dim)).tolist()


def _signature_bands(vec_col: str, planes, bands: int, rows: int):
    """Array of ``bands`` bucket ids; band b hashes the signs of hyperplanes
    b*rows .. b*rows+rows-1."""
    bits = []
    for p in planes:
        pl = F.array(*[F.lit(float(x)) for x in p])
        proj = F.aggregate(F.zip_with(F.col(vec_col), pl, lambda a, b: a.cast("double") * b),
                           F.lit(0.0), lambda acc, x: acc + x)
        bits.append(F.when(proj >= 0, 1).otherwise(0))
    out = []
    for b in range(bands):
        code = F.lit(0)
        for r in range(rows):
            code = code * 2 + bits[b * rows + r]
        out.append(code)
    return F.array(*out)


def vector_topk_lsh(qvecs: DataFrame, vectors: DataFrame, k: int = C.TOP_K, dim: int = 64,
                    bands: int = 8, rows: int = 4, seed: int = 17) -> DataFrame:
    """Approximate top-k: candidates share at least one signature band with
    the query; candidates are re-ranked exactly. Neither side is broadcast,
    so it scales with both the query batch and the corpus."""
    planes = _planes(dim, bands * rows, seed)
    qb = qvecs.select("*", F.posexplode(_signature_bands("qvec", planes, bands, rows)).alias("band", "bucket"))
    vb = vectors.select("*", F.posexplode(_signature_bands("vec", planes, bands, rows)).alias("band", "bucket"))
    cand = (qb.join(vb, ["domain", "band", "bucket"])
            .select("query_id", "domain", "chunk_id", "qvec", "vec",
                    *(["exclude_id"] if "exclude_id" in qvecs.columns else []))
            .dropDuplicates(["query_id", "domain", "chunk_id"]))
    if "exclude_id" in qvecs.columns:
        cand = cand.filter(F.col("exclude_id").isNull() | (F.col("chunk_id") != F.col("exclude_id")))
    d = sq_l2("qvec", "vec")
    s = cand.select("query_id", "domain", "chunk_id", d.alias("dist"), (1.0 / (1.0 + d)).alias("score"))
    return top_k(s, k, [F.col("dist").asc(), F.col("chunk_id").asc()])
