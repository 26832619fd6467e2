"""Approximate nearest neighbours by inner product: adaptive dimension scan.

Method: vectors are dealt to the lists of nearest centroids. A query probes the
lists whose centroids are nearest to it. Within a list, the centroid is taken
from the vectors, and what is left of them and the queries are rotated by a
random orthogonal matrix and scanned in blocks of columns: after each block a
hypothesis test abandons the vectors whose partial inner product is too small
for the query's threshold. Of a product s of vectors with lengths a and b, d of D
randomly rotated columns hold s d / D, with a deviation of at most
a b sqrt(2 d (D - d) / D^3); a vector goes when its part is more than ``z``
deviations below that share of the threshold, or when the rest of it could not
reach the threshold in any direction. Survivors are scored exactly, on the
original vectors, in double precision.

The threshold is the score of the k-th best vector of a bounded sample
(``sample`` vectors, those with the smallest hash of their id); the sample's
best ones are always among the results. One half of the sample fits the
centroids. How many lists a query probes is measured on the whole table: a
bounded sample of the queries is compared with every vector, and a query probes
so many lists that these hold the share ``recall`` of the true nearest.

Lists and their queries are split into blocks of bounded size, so a list with a
third of all vectors is the work of many tasks. Every vector is indexed.

Defined cases: vectors that are null, zero, of another length than most, or
hold null or non-finite numbers take no part; ties go to the smaller id; a
query has all candidates if there are fewer than k; repeated vectors are told
apart by id; an empty table gives no rows; other columns are ignored."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import stored

K, SAMPLE, RECALL, COLUMNS, Z = 20, 4096, 0.95, 16, 3.5
#: Vectors and queries that one task compares at a time.
VECTOR_BLOCK, QUERY_BLOCK = 4096, 1024
#: Pairs of them whose columns are gathered at a time.
PAIRS = 262_144
#: Queries that say how many lists are probed.
TRIED = 256
FOUND = "query_id long, vec_id long, score double"


def usable(v: Column) -> Column:
    return (v.isNotNull() & F.exists(v, lambda x: x != 0)
            & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def _matrix(column) -> np.ndarray:
    values = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1) if len(values) else np.empty((0, 1))


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def centroids(x: np.ndarray, lists: int, rounds: int = 10) -> np.ndarray:
    """k-means on the sample; an empty list keeps its centre."""
    c = x[np.random.default_rng(7).choice(len(x), lists, replace=False)]
    for _ in range(rounds):
        near = nearest_list(x, c)
        total, n = np.zeros_like(c), np.bincount(near, minlength=lists)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def nearest_list(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x @ c.T - 0.5 * (c * c).sum(1)).argmax(1)


def nearest_of_all(indexed: DataFrame, ids: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
    """asked, list: the lists of the ``k`` true nearest of each row of ``q``
    among all vectors; ``ids`` are their own ids, ``asked`` their places."""

    def compare(batches):
        import pyarrow as pa

        i, score, near, lists = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64)
        least = np.full(len(q), -np.inf)
        for batch in batches:
            for piece in (batch.slice(a, VECTOR_BLOCK) for a in range(0, batch.num_rows, VECTOR_BLOCK)):
                own, x, to = piece.column(0).to_numpy(), _matrix(piece.column(1)), piece.column(2).to_numpy()
                all_scores = q @ x.T
                all_scores[ids[:, None] == own[None, :]] = -np.inf
                a, b = np.nonzero((all_scores >= least[:, None]) & (all_scores > -np.inf))
                i, score, near, lists = np.append(i, a), np.append(score, all_scores[a, b]), np.append(near, own[b]), np.append(lists, to[b])
                best = _best(i, near, score, k)
                i, score, near, lists = i[best], score[best], near[best], lists[best]
                many = np.bincount(i, minlength=len(q))
                lowest = np.full(len(q), np.inf)
                np.minimum.at(lowest, i, score)
                least = np.where(many >= k, lowest, -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(score), pa.array(near), pa.array(lists)], names=["asked", "score", "vec_id", "list"])

    found = indexed.select("vec_id", "v", "list").mapInArrow(compare, "asked long, score double, vec_id long, list long")
    rank = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("_r", rank).filter(F.col("_r") <= k).select("asked", "list")


def probes_for(q: np.ndarray, c: np.ndarray, asked: np.ndarray, lists: np.ndarray, recall: float) -> int:
    """How many lists hold the share ``recall`` of the nearest vectors: those
    of row ``asked[i]`` of ``q`` lie in ``lists[i]``."""
    if not len(asked):
        return len(c)
    place = np.argsort(np.argsort(-(q @ c.T), axis=1, kind="stable"), axis=1)
    needed = np.sort(place[asked, lists])
    return int(needed[int(np.ceil(recall * len(needed))) - 1]) + 1


def scan(q: np.ndarray, x: np.ndarray, least: np.ndarray, turn: np.ndarray, z: float = Z, step: int = COLUMNS):
    """Pairs (query, vector) that no test abandons, of the rows of ``q`` and
    ``x``; ``least`` is each query's threshold."""
    rq, rx = q @ turn, x @ turn
    tail = lambda m: np.sqrt(np.maximum(0, np.cumsum((m * m)[:, ::-1], 1)[:, ::-1]))
    tq, tx, dim = tail(rq), tail(rx), q.shape[1]

    def lacks(part, least, end, a, b, left):
        """What the part of the first ``end`` columns has to reach."""
        slack = 1e-9 * (1 + a * b)
        if end >= dim:
            return part < least - slack
        sure = part + left < least - slack
        return sure | (part < least * end / dim - z * a * b * np.sqrt(2 * end * (dim - end) / dim**3) - slack)

    first, found = min(step, dim), []
    # equal vectors may leave all pairs: so many queries at a time as bound them
    many = max(1, PAIRS // max(1, len(x)))
    for own in (np.arange(a, min(len(q), a + many)) for a in range(0, len(q), many)):
        part = rq[own, :first] @ rx[:, :first].T
        left = np.outer(tq[own, first], tx[:, first]) if first < dim else 0.0
        i, j = np.nonzero(~lacks(part, least[own, None], first, tq[own, :1], tx[:, 0], left))
        part, i = part[i, j], own[i]
        for at in range(step, dim, step):
            end = min(dim, at + step)
            part = part + np.einsum("ij,ij->i", rq[i, at:end], rx[j, at:end])
            left = tq[i, end] * tx[j, end] if end < dim else 0.0
            keep = ~lacks(part, least[i], end, tq[i, 0], tx[j, 0], left)
            i, j, part = i[keep], j[keep], part[keep]
        found.append((i, j))
    return tuple(np.concatenate(both) for both in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64))


def _best(i: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best rows for each i: score descending, ids ascending."""
    order = np.lexsort((ids, -score, i))
    i = i[order]
    first = np.searchsorted(i, i)
    return order[np.arange(len(i)) - first < k]


def search(vectors: DataFrame, query_every: int = 20, k: int = K, sample: int = SAMPLE, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest vectors of every vector
    whose id is divisible by ``query_every``, itself excluded."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter(
        F.col("vec_id").isNotNull() & usable(F.col("v")))
    size = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    if size is None:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    dim, n = size["dim"], size["n"]
    rows = rows.filter(F.size("v") == dim)
    known = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    known_ids = np.array([r["vec_id"] for r in known])
    known_x = np.array([r["v"] for r in known], np.float64)
    fitted = known_x[::2]
    centre, turn = centroids(fitted, int(min(1024, max(1, np.sqrt(n) / 2), len(fitted)))), rotation(dim)

    def assign(batches):
        import pyarrow as pa

        for batch in batches:
            x = _matrix(batch.column(1))
            near = nearest_list(x, centre) if len(x) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int64))], names=["vec_id", "v", "list"])

    indexed = stored(rows.mapInArrow(assign, "vec_id long, v array<double>, list long"), "index")
    asking = indexed.filter(F.pmod("vec_id", F.lit(query_every)) == 0)
    tried = asking.orderBy(F.xxhash64("vec_id", F.lit("tried")), "vec_id").limit(TRIED).collect()
    tried_x = np.array([r["v"] for r in tried], np.float64).reshape(len(tried), -1)
    truth = nearest_of_all(indexed, np.array([r["vec_id"] for r in tried], np.int64), tried_x, k).collect() if tried else []
    probes = probes_for(tried_x, centre, np.array([r["asked"] for r in truth], np.int64), np.array([r["list"] for r in truth], np.int64), recall)

    def start(batches):
        """Each query's threshold, its best of the sample and its lists."""
        import pyarrow as pa

        for batch in batches:
            for piece in (batch.slice(a, QUERY_BLOCK) for a in range(0, batch.num_rows, QUERY_BLOCK)):
                q, ids = _matrix(piece.column(1)), np.array(piece.column(0).to_pylist())
                score = q @ known_x.T
                score[ids[:, None] == known_ids[None, :]] = -np.inf
                top = np.argsort(-score, axis=1, kind="stable")[:, :k]
                value = np.take_along_axis(score, top, 1)
                least = value[:, -1] - 1e-9 * (1 + np.abs(value[:, -1])) if top.shape[1] == k else np.full(len(q), -np.inf)
                to = np.argsort(-(q @ centre.T), axis=1, kind="stable")[:, :probes]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(1), pa.array(least), pa.array(to.tolist(), pa.list_(pa.int64())), pa.array(known_ids[top].tolist(), pa.list_(pa.int64()))],
                    names=["query_id", "q", "least", "lists", "sampled"])

    queries = stored(asking.select("vec_id", "v").mapInArrow(
        start, "query_id long, q array<double>, least double, lists array<long>, sampled array<long>"), "queries")
    asked = queries.select("query_id", "q", "least", F.explode("lists").alias("list"))

    # blocks of each list: at most 1024 lists, so both counts are small
    blocks = (indexed.groupBy("list").agg(F.ceil(F.count("*") / VECTOR_BLOCK).alias("vb"))
              .join(asked.groupBy("list").agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("qb")), "list"))
    blocks = F.broadcast(blocks)
    cut = lambda key, many: F.pmod(F.xxhash64(key), F.col(many)).cast("long")
    every = lambda many: F.explode(F.sequence(F.lit(0).cast("long"), F.col(many).cast("long") - 1))
    left = indexed.join(blocks, "list").select("list", cut("vec_id", "vb").alias("vb"), every("qb").alias("qb"), "vec_id", "v")
    right = asked.join(blocks, "list").select("list", every("vb").alias("vb"), cut("query_id", "qb").alias("qb"), "query_id", "q", "least")

    def compare(found, wanted):
        import pyarrow as pa

        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not found.num_rows or not wanted.num_rows:
            return empty
        x, q = _matrix(found.column("v")), _matrix(wanted.column("q"))
        ids, asking = found.column("vec_id").to_numpy(), wanted.column("query_id").to_numpy()
        middle = centre[found.column("list")[0].as_py()]
        i, j = scan(q, x - middle, wanted.column("least").to_numpy() - q @ middle, turn)
        other = ids[j] != asking[i]
        i, j = i[other], j[other]
        score = np.concatenate([np.einsum("ij,ij->i", q[i[a:a + PAIRS]], x[j[a:a + PAIRS]]) for a in range(0, len(i), PAIRS)] or [np.empty(0)])
        best = _best(i, ids[j], score, k)
        return pa.table({"query_id": asking[i[best]], "vec_id": ids[j[best]], "score": score[best]})

    key = ["list", "vb", "qb"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(compare, FOUND)

    # the sample's best, scored like the others: at most k a query
    held = F.broadcast(vectors.sparkSession.createDataFrame([(int(a), [float(z) for z in b]) for a, b in zip(known_ids, known_x)], "vec_id long, v array<double>"))
    seeds = queries.select("query_id", "q", F.explode("sampled").alias("vec_id")).filter("query_id <> vec_id").join(held, "vec_id")

    def rescore(batches):
        import pyarrow as pa

        for batch in batches:
            score = np.einsum("ij,ij->i", _matrix(batch.column(2)), _matrix(batch.column(3))) if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], names=["query_id", "vec_id", "score"])

    found = found.unionByName(seeds.select("query_id", "vec_id", "q", "v").mapInArrow(rescore, FOUND))
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
