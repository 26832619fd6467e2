"""Semantic answer cache, batch form (lookups against a frozen cache).

* ``cache_lookup`` -- for each lookup, the live entry of its domain with the
  highest cosine similarity (strictly > 0); a hit if >= threshold. Live means
  ``stored_at <= ts < stored_at + ttl``: a band join. Entries are keyed by
  (domain, ttl-bucket of stored_at) and each lookup probes its own bucket and
  the previous one, so the join is an equi-join whose candidates are bounded
  by the entries of one domain within two TTL windows.
* ``cache_exact`` -- md5(domain:query) equi-join, the fast path.
* ``cache_misses`` -- lookups without a hit (anti join).

The order-dependent replay (entries stored by earlier misses) is the
streaming operator in ``streaming/cache_state.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.vectors import dot

def _epoch0():
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def _us(c: str):
    return F.timestamp_diff("MICROSECOND", _epoch0(), F.col(c).cast("timestamp_ntz"))


def live_candidates(lookups: DataFrame, entries: DataFrame, ttl_seconds: int, keys=("domain",),
                    ts: str = "ts", stored_at: str = "stored_at", strict: bool = False) -> DataFrame:
    """(lookup, entry) pairs with equal keys and the entry live at the
    lookup's time, via an equi-join on (keys, ttl bucket). ``strict``
    requires the entry to be stored strictly before the lookup."""
    ttl_us = ttl_seconds * 1_000_000
    k = list(keys)
    e = (entries.withColumn("_sus", _us(stored_at))
         .withColumn("_bk", F.floor(F.col("_sus") / ttl_us)))
    lk = (lookups.withColumn("_tus", _us(ts))
          .withColumn("_bk", F.explode(F.array(F.floor(F.col("_tus") / ttl_us),
                                               F.floor(F.col("_tus") / ttl_us) - 1))))
    return (lk.join(e, [*k, "_bk"])
            .filter(((F.col("_sus") < F.col("_tus")) if strict else (F.col("_sus") <= F.col("_tus")))
                    & (F.col("_tus") < F.col("_sus") + ttl_us))
            .drop("_bk"))


def cache_lookup(lookups: DataFrame, entries: DataFrame, threshold: float = C.CACHE_SIM_THRESHOLD,
                 ttl_seconds: int = C.CACHE_TTL_SECONDS) -> DataFrame:
    """lookups(lookup_id, domain, vec, ts) x entries(domain, entry_id, vec,
    stored_at) -> (lookup_id, domain, best_entry_id, best_sim, hit)."""
    l = lookups.select("lookup_id", "domain", F.col("vec").alias("qvec"), "ts")
    e = entries.select("domain", "entry_id", "vec", "stored_at")
    c = live_candidates(l, e, ttl_seconds).withColumn("sim", dot("qvec", "vec")).filter(F.col("sim") > 0)
    w = Window.partitionBy("lookup_id").orderBy(F.col("sim").desc(), F.col("_sus").asc(), F.col("entry_id").asc())
    best = (c.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1)
            .select("lookup_id", F.col("entry_id").alias("best_entry_id"), F.col("sim").alias("best_sim")))
    return (lookups.select("lookup_id", "domain").join(best, "lookup_id", "left")
            .withColumn("hit", F.coalesce(F.col("best_sim") >= threshold, F.lit(False))))


def cache_key(domain, query):
    return F.md5(F.concat_ws(":", domain, query))


def cache_exact(lookups: DataFrame, entries: DataFrame, ttl_seconds: int = C.CACHE_TTL_SECONDS) -> DataFrame:
    """lookups(lookup_id, domain, query, ts) x entries(domain, query,
    stored_at, entry_id) on md5(domain:query) with the entry live ->
    (lookup_id, key, exact_hit, n_live, entry_id of the latest live entry)."""
    l = lookups.select("lookup_id", "ts", cache_key(F.col("domain"), F.col("query")).alias("key"))
    e = entries.select("entry_id", "stored_at", cache_key(F.col("domain"), F.col("query")).alias("key"))
    c = live_candidates(l, e, ttl_seconds, keys=("key",), strict=True)
    agg = c.groupBy("lookup_id").agg(F.count(F.lit(1)).alias("n_live"),
                                     F.max(F.struct("_sus", "entry_id")).getField("entry_id").alias("entry_id"))
    return (l.select("lookup_id", "key").join(agg, "lookup_id", "left")
            .select("lookup_id", "key", F.col("n_live").isNotNull().alias("exact_hit"),
                    F.coalesce("n_live", F.lit(0)).cast("bigint").alias("n_live"), "entry_id"))


def cache_misses(lookups: DataFrame, results: DataFrame) -> DataFrame:
    """Lookups that go on to retrieval: no hit in ``results``."""
    hits = results.filter(F.col("hit")).select("lookup_id")
    return lookups.join(hits, "lookup_id", "left_anti")
