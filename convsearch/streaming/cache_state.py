"""Semantic cache replay as a stateful stream.

Lookups are processed in event-time order per partition key (the domain,
optionally plus a caller-supplied bucket). Each lookup takes the live entry
with the highest cosine similarity (strictly > 0); a similarity at or above
the threshold is a hit, anything else is a miss and stores a new entry keyed
by md5(domain:query) with a TTL fixed at store time. Whether a later lookup
hits depends on earlier misses, so this is a per-key sequential operator;
state holds only live entries (expired ones are dropped on every batch and
by the event-time timeout), so it is bounded by the TTL window.

Against a frozen cache (no stores) use ``operators.cache.cache_lookup``.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from .. import config as C

OUT_SCHEMA = T.StructType([
    T.StructField("domain", T.StringType()),
    T.StructField("lookup_id", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("hit", T.BooleanType()),
    T.StructField("entry_key", T.StringType()),
    T.StructField("similarity", T.DoubleType()),
])
STATE_SCHEMA = T.StructType([T.StructField("entries", T.StringType())])


def _processor(threshold: float, ttl_seconds: int):
    ttl_ms = ttl_seconds * 1000

    def fn(key, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        entries = json.loads(state.get[0]) if state.exists else {}
        out = []
        # a group comes in several Arrow batches, in no order between them
        for row in pd.concat(list(pdfs)).sort_values(["ts", "lookup_id"]).itertuples(index=False):
            now = int(pd.Timestamp(row.ts).value // 1_000_000)
            entries = {k: e for k, e in entries.items() if e["stored"] <= now < e["stored"] + ttl_ms}
            q = np.asarray(row.vec, dtype=np.float64)
            best, best_key, best_order = 0.0, None, None
            for k, e in entries.items():
                s = float(np.dot(q, np.asarray(e["vec"], dtype=np.float64)))
                order = (e["stored"], k)
                if s > best or (s == best and best_key is not None and order < best_order):
                    best, best_key, best_order = s, k, order
            hit = best_key is not None and best >= threshold
            out.append((key[0], int(row.lookup_id), row.ts, hit, best_key if hit else None,
                        best if best_key is not None else None))
            if not hit:
                k = hashlib.md5(f"{key[0]}:{row.query}".encode()).hexdigest()
                entries[k] = {"vec": q.tolist(), "stored": now}
        expiry = max((e["stored"] for e in entries.values()), default=None)
        if expiry is not None and expiry + ttl_ms > state.getCurrentWatermarkMs():
            state.update((json.dumps(entries),))
            state.setTimeoutTimestamp(expiry + ttl_ms)
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=[f.name for f in OUT_SCHEMA.fields])
    return fn


def cache_replay(lookups: DataFrame, threshold: float = C.CACHE_SIM_THRESHOLD,
                 ttl_seconds: int = C.CACHE_TTL_SECONDS, watermark: str = "2 hours") -> DataFrame:
    """lookups(domain, lookup_id, ts, query, vec) stream -> per-lookup
    (domain, lookup_id, ts, hit, entry_key, similarity)."""
    return (lookups.select("domain", "lookup_id", "ts", "query", "vec").withWatermark("ts", watermark)
            .groupBy("domain")
            .applyInPandasWithState(_processor(threshold, ttl_seconds), OUT_SCHEMA, STATE_SCHEMA,
                                    "append", GroupStateTimeout.EventTimeTimeout))
