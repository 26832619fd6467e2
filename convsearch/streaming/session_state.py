"""Session memory as a Structured Streaming stateful operator.

State per session: the last 2 * max_turns entries and the time of the last
append. A turn arriving ``ttl`` seconds or more after the last append finds
the history expired (the TTL is refreshed by appends, not by reads); a
``clear`` event drops it. Each turn is emitted with the history it saw
(read before it is appended). State is bounded by 2N entries per session
and expires by event-time timeout, so a hot session never grows state.

The batch twin is ``operators.sessions.sessionize`` + ``history``.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from .. import config as C

OUT_SCHEMA = T.StructType([
    T.StructField("session_id", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("n_history", T.LongType()),
    T.StructField("history_text", T.StringType()),
])
STATE_SCHEMA = T.StructType([
    T.StructField("turns", T.StringType()),
    T.StructField("last_ms", T.LongType()),
])


def _fmt(hist, max_turns):
    lines = []
    for role, content in hist[-2 * max_turns:]:
        r = role or "user"
        lines.append(f"{r[:1].upper()}{r[1:].lower()}: {content or ''}")
    return "\n".join(lines)


def _processor(ttl_seconds: int, max_turns: int):
    ttl_ms = ttl_seconds * 1000

    def fn(key, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        hist, last = [], None
        if state.exists:
            t, last = state.get
            hist = [tuple(x) for x in json.loads(t)]
        out = []
        # a group comes in several Arrow batches, in no order between them
        for row in pd.concat(list(pdfs)).sort_values(["ts", "seq"]).itertuples(index=False):
            ms = int(pd.Timestamp(row.ts).value // 1_000_000)
            if last is not None and ms - last >= ttl_ms:
                hist = []
            if getattr(row, "kind", "turn") == "clear":
                hist, last = [], None
                continue
            out.append((key[0], int(row.seq), row.ts, len(hist), _fmt(hist, max_turns)))
            hist.append((row.role, row.content))
            hist = hist[-2 * max_turns:]
            last = ms
        if last is not None and last + ttl_ms > state.getCurrentWatermarkMs():
            state.update((json.dumps(hist), last))
            state.setTimeoutTimestamp(last + ttl_ms)
        elif state.exists:
            # already expired relative to the watermark: nothing to keep
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=[f.name for f in OUT_SCHEMA.fields])
    return fn


def session_memory(turns: DataFrame, ttl_seconds: int = C.SESSION_TTL_SECONDS,
                   max_turns: int = C.SESSION_MAX_TURNS, watermark: str = "1 hour") -> DataFrame:
    """turns(session_id, ts, seq, role, content[, kind]) streaming DataFrame
    -> (session_id, seq, ts, n_history, history_text), append mode."""
    cols = ["session_id", "ts", "seq", "role", "content"] + (["kind"] if "kind" in turns.columns else [])
    return (turns.select(*cols).withWatermark("ts", watermark)
            .groupBy("session_id")
            .applyInPandasWithState(_processor(ttl_seconds, max_turns), OUT_SCHEMA, STATE_SCHEMA,
                                    "append", GroupStateTimeout.EventTimeTimeout))
