"""Session memory, batch form.

A session's history expires when no turn was appended for ``ttl`` seconds
(the TTL is refreshed by each append), so a gap >= ttl between consecutive
turns starts a new *epoch*; a clear event starts one too. The history a turn
sees is the previous 2 * max_turns turns of its epoch.

Scale: a single session may hold a large share of all turns, so nothing is
partitioned by session alone.

* Epochs: turns are split into (session, time bucket) groups with bucket >=
  ttl, so only the previous bucket can continue an epoch. Local windows run
  per bucket; a small per-bucket summary (one row per session-bucket)
  stitches epochs and turn numbers across buckets.
* History: turn numbers within an epoch are grouped in blocks of 2N; the
  history of turn t lies in its own block and the one before, so it is an
  equi-join on (session, epoch, block) with at most 4N candidates per turn.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C

def _epoch0():
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def _micros(ts_col: str):
    return F.timestamp_diff("MICROSECOND", _epoch0(), F.col(ts_col).cast("timestamp_ntz"))


def sessionize(turns: DataFrame, ttl_seconds: int = C.SESSION_TTL_SECONDS, key: str = "session_id",
               ts: str = "ts", seq: str = "seq", clear_col: str | None = None,
               bucket_seconds: int = 86400) -> DataFrame:
    """Adds ``epoch`` (0-based per session) and ``turn_no`` (1-based within
    the epoch). Rows flagged by ``clear_col`` start a new epoch and are
    dropped from the output (they are control events, not turns)."""
    bucket_seconds = max(bucket_seconds, ttl_seconds)
    ttl_us = ttl_seconds * 1_000_000
    t = turns.withColumn("_us", _micros(ts)).withColumn("_b", F.floor(F.col("_us") / (bucket_seconds * 1_000_000)))
    clear = F.coalesce(F.col(clear_col), F.lit(False)) if clear_col else F.lit(False)
    w = Window.partitionBy(key, "_b").orderBy("_us", seq)
    t = (t.withColumn("_clear", clear)
         .withColumn("_lr", F.row_number().over(w))
         .withColumn("_inner_new", F.coalesce((F.col("_us") - F.lag("_us").over(w)) >= ttl_us, F.lit(False))
                     | F.col("_clear")))
    # one row per (session, bucket)
    s = t.groupBy(key, "_b").agg(
        F.min(F.struct("_us", seq)).getField("_us").alias("_first_us"),
        F.max(F.struct("_us", seq)).getField("_us").alias("_last_us"),
        F.count(F.lit(1)).alias("_n"),
        F.max(F.when((F.col("_lr") == 1) & F.col("_clear"), True).otherwise(False)).alias("_first_clear"),
        F.sum(F.when((F.col("_lr") > 1) & F.col("_inner_new"), 1).otherwise(0)).alias("_n_inner_new"),
        F.max(F.when((F.col("_lr") > 1) & F.col("_inner_new"), F.col("_lr"))).alias("_last_inner_new_lr"))
    ws = Window.partitionBy(key).orderBy("_b")
    before = ws.rowsBetween(Window.unboundedPreceding, -1)
    s = (s.withColumn("_first_new", F.lag("_b").over(ws).isNull()
                      | (F.lag("_b").over(ws) != F.col("_b") - 1)
                      | ((F.col("_first_us") - F.lag("_last_us").over(ws)) >= ttl_us)
                      | F.col("_first_clear"))
         .withColumn("_rows_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
         .withColumn("_new_in_b", F.col("_n_inner_new") + F.col("_first_new").cast("int"))
         .withColumn("_new_before", F.coalesce(F.sum("_new_in_b").over(before), F.lit(0)))
         .withColumn("_last_new_idx", F.coalesce(F.col("_last_inner_new_lr") + F.col("_rows_before"),
                                                 F.when(F.col("_first_new"), F.col("_rows_before") + 1)))
         .withColumn("_carry_idx", F.max("_last_new_idx").over(before))
         .select(key, "_b", "_first_new", "_rows_before", "_new_before", "_carry_idx"))
    j = t.join(s, [key, "_b"])
    is_new = F.when(F.col("_lr") == 1, F.col("_first_new")).otherwise(F.col("_inner_new"))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    j = (j.withColumn("_is_new", is_new)
         .withColumn("_gidx", F.col("_rows_before") + F.col("_lr"))
         .withColumn("_start", F.coalesce(F.max(F.when(F.col("_is_new"), F.col("_gidx"))).over(run), F.col("_carry_idx")))
         .withColumn("epoch", (F.col("_new_before") + F.sum(F.col("_is_new").cast("int")).over(run) - 1).cast("bigint"))
         .withColumn("turn_no", (F.col("_gidx") - F.col("_start") + 1).cast("bigint")))
    if clear_col:
        # a clear event opens its epoch as turn 1 but is not a turn itself:
        # drop it and renumber the turns of epochs it opened (few rows, so
        # the flag table is a small join)
        opened = j.filter(F.col("_clear")).select(key, "epoch").withColumn("_by_clear", F.lit(1))
        j = (j.filter(~F.col("_clear")).join(opened, [key, "epoch"], "left")
             .withColumn("turn_no", F.col("turn_no") - F.coalesce("_by_clear", F.lit(0))))
    return j.drop(*[c for c in j.columns if c.startswith("_")])


def history(sessions: DataFrame, max_turns: int = C.SESSION_MAX_TURNS, key: str = "session_id",
            seq: str = "seq", role: str = "role", content: str = "content") -> DataFrame:
    """For every turn, the previous ``2 * max_turns`` turns of its epoch as
    ARRAY<STRUCT<role, content>> in order (read before the turn is added)."""
    n = 2 * max_turns
    cur = sessions.select(key, seq, "epoch", "turn_no").withColumn("_blk", F.floor((F.col("turn_no") - 1) / n))
    past = sessions.select(key, "epoch", F.col("turn_no").alias("_pt"), F.col(role).alias("_role"),
                           F.col(content).alias("_content")).withColumn("_pblk", F.floor((F.col("_pt") - 1) / n))
    # each past turn serves its own block and the next one
    past = past.withColumn("_blk", F.explode(F.array(F.col("_pblk"), F.col("_pblk") + 1)))
    cand = (cur.join(past, [key, "epoch", "_blk"])
            .filter((F.col("_pt") < F.col("turn_no")) & (F.col("_pt") >= F.col("turn_no") - n)))
    h = cand.groupBy(key, seq).agg(F.array_sort(F.collect_list(F.struct("_pt", "_role", "_content"))).alias("_h"))
    h = h.select(key, seq, F.transform("_h", lambda x: F.struct(x["_role"].alias("role"),
                                                                x["_content"].alias("content"))).alias("history"))
    empty = F.array().cast("array<struct<role:string,content:string>>")
    return (sessions.join(h, [key, seq], "left")
            .withColumn("history", F.coalesce("history", empty)))


def format_history(hist_col: str = "history", max_turns: int = C.SESSION_MAX_TURNS):
    """'Role: content' lines for the last 2 * max_turns entries; a missing
    role counts as 'user'."""
    h = F.col(hist_col)
    last = F.slice(h, F.greatest(F.lit(1), F.size(h) - 2 * max_turns + 1), 2 * max_turns)

    def line(x):
        r = F.coalesce(x["role"], F.lit("user"))
        return F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1 << 30)), F.lit(": "),
                        F.coalesce(x["content"], F.lit("")))
    return F.when(F.size(h) > 0, F.array_join(F.transform(last, line), "\n")).otherwise(F.lit(""))
