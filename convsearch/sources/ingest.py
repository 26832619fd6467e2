"""Request and upload validation (valid rows go on, invalid rows go to a
quarantine with a reason), and landing of uploaded documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C

ASCII_WS = r"^[ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+$"


def validate_requests(req: DataFrame, max_session: int = C.SESSION_ID_MAX, max_query: int = C.QUERY_MAX) -> DataFrame:
    """Adds ``reject_reason`` (null when valid): session_id must hold
    1..128 characters, query 1..2000, checked in that order."""
    s, q = F.char_length("session_id"), F.char_length("query")
    reason = (F.when(F.col("session_id").isNull(), "session_id_missing")
              .when(s < 1, "session_id_too_short").when(s > max_session, "session_id_too_long")
              .when(F.col("query").isNull(), "query_missing")
              .when(q < 1, "query_too_short").when(q > max_query, "query_too_long"))
    return req.withColumn("reject_reason", reason).withColumn("valid", F.col("reject_reason").isNull())


def basename(path) -> F.Column:
    return F.element_at(F.split(F.coalesce(path, F.lit("")), "/"), -1)


def extension(name) -> F.Column:
    """Lower-cased last suffix; leading dots of the name do not start one."""
    return F.lower(F.regexp_extract(name, r"^\.*[^.].*(\.[^.]*)$", 1))


def validate_uploads(up: DataFrame, domains=C.DOMAINS, allowed=C.ALLOWED_DOC_EXTENSIONS,
                     max_bytes: int = C.MAX_UPLOAD_BYTES) -> DataFrame:
    """uploads(domain, filename, size_bytes, content) -> + safe_name, ext,
    reject_reason (first failing rule: domain, type, size, empty)."""
    name = basename(F.col("filename"))
    ext = extension(name)
    blank = F.regexp_replace(F.coalesce("content", F.lit("")), ASCII_WS, "") == ""
    reason = (F.when(~F.coalesce(F.col("domain").isin(*domains), F.lit(False)), "invalid_domain")
              .when((name == "") | ~ext.isin(*allowed), "unsupported_type")
              .when(F.col("size_bytes") > max_bytes, "too_large")
              .when(blank, "empty"))
    return (up.withColumn("safe_name", name).withColumn("ext", ext)
            .withColumn("reject_reason", reason).withColumn("valid", F.col("reject_reason").isNull()))


def landing_names(valid: DataFrame, existing: DataFrame, salt: str = "") -> DataFrame:
    """``valid`` uploads with ``final_name``: the safe name, or
    ``{stem}_{8 hex}{ext}`` if the domain has a file of that name
    (``existing(domain, name)``) or another upload of the batch takes it.

    The hex digits hash ``salt`` (a batch's own name), the upload's domain,
    name and content, and its place among uploads equal in name, so a batch
    that is repeated gets the same names; 32 digits where 8 would meet a name
    that is taken. Of uploads equal in name, the one whose content hash is
    smallest comes first."""
    rows = valid.withColumn("_sha", F.sha2(F.coalesce("content", F.lit("")), 256))
    w = Window.partitionBy("domain", "safe_name").orderBy("_sha")
    rows = rows.withColumn("_at", F.row_number().over(w))
    taken = existing.select("domain", F.col("name").alias("_name")).distinct().withColumn("_taken", F.lit(True))

    def clash(df: DataFrame, name: str) -> DataFrame:
        t = taken.withColumnRenamed("_name", name)
        return df.join(t, ["domain", name], "left").withColumn("_taken", F.coalesce("_taken", F.lit(False)))

    rows = clash(rows, "safe_name").withColumn("_new", F.col("_taken") | (F.col("_at") > 1)).drop("_taken")
    stem = F.expr("substring(safe_name, 1, char_length(safe_name) - char_length(ext))")
    suffix = F.expr("right(safe_name, char_length(ext))")
    digest = F.sha2(F.concat_ws("/", F.lit(salt), "domain", "safe_name", "_sha", F.col("_at").cast("string")), 256)
    rows = rows.withColumn("_short", F.when(F.col("_new"), F.concat(stem, F.lit("_"), F.substring(digest, 1, 8), suffix)).otherwise(F.col("safe_name")))
    rows = clash(rows, "_short").withColumn("_many", F.count(F.lit(1)).over(Window.partitionBy("domain", "_short")))
    final = F.when(F.col("_new") & (F.col("_taken") | (F.col("_many") > 1)),
                   F.concat(stem, F.lit("_"), F.substring(digest, 1, 32), suffix)).otherwise(F.col("_short"))
    return rows.withColumn("final_name", final).drop("_sha", "_at", "_new", "_short", "_taken", "_many")
