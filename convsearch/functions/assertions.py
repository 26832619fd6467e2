"""Eval assertions as Column functions returning struct(name, pass, score,
reason) -- the plug-in surface: a user assertion is any function of the
output / metadata / case columns that returns the same struct."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C

META_SCHEMA = T.StructType([
    T.StructField("agent", T.StringType()),
    T.StructField("sources", T.ArrayType(T.StringType())),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("latency_ms", T.DoubleType()),
])

# --- fixed values: fabricated-fact check ---
KNOWN_NUMBERS = (
    "30 days", "14 days", "7 days", "5-7 business days", "2 business days",
    "60 days", "30 business days", "3 days", "3-5 business days",
    "12 months", "1.5%", "25%", "1 month", "2 hours", "4 hours",
    "24 hours", "48 hours", "5 business days", "$200", "$500",
)
SUSPICIOUS_PATTERNS = (
    r"\b(90|45|21)\s*days?\b",
    r"\b[3-9]\d\s*%\s*(fee|penalty|discount)\b",
)
META_RE = r"<!--CXMETA:(.+?)-->"
# up to the end of the first block; later blocks are part of the answer
META_STRIP_RE = r"^([\s\S]*?)\n*<!--CXMETA:.+?-->"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def result(name: str, passed, score, reason) -> Column:
    return F.struct((name if isinstance(name, Column) else F.lit(name)).alias("assertion"), passed.alias("pass"),
                    score.cast("double").alias("score"), reason.alias("reason"))


def parse_meta(output) -> Column:
    """The embedded metadata object (fields null when absent/invalid)."""
    m = F.regexp_extract(F.coalesce(_c(output), F.lit("")), META_RE, 1)
    return F.from_json(F.when(m != "", m), META_SCHEMA)


def clean_output(output) -> Column:
    o = F.coalesce(_c(output), F.lit(""))
    return F.regexp_replace(F.regexp_replace(o, META_STRIP_RE, "$1"), r"(?U)^\s+|\s+$", "")


def has_source(meta) -> Column:
    src = F.coalesce(_c(meta)["sources"], F.array().cast("array<string>"))
    n = F.size(src)
    return result("has_source", n > 0, F.when(n > 0, 1.0).otherwise(0.0),
                  F.when(n > 0, F.concat(F.lit("Cited "), n.cast("string"), F.lit(" source(s): "),
                                         F.array_join(src, ", ")))
                  .otherwise(F.lit("No source documents cited — potential hallucination")))


def correct_agent(meta, expected) -> Column:
    exp, act = _c(expected), _c(meta)["agent"]
    no_exp = exp.isNull() | (exp == "")
    match = F.coalesce(act == exp, F.lit(False))
    ok = no_exp | match
    reason = (F.when(no_exp, F.lit("No expected_agent set"))
              .when(match, F.concat(F.lit("Correctly routed to "), act))
              .otherwise(F.concat(F.lit('Wrong agent: expected "'), exp, F.lit('", got "'),
                                  F.coalesce(act, F.lit("undefined")), F.lit('"'))))
    return result("correct_agent", ok, F.when(ok, 1.0).otherwise(0.0), reason)


def _limit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def number_text(x) -> Column:
    """A number as text: whole ones without a fraction, others by their
    shortest digits (0.6, 9000.5)."""
    x = _c(x).cast("double")
    return F.when(x == F.floor(x), x.cast("decimal(20,0)").cast("string")).otherwise(x.cast("string"))


def confidence_at_least(meta, threshold=C.EVAL_MIN_CONFIDENCE) -> Column:
    """``threshold`` is a number or a column (a case's own threshold)."""
    conf, least = F.coalesce(_c(meta)["confidence"], F.lit(0.0)), _limit(threshold).cast("double")
    ok = conf >= least
    txt, label = F.format_string("%.3f", conf), number_text(least)
    return result("confidence", ok, conf,
                  F.when(ok, F.concat(F.lit("Confidence "), txt, F.lit(" ≥ "), label))
                  .otherwise(F.concat(F.lit("Low confidence: "), txt, F.lit(" < "), label)))


def latency_at_most(meta, max_ms=C.EVAL_MAX_LATENCY_MS) -> Column:
    """``max_ms`` is a number or a column (a case's own limit)."""
    lat, most = F.coalesce(_c(meta)["latency_ms"], F.lit(0.0)), _limit(max_ms).cast("double")
    ok, label = lat <= most, F.concat(number_text(most), F.lit("ms"))
    return result("latency", ok,
                  F.when(ok, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.try_divide(lat - most, most))),
                  F.when(ok, F.concat(F.lit("Latency "), number_text(lat), F.lit("ms ≤ "), label))
                  .otherwise(F.concat(F.lit("Slow: "), number_text(lat), F.lit("ms > "), label)))


def no_fabricated_facts(output) -> Column:
    text = F.lower(clean_output(output))
    known = F.exists(F.array(*[F.lit(k.lower()) for k in KNOWN_NUMBERS]), lambda k: F.contains(text, k))
    flags = [F.when((F.regexp_extract(text, p, 0) != "") & ~known, F.regexp_extract(text, p, 0))
             for p in SUSPICIOUS_PATTERNS]
    arr = F.filter(F.array(*flags), lambda x: x.isNotNull())
    bad = F.size(arr) > 0
    return result("no_fabricated_facts", ~bad, F.when(bad, 0.0).otherwise(1.0),
                  F.when(bad, F.concat(F.lit('Possible fabricated facts: "'), F.array_join(arr, '", "'), F.lit('"')))
                  .otherwise(F.lit("No fabricated facts detected")))


def contains(output, value, ignore_case: bool = False) -> Column:
    o, v = F.coalesce(_c(output), F.lit("")), _c(value)
    ok = F.contains(F.lower(o), F.lower(v)) if ignore_case else F.contains(o, v)
    name = "icontains" if ignore_case else "contains"
    return result(name, ok, F.when(ok, 1.0).otherwise(0.0),
                  F.when(ok, F.lit("Assertion passed"))
                  .otherwise(F.concat(F.lit(f"Expected output to {name} \""), v, F.lit('"'))))


def custom_check(kind, output, meta) -> Column:
    """The suite's three inline checks: has_sources, ood_handled,
    min_length_20."""
    k = _c(kind)
    m = _c(meta)
    n = F.size(F.coalesce(m["sources"], F.array().cast("array<string>")))
    agent = m["agent"]
    conf = F.coalesce(m["confidence"], F.lit(1.0))
    ood = F.coalesce(agent == "escalation", F.lit(False)) | (conf < 0.65)
    ood_txt = F.concat(F.lit("(agent="), F.coalesce(agent, F.lit("undefined")), F.lit(", confidence="),
                       F.format_string("%.2f", conf), F.lit(")"))
    long_ok = F.char_length(F.coalesce(_c(output), F.lit(""))) > 20
    ok = (F.when(k == "has_sources", n > 0).when(k == "ood_handled", ood).otherwise(long_ok))
    reason = (F.when(k == "has_sources", F.when(n > 0, F.lit("Has sources for cross-domain query"))
                     .otherwise(F.lit("No sources on cross-domain query")))
              .when(k == "ood_handled", F.when(ood, F.concat(F.lit("OOD query correctly handled "), ood_txt))
                    .otherwise(F.concat(F.lit("OOD query not flagged "), ood_txt)))
              .otherwise(F.when(long_ok, F.lit("Got meaningful response to short query"))
                         .otherwise(F.lit("Response too short"))))
    return F.struct(k.alias("assertion"), ok.alias("pass"), F.when(ok, 1.0).otherwise(0.0).alias("score"),
                    reason.alias("reason"))
