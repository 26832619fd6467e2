"""Parsing model output with Column expressions.

Router output: a JSON object {"category", "confidence"} is preferred; text
that is not JSON falls back to two regexes; some malformed JSON makes the
router call fail, which routes to escalation with confidence 0.5. Spark's
VARIANT functions give the JSON value types needed to tell those paths
apart.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C

CATEGORIES = C.DOMAINS
WS_STRIP = r"(?U)^\s+|\s+$"

# --- fixed values: patterns of the service's parsers ---
ROUTER_CATEGORY_RE = r'(?iU)"category"\s*:\s*"(\w+)"'
ROUTER_CONFIDENCE_RE = r'"confidence"\s*:\s*([0-9.]+)'
ANSWER_RE = r"(?isU)ANSWER:\s*(.*?)(?=\n\s*CONFIDENCE:|\z)"
RATING_TEXT_RE = r"(?isU)CONFIDENCE:\s*(.*)"
RATING_RE = r"(?U)\b(0(?:\.\d+)?|1(?:\.0+)?)\b"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    return F.regexp_replace(_c(c), WS_STRIP, "")


def parse_router(text, categories=CATEGORIES) -> Column:
    """-> struct(category, confidence, failed); a category outside
    ``categories`` becomes escalation. ``failed`` marks outputs
    that make the router call itself fail (category not a string, null /
    array / object confidence, valid JSON that is not an object)."""
    raw = _c(text)
    s = strip(raw)
    v = F.try_parse_json(s)
    top = F.schema_of_variant(v)
    is_obj = v.isNotNull() & s.startswith("{") & s.endswith("}") & top.startswith("OBJECT")
    non_obj_json = v.isNotNull() & ~is_obj & ~(s.startswith("{") & top.startswith("OBJECT"))
    cat_t = F.schema_of_variant(F.variant_get(v, "$.category", "variant"))
    conf_t = F.schema_of_variant(F.variant_get(v, "$.confidence", "variant"))
    cat_s = F.try_variant_get(v, "$.category", "string")
    conf_s = F.try_variant_get(v, "$.confidence", "string")
    bad_types = ((cat_t.isNotNull() & (cat_t != "STRING"))
                 | conf_t.isin("VOID") | conf_t.startswith("ARRAY") | conf_t.startswith("OBJECT"))
    json_conf = (F.when(conf_t.isNull(), F.lit(0.5))
                 .when(conf_t == "BOOLEAN", F.when(conf_s == "true", 1.0).otherwise(0.0))
                 .otherwise(conf_s.try_cast("double")))
    json_cat = F.lower(strip(F.coalesce(cat_s, F.lit(""))))
    failed = non_obj_json | (is_obj & bad_types)
    json_ok = is_obj & ~bad_types & json_conf.isNotNull() & json_cat.isin(*categories)
    rx_cat = F.lower(F.regexp_extract(raw, ROUTER_CATEGORY_RE, 1))
    rx_conf = F.regexp_extract(raw, ROUTER_CONFIDENCE_RE, 1)
    fb_cat = F.when(rx_cat.isin(*categories), rx_cat).otherwise(F.lit("escalation"))
    fb_conf = F.coalesce(F.when(rx_conf != "", rx_conf.try_cast("double")), F.lit(0.5))
    return (F.when(failed, F.struct(F.lit("escalation").alias("category"), F.lit(0.5).alias("confidence"),
                                    F.lit(True).alias("failed")))
            .when(json_ok, F.struct(json_cat.alias("category"), json_conf.alias("confidence"),
                                    F.lit(False).alias("failed")))
            .otherwise(F.struct(fb_cat.alias("category"), fb_conf.alias("confidence"),
                                F.lit(False).alias("failed"))))


def route(parsed, threshold: float = C.CONFIDENCE_THRESHOLD) -> Column:
    """Routing rule on a parsed struct: failure -> (escalation, 0.5);
    confidence below threshold -> escalation, confidence kept."""
    p = _c(parsed)
    cat = (F.when(p["failed"], F.lit("escalation"))
           .when(p["confidence"] < threshold, F.lit("escalation")).otherwise(p["category"]))
    conf = F.when(p["failed"], F.lit(0.5)).otherwise(p["confidence"])
    return F.struct(cat.alias("category"), conf.alias("confidence"))


def parse_answer(text) -> Column:
    """-> struct(answer, rating_text): text after the first ANSWER: up to a
    line starting CONFIDENCE: (else the whole text), and everything after
    the first CONFIDENCE: (else '')."""
    raw = _c(text)
    has_answer = raw.rlike(r"(?is)ANSWER:")
    answer = F.when(has_answer, strip(F.regexp_extract(raw, ANSWER_RE, 1))).otherwise(strip(raw))
    has_rating = raw.rlike(r"(?is)CONFIDENCE:")
    rating = F.when(has_rating, strip(F.regexp_extract(raw, RATING_TEXT_RE, 1))).otherwise(F.lit(""))
    return F.struct(answer.alias("answer"), rating.alias("rating_text"))


def parse_rating(text) -> Column:
    """Last number 0..1 found (clamped); none or empty text -> 0.5."""
    m = F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(RATING_RE), 1)
    last = F.when(F.size(m) > 0, F.element_at(m, -1).try_cast("double"))
    # greatest/least skip nulls, so clamp only a found value
    return F.when(last.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), last))).otherwise(F.lit(0.5))


def fused_confidence(router_conf, retrieval, llm, weights=C.CONFIDENCE_WEIGHTS) -> Column:
    """w_r * router + w_s * retrieval + w_l * llm, clamped to [0, 1], 4 places."""
    wr, ws, wl = weights
    f = F.lit(wr) * _c(router_conf) + F.lit(ws) * _c(retrieval) + F.lit(wl) * _c(llm)
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), f)), 4)


def confidence_band(conf) -> Column:
    c = F.coalesce(_c(conf), F.lit(0.0))
    return F.when(c >= 0.65, "good").when(c >= 0.5, "warn").otherwise("bad")


def source_basename(path) -> Column:
    return F.element_at(F.split(_c(path), r"[\\/]"), -1)


# --- fixed values: category keyword lists for lexical routing ---
ROUTING_TERMS = {
    "billing": ("invoices", "charges", "payments", "subscriptions", "refunds", "pricing"),
    "returns": ("returning", "products", "exchanges", "return", "eligibility", "status"),
    "escalation": ("complaints", "unresolved", "issues", "requests", "speak", "manager", "urgent", "problems"),
}
WORD_RUN = r"[\p{L}\p{N}_]+"


def route_lexical(text, terms=None, threshold: float = C.CONFIDENCE_THRESHOLD) -> Column:
    """Keyword routing without a model: count the text's words in each
    category's list (row-wise, no join); the unique best category wins with
    confidence best / all matches; ties or no match -> (escalation, 0.5);
    then the usual threshold rule."""
    terms = terms or ROUTING_TERMS
    toks = F.regexp_extract_all(F.lower(_c(text)), F.lit(WORD_RUN), 0)
    def in_list(ts):
        return lambda t: t.isin(*ts)
    counts = {c: F.size(F.filter(toks, in_list(ts))) for c, ts in terms.items()}
    total = sum(counts.values(), F.lit(0))
    best = F.greatest(*counts.values())
    n_best = sum((F.when(v == best, 1).otherwise(0) for v in counts.values()), F.lit(0))
    winner = F.lit(None).cast("string")
    for c, v in reversed(list(counts.items())):
        winner = F.when(v == best, F.lit(c)).otherwise(winner)
    ok = (total > 0) & (n_best == 1)
    cat = F.when(ok, winner).otherwise(F.lit("escalation"))
    conf = F.when(ok, best / total).otherwise(F.lit(0.5))
    return F.struct(F.when(conf < threshold, F.lit("escalation")).otherwise(cat).alias("category"),
                    conf.alias("confidence"))
