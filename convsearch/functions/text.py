"""Text Column functions: tokenising, n-grams, PII redaction, fingerprints,
cross-reference phrases. All are JVM-side expressions (no Python UDF), so
they stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: redaction patterns, applied in this order ---
# (Java regexes with (?U) so \w, \d, \s and \b are Unicode-aware like Python's.)
EMAIL_PATTERN = r"\b[\w.-]+@[\w.-]+\.\w{2,}\b"
PHONE_PATTERN = r"\b(\+?1[\s.-]?)?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}\b"
CARD_PATTERN = r"\b\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b"
SSN_PATTERN = r"\b\d{3}-\d{2}-\d{4}\b"
IP_PATTERN = r"\b(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\b"

REDACTIONS = (
    ("EMAIL", EMAIL_PATTERN, "<EMAIL>"),
    ("PHONE", PHONE_PATTERN, "<PHONE>"),
    ("CREDIT_CARD", CARD_PATTERN, "<CREDIT_CARD>"),
    ("SSN", SSN_PATTERN, "<SSN>"),
)
IP_REDACTION = ("IP_ADDRESS", IP_PATTERN, "<IP_ADDRESS>")

# --- fixed values: cross-reference phrase patterns (case-insensitive) ---
REFERENCE_PATTERNS = (
    r"see\s+(?:section|policy|clause|article|paragraph)\s+[\w.]+",
    r"refer\s+to\s+[\w\s]+policy",
    r"as\s+per\s+(?:the\s+)?[\w\s]+policy",
    r"according\s+to\s+(?:the\s+)?[\w\s]+(?:policy|terms|agreement)",
)



def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokenize(text) -> Column:
    """Lower-case, split on (Unicode) whitespace, drop empties: the maximal
    runs of non-whitespace (one regex pass, no per-element lambda)."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(r"(?U)\S+"), 0)


def word_set(text) -> Column:
    return F.array_distinct(tokenize(text))


def redact(text, with_ip: bool = False) -> Column:
    """EMAIL -> PHONE -> CREDIT_CARD -> SSN replacement; null and '' unchanged."""
    out = _c(text)
    steps = REDACTIONS + ((IP_REDACTION,) if with_ip else ())
    for _, pat, repl in steps:
        out = F.regexp_replace(out, F.lit("(?U)" + pat), F.lit(repl))
    return out


def redaction_counts(text, with_ip: bool = True) -> Column:
    """Struct with the number of replacements each redaction step makes,
    counted on the text as it is when that step runs."""
    cur = _c(text)
    fields = []
    steps = REDACTIONS + ((IP_REDACTION,) if with_ip else ())
    for name, pat, repl in steps:
        p = F.lit("(?U)" + pat)
        fields.append(F.coalesce(F.regexp_count(cur, p), F.lit(0)).cast("bigint").alias(name.lower()))
        cur = F.regexp_replace(cur, p, F.lit(repl))
    return F.struct(*fields)


def fingerprint(content, n: int) -> Column:
    return F.substring(_c(content), 1, n)


def reference_phrases(text) -> Column:
    """First match of each cross-reference pattern (nulls dropped)."""
    matches = [F.regexp_extract(_c(text), "(?iU)(" + p + ")", 1) for p in REFERENCE_PATTERNS]
    return F.filter(F.array(*matches), lambda m: m != "")


def reference_words(text) -> Column:
    """Distinct lower-cased words of the matched reference phrases."""
    return F.array_distinct(F.flatten(F.transform(reference_phrases(text), tokenize)))
