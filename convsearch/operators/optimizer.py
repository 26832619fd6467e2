"""Prompt-variant optimisation over low-confidence traffic.

Inputs: the first n low-confidence records among today's last ``tail``
audit records. Each input is paired with every variant by exploding a
literal array (no join); completions are an input table (a model run is
not part of the engine); answers are scored with the heuristic below and the
variant with the best mean wins (first declared on ties)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..sources.audit import audit_tail

# --- fixed values: prompt variants (declared order matters for ties) ---
PROMPT_VARIANTS = (
    ("precise",
     "You are a precise customer support agent. Answer using ONLY the provided documents. "
     "Quote the exact policy section when applicable. Be concise and factual."),
    ("empathetic",
     "You are a warm and empathetic customer support agent. Acknowledge the customer's concern, "
     "then answer using ONLY the provided documents. Use clear, simple language."),
    ("structured",
     "You are a structured customer support agent. Answer in this format:\n"
     "1. Direct Answer\n2. Policy Reference\n3. Next Steps\n"
     "Use ONLY the provided documents."),
)
PLACEHOLDER_CONTEXT = "Sample context for optimization."
IDK_PHRASE = "i don't have enough information"


def optimizer_inputs(audit: DataFrame, today, tail: int = C.OPTIMIZER_TAIL,
                     n: int = C.OPTIMIZER_SAMPLES) -> DataFrame:
    t = audit_tail(audit, today, tail).filter(F.coalesce("low_confidence_flag", F.lit(False)))
    w = Window.partitionBy("date").orderBy("pos")
    return (t.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= n)
            .select("rank", "audit_id", F.coalesce("redacted_query", F.lit("")).alias("query")))


def variants_column():
    return F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(name).alias("variant"), F.lit(p).alias("system_prompt"))
                     for i, (name, p) in enumerate(PROMPT_VARIANTS)])


def variant_prompts(inputs: DataFrame, context: str = PLACEHOLDER_CONTEXT) -> DataFrame:
    """One prompt per (input, variant): system prompt, the first 1000
    characters of the context, the query."""
    e = inputs.select("*", F.explode(variants_column()).alias("v"))
    prompt = F.concat(F.col("v.system_prompt"), F.lit("\n\nDocuments:\n"), F.substring(F.lit(context), 1, 1000),
                      F.lit("\n\nQuery: "), F.col("query"), F.lit("\n\nAnswer:"))
    return e.select("rank", "audit_id", F.col("v.ord").alias("ord"), F.col("v.variant").alias("variant"),
                    prompt.alias("prompt"))


def answer_score(answer) -> F.Column:
    """IDK phrase -> 0.3; shorter than 50 -> 0.4; else min(1, len/500);
    failed call (null) -> 0.0."""
    c = F.col(answer) if isinstance(answer, str) else answer
    a = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    n = F.char_length(a)
    return (F.when(c.isNull(), F.lit(0.0))
            .when(F.contains(F.lower(a), F.lit(IDK_PHRASE)), F.lit(0.3))
            .when(n < 50, F.lit(0.4))
            .otherwise(F.least(F.lit(1.0), n / 500.0)))


def variant_scores(prompts: DataFrame, completions: DataFrame) -> DataFrame:
    """prompts ⋈ completions(audit_id, variant, completion) (left: a missing
    completion is a failed call)."""
    j = prompts.join(completions, ["audit_id", "variant"], "left")
    return j.select("rank", "audit_id", "ord", "variant", answer_score("completion").alias("score"))


def variant_winner(scores: DataFrame) -> DataFrame:
    """Mean score per variant (4 places) and the winner."""
    m = scores.groupBy("ord", "variant").agg(F.round(F.avg("score"), 4).alias("score"),
                                            F.count(F.lit(1)).alias("samples"))
    w = Window.orderBy(F.col("score").desc(), F.col("ord").asc())
    return m.withColumn("best", F.row_number().over(w) == 1)


def optimizer_report(scores: DataFrame) -> DataFrame:
    """The report as one row: scores (variant -> mean), best_variant,
    best_prompt and samples_tested. Without a sample there is no row."""
    m = variant_winner(scores)
    prompts = F.create_map(*[x for name, text in PROMPT_VARIANTS for x in (F.lit(name), F.lit(text))])
    best = F.max_by("variant", F.col("best"))
    return (m.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("variant", "score")))).alias("scores"), best.alias("best_variant"),
                  F.max("samples").alias("samples_tested"))
            .filter("best_variant is not null")
            .select("scores", "best_variant", F.element_at(prompts, F.col("best_variant")).alias("best_prompt"), "samples_tested"))
