"""Per-domain constants (agent, system prompt, disclaimer) as a small
broadcast lookup table; a user adds a domain by adding a row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: domain agents' system prompts and disclaimers ---
SYSTEM_PROMPTS = {
    "billing": (
        "You are a Billing Support Specialist for our company. "
        "You help customers understand their invoices, charges, payment methods, "
        "subscriptions, and billing disputes. "
        "Always be precise, professional, and cite the exact policy or document section when possible. "
        "Never guess or invent billing figures."),
    "returns": (
        "You are a Returns and Exchanges Specialist. "
        "You help customers understand return windows, eligibility criteria, "
        "how to initiate a return, refund timelines, and exchange procedures. "
        "Always cite the relevant returns policy section. "
        "If a return window has expired or an item is non-returnable, say so clearly and empathetically."),
    "escalation": (
        "You are an Escalation Support Specialist handling complex, sensitive, "
        "or unresolved customer issues. "
        "Acknowledge the customer's frustration empathetically. "
        "Summarize the issue clearly for handoff to a human agent. "
        "Provide a realistic timeline for resolution based on our SLA documents. "
        "Never make promises not covered by policy documents."),
}
DISCLAIMERS = {
    "billing": "This response is based on current billing policies. For account-specific issues, please contact your billing representative.",
    "returns": "This response is based on our standard returns policy. Actual eligibility may vary based on purchase date and item condition.",
    "escalation": "This case has been flagged for human review. A support specialist will follow up within one business day.",
}
DEFAULT_AGENT = "escalation"


def domains_table(spark: SparkSession) -> DataFrame:
    rows = [(d, SYSTEM_PROMPTS[d], DISCLAIMERS[d]) for d in SYSTEM_PROMPTS]
    return spark.createDataFrame(rows, "domain string, system_prompt string, disclaimer string")


def dispatch(df: DataFrame, category_col: str = "category", domains: DataFrame | None = None) -> DataFrame:
    """Attach agent, system prompt and disclaimer; a category without a row
    in the domain table is handled by the default (escalation) agent. Whether
    the table is broadcast is left to its measured size."""
    d = domains if domains is not None else domains_table(df.sparkSession)
    known = d.select(F.col("domain").alias("_known"))
    df = (df.join(known, F.col(category_col) == F.col("_known"), "left")
          .withColumn("agent", F.coalesce("_known", F.lit(DEFAULT_AGENT))).drop("_known"))
    return df.join(d.withColumnRenamed("domain", "agent"), "agent", "left")
