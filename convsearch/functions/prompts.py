"""Prompt templates as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: prompt templates ---
ANSWER_RULES = ("Use ONLY the following documents to answer. Do not hallucinate.\n"
                "If the answer is not in the documents, say 'I don't have enough information.'\n\n")
ANSWER_FORMAT = ("Respond in EXACTLY this two-line format, nothing else:\n"
                 "ANSWER: <your answer to the customer>\n"
                 "CONFIDENCE: <single number 0.0-1.0 rating how well the documents support your answer>")
ROUTER_PROMPT_HEAD = (
    "You are a customer support query classifier.\n"
    "Classify the customer query into EXACTLY one of these categories: billing, returns, escalation.\n\n"
    "Category definitions:\n"
    "- billing: questions about invoices, charges, payments, subscriptions, refunds, pricing\n"
    "- returns: questions about returning products, exchanges, return eligibility, return status\n"
    "- escalation: complaints, unresolved issues, requests to speak with a manager, urgent problems\n\n"
    "Respond with ONLY valid JSON in this exact format (no other text):\n"
    '{"category": "<billing|returns|escalation>", "confidence": <float 0.0-1.0>}\n\n'
    "Customer Query: ")
RATING_PROMPT_HEAD = ("Given the following context and answer, rate the answer's accuracy and groundedness "
                      "on a scale from 0.0 to 1.0 (1.0 = perfectly grounded, 0.0 = completely unsupported).\n\n"
                      "Context:\n")
RATING_PROMPT_TAIL = "\n\nRespond with ONLY a single number between 0.0 and 1.0."


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def answer_prompt(system_prompt, history_text, context, query) -> Column:
    h = F.coalesce(_c(history_text), F.lit(""))
    block = F.when(h != "", F.concat(F.lit("\nConversation History:\n"), h, F.lit("\n"))).otherwise(F.lit(""))
    return F.concat(_c(system_prompt), F.lit("\n"), block, F.lit("\n"), F.lit(ANSWER_RULES),
                    F.lit("Documents:\n"), _c(context), F.lit("\n\nCustomer Query: "), _c(query),
                    F.lit("\n\n"), F.lit(ANSWER_FORMAT))


def router_prompt(query) -> Column:
    return F.concat(F.lit(ROUTER_PROMPT_HEAD), _c(query))


def rating_prompt(answer, context) -> Column:
    return F.concat(F.lit(RATING_PROMPT_HEAD), F.substring(_c(context), 1, 800), F.lit("\n\nAnswer:\n"),
                    F.substring(_c(answer), 1, 400), F.lit(RATING_PROMPT_TAIL))
