"""Output tables: transactions, settlements, run information."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import MONEY


def bank_projection(txns: DataFrame) -> DataFrame:
    """H1-H4: the transaction table. Card amounts are turned to the view of cash, raw text stays on flagged rows.

    ``txns``: source, institution, doc_account, block_name, is_credit_card, date, description,
    amount, balance, status, note, raw.
    """
    amount = F.when(F.col("is_credit_card"), -F.col("amount")).otherwise(F.col("amount")).cast(MONEY)
    own = F.lower(F.coalesce("block_name", F.lit(""))).rlike("^(beginning|balance)") | (F.coalesce("block_name", F.lit("")) == "")
    return txns.select(
        "source", "institution", F.when(own, F.coalesce("doc_account", F.lit(""))).otherwise(F.col("block_name")).alias("account"), "date",
        F.substring("description", 1, 500).alias("description"),
        F.when(amount.isNull(), "").when(amount >= 0, "Credit").otherwise("Debit").alias("type"), amount.alias("amount"), "balance", "status",
        "note", F.when(F.col("status") != "OK", F.substring("raw", 1, 500)).alias("raw"),
    )


def settlement_projection(rows: DataFrame, *keys: str) -> DataFrame:
    """H5: the settlement table; raw text stays on flagged rows. ``keys``: columns that lead."""
    return rows.select(
        *keys, "section", "job", "customer", "type", F.substring("description", 1, 400).alias("description"), "amount", "status", "note",
        F.when(F.col("status") != "OK", F.substring("raw", 1, 400)).alias("raw"),
    )


def run_info(outcomes: DataFrame, facts: DataFrame) -> DataFrame:
    """One row a document: profile, confidence, method, OCR confidence, pages, rows, rows to review and verdict.

    ``outcomes``: as from flow.statement_outcomes or route.settlement_outcomes; ``facts``: as from route.run_facts.
    """
    return outcomes.join(facts, "doc_id", "left").select(
        "doc_id", "profile", "confidence", "method", "ocr_confidence", "pages", "rows", F.col("flagged").alias("to_review"), "state", "verdict", "detail"
    )
