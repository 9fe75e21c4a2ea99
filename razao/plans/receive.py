"""Receivables of all companies: settle what is certain, list the rest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from razao.operators.balances import invoice_balances, open_invoices
from razao.operators.decisions import settle_invoices
from razao.operators.lookups import credit_tax_id, unswept_credits
from razao.operators.receivables import match_receivables, settlement_requests


@dataclass(frozen=True)
class ReceivablesResult:
    """Exact matches as judged settlements; proposals; credits without any invoice."""

    settlements: DataFrame
    suggested: DataFrame
    unmatched: DataFrame


def receivable_inputs(
    transactions: DataFrame, invoices: DataFrame, settlements: DataFrame, counterparties: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Credits nothing was allocated from yet, with the payer's tax id, and open invoices."""
    credits = credit_tax_id(unswept_credits(transactions, settlements), counterparties)
    balances = open_invoices(invoice_balances(invoices, settlements))
    return credits, balances.withColumnRenamed("outstanding_amount", "outstanding")


def auto_apply_receivables(
    transactions: DataFrame,
    invoices: DataFrame,
    settlements: DataFrame,
    counterparties: DataFrame,
    closings: DataFrame,
    requested_at,
) -> ReceivablesResult:
    """Match, settle the exact ones, and return everything a person still decides."""
    credits, open_ones = receivable_inputs(transactions, invoices, settlements, counterparties)
    matches = match_receivables(credits, open_ones)
    asked = settlement_requests(matches, open_ones).withColumn("requested_at", requested_at)
    judged = settle_invoices(asked, transactions, invoices, settlements, closings)
    return ReceivablesResult(
        settlements=judged,
        suggested=matches.where(F.col("confidence") == "likely"),
        unmatched=matches.where(F.col("confidence") == "none"),
    )
