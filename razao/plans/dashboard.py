"""Dashboard of all companies: balances, projection and alerts in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from razao.functions.dates import day
from razao.operators.balances import account_balances
from razao.operators.series import project, projection_summary
from razao.schema import PLANNED


def company_projection(
    accounts: DataFrame, transactions: DataFrame, as_of, days: int = 30
) -> DataFrame:
    """Projection from today's balance of every company over its planned rows."""
    openings = (
        account_balances(accounts, transactions, as_of)
        .groupBy("company_id")
        .agg(F.sum("current_balance").alias("opening_balance"))
        .withColumn("minimum_balance", F.lit(None).cast("bigint"))
    )
    planned = transactions.where(F.col("status") == PLANNED)
    return project(openings, planned, as_of, F.date_add(day(as_of), days))


def cash_alert(accounts: DataFrame, transactions: DataFrame, as_of, days: int = 30) -> DataFrame:
    """Companies whose balance turns negative within the horizon, when and how deep."""
    summary = projection_summary(company_projection(accounts, transactions, as_of, days))
    return summary.where(F.col("first_negative_date").isNotNull()).select(
        "company_id", "first_negative_date", "lowest_balance"
    )
