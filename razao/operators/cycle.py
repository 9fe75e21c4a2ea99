"""The monthly cycle of an accounting office: working month, coverage, steps, status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from razao.functions.dates import day, month_start
from razao.operators.balances import account_balances, balance_proof, invoice_balances
from razao.operators.filters import can_close_month, is_invoice_overdue, locked_periods
from razao.schema import LINE_PENDING


def working_month(accounts: DataFrame, closings: DataFrame, as_of) -> DataFrame:
    """The previous month until it is closed, then the current one.

    Never before the month of the earliest opening date of an active account.
    """
    current = month_start(day(as_of))
    previous = F.add_months(current, -1)
    first = accounts.where("is_active").groupBy("company_id").agg(
        F.min("opening_balance_date").alias("_first")
    )
    closed = locked_periods(closings).where(F.col("period") == previous).select(
        "company_id", F.lit(True).alias("_closed")
    )
    month = F.when(
        (previous < month_start(F.col("_first"))) | F.col("_closed").isNotNull(), current
    ).otherwise(previous)
    return (
        accounts.select("company_id")
        .distinct()
        .join(first, "company_id", "left")
        .join(closed, "company_id", "left")
        .select("company_id", month.alias("working_month"))
    )


def statement_coverage(accounts: DataFrame, imports: DataFrame, periods: DataFrame) -> DataFrame:
    """Accounts whose imported statements reach the month end, and those that are missing.

    ``periods`` has (company_id, period). Accounts opened after the month owe no statement.
    """
    reach = imports.groupBy("bank_account_id").agg(F.max("period_end").alias("_reach"))
    end = F.last_day("period")
    return (
        accounts.join(periods, "company_id")
        .where(F.col("opening_balance_date") <= end)
        .join(reach, "bank_account_id", "left")
        .select(
            "company_id",
            "bank_account_id",
            "period",
            F.coalesce(F.col("_reach") >= end, F.lit(False)).alias("covered"),
        )
    )


def line_counts(lines: DataFrame) -> DataFrame:
    """Lines per company and status, without reading any other column."""
    return lines.groupBy("company_id", "status").agg(F.count("*").alias("lines"))


def _per_company(df: DataFrame, value, name: str) -> DataFrame:
    return df.groupBy("company_id").agg(value.alias(name))


def close_steps(
    accounts: DataFrame,
    transactions: DataFrame,
    lines: DataFrame,
    imports: DataFrame,
    invoices: DataFrame,
    settlements: DataFrame,
    closings: DataFrame,
    as_of,
) -> DataFrame:
    """The five steps of the working month per company, and the first one not done."""
    months = working_month(accounts, closings, as_of)
    active = accounts.where("is_active")
    coverage = statement_coverage(
        active, imports, months.withColumnRenamed("working_month", "period")
    )
    missing = _per_company(coverage, F.sum((~F.col("covered")).cast("bigint")), "statement_count")
    pending = _per_company(
        lines.where(F.col("status") == LINE_PENDING), F.count("*"), "review_count"
    )
    late = is_invoice_overdue(F.col("issued_on"), F.col("outstanding_amount"), as_of)
    overdue = _per_company(
        invoice_balances(invoices, settlements).where(late), F.count("*"), "invoice_count"
    )
    open_entries = _per_company(
        account_balances(accounts, transactions, as_of), F.sum("unreconciled_count"), "check_count"
    )
    wrong = _per_company(
        balance_proof(active, transactions, imports), F.max(F.col("diff") != 0), "balance_differs"
    )
    locked = locked_periods(closings).select(
        "company_id", F.col("period").alias("working_month"), F.lit(True).alias("_locked")
    )
    rows = months
    for part in (missing, pending, overdue, open_entries, wrong):
        rows = rows.join(part, "company_id", "left")
    rows = rows.join(locked, ["company_id", "working_month"], "left")
    counts = ("statement_count", "review_count", "invoice_count", "check_count")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in counts})
    done = {
        "statement_done": F.col("statement_count") == 0,
        "review_done": F.col("review_count") == 0,
        "invoice_done": F.col("invoice_count") == 0,
        "check_done": (F.col("check_count") == 0)
        & ~F.coalesce("balance_differs", F.lit(False)),
        "close_done": F.col("_locked").isNotNull()
        | ~can_close_month(F.col("working_month"), as_of),
    }
    rows = rows.withColumns(done)
    # Step names in their order.
    steps = zip(done, ("extrato", "revisar", "notas", "conferir", "fechar"), strict=True)
    current = F.coalesce(*[F.when(~F.col(flag), F.lit(name)) for flag, name in steps])
    return rows.select("company_id", "working_month", *counts, *done, current.alias("current_step"))


def portfolio_status(
    accounts: DataFrame,
    transactions: DataFrame,
    lines: DataFrame,
    imports: DataFrame,
    invoices: DataFrame,
    settlements: DataFrame,
    closings: DataFrame,
    as_of,
) -> DataFrame:
    """One row per company with accounts: balance, open work, receivables, month state.

    An account counts as covered here when anything was imported for it this month.
    """
    start = month_start(day(as_of))
    balances = (
        account_balances(accounts, transactions, as_of)
        .groupBy("company_id")
        .agg(
            F.sum("current_balance").alias("current_balance"),
            F.sum(F.col("is_active").cast("bigint")).alias("active_accounts"),
            F.sum("unreconciled_count").alias("unreconciled"),
        )
    )
    imported = (
        imports.where(F.col("created_at") >= start)
        .select("company_id", "bank_account_id")
        .distinct()
        .groupBy("company_id")
        .agg(F.count("*").alias("imported_accounts"))
    )
    pending = _per_company(
        lines.where(F.col("status") == LINE_PENDING), F.count("*"), "pending_lines"
    )
    late = is_invoice_overdue(F.col("issued_on"), F.col("outstanding_amount"), as_of)
    receivables = (
        invoice_balances(invoices, settlements)
        .where(F.col("outstanding_amount") > 0)
        .groupBy("company_id")
        .agg(
            F.sum(late.cast("bigint")).alias("overdue_invoices"),
            F.sum("outstanding_amount").alias("receivable"),
        )
    )
    closed = locked_periods(closings).where(F.col("period") == start).select(
        "company_id", F.lit(True).alias("month_closed")
    )
    rows = balances
    for part in (imported, pending, receivables, closed):
        rows = rows.join(part, "company_id", "left")
    zero = F.lit(0).cast("bigint")
    names = ("imported_accounts", "pending_lines", "overdue_invoices", "receivable")
    return rows.withColumns(
        {n: F.coalesce(n, zero) for n in names}
        | {"month_closed": F.coalesce("month_closed", F.lit(False))}
    )


def with_attention_score(status: DataFrame) -> DataFrame:
    """0 to 4: pending lines, unreconciled entries, overdue invoices, missing statements."""
    missing = (F.col("active_accounts") > 0) & (
        F.col("imported_accounts") < F.col("active_accounts")
    )
    tests = (
        F.col("pending_lines") > 0,
        F.col("unreconciled") > 0,
        F.col("overdue_invoices") > 0,
        missing,
    )
    score = sum((test.cast("int") for test in tests), F.lit(0))
    return status.withColumn("attention_score", score)
