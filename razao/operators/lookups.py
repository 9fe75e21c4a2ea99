"""Name lookups and the small joins of the screens.

No side is broadcast by hint: Spark compares the measured size with its broadcast threshold,
and sorts or hashes both sides beyond it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from razao.operators.filters import period_open


def lookup(
    rows: DataFrame,
    names: DataFrame,
    key: str,
    names_key: str,
    value: str,
    alias: str,
    default: str | None = None,
) -> DataFrame:
    """Left join of one name column, with a default text for ids without a name."""
    side = names.select(F.col(names_key).alias(key), F.col(value).alias(alias))
    joined = rows.join(side, key, "left")
    return joined if default is None else joined.withColumn(alias, F.coalesce(alias, F.lit(default)))


def account_movement_join(accounts: DataFrame, transactions: DataFrame) -> DataFrame:
    """Accounts with or without movement; the movement is counted before the join."""
    counts = transactions.groupBy("bank_account_id").agg(F.count("*").alias("entry_count"))
    entries = F.coalesce("entry_count", F.lit(0).cast("bigint"))
    return (
        accounts.join(counts, "bank_account_id", "left")
        .withColumn("entry_count", entries)
        .withColumn("has_movement", F.col("entry_count") > 0)
    )


def settlement_join(invoices: DataFrame, settlements: DataFrame) -> DataFrame:
    """Invoices with the number and last day of their settlements."""
    per_invoice = settlements.groupBy(F.col("invoice_id").alias("id")).agg(
        F.count("*").alias("settlements"),
        F.max("created_at").cast("date").alias("last_settlement"),
    )
    return invoices.join(per_invoice, "id", "left").withColumn(
        "settlements", F.coalesce("settlements", F.lit(0).cast("bigint"))
    )


def memo_backfill(transactions: DataFrame, lines: DataFrame) -> DataFrame:
    """The bank's memo for a transaction, through the line matched to it."""
    memos = lines.where(F.col("matched_transaction_id").isNotNull()).select(
        F.col("matched_transaction_id").alias("id"), F.col("memo").alias("bank_memo")
    )
    return transactions.join(memos, "id", "left")


def has_settlement(transactions: DataFrame, settlements: DataFrame) -> DataFrame:
    """Transactions that settled an invoice."""
    used = settlements.select(F.col("transaction_id").alias("id"))
    return transactions.join(used, "id", "left_semi")


def unswept_credits(transactions: DataFrame, settlements: DataFrame) -> DataFrame:
    """Realised credits without any settlement."""
    used = settlements.select(F.col("transaction_id").alias("id"))
    credits = transactions.where((F.col("status") == "realizado") & (F.col("amount") > 0))
    return credits.join(used, "id", "left_anti")


def open_month_children(children: DataFrame, transactions: DataFrame, closings: DataFrame) -> DataFrame:
    """Rows whose parent transaction lies in an open month (what an attachment may change)."""
    writable = period_open(transactions.select("id", "company_id", "booking_date"), closings)
    return children.join(
        writable.select(F.col("id").alias("transaction_id")), "transaction_id", "left_semi"
    )


def credit_tax_id(credits: DataFrame, counterparties: DataFrame, text: str = "description") -> DataFrame:
    """Payer document: the linked counterparty's, else the one printed in the text."""
    from razao.functions.text import extract_tax_id

    known = counterparties.where(F.col("tax_id").isNotNull()).select(
        F.col("id").alias("counterparty_id"), F.col("tax_id").alias("_linked")
    )
    return (
        credits.join(known, "counterparty_id", "left")
        .withColumn("payer_tax_id", F.coalesce("_linked", extract_tax_id(F.col(text))))
        .drop("_linked")
    )


def last_import(imports: DataFrame) -> DataFrame:
    """Newest import of each company."""
    newest = F.max(F.struct("created_at", "id", "bank_account_id", "source")).alias("n")
    return imports.groupBy("company_id").agg(newest).select(
        "company_id", "n.id", "n.created_at", "n.bank_account_id", "n.source"
    )


def compare_sources(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Multiset difference of two readings: keys whose row counts differ."""
    one = left.groupBy(*keys).agg(F.count("*").alias("left_count"))
    two = right.groupBy(*keys).agg(F.count("*").alias("right_count"))
    zero = F.lit(0).cast("bigint")
    return (
        one.join(two, keys, "full_outer")
        .withColumns(
            {"left_count": F.coalesce("left_count", zero), "right_count": F.coalesce("right_count", zero)}
        )
        .where(F.col("left_count") != F.col("right_count"))
    )


def orphans(
    children: DataFrame, parents: DataFrame, child_key: str, parent_key: str = "id"
) -> DataFrame:
    """Children whose parent is missing or belongs to another company."""
    owners = parents.select(F.col(parent_key).alias(child_key), "company_id")
    return children.where(F.col(child_key).isNotNull()).join(
        owners, [child_key, "company_id"], "left_anti"
    )
