"""Constraints of the store as violation reports: (rule, table, id, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from razao.operators.balances import transfer_check
from razao.operators.filters import with_period_lock
from razao.operators.lookups import orphans
from razao.schema import LINE_IGNORED, LINE_MATCHED


def _report(rows: DataFrame, rule: str, table: str, identifier: Column | str = "id", detail=None) -> DataFrame:
    key = F.col(identifier) if isinstance(identifier, str) else identifier
    return rows.select(
        F.lit(rule).alias("rule"),
        F.lit(table).alias("table_name"),
        key.cast("string").alias("row_id"),
        (F.lit(None) if detail is None else detail).cast("string").alias("detail"),
    )


def union_reports(*reports: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, reports)


def before_opening(transactions: DataFrame, accounts: DataFrame) -> DataFrame:
    """Movement the opening balance already contains."""
    dates = accounts.select("bank_account_id", "opening_balance_date")
    rows = transactions.join(dates, "bank_account_id").where(
        F.col("booking_date") < F.col("opening_balance_date")
    )
    return _report(rows, "before_opening", "transactions", detail=F.col("opening_balance_date"))


def category_direction(transactions: DataFrame, categories: DataFrame) -> DataFrame:
    """Rows whose sign the category's kind does not accept."""
    kinds = categories.select(F.col("id").alias("category_id"), "kind")
    rows = transactions.join(kinds, "category_id").where(
        (F.col("kind") != "ambos") & (F.col("kind") != F.col("direction"))
    )
    return _report(rows, "category_direction", "transactions", detail=F.col("kind"))


def transfer_group(transactions: DataFrame) -> DataFrame:
    """Broken transfer groups, and transfers with a category."""
    groups = transfer_check(transactions)
    categorised = transactions.where(F.col("is_transfer") & F.col("category_id").isNotNull())
    return _report(groups, "transfer_group", "transactions", "transfer_group_id", F.col("legs")).unionByName(
        _report(categorised, "transfer_category", "transactions")
    )


def nonzero(rows: DataFrame, table: str, positive: bool = False) -> DataFrame:
    bad = F.col("amount") <= 0 if positive else F.col("amount") == 0
    return _report(rows.where(bad), "amount", table, detail=F.col("amount"))


def not_unique(rows: DataFrame, table: str, keys: list[str | Column]) -> DataFrame:
    """Key values held by more than one row; rows with a null in the key are exempt.

    A count per key reduces on the map side, so one value shared by very many rows is one
    row per task in the shuffle.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    keyed = rows.select(
        *[(F.col(k) if isinstance(k, str) else k).alias(n) for k, n in zip(keys, names, strict=True)]
    )
    full = reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in names])
    groups = keyed.where(full).groupBy(*names).agg(F.count("*").alias("_n")).where("_n > 1")
    shown = F.concat_ws("|", *[F.col(n).cast("string") for n in names])
    return _report(groups, "unique", table, shown, F.col("_n"))


def tax_id(rows: DataFrame, table: str, pattern: str, column: str = "tax_id", key: str = "id") -> DataFrame:
    bad = rows.where(F.col(column).isNotNull() & ~F.col(column).rlike(pattern))
    return _report(bad, "tax_id", table, key, F.col(column))


def same_company(children: DataFrame, parents: DataFrame, child_key: str, table: str, parent_key: str = "id") -> DataFrame:
    return _report(orphans(children, parents, child_key, parent_key), "same_company", table, detail=F.col(child_key))


def line_state(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """Matched lines need a transaction, ignored ones a reason, rules must set something."""
    matched = lines.where((F.col("status") == LINE_MATCHED) & F.col("matched_transaction_id").isNull())
    reason = F.trim(F.coalesce("ignored_reason", F.lit("")))
    ignored = lines.where((F.col("status") == LINE_IGNORED) & (reason == ""))
    idle = rules.where(
        F.coalesce("category_id", "counterparty_id", "cost_center_id").isNull()
    )
    return union_reports(
        _report(matched, "line_without_transaction", "statement_lines"),
        _report(ignored, "ignored_without_reason", "statement_lines"),
        _report(idle, "rule_sets_nothing", "matching_rules"),
    )


def period(closings: DataFrame, recurrences: DataFrame) -> DataFrame:
    reason = F.trim(F.coalesce("reopen_reason", F.lit("")))
    return union_reports(
        _report(closings.where(F.dayofmonth("period") != 1), "period_first_day", "monthly_closings"),
        _report(
            closings.where(F.col("reopened_at").isNotNull() & (reason == "")),
            "reopened_without_reason",
            "monthly_closings",
        ),
        _report(recurrences.where(F.col("end_date") < F.col("start_date")), "ends_before_start", "recurrences"),
        _report(recurrences.where(~F.col("day_of_month").between(1, 31)), "day_of_month", "recurrences"),
    )


def not_blank(rows: DataFrame, table: str, column: str, key: str = "id") -> DataFrame:
    bad = rows.where(F.trim(F.coalesce(column, F.lit(""))) == "")
    return _report(bad, "blank", table, key, F.lit(column))


def locked_change(before: DataFrame, after: DataFrame, closings: DataFrame) -> DataFrame:
    """Transactions that changed although their old or new month is closed."""
    columns = [c for c in before.columns if c != "id"]
    old = before.select("id", "company_id", "booking_date", F.struct(*columns).alias("old"))
    new = after.select("id", "company_id", "booking_date", F.struct(*columns).alias("new"))
    old = with_period_lock(old, closings, flag="old_locked").drop("company_id", "booking_date")
    new = with_period_lock(new, closings, flag="new_locked").drop("company_id", "booking_date")
    changed = old.join(new, "id", "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
    side = F.concat_ws("+", F.when(F.col("old_locked"), "old"), F.when(F.col("new_locked"), "new"))
    return _report(changed.where(side != ""), "locked_change", "transactions", detail=side)
