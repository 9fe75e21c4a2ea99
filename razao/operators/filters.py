"""Row filters, visibility and per-row state. All of them stay in the scan's stage or become
semi joins; none of them changes the number of columns read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from razao.functions.dates import day, iso_date, month_start
from razao.schema import LINE_PENDING, NOT_RECONCILED, PLANNED, REALIZED, ROLE_RANK

TOTAL = "total"


def in_scope(scope: str) -> Column:
    """``realizado`` keeps what happened; ``total`` keeps planned rows too."""
    return F.lit(True) if scope == TOTAL else F.col("status") == REALIZED


def scope_filter(transactions: DataFrame, scope: str = REALIZED) -> DataFrame:
    return transactions.where(in_scope(scope))


def opening_cutoff(transactions: DataFrame, accounts: DataFrame) -> DataFrame:
    """Drop movement the opening balance already contains."""
    dates = accounts.select("bank_account_id", "opening_balance_date")
    return (
        transactions.join(dates, "bank_account_id")
        .where(F.col("booking_date") >= F.col("opening_balance_date"))
        .drop("opening_balance_date")
    )


def month_filter(rows: DataFrame, month, column: str = "booking_date") -> DataFrame:
    """Half-open month range on the plain column, so partitions and row groups are pruned."""
    start = month_start(day(month))
    return rows.where((F.col(column) >= start) & (F.col(column) < F.add_months(start, 1)))


def period_bounds(first: str | None, last: str | None, today: str) -> tuple[Column, Column]:
    """Report bounds from page parameters; invalid text falls back to month start and today."""
    start = F.coalesce(iso_date(F.lit(first)), month_start(day(today)))
    return start, F.coalesce(iso_date(F.lit(last)), day(today))


def period_filter(rows: DataFrame, first, last, today, column: str = "booking_date") -> DataFrame:
    start, end = period_bounds(first, last, today)
    return rows.where(F.col(column).between(start, end))


def pending_lines(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("status") == LINE_PENDING)


def unreconciled(transactions: DataFrame) -> DataFrame:
    return transactions.where(
        (F.col("status") == REALIZED) & (F.col("reconciliation") == NOT_RECONCILED)
    )


def active_only(rows: DataFrame, include_inactive: bool = False) -> DataFrame:
    return rows if include_inactive else rows.where("is_active")


def locked_periods(closings: DataFrame) -> DataFrame:
    """(company_id, period) of the months that accept no write."""
    return closings.where(F.col("locked_at").isNotNull()).select("company_id", "period").distinct()


def period_locked(rows: DataFrame, closings: DataFrame, column: str = "booking_date") -> DataFrame:
    """Rows whose month is closed."""
    keyed = rows.withColumn("period", month_start(F.col(column)))
    return keyed.join(locked_periods(closings), ["company_id", "period"], "left_semi").drop("period")


def period_open(rows: DataFrame, closings: DataFrame, column: str = "booking_date") -> DataFrame:
    keyed = rows.withColumn("period", month_start(F.col(column)))
    return keyed.join(locked_periods(closings), ["company_id", "period"], "left_anti").drop("period")


def with_period_lock(
    rows: DataFrame, closings: DataFrame, column: str = "booking_date", flag: str = "period_locked"
) -> DataFrame:
    """Add a boolean: the month of ``column`` is closed for the row's company."""
    marks = locked_periods(closings).select(
        "company_id", F.col("period").alias("_period"), F.lit(True).alias("_locked")
    )
    return (
        rows.withColumn("_period", month_start(F.col(column)))
        .join(marks, ["company_id", "_period"], "left")
        .withColumn(flag, F.coalesce("_locked", F.lit(False)))
        .drop("_period", "_locked")
    )


def tenant_visibility(rows: DataFrame, memberships: DataFrame, user_id) -> DataFrame:
    """Rows of the companies the user belongs to."""
    mine = memberships.where(F.col("user_id") == user_id).select("company_id").distinct()
    return rows.join(mine, "company_id", "left_semi")


def role_rank(role: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for pair in ROLE_RANK.items() for x in pair])
    return F.try_element_at(ranks, role)


def role_filter(rows: DataFrame, memberships: DataFrame, user_id, minimum: str) -> DataFrame:
    """Rows of the companies where the user has at least the role ``minimum``."""
    enough = memberships.where(role_rank(F.col("role")) >= ROLE_RANK[minimum])
    return tenant_visibility(rows, enough, user_id)


def lens_union(profile_accounts: DataFrame, profiles: list) -> DataFrame:
    """Distinct accounts of the chosen profiles; unknown ids add nothing."""
    return profile_accounts.where(F.col("profile_id").isin(profiles)).select(
        "bank_account_id"
    ).distinct()


def account_lens(
    rows: DataFrame, profile_accounts: DataFrame, profiles: list, account=None
) -> DataFrame:
    """Rows of the chosen profiles' accounts.

    One chosen account wins over the lens. When no chosen profile exists the lens means "all":
    the semi join is combined with that test in the plan, so no action decides it.
    """
    if account is not None:
        return rows.where(F.col("bank_account_id") == account)
    if not profiles:
        return rows
    chosen = lens_union(profile_accounts, profiles)
    # One row: does any chosen profile exist? A scalar, so its broadcast has a fixed size.
    any_valid = chosen.agg(F.count("*").alias("_valid")).select(F.col("_valid") > 0)
    marked = rows.join(
        chosen.withColumn("_in", F.lit(True)), "bank_account_id", "left"
    ).withColumn("_any", any_valid.scalar())
    return marked.where(F.col("_in").isNotNull() | ~F.col("_any")).drop("_in", "_any")


def not_transfer(transactions: DataFrame) -> DataFrame:
    return transactions.where(~F.col("is_transfer"))


def overdue_planned(transactions: DataFrame, as_of) -> DataFrame:
    """Planned rows due before today; a row due today is not overdue."""
    return transactions.where((F.col("status") == PLANNED) & (F.col("booking_date") < day(as_of)))


# Fixed value: days after issue from which an open invoice counts as overdue.
INVOICE_OVERDUE_DAYS = 45


def is_invoice_overdue(issued_on: Column, outstanding: Column, as_of) -> Column:
    return (outstanding > 0) & (F.datediff(day(as_of), issued_on) >= INVOICE_OVERDUE_DAYS)


def can_close_month(period: Column, as_of) -> Column:
    """A month can be closed once it is over."""
    return F.last_day(period) < day(as_of)


def transaction_state(
    transactions: DataFrame, settlements: DataFrame, closings: DataFrame
) -> DataFrame:
    """The five flags that decide what may change on a transaction."""
    settled = settlements.select(
        F.col("transaction_id").alias("id"), F.lit(True).alias("_settled")
    ).distinct()
    return (
        with_period_lock(transactions, closings)
        .join(settled, "id", "left")
        .withColumn("reconciled", F.col("reconciliation") == "conciliado")
        .withColumn("has_settlement", F.coalesce("_settled", F.lit(False)))
        .drop("_settled")
    )


# Lock reasons, and the fields each one locks.
LOCKS = {
    "is_transfer": ("transferencia", ("amount", "booking_date", "bank_account_id", "category_id")),
    "reconciled": ("conciliado", ("amount", "booking_date", "bank_account_id")),
    "has_settlement": ("baixaDeNota", ("amount",)),
    "period_locked": (
        "mesFechado",
        ("amount", "booking_date", "bank_account_id", "category_id", "competence_date", "text"),
    ),
}
EDITABLE_FIELDS = LOCKS["period_locked"][1]


def lock_reasons(field: str) -> Column:
    """Why ``field`` is locked: an array of reasons, empty when it may be edited."""
    reasons = [
        F.when(F.col(flag), F.lit(reason)) for flag, (reason, fields) in LOCKS.items() if field in fields
    ]
    return F.array_compact(F.array(*reasons))


def edit_locks(state: DataFrame) -> DataFrame:
    return state.select("*", *[lock_reasons(f).alias(f"lock_{f}") for f in EDITABLE_FIELDS])


def can_settle() -> Column:
    return (F.col("status") == PLANNED) & ~F.col("is_transfer") & ~F.col("period_locked")


def can_unsettle() -> Column:
    return (
        (F.col("status") == REALIZED)
        & ~F.col("reconciled")
        & ~F.col("has_settlement")
        & ~F.col("is_transfer")
        & ~F.col("period_locked")
    )
