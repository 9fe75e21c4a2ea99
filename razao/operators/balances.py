"""Balances and grouped views.

A balance is opening balance plus movement; it is never stored. Every operator here first
reduces the transactions to one row per account, day and status with a partial aggregate on
the map side. The shuffle is keyed by account *and* day, so an account that holds a third of
all rows is spread over its days, and everything after it works on at most one row per day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from razao.functions.dates import day, month_start
from razao.functions.money import safe_sum, sum_when
from razao.operators.filters import in_scope, is_invoice_overdue, not_transfer
from razao.schema import NOT_RECONCILED, PLANNED, REALIZED


def daily_movement(transactions: DataFrame) -> DataFrame:
    """Net, inflow, outflow and count per company, account, day and status.

    Inflow and outflow are null when the day has none.
    """
    amount = F.col("amount")
    return transactions.groupBy("company_id", "bank_account_id", "booking_date", "status").agg(
        F.sum(amount).alias("net_amount"),
        F.sum(F.when(amount > 0, amount)).alias("inflow"),
        F.sum(F.when(amount < 0, amount)).alias("outflow"),
        F.count("*").alias("entry_count"),
    )


def _daily_net(transactions: DataFrame) -> DataFrame:
    return transactions.groupBy("bank_account_id", "booking_date", "status").agg(
        F.sum("amount").alias("net"),
        F.sum((F.col("reconciliation") == NOT_RECONCILED).cast("bigint")).alias("unreconciled"),
    )


def account_balances(accounts: DataFrame, transactions: DataFrame, as_of) -> DataFrame:
    """Current, realised and projected balance, overdue amount and open reconciliations.

    Every movement counts, also movement before the opening date (see ``dq_before_opening``).
    """
    realized = F.col("status") == REALIZED
    net = F.col("amount")
    waiting = (F.col("reconciliation") == NOT_RECONCILED).cast("bigint")
    # No date differs by account here, so the map-side sums leave one row per account and task.
    per_account = transactions.groupBy("bank_account_id").agg(
        F.sum(F.when(realized & (F.col("booking_date") <= day(as_of)), net)).alias("_current"),
        F.sum(F.when(realized, net)).alias("_realized"),
        F.sum(net).alias("_all"),
        F.sum(
            F.when((F.col("status") == PLANNED) & (F.col("booking_date") < day(as_of)), net)
        ).alias("_overdue"),
        F.sum(F.when(realized, waiting)).alias("_unreconciled"),
    )
    zero = F.lit(0).cast("bigint")
    opening = F.col("opening_balance")
    return accounts.join(per_account, "bank_account_id", "left").select(
        "bank_account_id",
        "company_id",
        "name",
        "kind",
        "is_active",
        "opening_balance",
        "opening_balance_date",
        "minimum_balance",
        (opening + F.coalesce("_current", zero)).alias("current_balance"),
        (opening + F.coalesce("_realized", zero)).alias("realized_balance"),
        (opening + F.coalesce("_all", zero)).alias("projected_balance"),
        F.coalesce("_overdue", zero).alias("overdue_amount"),
        F.coalesce("_unreconciled", zero).alias("unreconciled_count"),
    )


def _movement_since_opening(accounts: DataFrame, transactions: DataFrame, *sums) -> DataFrame:
    """Accounts with sums over the daily movement on or after the opening date."""
    opening = accounts.select("bank_account_id", "opening_balance_date")
    per_account = (
        _daily_net(transactions)
        .join(opening, "bank_account_id")
        .where(F.col("booking_date") >= F.col("opening_balance_date"))
        .groupBy("bank_account_id")
        .agg(*sums)
    )
    return accounts.join(per_account, "bank_account_id", "left")


def balance_on(
    accounts: DataFrame, transactions: DataFrame, date, scope: str = REALIZED
) -> DataFrame:
    """Balance of every account at the end of ``date``; 0 before its opening date."""
    moved = F.sum(F.when(in_scope(scope) & (F.col("booking_date") <= day(date)), F.col("net")))
    zero = F.lit(0).cast("bigint")
    return _movement_since_opening(accounts, transactions, moved.alias("_moved")).select(
        "bank_account_id",
        "company_id",
        F.when(F.col("opening_balance_date") > day(date), zero)
        .otherwise(F.col("opening_balance") + F.coalesce("_moved", zero))
        .alias("balance"),
    )


def current_balance(accounts: DataFrame, transactions: DataFrame) -> DataFrame:
    """Balances with no date cut: realised only, and with planned rows."""
    zero = F.lit(0).cast("bigint")
    sums = (
        F.sum(F.when(in_scope(REALIZED), F.col("net"))).alias("_realized"),
        F.sum("net").alias("_total"),
    )
    return _movement_since_opening(accounts, transactions, *sums).select(
        "bank_account_id",
        "company_id",
        (F.col("opening_balance") + F.coalesce("_realized", zero)).alias("current"),
        (F.col("opening_balance") + F.coalesce("_total", zero)).alias("projected"),
    )


def consolidate(accounts: DataFrame, transactions: DataFrame) -> DataFrame:
    """Per-account balances and their company totals (``bank_account_id`` null)."""
    return (
        current_balance(accounts, transactions)
        .rollup("company_id", "bank_account_id")
        .agg(F.sum("current").alias("current"), F.sum("projected").alias("projected"))
        .where(F.col("company_id").isNotNull())
    )


def newest_declarations(imports: DataFrame) -> DataFrame:
    """Per account the import whose declared balance has the latest date, then the latest import."""
    fields = ("statement_balance_date", "created_at", "id", "statement_balance")
    return (
        imports.where(
            F.col("statement_balance").isNotNull() & F.col("statement_balance_date").isNotNull()
        )
        .groupBy("bank_account_id")
        .agg(F.max(F.struct(*fields)).alias("d"))
        .select("bank_account_id", *[F.col(f"d.{f}").alias(f) for f in fields])
    )


def latest_declared_balance(imports: DataFrame) -> DataFrame:
    """Per account the balance with the latest date, then the latest import.

    A late upload of an old statement does not replace a newer declaration.
    """
    return newest_declarations(imports).select(
        "bank_account_id",
        F.col("statement_balance").alias("declared_balance"),
        F.col("statement_balance_date").alias("declared_date"),
    )


def check_balance(accounts: DataFrame, transactions: DataFrame, declared: DataFrame) -> DataFrame:
    """Computed minus declared balance at the declared date of each account."""
    zero = F.lit(0).cast("bigint")
    terms = accounts.join(declared, "bank_account_id").select(
        "bank_account_id",
        "company_id",
        "opening_balance",
        "opening_balance_date",
        "declared_balance",
        "declared_date",
    )
    moved = (
        _daily_net(transactions.where(in_scope(REALIZED)))
        .join(
            terms.select("bank_account_id", "opening_balance_date", "declared_date"),
            "bank_account_id",
        )
        .where(F.col("booking_date").between(F.col("opening_balance_date"), F.col("declared_date")))
        .groupBy("bank_account_id")
        .agg(F.sum("net").alias("_moved"))
    )
    computed = F.when(F.col("declared_date") < F.col("opening_balance_date"), zero).otherwise(
        F.col("opening_balance") + F.coalesce("_moved", zero)
    )
    return (
        terms.join(moved, "bank_account_id", "left")
        .withColumn("computed_balance", computed)
        .select(
            "bank_account_id",
            "company_id",
            "declared_balance",
            "declared_date",
            "computed_balance",
            (F.col("computed_balance") - F.col("declared_balance")).alias("diff"),
        )
    )


def balance_proof(accounts: DataFrame, transactions: DataFrame, imports: DataFrame) -> DataFrame:
    return check_balance(accounts, transactions, latest_declared_balance(imports))


# A company's accounts are dealt to so many tasks where they meet its months.
COMPANY_SALTS = 64


def closing_snapshot(accounts: DataFrame, transactions: DataFrame, periods: DataFrame) -> DataFrame:
    """Balance of every account at each closed month end of its company.

    ``periods`` holds (closing_id, company_id, period). The movement is first summed per
    account and month, then accumulated, so the result does not multiply transactions by
    months. An account opened later keeps its opening balance here.
    """
    monthly = (
        transactions.where(in_scope(REALIZED))
        .groupBy("bank_account_id", month_start(F.col("booking_date")).alias("period"))
        .agg(F.sum("amount").alias("net"))
    )
    # Each wanted month end is a row without movement among its account's months, so the running
    # sum reaches it where it stands and nothing is joined back.
    # The few months of a company are repeated for each salt, so a large company is spread over tasks.
    salts = F.explode(F.sequence(F.lit(0), F.lit(COMPANY_SALTS - 1))).alias("_salt")
    marks = (
        accounts.select(
            "bank_account_id", "company_id", "opening_balance",
            F.pmod(F.xxhash64("bank_account_id"), F.lit(COMPANY_SALTS)).cast("int").alias("_salt"),
        )
        .join(periods.select("closing_id", "company_id", "period", salts), ["company_id", "_salt"])
        .select(
            "bank_account_id", "period", F.lit(0).cast("bigint").alias("net"),
            F.lit(True).alias("_wanted"), "closing_id", "opening_balance",
        )
    )
    through = W.partitionBy("bank_account_id").orderBy("period").rangeBetween(
        W.unboundedPreceding, W.currentRow
    )
    return (
        monthly.unionByName(marks, allowMissingColumns=True)
        .withColumn("moved", F.sum("net").over(through))
        .where("_wanted")
        .select(
            "closing_id",
            "bank_account_id",
            (F.col("opening_balance") + F.col("moved")).alias("closing_balance"),
        )
    )


def category_summary(transactions: DataFrame, categories: DataFrame) -> DataFrame:
    """Totals per cash month, accrual month, category, direction and status.

    The transactions are summed before the category name is joined.
    """
    sums = (
        not_transfer(transactions)
        .groupBy(
            "company_id",
            month_start(F.col("booking_date")).alias("period_cash"),
            month_start(F.col("competence_date")).alias("period_accrual"),
            "category_id",
            "direction",
            "status",
        )
        .agg(F.sum("amount").alias("total_amount"), F.count("*").alias("entry_count"))
    )
    names = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category_name"))
    return sums.join(names, "category_id", "left")


def category_report(
    transactions: DataFrame, categories: DataFrame, month, accrual: bool = False
) -> DataFrame:
    """Realised totals of one month on a cash or accrual basis, with the side's total.

    The other month column stays in the key, so a category can have several rows.
    """
    basis = "period_accrual" if accrual else "period_cash"
    rows = category_summary(transactions, categories).where(
        (F.col(basis) == month_start(day(month))) & (F.col("status") == REALIZED)
    )
    side = rows.groupBy("company_id", "direction").agg(F.sum("total_amount").alias("side_total"))
    return rows.join(side, ["company_id", "direction"])


def month_totals(transactions: DataFrame, as_of) -> DataFrame:
    """Realised inflow and outflow of the month to date, without transfers."""
    amount = F.col("amount")
    return (
        not_transfer(transactions)
        .where(
            in_scope(REALIZED)
            & F.col("booking_date").between(month_start(day(as_of)), day(as_of))
        )
        .groupBy("company_id")
        .agg(
            sum_when(amount > 0, amount).alias("inflow"),
            sum_when(amount < 0, amount).alias("outflow"),
        )
    )


def invoice_balances(invoices: DataFrame, settlements: DataFrame) -> DataFrame:
    """Received and outstanding per invoice; withheld tax does not reduce the outstanding."""
    received = settlements.groupBy(F.col("invoice_id").alias("id")).agg(
        F.sum("amount").alias("_received")
    )
    paid = F.coalesce("_received", F.lit(0).cast("bigint"))
    return (
        invoices.join(received, "id", "left")
        .withColumn("received_amount", paid)
        .withColumn("outstanding_amount", F.col("amount") - paid)
        .drop("_received")
    )


def open_invoices(balances: DataFrame, exclude_cancelled: bool = False) -> DataFrame:
    """Invoices with something outstanding; cancelled ones stay unless excluded."""
    rows = balances.where(F.col("outstanding_amount") > 0)
    return rows.where(F.col("status") != "cancelada") if exclude_cancelled else rows


def accounts_receivable(balances: DataFrame) -> DataFrame:
    return open_invoices(balances).groupBy("company_id").agg(
        F.sum("outstanding_amount").alias("receivable")
    )


def invoice_totals(balances: DataFrame, as_of) -> DataFrame:
    """Billed, received, outstanding and overdue count per company."""
    late = is_invoice_overdue(F.col("issued_on"), F.col("outstanding_amount"), as_of)
    return balances.groupBy("company_id").agg(
        F.sum("amount").alias("billed"),
        F.sum("received_amount").alias("received"),
        F.sum("outstanding_amount").alias("outstanding"),
        F.sum(late.cast("bigint")).alias("overdue_count"),
    )


def planned_split(transactions: DataFrame, as_of) -> DataFrame:
    """Planned rows in four buckets: overdue or upcoming, in or out."""
    overdue = F.col("booking_date") < day(as_of)
    amount = F.col("amount")
    cells = []
    for when, late in (("overdue", overdue), ("upcoming", ~overdue)):
        for side, test in (("in", amount > 0), ("out", amount <= 0)):
            cells.append(sum_when(late & test, amount).alias(f"{when}_{side}"))
            cells.append(F.sum((late & test).cast("bigint")).alias(f"{when}_{side}_count"))
    return transactions.where(F.col("status") == PLANNED).groupBy("company_id").agg(*cells)


def category_usage(transactions: DataFrame) -> DataFrame:
    """Rows per category and direction: what a change of kind would orphan."""
    return (
        transactions.where(F.col("category_id").isNotNull())
        .groupBy("company_id", "category_id", "direction")
        .agg(F.count("*").alias("uses"))
    )


def earliest_booking(transactions: DataFrame) -> DataFrame:
    """First movement of each account: an opening date must not lie after it."""
    return transactions.groupBy("company_id", "bank_account_id").agg(
        F.min("booking_date").alias("first_booking")
    )


def transfer_check(transactions: DataFrame) -> DataFrame:
    """Transfer groups that are not two rows on two accounts summing to zero.

    A group key is shared by two rows, so nothing here can grow hot; the distinct accounts
    are told from their minimum and maximum, which aggregates on the map side.
    """
    groups = (
        transactions.where(F.col("transfer_group_id").isNotNull())
        .groupBy("transfer_group_id")
        .agg(
            F.count("*").alias("legs"),
            F.sum("amount").alias("total"),
            F.min("bank_account_id").alias("_low"),
            F.max("bank_account_id").alias("_high"),
        )
    )
    return groups.where(
        (F.col("legs") != 2) | (F.col("total") != 0) | (F.col("_low") == F.col("_high"))
    ).select(
        "transfer_group_id",
        "legs",
        "total",
        (F.col("_low") == F.col("_high")).alias("same_account"),
    )


def total_movement(transactions: DataFrame) -> DataFrame:
    """Range-checked totals per company."""
    return transactions.groupBy("company_id").agg(safe_sum(F.col("amount")).alias("total"))
