"""Gap-free daily series: ledgers, projections and what is read off them.

Movement is summed to one row per key and day before any window, and the spine is cut to the
report window, so a window partition holds at most one row per day of the report, however
many transactions an account or company has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from razao.functions.dates import day, is_business_day, month_start
from razao.operators.filters import in_scope, not_transfer
from razao.schema import PLANNED, REALIZED


def date_spine(rows: DataFrame, first: Column, last: Column, name: str = "date") -> DataFrame:
    """One row per day from ``first`` to ``last``; none where first is after last."""
    days = F.when(first <= last, F.sequence(first, last, F.expr("interval 1 day")))
    return rows.withColumn(name, F.explode(days))


def _running(df: DataFrame, keys: list[str], value: str, order: str = "date") -> Column:
    window = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return F.sum(value).over(window)


def daily_balances(
    accounts: DataFrame, transactions: DataFrame, first, last, scope: str = REALIZED
) -> DataFrame:
    """Gap-free ledger per account, from the later of ``first`` and the opening date.

    All movement before the start lands on the eve, so the first row starts from the right
    balance with one aggregate instead of a separate lookup.
    """
    start = F.greatest(day(first), F.col("opening_balance_date"))
    opening = accounts.select(
        "bank_account_id", "company_id", "opening_balance", "opening_balance_date"
    ).withColumn("start", start)
    amount = F.col("amount")
    daily = (
        transactions.where(in_scope(scope) & (F.col("booking_date") <= day(last)))
        .groupBy("bank_account_id", "booking_date")
        .agg(
            F.sum(F.when(amount > 0, amount)).alias("inflow"),
            F.sum(F.when(amount < 0, amount)).alias("outflow"),
            F.sum(amount).alias("net"),
            F.count("*").alias("entry_count"),
        )
        .join(opening.select("bank_account_id", "opening_balance_date", "start"), "bank_account_id")
        .where(F.col("booking_date") >= F.col("opening_balance_date"))
        .withColumn("date", F.greatest("booking_date", F.date_sub("start", 1)))
        .groupBy("bank_account_id", "date")
        .agg(*[F.sum(c).alias(c) for c in ("inflow", "outflow", "net", "entry_count")])
    )
    spine = date_spine(
        opening.where(F.col("start") <= day(last)), F.date_sub("start", 1), day(last)
    )
    zero = F.lit(0).cast("bigint")
    filled = spine.join(daily, ["bank_account_id", "date"], "left").withColumn(
        "net", F.coalesce("net", zero)
    )
    return (
        filled.withColumn(
            "balance", F.col("opening_balance") + _running(filled, ["bank_account_id"], "net")
        )
        .where(F.col("date") >= F.col("start"))
        .select(
            "company_id",
            "bank_account_id",
            "date",
            F.coalesce("inflow", zero).alias("inflow"),
            F.coalesce("outflow", zero).alias("outflow"),
            "net",
            "balance",
            F.coalesce("entry_count", zero).alias("entry_count"),
        )
    )


def project(
    openings: DataFrame, entries: DataFrame, first, last, keys: list[str] | None = None
) -> DataFrame:
    """Daily projected balance per key.

    ``openings`` has the keys, ``opening_balance`` and ``minimum_balance`` (null means 0);
    ``entries`` the keys, booking_date, amount and status. Overdue planned rows enter on the
    first day; realised rows before it are ignored; realised rows inside the window count.
    Bounds may be columns of ``openings``.
    """
    keys = keys or ["company_id"]
    bounds = openings.withColumns({"_first": day(first), "_last": day(last)}).select(
        *keys, "opening_balance", "minimum_balance", "_first", "_last"
    )
    amount = F.col("amount")
    overdue = (F.col("status") == PLANNED) & (F.col("booking_date") < F.col("_first"))
    daily = (
        entries.groupBy(*keys, "booking_date", "status")
        .agg(
            F.sum(F.when(amount > 0, amount)).alias("inflow"),
            F.sum(F.when(amount < 0, amount)).alias("outflow"),
        )
        .join(bounds.select(*keys, "_first", "_last"), keys)
        .where((F.col("booking_date") <= F.col("_last")) & (overdue | (F.col("booking_date") >= F.col("_first"))))
        .withColumn("date", F.greatest("booking_date", "_first"))
        .withColumn("net", F.coalesce("inflow", F.lit(0)) + F.coalesce("outflow", F.lit(0)))
        .groupBy(*keys, "date")
        .agg(
            F.sum("inflow").alias("inflow"),
            F.sum("outflow").alias("outflow"),
            F.sum(F.when(overdue, F.col("net"))).alias("overdue"),
        )
    )
    zero = F.lit(0).cast("bigint")
    filled = (
        date_spine(bounds, F.col("_first"), F.col("_last"))
        .join(daily, [*keys, "date"], "left")
        .withColumns(
            {
                "inflow": F.coalesce("inflow", zero),
                "outflow": F.coalesce("outflow", zero),
                "overdue_brought_forward": F.coalesce("overdue", zero),
            }
        )
        .withColumn("net", F.col("inflow") + F.col("outflow"))
    )
    balance = F.col("opening_balance") + _running(filled, keys, "net")
    return (
        filled.withColumn("balance", balance)
        .withColumns(
            {
                "is_business_day": is_business_day(F.col("date")),
                "below_minimum": F.col("balance") < F.coalesce("minimum_balance", zero),
                "negative": F.col("balance") < 0,
            }
        )
        .select(
            *keys,
            "date",
            "is_business_day",
            "inflow",
            "outflow",
            "net",
            "balance",
            "overdue_brought_forward",
            "below_minimum",
            "negative",
        )
    )


def projection_summary(days: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Final and lowest balance, first warning days and totals of a projection."""
    date, balance = F.col("date"), F.col("balance")
    return (
        days.groupBy(*(keys or ["company_id"]))
        .agg(
            F.max_by(balance, date).alias("final_balance"),
            F.min(F.struct(balance, date)).alias("_low"),
            F.min(F.when(F.col("negative"), date)).alias("first_negative_date"),
            F.min(F.when(F.col("below_minimum"), date)).alias("first_below_minimum_date"),
            F.sum("inflow").alias("total_inflow"),
            F.sum("outflow").alias("total_outflow"),
            F.sum("overdue_brought_forward").alias("overdue_brought_forward"),
        )
        .withColumn("lowest_balance", F.col("_low.balance"))
        .withColumn("lowest_balance_date", F.col("_low.date"))
        .drop("_low")
    )


def project_horizon(
    openings: DataFrame, entries: DataFrame, first, horizons: tuple[int, ...] = (30, 60, 90)
) -> DataFrame:
    """Summaries at D+30, D+60 and D+90 from one projection of the longest horizon.

    The shorter windows are prefixes of the longest one, so the entries are read once.
    """
    longest = project(openings, entries, day(first), F.date_add(day(first), max(horizons)))
    marks = F.array(*[F.lit(h) for h in sorted(horizons)])
    fanned = longest.withColumn("horizon", F.explode(marks)).where(
        F.col("date") <= F.date_add(day(first), F.col("horizon"))
    )
    return projection_summary(fanned, ["company_id", "horizon"])


def company_openings(accounts: DataFrame, transactions: DataFrame, first) -> DataFrame:
    """Opening balances plus realised movement before ``first``, per company.

    The full opening balance counts, also of accounts opened inside or after the window.
    """
    before = (
        transactions.where(in_scope(REALIZED) & (F.col("booking_date") < day(first)))
        .join(accounts.select("bank_account_id"), "bank_account_id", "left_semi")
        .groupBy("company_id")
        .agg(F.sum("amount").alias("_moved"))
    )
    return (
        accounts.groupBy("company_id")
        .agg(F.sum("opening_balance").alias("_opening"))
        .join(before, "company_id", "left")
        .select(
            "company_id",
            (F.col("_opening") + F.coalesce("_moved", F.lit(0))).alias("opening_balance"),
            F.lit(None).cast("bigint").alias("minimum_balance"),
        )
    )


def cash_flow_report(accounts: DataFrame, transactions: DataFrame, first, last) -> DataFrame:
    """Historic daily flow of the accounts in scope; transfers stay and cancel out."""
    inside = transactions.where(
        in_scope(REALIZED) & F.col("booking_date").between(day(first), day(last))
    ).join(accounts.select("bank_account_id"), "bank_account_id", "left_semi")
    return project(company_openings(accounts, transactions, first), inside, first, last)


def monthly_evolution(
    accounts: DataFrame, transactions: DataFrame, as_of, months: int
) -> DataFrame:
    """The last months: inflow, outflow, result and balance at month end (today for the current).

    Active accounts only, transfers left out of the flow. Works on one row per company and
    month, without a daily spine: a month-end balance is the running sum of the months.
    """
    start = F.add_months(month_start(day(as_of)), 1 - months)
    active = accounts.where("is_active")
    amount = F.col("amount")
    monthly = (
        not_transfer(transactions)
        .where(in_scope(REALIZED) & F.col("booking_date").between(start, day(as_of)))
        .join(active.select("bank_account_id"), "bank_account_id", "left_semi")
        .groupBy("company_id", month_start(F.col("booking_date")).alias("month"))
        .agg(
            F.sum(F.when(amount > 0, amount)).alias("inflow"),
            F.sum(F.when(amount < 0, amount)).alias("outflow"),
        )
    )
    openings = company_openings(active, transactions, start)
    spine = openings.withColumn(
        "month",
        F.explode(F.sequence(start, month_start(day(as_of)), F.expr("interval 1 month"))),
    )
    zero = F.lit(0).cast("bigint")
    filled = spine.join(monthly, ["company_id", "month"], "left").withColumns(
        {"inflow": F.coalesce("inflow", zero), "outflow": F.coalesce("outflow", zero)}
    ).withColumn("result", F.col("inflow") + F.col("outflow"))
    return filled.select(
        "company_id",
        "month",
        "inflow",
        "outflow",
        "result",
        (F.col("opening_balance") + _running(filled, ["company_id"], "result", "month")).alias(
            "balance"
        ),
    )


def daily_statement_check(
    lines: DataFrame, openings: DataFrame, declared: DataFrame
) -> DataFrame:
    """Running balance of each file against the day balances the bank printed.

    ``lines`` (file, posted_at, amount), ``openings`` (file, opening_balance), ``declared``
    (file, date, balance). A file is bounded by the import gate; the window runs on its days.
    """
    daily = lines.groupBy("file", F.col("posted_at").alias("date")).agg(
        F.sum("amount").alias("net")
    )
    running = daily.join(openings, "file").withColumn(
        "computed", F.col("opening_balance") + _running(daily, ["file"], "net")
    )
    return running.join(declared, ["file", "date"]).select(
        "file",
        "date",
        F.col("balance").alias("declared"),
        "computed",
        (F.col("balance") == F.col("computed")).alias("ok"),
    )


def first_divergence(checks: DataFrame) -> DataFrame:
    """Per file the first day on which reading and bank disagree."""
    return checks.where(~F.col("ok")).groupBy("file").agg(
        F.min("date").alias("first_divergent_day"), F.count("*").alias("divergent_days")
    )


def heading_carry_forward(rows: DataFrame) -> DataFrame:
    """Give each row the day of the last heading above it in its file.

    ``rows`` (file, page, position, heading_day): heading rows carry a day, the others null.
    """
    above = W.partitionBy("file").orderBy("page", "position").rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("day", F.last("heading_day", ignorenulls=True).over(above))
