"""Recurring templates expanded to planned rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from razao.functions.dates import day, days_in_month

# Days of a weekly and a biweekly step, months of a monthly and a yearly one.
DAY_STEPS = {"semanal": 7, "quinzenal": 14}
MONTH_STEPS = {"mensal": 1, "anual": 12}
# Months after which the shortest month has certainly been visited (a common February).
VISITED = 48


def _monthly_date(k: Column) -> Column:
    """The k-th occurrence of a monthly or yearly template.

    With a fixed day it comes back after a short month. Without one the day sticks: it is the
    least of the start day and the lengths of all months visited, which is settled after four
    years of months, so no occurrence depends on the row before it.
    """
    start = F.col("start_date")
    step = F.when(F.col("frequency") == "anual", 12).otherwise(1)
    month = F.add_months(F.trunc(start, "MM"), (k * step).cast("int"))
    shortest = F.array_min(
        F.transform(
            F.sequence(F.lit(1), F.least(F.greatest(k, F.lit(1)), F.lit(VISITED)).cast("int")),
            lambda j: days_in_month(F.add_months(F.trunc(start, "MM"), (j * step).cast("int"))),
        )
    )
    fixed = F.when(
        F.col("day_of_month").isNotNull(), F.least(F.col("day_of_month"), days_in_month(month))
    )
    sticky = F.least(F.dayofmonth(start), shortest)
    return F.when(k == 0, start).otherwise(F.date_add(month, F.coalesce(fixed, sticky) - 1))


def expand_recurrences(recurrences: DataFrame, first, last) -> DataFrame:
    """Occurrences of each template inside [first, last], both of which may be columns.

    Steps before the window are skipped by arithmetic, so an old template costs no more than
    a new one.
    """
    start, frequency = F.col("start_date"), F.col("frequency")
    limit = F.least(day(last), F.coalesce("end_date", day(last)))
    days = F.when(frequency == "semanal", 7).otherwise(14)
    months = F.when(frequency == "anual", 12).otherwise(1)
    by_day = frequency.isin(*DAY_STEPS)

    def steps(date: Column, slack: int) -> Column:
        whole = F.when(by_day, F.floor(F.datediff(date, start) / days)).otherwise(
            F.floor(F.months_between(F.trunc(date, "MM"), F.trunc(start, "MM")) / months)
        )
        return F.greatest(whole + slack, F.lit(0)).cast("int")

    low, high = steps(day(first), -1), steps(limit, 1)
    k = F.col("_k")
    date = F.when(by_day, F.date_add(start, (k * days).cast("int"))).otherwise(_monthly_date(k))
    return (
        recurrences.where(start <= limit)
        .withColumn("_first", day(first))
        .withColumn("_limit", limit)
        .withColumn("_k", F.explode(F.sequence(low, high)))
        .withColumn("booking_date", date)
        .where(F.col("booking_date").between(F.col("_first"), F.col("_limit")))
        .drop("_k", "_first", "_limit")
    )


def generate_planned(
    recurrences: DataFrame, transactions: DataFrame, as_of
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Planned rows to add, occurrences that already exist, and the advanced templates.

    Active templates run from the day after ``generated_until`` to the end of next month. A
    date that already has a row of the template is skipped.
    """
    horizon = F.last_day(F.add_months(F.trunc(day(as_of), "MM"), 1))
    begin = F.coalesce(F.date_add("generated_until", 1), F.col("start_date"))
    due = recurrences.where(
        F.col("is_active") & (F.col("start_date") <= horizon) & (begin <= horizon)
    )
    planned = expand_recurrences(due, begin, horizon).withColumnRenamed("id", "recurrence_id")
    existing = transactions.where(F.col("recurrence_id").isNotNull()).select(
        "recurrence_id", "booking_date"
    )
    keys = ["recurrence_id", "booking_date"]
    rows = (
        planned.join(existing, keys, "left_anti")
        .withColumn("competence_date", F.col("booking_date"))
        .withColumn("status", F.lit("previsto"))
    )
    advanced = recurrences.join(due.select("id", F.lit(True).alias("_due")), "id", "left").withColumn(
        "generated_until",
        F.when(F.col("_due"), F.least(F.coalesce("end_date", horizon), horizon)).otherwise(
            F.col("generated_until")
        ),
    ).drop("_due")
    return rows, planned.join(existing, keys, "left_semi"), advanced
