"""Orders and top-k per company.

Full orders are range sorts over the whole result, never one window per company. Top-k uses ``row_number() <= k``: Spark keeps only k rows per group in each task before the
shuffle, so a company with most of the rows still sends k rows per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from razao.functions.dates import day, month_start
from razao.functions.text import natural_key


def ranked(rows: DataFrame, keys: list[str], order: list[Column], name: str = "place") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def top_k(rows: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "place") -> DataFrame:
    return ranked(rows, keys, order, name).where(F.col(name) <= k)


def ledger_order() -> list[Column]:
    """Newest first; the id settles rows created at the same instant."""
    return [F.desc("booking_date"), F.desc("created_at"), F.desc("id")]


def capped_list(
    rows: DataFrame, order: list[Column], cap: int, key: str = "company_id"
) -> DataFrame:
    """The first ``cap`` rows per company, and whether the cap was reached."""
    sizes = rows.groupBy(key).agg((F.count("*") >= cap).alias("cap_reached"))
    return top_k(rows, [key], order, cap).join(sizes, key)


def next_due(planned: DataFrame, first, last, k: int) -> DataFrame:
    """The first planned rows of each company inside the horizon."""
    inside = planned.where(
        (F.col("status") == "previsto") & F.col("booking_date").between(day(first), day(last))
    )
    return top_k(inside, ["company_id"], [F.asc("booking_date"), F.asc("id")], k)


def divergence_order(found: DataFrame) -> DataFrame:
    """By account, day, then amount, bank side first: a range sort, which splits any account."""
    side = F.when(F.col("kind") == "missing_in_system", 0).otherwise(1)
    return found.orderBy("bank_account_id", "date", "amount", side, "source_id")


def natural_order(column: str) -> list[Column]:
    """Text with digit runs compared by value: 9 before 10."""
    return [natural_key(F.col(column)).asc(), F.col(column).asc()]


def portfolio_order() -> list[Column]:
    """Companies that need attention first, then by name in Portuguese order."""
    return [F.desc("attention_score"), F.collate(F.col("name"), "pt").asc(), F.asc("company_id")]


def closing_calendar(companies: DataFrame, closings: DataFrame, as_of, months: int) -> DataFrame:
    """The last months of each company, newest first, also those without a closing."""
    last = month_start(day(as_of))
    spine = companies.select(
        "company_id",
        F.explode(F.sequence(F.add_months(last, 1 - months), last, F.expr("interval 1 month"))).alias(
            "period"
        ),
    )
    state = F.when(F.col("locked_at").isNotNull(), "fechado").when(
        F.col("reopened_at").isNotNull(), "reaberto"
    ).otherwise("aberto")
    return (
        spine.join(closings.drop("id"), ["company_id", "period"], "left")
        .withColumn("state", state)
        .orderBy("company_id", F.desc("period"))
    )


def chronological(lines: DataFrame) -> DataFrame:
    """Statement lines by day; lines of one day keep their place in the file."""
    return ranked(lines, ["file"], [F.asc("posted_at"), F.asc("line_no")])


def settlements_by_invoice(settlements: DataFrame) -> DataFrame:
    """Settlements of each invoice as one list, newest invoice first.

    An invoice has the few settlements that add up to its amount; the list holds those.
    """
    item = F.struct(F.col("created_at"), F.col("id"), F.col("transaction_id"), F.col("amount"))
    return (
        settlements.groupBy("invoice_id")
        .agg(
            F.sort_array(F.collect_list(item), asc=False).alias("settlements"),
            F.max("created_at").alias("last_settlement"),
            F.sum("amount").alias("total"),
        )
        .orderBy(F.desc("last_settlement"), "invoice_id")
    )
