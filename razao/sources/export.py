"""The cash-flow report as a CSV a spreadsheet opens directly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from razao.functions.dates import format_date
from razao.functions.money import format_amount

# Report titles.
TITLES = {"date": "Data", "inflow": "Entradas", "outflow": "Saidas", "net": "Liquido", "balance": "Saldo"}


def cash_flow_text(days: DataFrame) -> DataFrame:
    """Report columns as text: dd/mm/yyyy and pt-BR numbers."""
    return days.select(
        "company_id",
        "date",
        format_date(F.col("date")).alias("Data"),
        *[format_amount(F.col(c)).alias(title) for c, title in TITLES.items() if c != "date"],
    )


def export_cash_flow(days: DataFrame, path: str) -> None:
    """Write one folder per company: ``;``, CRLF, a header, and a byte order mark.

    The mark goes in front of the first title, where a spreadsheet looks for it. Rows are
    clustered by company before the write, so each company becomes one ordered file; a
    company's report has one row per day, however many transactions it sums.
    """
    text = cash_flow_text(days).repartition("company_id").sortWithinPartitions("company_id", "date")
    titled = text.drop("date").withColumnRenamed("Data", "\ufeffData")
    (
        titled.write.mode("overwrite")
        .partitionBy("company_id")
        .csv(path, sep=";", header=True, lineSep="\r\n", quoteAll=False)
    )
