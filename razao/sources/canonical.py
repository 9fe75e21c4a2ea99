"""What all readers share: one line shape, totals, spans, counts and integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from razao.functions.text import is_truncated_name, normalize_text
from razao.operators.imports import composite_base

CANONICAL = (
    "file", "line_no", "posted_at", "amount", "memo", "fitid", "check_number",
    "counterparty_name", "counterparty_document", "name_truncated", "dedup_key",
)


def canonical_lines(*readers: tuple[str, DataFrame]) -> DataFrame:
    """(source, lines) of several readers as one table."""
    parts = [lines.select(F.lit(source).alias("source"), *CANONICAL) for source, lines in readers]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def statement_span(lines: DataFrame) -> DataFrame:
    """First and last posted day per file."""
    return lines.groupBy("file").agg(
        F.min("posted_at").alias("period_start"), F.max("posted_at").alias("period_end")
    )


def statement_integrity(headers: DataFrame, lines: DataFrame) -> DataFrame:
    """Totals read from a file, and the opening balance its closing balance implies."""
    amount = F.col("amount")
    totals = lines.groupBy("file").agg(
        F.sum(F.when(amount > 0, amount)).alias("_in"), F.sum(F.when(amount < 0, -amount)).alias("_out")
    )
    zero = F.lit(0).cast("bigint")
    return headers.join(totals, "file", "left").select(
        "file",
        F.coalesce("_in", zero).alias("computed_inflow"),
        F.coalesce("_out", zero).alias("computed_outflow"),
        F.col("ledger_balance").alias("declared_closing"),
        (F.col("ledger_balance") - F.coalesce("_in", zero) + F.coalesce("_out", zero)).alias(
            "implied_opening"
        ),
    )


def declared_totals_check(lines: DataFrame, declared: DataFrame) -> DataFrame:
    """Totals and closing balance a bank declares against the lines read.

    ``declared`` (file, declared_opening, declared_inflow, declared_outflow,
    declared_closing); a null declaration checks nothing.
    """
    amount = F.col("amount")
    totals = lines.groupBy("file").agg(
        F.coalesce(F.sum(F.when(amount > 0, amount)), F.lit(0)).alias("computed_inflow"),
        F.coalesce(F.sum(F.when(amount < 0, -amount)), F.lit(0)).alias("computed_outflow"),
    )

    def agrees(one: str, other) -> Column:
        return F.coalesce(F.col(one) == other, F.lit(True))

    closing = F.col("declared_opening") + F.col("computed_inflow") - F.col("computed_outflow")
    return declared.join(totals, "file").select(
        "file",
        "computed_inflow",
        "computed_outflow",
        closing.alias("computed_closing"),
        agrees("declared_inflow", F.col("computed_inflow")).alias("inflow_ok"),
        agrees("declared_outflow", F.col("computed_outflow")).alias("outflow_ok"),
        agrees("declared_closing", closing).alias("closing_ok"),
    )


def warning_counts(lines: DataFrame) -> DataFrame:
    """Per file: lines without bank id, with a document, with a cut name, and repeated lines.

    Repeated lines are all but the first of equal day, amount and memo. The contents are
    counted first, so the second aggregate adds numbers instead of collecting distinct texts.
    """
    content = lines.groupBy(
        "file", composite_base(F.col("posted_at"), F.col("amount"), F.col("memo")).alias("_key"),
        normalize_text(F.col("memo")).alias("_memo"),
    ).agg(
        F.count("*").alias("_n"),
        F.sum((F.trim(F.coalesce("fitid", F.lit(""))) == "").cast("bigint")).alias("_no_id"),
        F.sum(F.col("counterparty_document").isNotNull().cast("bigint")).alias("_document"),
        F.sum(is_truncated_name(F.col("counterparty_name")).cast("bigint")).alias("_cut"),
    )
    return content.groupBy("file").agg(
        F.sum("_n").alias("lines"),
        F.sum("_no_id").alias("without_fitid"),
        F.sum("_document").alias("with_document"),
        F.sum("_cut").alias("truncated_names"),
        F.sum(F.col("_n") - 1).alias("repeated"),
    )
