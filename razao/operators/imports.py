"""Loading statements and invoices without duplicates.

State tables only grow by what the anti joins let through, so a load can be repeated after a
lost executor or a second upload and gives the same tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from razao.functions.text import content_hash, normalize_text
from razao.schema import IMPORTABLE_SOURCES


def composite_base(posted_at: Column, amount: Column, memo: Column) -> Column:
    """``c:<day>|<cents>|<memo>|``: what identifies a line that has no bank id."""
    return F.concat(
        F.lit("c:"),
        posted_at.cast("string"),
        F.lit("|"),
        amount.cast("string"),
        F.lit("|"),
        normalize_text(memo),
        F.lit("|"),
    )


def with_dedup_key(lines: DataFrame) -> DataFrame:
    """Add ``dedup_key``: the bank's id, else day, cents, memo and occurrence number.

    Equal lines are numbered inside their file, in file order. One pass, so a file is parsed
    once; lines with a bank id are spread by it, as their number is not used.
    """
    has_id = F.trim(F.coalesce("fitid", F.lit(""))) != ""
    base = composite_base(F.col("posted_at"), F.col("amount"), F.col("memo"))
    order = W.partitionBy("file", F.coalesce("_base", "fitid")).orderBy("line_no")
    occurrence = (F.row_number().over(order) - 1).cast("string")
    return (
        lines.withColumn("_base", F.when(~has_id, base))
        .withColumn("_occurrence", occurrence)
        .withColumn(
            "dedup_key",
            F.coalesce(
                F.concat("_base", "_occurrence"), F.concat(F.lit("fitid:"), F.trim("fitid"))
            ),
        )
        .drop("_base", "_occurrence")
    )


def line_is_valid() -> Column:
    return (
        F.col("posted_at").isNotNull()
        & F.col("amount").isNotNull()
        & F.col("memo").isNotNull()
        & (F.coalesce(F.length("dedup_key"), F.lit(0)) > 0)
    )


def payload_gate(files: DataFrame, lines: DataFrame, max_lines: int | None = None) -> DataFrame:
    """Why each file is refused, or null: source, no lines, too many, malformed, only zeros.

    ``files`` (file, source), ``lines`` with canonical columns. Files of any length pass unless
    the caller states ``max_lines``.
    """
    too_many = F.lit(False) if max_lines is None else F.coalesce("line_count", F.lit(0)) > max_lines
    counts = lines.groupBy("file").agg(
        F.count("*").alias("line_count"),
        F.sum((~line_is_valid()).cast("bigint")).alias("_bad"),
        F.sum((F.col("amount") != 0).cast("bigint")).alias("_moving"),
    )
    total = F.coalesce("line_count", F.lit(0).cast("bigint"))
    reason = (
        F.when(~F.coalesce(F.col("source").isin(*IMPORTABLE_SOURCES), F.lit(False)), "source")
        .when(total == 0, "no_lines")
        .when(too_many, "too_many_lines")
        .when(F.col("_bad") > 0, "malformed_line")
        .when(F.coalesce("_moving", F.lit(0)) == 0, "only_zero_amounts")
    )
    return files.join(counts, "file", "left").select(
        *files.columns, total.alias("line_count"), reason.alias("reject_reason")
    )


def accepted_lines(lines: DataFrame, gate: DataFrame) -> DataFrame:
    """Lines of accepted files, without zero amounts."""
    good = gate.where(F.col("reject_reason").isNull()).select("file")
    return lines.join(good, "file", "left_semi").where(F.col("amount") != 0)


def new_lines(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Incoming lines whose (account, dedup key) is not stored yet."""
    keys = stored.select("bank_account_id", "dedup_key")
    return incoming.join(keys, ["bank_account_id", "dedup_key"], "left_anti")


@dataclass(frozen=True)
class ImportResult:
    headers: DataFrame
    lines: DataFrame
    rejected_files: DataFrame
    duplicate_lines: DataFrame


def payload_hash(lines: DataFrame) -> DataFrame:
    """SHA-256 per file over its lines in file order; files are bounded by the gate."""
    row = F.concat_ws(
        "|", F.col("posted_at").cast("string"), F.col("amount").cast("string"), "memo", "dedup_key"
    )
    return lines.groupBy("file").agg(
        content_hash(
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("line_no", row.alias("row")))),
                    lambda r: r["row"],
                ),
                "\n",
            )
        ).alias("file_hash")
    )


def import_statements(
    files: DataFrame, lines: DataFrame, stored_imports: DataFrame, stored_lines: DataFrame
) -> ImportResult:
    """Idempotent load of many files.

    ``files`` (file, company_id, bank_account_id, source, …), ``lines`` canonical. A file is
    refused when the gate refuses it, when its content is already stored for the account, or
    when an earlier file of this batch has the same content. Of lines with one key in an
    account the first stays; the rest go to ``duplicate_lines``.
    """
    gate = payload_gate(files, lines)
    good = accepted_lines(lines, gate)
    hashed = gate.join(payload_hash(good), "file", "left")
    known = stored_imports.where(F.col("file_hash").isNotNull()).select(
        "bank_account_id", "file_hash", F.lit(True).alias("_known")
    ).distinct()
    same = (
        hashed.where(F.col("reject_reason").isNull())
        .groupBy("bank_account_id", "file_hash")
        .agg(F.min("file").alias("_first"))
    )
    judged = (
        hashed.join(known, ["bank_account_id", "file_hash"], "left")
        .join(same, ["bank_account_id", "file_hash"], "left")
        .withColumn(
            "reject_reason",
            F.coalesce(
                "reject_reason",
                F.when(F.col("_known") | (F.col("_first") != F.col("file")), "already_imported"),
            ),
        )
        .drop("_known", "_first")
    )
    headers = judged.where(F.col("reject_reason").isNull()).drop("reject_reason")
    fresh = new_lines(
        good.join(headers.select("file", "company_id", "bank_account_id"), "file"), stored_lines
    )
    # First line per key by file and place; a minimum, so a key shared by very many lines is
    # reduced in each task before the shuffle.
    first = fresh.groupBy("bank_account_id", "dedup_key").agg(
        F.min(F.struct("file", "line_no")).alias("_keep")
    )
    marked = fresh.join(first, ["bank_account_id", "dedup_key"])
    keep = F.struct("file", "line_no") == F.col("_keep")
    return ImportResult(
        headers=headers,
        lines=marked.where(keep).drop("_keep"),
        rejected_files=judged.where(F.col("reject_reason").isNotNull()),
        duplicate_lines=marked.where(~keep).drop("_keep"),
    )


@dataclass(frozen=True)
class InvoiceImport:
    counterparties: DataFrame
    invoices: DataFrame
    duplicates: DataFrame


INVOICE_KEY = ["company_id", "number", "_series"]


def import_invoices(
    incoming: DataFrame, stored_invoices: DataFrame, counterparties: DataFrame
) -> InvoiceImport:
    """Create missing counterparties by tax id and add invoices that are not stored.

    ``incoming`` (file, line_no, company_id, number, series, …, client_name, client_tax_id).
    The natural key is (company, number, series or empty).
    """
    rows = incoming.withColumn("_series", F.coalesce("series", F.lit("")))
    known = counterparties.where(F.col("tax_id").isNotNull()).select(
        "company_id", F.col("tax_id").alias("client_tax_id")
    )
    clients = (
        rows.where(F.col("client_tax_id").isNotNull())
        .groupBy("company_id", "client_tax_id")
        .agg(F.min_by("client_name", F.struct("file", "line_no")).alias("name"))
        .join(known, ["company_id", "client_tax_id"], "left_anti")
        .withColumnRenamed("client_tax_id", "tax_id")
    )
    stored = stored_invoices.select(
        "company_id", "number", F.coalesce("series", F.lit("")).alias("_series"), F.lit(True).alias("_known")
    ).distinct()
    first = rows.groupBy(*INVOICE_KEY).agg(F.min(F.struct("file", "line_no")).alias("_keep"))
    marked = rows.join(first, INVOICE_KEY).join(stored, INVOICE_KEY, "left")
    new = F.col("_known").isNull() & (F.struct("file", "line_no") == F.col("_keep"))
    return InvoiceImport(
        counterparties=clients,
        invoices=marked.where(new).drop("_keep", "_known", "_series"),
        duplicates=marked.where(~new).drop("_keep", "_known", "_series"),
    )
