"""OFX statements, 1.x SGML and 2.x XML, as one relational job.

A leaf is a tag followed by text, closed or not; a tag followed by another tag is a container.
Transactions are cut out with one pattern per file and exploded; every field is one pattern
on the transaction's own text. A broken transaction becomes a warning and the file goes on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from razao.functions.dates import format_date, ofx_date
from razao.functions.money import parse_tolerant_amount, trimmed
from razao.functions.staging import staged
from razao.functions.text import extract_tax_id, memo_join, xml_entities
from razao.operators.imports import with_dedup_key
from razao.sources.decode import decode_statement

TAG = r"[A-Za-z0-9._:]+"
# A container inside a section: up to its end tag, or the rest when it has none.
CONTAINER = rf"(?is)<({TAG})>\s*(?=<)(?:.*?</\1>|.*$)"


def read_statement_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, content) of every file under ``path``; files are the unit of parallelism."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(
        F.col("path").alias("file"), "content"
    )


def _section(body: Column, tag: str, stop: str | None = None) -> Column:
    """Text inside the first container ``tag``, without the containers nested in it."""
    ends = rf"</{tag}>" if stop is None else rf"</{tag}>|{stop}"
    inner = F.regexp_extract(body, rf"(?is)<{tag}>(.*?)(?:{ends}|$)", 1)
    return F.regexp_replace(inner, CONTAINER, "")


def _leaves(section: Column) -> Column:
    """(tags, values) of the leaves of a section, tags in capitals, in document order."""
    leaf = F.lit(rf"<({TAG})>([^<]*)")
    return F.struct(
        F.regexp_extract_all(F.upper(section), leaf, F.lit(1)).alias("tags"),
        F.regexp_extract_all(section, leaf, F.lit(2)).alias("values"),
    )


def _value(leaves: Column, tag: str) -> Column:
    """Text of the first leaf ``tag`` with entities decoded, or null."""
    place = F.nullif(F.array_position(leaves["tags"], tag), F.lit(0))
    found = trimmed(F.try_element_at(leaves["values"], place.cast("int")))
    return F.nullif(xml_entities(found), F.lit(""))


def _bodies(files: DataFrame) -> DataFrame:
    """Files with their decoded text, null where the text is no OFX."""
    text = staged(files, {"_text": decode_statement(F.col("content"))})
    body = F.when(F.col("_text").rlike("(?i)<OFX>"), F.col("_text"))
    return staged(text.drop("content"), {"_body": body}).drop("_text")


def statement_header(files: DataFrame) -> DataFrame:
    """One row per file: bank, account, attested period, ledger balance, rejection.

    The period ends at the generation date when the file was made before its declared end: it
    cannot contain what happened afterwards. The balance date is cut in the same way.
    """
    body = F.col("_body")
    account = F.when(body.rlike("(?i)<BANKACCTFROM>"), _section(body, "BANKACCTFROM")).otherwise(
        _section(body, "CCACCTFROM")
    )
    movement = _section(body, "BANKTRANLIST", stop="<STMTTRN>")
    ledger = _section(body, "LEDGERBAL")
    sections = {
        "_account": account, "_movement": movement, "_ledger": ledger, "_sonrs": _section(body, "SONRS"),
    }

    def value(section: str, tag: str) -> Column:
        return _value(F.col(section), tag)

    found = staged(
        _bodies(files), {name: _leaves(text) for name, text in sections.items()}
    )
    raw = staged(
        found.select("file", body.isNull().alias("_not_ofx"), *sections),
        {
            "bank_id": value("_account", "BANKID"),
            "account_id": value("_account", "ACCTID"),
            "period_start": ofx_date(value("_movement", "DTSTART")),
            "declared_end": ofx_date(value("_movement", "DTEND")),
            "ledger_balance": parse_tolerant_amount(value("_ledger", "BALAMT")),
            "_as_of": ofx_date(value("_ledger", "DTASOF")),
            "generated_on": ofx_date(value("_sonrs", "DTSERVER")),
        },
    )
    end = attested(F.col("declared_end"), F.col("generated_on"))
    return raw.select(
        "file",
        F.lit("ofx").alias("source"),
        "bank_id",
        "account_id",
        "period_start",
        end.alias("period_end"),
        "ledger_balance",
        attested(F.col("_as_of"), F.col("generated_on")).alias("ledger_balance_date"),
        F.when(
            end < F.col("declared_end"),
            F.concat(
                F.lit("O arquivo diz cobrir até "),
                format_date(F.col("declared_end")),
                F.lit(", mas foi gerado em "),
                format_date(end),
            ),
        ).alias("period_warning"),
        F.when(F.col("_not_ofx"), "not_ofx").alias("reject_reason"),
    )


def attested(declared: Column, generated: Column) -> Column:
    """The declared day, or the generation day when that came first; null if undeclared."""
    return F.when(declared.isNotNull(), F.least(declared, generated))


def _transactions(files: DataFrame) -> DataFrame:
    # Up to the next of these tags or the end; possessive, so that nothing is tried twice.
    block = r"(?i)<STMTTRN>((?:[^<]++|<(?!/?STMTTRN>|/BANKTRANLIST>))*+)"
    blocks = F.regexp_extract_all("_body", F.lit(block), F.lit(1))
    cleaned = F.regexp_replace(F.col("_block"), CONTAINER, "")
    fields = {
        "_posted": "DTPOSTED",
        "_amount": "TRNAMT",
        "_name": "NAME",
        "_memo": "MEMO",
        "fitid": "FITID",
        "check_number": "CHECKNUM",
    }
    found = staged(_bodies(files).where(F.col("_body").isNotNull()), {"_blocks": blocks})
    entries = found.select("file", F.posexplode("_blocks").alias("_index", "_block"))
    leaves = staged(entries, {"_leaves": _leaves(cleaned)}).select(
        "file", (F.col("_index") + 1).alias("line_no"), "_leaves"
    )
    values = staged(leaves, {name: _value(F.col("_leaves"), tag) for name, tag in fields.items()})
    return staged(
        values.drop("_leaves"),
        {
            "posted_at": ofx_date(F.col("_posted")),
            "amount": parse_tolerant_amount(F.col("_amount")),
            "memo": memo_join(F.col("_name"), F.col("_memo")),
        },
    )


def ingest_ofx(files: DataFrame) -> DataFrame:
    """Canonical lines of (file, content)."""
    rows = _transactions(files).where(F.col("posted_at").isNotNull() & F.col("amount").isNotNull())
    canonical = rows.select(
        "file",
        "line_no",
        "posted_at",
        "amount",
        "memo",
        "fitid",
        "check_number",
        F.lit(None).cast("string").alias("counterparty_name"),
        extract_tax_id(F.col("memo")).alias("counterparty_document"),
        F.lit(None).cast("boolean").alias("name_truncated"),
    )
    return with_dedup_key(canonical)


def ofx_warnings(files: DataFrame) -> DataFrame:
    """Transactions that were left out, with the reason."""
    missing = F.col("_posted").isNull() | F.col("_amount").isNull()
    reason = (
        F.when(missing, "falta data ou valor")
        .when(F.col("posted_at").isNull(), F.concat(F.lit('Data OFX inválida: "'), "_posted", F.lit('"')))
        .otherwise(F.concat(F.lit('Valor OFX inválido: "'), "_amount", F.lit('"')))
    )
    return (
        _transactions(files)
        .where(F.col("posted_at").isNull() | F.col("amount").isNull())
        .select("file", "line_no", reason.alias("warning"))
    )
