"""CSV statements: separator and column mapping from the file itself, then canonical lines.

A file is one row until its records are exploded, so separator, header and mapping are expressions on that row and need no shuffle.
Quotes are handled by cutting the text at each quote: pieces alternate between outside and
inside, and an empty outside piece between two quotes is a doubled quote.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from razao.functions.dates import csv_date
from razao.functions.money import let, parse_user_amount, trimmed
from razao.functions.staging import staged
from razao.functions.text import normalize_text
from razao.operators.imports import with_dedup_key
from razao.sources.decode import decode_statement

# Separators in order of preference, and column titles by meaning.
SEPARATORS = (";", ",", "\t", "|")
HINTS = {
    "date": ("data", "data lancamento", "data movimento", "dt", "date", "data da operacao"),
    "description": (
        "historico", "descricao", "lancamento", "memo", "detalhe", "description",
        "historico complementar",
    ),
    "amount": ("valor", "valor r", "montante", "amount", "vlr"),
    "debit": ("debito", "saida", "saidas", "pagamento", "debit"),
    "credit": ("credito", "entrada", "entradas", "recebimento", "credit"),
    "document": ("documento", "doc", "numero documento", "num doc", "n documento"),
}

# Unicode noncharacters: they cannot occur in text that is interchanged.
RECORD_END, FIELD_END = "\ufdd0", "\ufdd1"


def detect_separator(text: Column) -> Column:
    """The separator with the most consistent column count over all lines."""
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: trimmed(x) != "")
    bare = F.transform(lines, lambda x: F.regexp_replace(x, r'"(?:[^"]|"")*(?:"|$)', ""))

    def score(counts: Column) -> Column:
        columns = F.try_element_at(counts, F.lit(1))
        same = F.size(F.filter(counts, lambda c: c == columns))
        return F.when(columns >= 2, same * 100 + columns)

    def best(sample: Column) -> Column:
        scored = []
        for place, separator in enumerate(SEPARATORS):
            counts = F.transform(sample, _column_count(separator))
            ranked = F.struct(
                let(counts, score).alias("score"),
                F.lit(-place).alias("place"),
                F.lit(separator).alias("separator"),
            )
            scored.append(ranked)
        top = F.array_max(F.filter(F.array(*scored), lambda r: r["score"].isNotNull()))
        return top["separator"]

    return F.coalesce(let(bare, best), F.lit(SEPARATORS[0]))


def _column_count(separator: str) -> Callable[[Column], Column]:
    return lambda line: F.length(line) - F.length(F.translate(line, separator, "")) + 1


def _pieces(text: Column) -> Column:
    return F.split(text, '"', -1)


def records(text: Column) -> Column:
    """Non-blank records; a line break inside quotes does not end one."""
    marked = F.array_join(
        F.transform(
            _pieces(text),
            lambda piece, i: F.when(
                i % 2 == 0, F.regexp_replace(piece, r"\r\n|\r|\n", RECORD_END)
            ).otherwise(piece),
        ),
        '"',
    )
    return F.filter(F.split(marked, RECORD_END), lambda record: trimmed(record) != "")


def fields(record: Column, separator: Column) -> Column:
    """Trimmed fields of one record."""

    def joined(pieces: Column) -> Column:
        last = F.size(pieces) - 1
        return F.array_join(
            F.transform(
                pieces,
                lambda piece, i: F.when(i % 2 == 1, piece)
                .when((piece == "") & (i > 0) & (i < last), '"')
                .otherwise(F.replace(piece, separator, F.lit(FIELD_END))),
            ),
            "",
        )

    return F.transform(F.split(let(_pieces(record), joined), FIELD_END, -1), trimmed)


def _has(hint: str) -> Callable[[Column], Column]:
    return lambda title: F.contains(title, F.lit(hint))


def find_column(titles: Column, meaning: str) -> Column:
    """1-based place of a column: an exact title first, then one that contains a hint."""
    exact = [F.array_position(titles, hint) for hint in HINTS[meaning]]
    partial = [F.array_position(F.transform(titles, _has(hint)), True) for hint in HINTS[meaning]]
    places = F.filter(F.array(*exact, *partial), lambda place: place > 0)
    return F.try_element_at(places, F.lit(1)).cast("int")


def _looks_like_header(row: Column) -> Column:
    def named(titles: Column) -> Column:
        money = F.coalesce(find_column(titles, "amount"), find_column(titles, "credit"))
        return find_column(titles, "date").isNotNull() & money.isNotNull()

    return (F.size(row) >= 3) & let(F.transform(row, normalize_text), named)


def _parsed(files: DataFrame, separator: Column | None = None) -> DataFrame:
    """Content as ``rows`` (records of fields), cut at the stated separator or the detected one."""
    text = F.regexp_replace(decode_statement(F.col("content")), "^\ufeff", "")
    decoded = staged(files, {"_text": text}).drop("content")
    found = detect_separator(F.col("_text"))
    found = found if separator is None else F.coalesce(separator, found)
    separated = staged(decoded, {"separator": found})
    cut = staged(separated, {"_records": records(F.col("_text"))}).drop("_text")
    rows = F.transform("_records", lambda record: fields(record, F.col("separator")))
    return staged(cut, {"rows": rows}).drop("_records")


def csv_layout(files: DataFrame) -> DataFrame:
    """(file, separator, rows, header row, column places, problem); one row per file."""
    parsed = _parsed(files)
    place = F.array_position(F.transform("rows", _looks_like_header), True).cast("int")
    placed = staged(parsed, {"header_row": place})
    header = F.when(F.col("header_row") > 0, F.element_at("rows", F.col("header_row")))
    titled = staged(placed, {"header": header, "_titles": F.transform(header, normalize_text)})
    placed = staged(
        titled, {f"{meaning}_column": find_column(F.col("_titles"), meaning) for meaning in HINTS}
    )
    no_amount = F.col("amount_column").isNull() & (
        F.col("debit_column").isNull() | F.col("credit_column").isNull()
    )
    problem = (
        F.when(F.col("header").isNull(), "no_header")
        .when(F.col("description_column").isNull(), "no_description")
        .when(no_amount, "no_amount")
    )
    return placed.withColumn("problem", problem).drop("_titles")


def csv_mapping(files: DataFrame) -> DataFrame:
    """The proposed column places per file (0-based, as a person confirms them)."""
    signed = F.col("amount_column").isNotNull()
    return csv_layout(files).select(
        "file",
        "separator",
        (F.col("header_row") - 1).alias("skip_rows"),
        (F.col("date_column") - 1).alias("date_column"),
        (F.col("description_column") - 1).alias("description_column"),
        (F.col("amount_column") - 1).alias("amount_column"),
        F.when(~signed, F.col("debit_column") - 1).alias("debit_column"),
        F.when(~signed, F.col("credit_column") - 1).alias("credit_column"),
        (F.col("document_column") - 1).alias("document_column"),
        "problem",
    )


# A place no record has: what is stated but not found is read as an empty cell.
NOWHERE = 2_147_483_647


def stated_layout(files: DataFrame, mapping: DataFrame) -> DataFrame:
    """The layout a person confirmed, one row of ``mapping`` per file.

    ``mapping`` has ``file`` and any of ``separator`` (null: detected), ``skip_rows`` (records
    before the table, 0), ``has_header`` (true), ``invert_sign`` (false) and, per meaning,
    ``date_title`` or ``date_position`` (from 0) and so on. A file without mapping is not read.
    """

    def given(name: str, kind: str) -> Column:
        return (F.col(name) if name in mapping.columns else F.lit(None)).cast(kind)

    stated = mapping.select(
        "file",
        given("separator", "string").alias("_separator"),
        F.coalesce(given("skip_rows", "int"), F.lit(0)).alias("_skip"),
        F.coalesce(given("has_header", "boolean"), F.lit(True)).alias("_has_header"),
        F.coalesce(given("invert_sign", "boolean"), F.lit(False)).alias("invert_sign"),
        *[normalize_text(given(f"{meaning}_title", "string")).alias(f"_{meaning}_title") for meaning in HINTS],
        *[(given(f"{meaning}_position", "int") + 1).alias(f"_{meaning}_position") for meaning in HINTS],
        *[given(f"{meaning}_title", "string").isNotNull().alias(f"_{meaning}_titled") for meaning in HINTS],
    )
    parsed = _parsed(files.select("file", "content").join(stated, "file"), F.col("_separator"))
    header = F.when(F.col("_has_header"), F.try_element_at("rows", F.col("_skip") + 1))
    titled = staged(parsed, {"_titles": F.transform(header, normalize_text)})

    def place(meaning: str) -> Column:
        found = F.nullif(F.array_position("_titles", F.col(f"_{meaning}_title")).cast("int"), F.lit(0))
        by_title = F.when(F.col(f"_{meaning}_titled"), F.coalesce(found, F.lit(NOWHERE)))
        return F.coalesce(F.col(f"_{meaning}_position"), by_title)

    header_row = F.col("_skip") + F.col("_has_header").cast("int")
    return titled.select(
        "file",
        "separator",
        "rows",
        header_row.alias("header_row"),
        "invert_sign",
        *[place(meaning).alias(f"{meaning}_column") for meaning in HINTS],
        F.when(F.size("rows") <= header_row, "no_lines").alias("problem"),
    )


def _rows(files: DataFrame, invert_sign: bool, mapping: DataFrame | None = None) -> DataFrame:
    if mapping is None:
        layout = csv_layout(files).withColumn("invert_sign", F.lit(invert_sign))
    else:
        layout = stated_layout(files, mapping)
    layout = layout.where(F.col("problem").isNull())
    data = F.slice("rows", F.col("header_row") + 1, F.size("rows"))
    exploded = staged(layout, {"_data": data}).select(
        "file",
        "header_row",
        "invert_sign",
        *[f"{meaning}_column" for meaning in HINTS],
        F.posexplode("_data").alias("_index", "_row"),
    )

    def cell(meaning: str) -> Column:
        place = F.col(f"{meaning}_column")
        value = F.when(place.isNotNull(), F.try_element_at("_row", F.coalesce(place, F.lit(1))))
        return F.coalesce(value, F.lit(""))

    def unsigned(meaning: str) -> Column:
        return F.when(cell(meaning) == "", F.lit(0).cast("bigint")).otherwise(
            F.abs(parse_user_amount(cell(meaning)))
        )

    cells = staged(
        exploded,
        {
            "raw_date": cell("date"),
            "_single": parse_user_amount(cell("amount")),
            "_debit": unsigned("debit"),
            "_credit": unsigned("credit"),
            "memo": cell("description"),
            "check_number": F.nullif(cell("document"), F.lit("")),
        },
    ).where(F.col("raw_date") != "")
    both = (F.col("_debit") != 0) & (F.col("_credit") != 0)
    split = F.when(~both, F.col("_credit") - F.col("_debit"))
    single = F.when(F.col("invert_sign"), -F.col("_single")).otherwise(F.col("_single"))
    return staged(
        cells,
        {
            "posted_at": csv_date(F.col("raw_date")),
            "amount": F.when(F.col("amount_column").isNotNull(), single).otherwise(split),
        },
    ).select(
        "file",
        (F.col("_index") + 1).alias("line_no"),
        # As a person counts: records of the file, the header included.
        (F.col("header_row") + F.col("_index") + 1).alias("record_no"),
        "raw_date",
        "posted_at",
        "amount",
        "memo",
        "check_number",
    )


def ingest_csv(
    files: DataFrame, invert_sign: bool = False, mapping: DataFrame | None = None
) -> DataFrame:
    """Canonical lines of (file, content); rows without date or with amount zero are dropped.

    The layout is proposed from the file, or stated by ``mapping`` (see ``stated_layout``).
    """
    none = F.lit(None).cast("string")
    rows = _rows(files, invert_sign, mapping).where(F.col("posted_at").isNotNull() & (F.col("amount") != 0))
    return with_dedup_key(
        rows.select(
            "file",
            "line_no",
            "posted_at",
            "amount",
            "memo",
            none.alias("fitid"),
            "check_number",
            none.alias("counterparty_name"),
            none.alias("counterparty_document"),
            F.lit(None).cast("boolean").alias("name_truncated"),
        )
    )


def csv_warnings(
    files: DataFrame, invert_sign: bool = False, mapping: DataFrame | None = None
) -> DataFrame:
    """Rows with a date cell that could not be read."""
    rows = _rows(files, invert_sign, mapping)
    bad_amount, bad_date = F.col("amount").isNull(), F.col("posted_at").isNull()
    reason = F.when(bad_amount, "valor").when(bad_date & (F.col("amount") != 0), "data")
    return rows.select("file", "line_no", reason.alias("warning")).where("warning IS NOT NULL")

