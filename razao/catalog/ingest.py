"""Queries: statement and invoice files, rendered from the given orders, and the loads.

The files are built inside the query (see the adapters), so their number grows with the data;
the oracle states the expected rows from the orders directly, without any text in between.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from razao.adapters import Model
from razao.catalog.base import query
from razao.catalog.matching import _norm
from razao.catalog.model_sql import _PRICE, WORDS, _pick
from razao.operators import imports
from razao.operators import series as ser
from razao.session import checkpoint_dir, cut_lineage
from razao.sources import canonical, delimited, nfse, ofx

# Lines of the rendered files: `no` numbers the file, `pos` the line in it.
_SIGNED = f"CASE WHEN o_orderkey % 4 >= 2 THEN -{_PRICE} ELSE {_PRICE} END"
_MEMO = f"{_pick('o_orderkey', WORDS)} || ' & ' || lower(o_orderpriority)"
_NAME = "'Cliente ' || o_custkey || CASE WHEN o_orderkey % 8 = 0 THEN ' 12.345.678/0001-90' ELSE '' END"


def _file_rows(size: int) -> str:
    return f"""entries AS (SELECT o_orderkey // {size} AS no, o_orderkey AS key, o_custkey AS account,
        CAST(o_orderdate AS DATE) AS day, {_SIGNED} AS cents, {_MEMO} AS memo, {_NAME} AS name,
        row_number() OVER (PARTITION BY o_orderkey // {size} ORDER BY o_orderkey)::INTEGER AS pos
        FROM orders)"""


_OFX = f"""WITH {_file_rows(50)}, ofx AS (
    SELECT 'o' || no AS file, no, key, pos AS line_no, day AS posted_at, cents AS amount,
           CASE WHEN key % 15 = 2 THEN memo ELSE name || ' - ' || memo END AS memo,
           CASE WHEN key % 9 <> 0 THEN 'F' || key END AS fitid,
           CASE WHEN key % 15 <> 2 AND key % 8 = 0 THEN '12345678000190' END AS counterparty_document
    FROM entries WHERE key % 97 <> 5 AND key % 89 <> 7),
ofx_keyed AS (SELECT *, CASE WHEN fitid IS NOT NULL THEN 'fitid:' || fitid
        ELSE 'c:' || posted_at || '|' || amount || '|' || {_norm('memo')} || '|'
             || (row_number() OVER (PARTITION BY file, posted_at, amount, {_norm('memo')},
                                    fitid IS NULL ORDER BY line_no) - 1) END AS dedup_key FROM ofx) """
_CSV_MEMO = """CASE WHEN key % 25 = 6 THEN replace(memo, ' & ', '; ' || chr(10) || '"X", ')
    WHEN key % 10 = 4 THEN replace(memo, ' & ', '; "X", ') ELSE memo END"""
_CSV = f"""WITH {_file_rows(50)}, csv AS (
    SELECT 'c' || no AS file, pos AS line_no, day AS posted_at, cents AS amount, {_CSV_MEMO} AS memo,
           CASE WHEN no % 3 <> 1 THEN lpad(key::VARCHAR, 6, '0') END AS check_number
    FROM entries),
csv_keyed AS (SELECT *, 'c:' || posted_at || '|' || amount || '|' || {_norm('memo')} || '|'
        || (row_number() OVER (PARTITION BY file, posted_at, amount, {_norm('memo')}
                               ORDER BY line_no) - 1) AS dedup_key FROM csv) """


@query(
    "ingest_ofx",
    sql=_OFX + """SELECT file, line_no, posted_at::VARCHAR AS posted_at, amount, memo, fitid,
       counterparty_document, dedup_key FROM ofx_keyed""",
)
def ingest_ofx(m: Model):
    return ofx.ingest_ofx(m.ofx_files).drop("check_number", "counterparty_name", "name_truncated")


@query(
    "ofx_warnings",
    sql=f"""WITH {_file_rows(50)} SELECT 'o' || no AS file, pos AS line_no,
        CASE WHEN key % 89 = 7 THEN 'falta data ou valor' ELSE 'Data OFX inválida: "20250230"' END
            AS warning FROM entries WHERE key % 89 = 7 OR key % 97 = 5""",
)
def ofx_warnings(m: Model):
    return ofx.ofx_warnings(m.ofx_files)


@query(
    "decode_statement",
    sql=f"""WITH {_file_rows(50)} SELECT 'o' || no AS file,
        CASE WHEN no % 2 = 1 THEN 'utf-8' ELSE 'windows-1252' END AS charset,
        bool_or(contains(memo, 'automático')) AS accents FROM entries GROUP BY no""",
)
def decode_statement(m: Model):
    from razao.sources.decode import decode_statement as decode
    from razao.sources.decode import statement_charset

    return m.ofx_files.select(
        "file",
        statement_charset(F.col("content")).alias("charset"),
        F.contains(decode(F.col("content")), F.lit("automático")).alias("accents"),
    )


_HEADERS = f"""WITH {_file_rows(50)}, headers AS (
    SELECT 'o' || no AS file, no, min(day) AS first, last_day(max(day)) AS declared,
           CASE WHEN no % 3 = 0 THEN last_day(max(day)) - 1 ELSE last_day(max(day)) END AS attested,
           sum(cents)::BIGINT AS total FROM entries GROUP BY no) """


@query(
    "statement_header",
    sql=_HEADERS + """SELECT file, 'ofx' AS source, '341' AS bank_id, no || '-0' AS account_id,
       first::VARCHAR AS period_start, total AS ledger_balance,
       attested::VARCHAR AS ledger_balance_date FROM headers""",
)
def statement_header(m: Model):
    return ofx.statement_header(m.ofx_files).select(
        "file", "source", "bank_id", "account_id", "period_start", "ledger_balance",
        "ledger_balance_date",
    )


@query(
    "attested_period",
    sql=_HEADERS + """SELECT file, attested::VARCHAR AS period_end,
       CASE WHEN attested < declared THEN 'O arquivo diz cobrir até ' || strftime(declared, '%d/%m/%Y')
            || ', mas foi gerado em ' || strftime(attested, '%d/%m/%Y') END AS period_warning
       FROM headers""",
)
def attested_period(m: Model):
    return ofx.statement_header(m.ofx_files).select("file", "period_end", "period_warning")


@query(
    "csv_delimiter",
    sql=f"""WITH {_file_rows(50)} SELECT DISTINCT 'c' || no AS file,
        CASE WHEN no % 3 = 1 THEN ',' ELSE ';' END AS separator FROM entries""",
)
def csv_delimiter(m: Model):
    return delimited.csv_layout(m.csv_files).select("file", "separator")


@query(
    "csv_mapping",
    sql=f"""WITH {_file_rows(50)} SELECT DISTINCT 'c' || no AS file,
        CASE WHEN no % 3 = 1 THEN 0 ELSE 2 END::INTEGER AS skip_rows, 0 AS date_column,
        1 AS description_column, CASE WHEN no % 3 <> 1 THEN 3 END AS amount_column,
        CASE WHEN no % 3 = 1 THEN 2 END AS debit_column, CASE WHEN no % 3 = 1 THEN 3 END
        AS credit_column, CASE WHEN no % 3 <> 1 THEN 2 END AS document_column,
        NULL::VARCHAR AS problem FROM entries""",
)
def csv_mapping(m: Model):
    return delimited.csv_mapping(m.csv_files).drop("separator")


@query(
    "ingest_csv",
    sql=_CSV + """SELECT file, line_no, posted_at::VARCHAR AS posted_at, amount, memo, check_number,
       dedup_key FROM csv_keyed""",
)
def ingest_csv(m: Model):
    return delimited.ingest_csv(m.csv_files).select(
        "file", "line_no", "posted_at", "amount", "memo", "check_number", "dedup_key"
    )


@query(
    "ingest_csv_mapped",
    sql=_CSV + f"""SELECT 'c' || no AS file, pos AS line_no, day::VARCHAR AS posted_at,
       CASE WHEN no % 3 = 2 THEN -cents ELSE cents END AS amount, {_CSV_MEMO} AS memo,
       CASE WHEN no % 3 = 2 THEN lpad(key::VARCHAR, 6, '0') END AS check_number FROM entries""",
)
def ingest_csv_mapped(m: Model):
    """Titles for files with one kind of table, places without a header for the others."""
    kind = F.substring("file", 2, 20).cast("bigint") % 3
    text = lambda value: F.when(kind != 2, value)
    split, whole, places = kind == 1, kind == 0, kind == 2
    mapping = m.csv_files.select(
        "file",
        F.when(split, ",").alias("separator"),
        F.when(places, 3).when(whole, 2).alias("skip_rows"),
        F.when(places, False).alias("has_header"),
        places.alias("invert_sign"),
        text(F.lit("DATA")).alias("date_title"),
        F.when(split, "lancamento").when(whole, "histórico").alias("description_title"),
        F.when(whole, "Valor").alias("amount_title"),
        F.when(split, "Debito").alias("debit_title"),
        F.when(split, "CRÉDITO").alias("credit_title"),
        F.when(places, 0).alias("date_position"),
        F.when(places, 1).alias("description_position"),
        F.when(places, 3).alias("amount_position"),
        F.when(places, 2).alias("document_position"),
    )
    return delimited.ingest_csv(m.csv_files, mapping=mapping).select(
        "file", "line_no", "posted_at", "amount", "memo", "check_number"
    )


@query(
    "canonical_lines",
    sql=_OFX + _CSV.replace(f"WITH {_file_rows(50)}", "", 1) + """, every AS (
       SELECT 'ofx' AS source, file, line_no, posted_at, amount, memo, dedup_key FROM ofx_keyed
       UNION ALL SELECT 'csv', file, line_no, posted_at, amount, memo, dedup_key FROM csv_keyed)
       SELECT source, file, line_no, posted_at::VARCHAR AS posted_at, amount, memo, dedup_key FROM every"""
    ,
)
def canonical_lines(m: Model):
    both = canonical.canonical_lines(
        ("ofx", ofx.ingest_ofx(m.ofx_files)), ("csv", delimited.ingest_csv(m.csv_files))
    )
    return both.select("source", "file", "line_no", "posted_at", "amount", "memo", "dedup_key")


@query(
    "statement_span",
    sql=_CSV + """SELECT file, min(posted_at)::VARCHAR AS period_start,
       max(posted_at)::VARCHAR AS period_end FROM csv GROUP BY file""",
)
def statement_span(m: Model):
    return canonical.statement_span(delimited.ingest_csv(m.csv_files))


@query(
    "statement_integrity",
    sql=_OFX + """, totals AS (SELECT 'o' || no AS file, sum(cents)::BIGINT AS closing FROM entries
           GROUP BY no)
       SELECT t.file, coalesce(sum(amount) FILTER (amount > 0), 0)::BIGINT AS computed_inflow,
              coalesce(-sum(amount) FILTER (amount < 0), 0)::BIGINT AS computed_outflow,
              closing AS declared_closing, (closing - coalesce(sum(amount), 0))::BIGINT
                  AS implied_opening
       FROM totals t LEFT JOIN ofx USING (file) GROUP BY t.file, closing""",
)
def statement_integrity(m: Model):
    headers = ofx.statement_header(m.ofx_files)
    return canonical.statement_integrity(headers, ofx.ingest_ofx(m.ofx_files))


@query(
    "warning_counts",
    sql=_OFX + f"""SELECT file, count(*) AS lines, count(*) FILTER (fitid IS NULL) AS without_fitid,
       count(counterparty_document) AS with_document, 0::BIGINT AS truncated_names,
       count(*) - count(DISTINCT posted_at || '|' || amount || '|' || {_norm('memo')}) AS repeated
       FROM ofx GROUP BY file""",
)
def warning_counts(m: Model):
    return canonical.warning_counts(ofx.ingest_ofx(m.ofx_files))


# Keys and loads on the statement lines of the model


@query(
    "occurrence_key",
    "statement_lines",
    f""", l AS (SELECT *, date_trunc('month', posted_at)::DATE AS d FROM statement_lines
               WHERE fitid IS NULL)
    SELECT id, 'c:' || d || '|' || amount || '|' || {_norm('memo')} || '|'
           || (row_number() OVER (PARTITION BY bank_account_id, d, amount, {_norm('memo')}
                                  ORDER BY id) - 1) AS dedup_key FROM l""",
)
def occurrence_key(m: Model):
    """Fees dated to their month, so that equal lines occur; the account stands for the file."""
    lines = m.statement_lines.where("fitid IS NULL").select(
        "id",
        F.col("bank_account_id").alias("file"),
        F.col("id").alias("line_no"),
        F.trunc("posted_at", "MM").alias("posted_at"),
        "amount",
        "memo",
        "fitid",
    )
    return imports.with_dedup_key(lines).select("id", "dedup_key")


@query(
    "dedup_key",
    "statement_lines",
    f"""SELECT id, CASE WHEN fitid IS NOT NULL THEN 'fitid:' || fitid
           ELSE 'c:' || posted_at || '|' || amount || '|' || {_norm('memo')} || '|'
                || (row_number() OVER (PARTITION BY bank_account_id, posted_at, amount,
                        {_norm('memo')}, fitid IS NULL ORDER BY id) - 1) END AS dedup_key
       FROM statement_lines""",
)
def dedup_key(m: Model):
    lines = m.statement_lines.select(
        "id",
        F.col("bank_account_id").alias("file"),
        F.col("id").alias("line_no"),
        "posted_at",
        "amount",
        "memo",
        "fitid",
    )
    return imports.with_dedup_key(lines).select("id", "dedup_key")


_GATED = """, files AS (
    SELECT DISTINCT id AS file, CASE WHEN id % 29 = 0 THEN 'manual' ELSE source END AS source
    FROM imports),
lines AS (SELECT import_id AS file, id, CASE WHEN id % 41 = 0 THEN NULL WHEN import_id % 13 = 0
                 THEN 0 ELSE amount END AS amount FROM statement_lines),
gate AS (SELECT f.file, f.source, count(l.id) AS line_count,
         CASE WHEN f.source NOT IN ('ofx', 'csv', 'pdf') THEN 'source' WHEN count(l.id) = 0
              THEN 'no_lines'
              WHEN count(l.id) > count(l.amount) THEN 'malformed_line'
              WHEN count(*) FILTER (l.amount <> 0) = 0 THEN 'only_zero_amounts' END AS reject_reason
    FROM files f LEFT JOIN lines l USING (file) GROUP BY f.file, f.source) """


@query(
    "payload_gate",
    "imports statement_lines",
    _GATED + "SELECT file, source, line_count, reject_reason FROM gate",
)
def payload_gate(m: Model):
    files = m.imports.select(
        F.col("id").alias("file"),
        F.when(F.col("id") % 29 == 0, "manual").otherwise(F.col("source")).alias("source"),
    )
    lines = m.statement_lines.select(
        F.col("import_id").alias("file"),
        "posted_at",
        F.when(F.col("id") % 41 == 0, None)
        .when(F.col("import_id") % 13 == 0, 0)
        .otherwise(F.col("amount"))
        .alias("amount"),
        "memo",
        "dedup_key",
    )
    return imports.payload_gate(files, lines)


@query(
    "import_statement",
    sql=_OFX + """, stored AS (SELECT key // 50 // 7 AS account,
        CASE WHEN key % 5 = 0 THEN dedup_key ELSE 'x' || dedup_key END AS dedup_key FROM ofx_keyed),
    incoming AS (SELECT *, no // 7 AS account FROM ofx_keyed WHERE amount <> 0),
    fresh AS (SELECT i.* FROM incoming i WHERE NOT EXISTS (SELECT 1 FROM stored s
              WHERE s.account = i.account AND s.dedup_key = i.dedup_key)),
    placed AS (SELECT *, row_number() OVER (PARTITION BY account, dedup_key ORDER BY file, line_no) AS n
               FROM fresh)
    SELECT account AS bank_account_id, file, line_no, dedup_key, n > 1 AS duplicate FROM placed""",
)
def import_statement(m: Model):
    """Files of seven accounts' worth each, where every fifth line is already stored and the others under another key."""
    number = F.substring("file", 2, 20).cast("bigint")
    account = ((number - number % 7) / 7).cast("bigint")
    files = m.ofx_files
    # The load reads the canonical lines several times, so they are written once before it.
    lines = cut_lineage(ofx.ingest_ofx(files))
    headers = files.select(
        "file",
        account.alias("bank_account_id"),
        (account % 25).alias("company_id"),
        F.lit("ofx").alias("source"),
    )
    # The stored fifth: a line's key is its place in the file plus fifty per file.
    key = number * 50 + F.col("line_no") - 1
    stored_key = F.when(key % 5 == 0, F.col("dedup_key")).otherwise(F.concat(F.lit("x"), "dedup_key"))
    stored_lines = lines.select(account.alias("bank_account_id"), stored_key.alias("dedup_key"))
    stored_imports = m.imports.select("bank_account_id", "file_hash")
    result = imports.import_statements(headers, lines, stored_imports, stored_lines)
    columns = ("bank_account_id", "file", "line_no", "dedup_key")
    return result.lines.select(*columns, F.lit(False).alias("duplicate")).unionByName(
        result.duplicate_lines.select(*columns, F.lit(True).alias("duplicate"))
    )


# Invoices

_INVOICES = f"""WITH {_file_rows(10)}, read AS (
    SELECT CASE WHEN no % 2 = 0 THEN 'b' || no ELSE 'n' || key END AS file, no % 25 AS company_id,
           CASE WHEN no % 2 = 0 THEN pos ELSE 1 END::INTEGER AS line_no, key, no,
           key::VARCHAR AS number, day AS issued_on, abs(cents) AS amount,
           abs(cents) // 100 + CASE WHEN no % 2 = 0 THEN 10 ELSE 0 END AS withheld_amount,
           CASE WHEN no % 2 = 1 THEN 'Cliente ' || account
                WHEN key % 19 = 4 THEN 'Prestador Ltda' ELSE 'Cliente & ' || account || ' Ltda' END
               AS client_name,
           CASE WHEN no % 2 = 0 AND key % 19 = 4 THEN '11222333000181'
                ELSE lpad((account * 7919 + 11)::VARCHAR, 14, '0') END AS client_tax_id,
           no % 2 = 1 AND key % 31 = 6 AS broken, key % 23 = 5 AS bad_date
    FROM entries),
good AS (SELECT * FROM read WHERE NOT broken AND NOT bad_date) """


@query(
    "ingest_invoices",
    sql=_INVOICES + """SELECT file, company_id, line_no, number, issued_on::VARCHAR AS issued_on, amount,
       withheld_amount, client_name, client_tax_id,
       CASE WHEN no % 2 = 0 AND key % 19 = 4 THEN 'sem_tomador' ELSE '' END AS warnings FROM good""",
)
def ingest_invoices(m: Model):
    rows = nfse.ingest_invoices(m.invoice_files)
    return rows.select(
        "file", "company_id", "line_no", "number", "issued_on", "amount", "withheld_amount",
        "client_name", "client_tax_id", F.array_join("warnings", ",").alias("warnings"),
    )


@query(
    "rejected_invoices",
    sql=_INVOICES + """SELECT file, line_no, CASE WHEN broken THEN 'xml_ilegivel' ELSE 'data_invalida' END
       AS reason FROM read WHERE broken OR bad_date""",
)
def rejected_invoices(m: Model):
    return nfse.rejected_invoices(m.invoice_files)


_STORED_INVOICES = """, incoming AS (SELECT file, line_no, company_id, key % 1000 AS number,
        key % 3 = 0 AS a, client_tax_id, client_name FROM good),
    stored AS (SELECT DISTINCT (o_orderkey // 10) % 25 AS company_id, o_orderkey % 1000 AS number,
               CASE WHEN o_orderkey % 6 = 0 THEN 'A' ELSE 'X' END AS series FROM orders),
    placed AS (SELECT i.*, row_number() OVER (PARTITION BY company_id, number, a
                   ORDER BY file, line_no) = 1 AND NOT EXISTS (SELECT 1 FROM stored s
                   WHERE s.company_id = i.company_id AND s.number = i.number AND i.a AND s.series = 'A') AS new
               FROM incoming i) """


@query(
    "import_invoices",
    sql=_INVOICES + _STORED_INVOICES + """SELECT file, line_no, company_id, number::VARCHAR AS number,
       CASE WHEN a THEN 'A' END AS series, new FROM placed""",
)
def import_invoices(m: Model):
    """Numbers shortened to three digits so that the natural key repeats."""
    result = _invoice_import(m)
    columns = ("file", "line_no", "company_id", "number", "series")
    return result.invoices.select(*columns, F.lit(True).alias("new")).unionByName(
        result.duplicates.select(*columns, F.lit(False).alias("new"))
    )


@query(
    "new_counterparties",
    sql=_INVOICES + """SELECT company_id, client_tax_id AS tax_id,
       arg_min(client_name, (file, line_no)) AS name
       FROM good WHERE NOT EXISTS (SELECT 1 FROM customer
           WHERE c_custkey % 25 = good.company_id AND c_custkey % 13 <> 0 AND c_custkey % 29 <> 3
             AND c_custkey % 2 = 0 AND lpad((c_custkey * 7919 + 11)::VARCHAR, 14, '0') = client_tax_id)
       GROUP BY company_id, client_tax_id""",
)
def new_counterparties(m: Model):
    return _invoice_import(m).counterparties


def _invoice_import(m: Model) -> imports.InvoiceImport:
    key = F.col("number").cast("bigint")
    incoming = cut_lineage(nfse.ingest_invoices(m.invoice_files)).withColumns(
        {
            "series": F.when(key % 3 == 0, "A"),
            "number": (key % 1000).cast("string"),
        }
    )
    order = F.col("o_orderkey")
    stored = m.raw("orders").select(
        (((order - order % 10) / 10).cast("bigint") % 25).alias("company_id"),
        (order % 1000).cast("string").alias("number"),
        F.when(order % 6 == 0, "A").otherwise("X").alias("series"),
    )
    return imports.import_invoices(incoming, stored, m.counterparties)


# Statement checks of sectioned reports


@query(
    "heading_carry_forward",
    sql="""WITH rows AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 4 = 0
               THEN CAST(o_orderdate AS DATE) END AS heading FROM orders)
    SELECT o_custkey AS file, o_orderkey AS position, last_value(heading IGNORE NULLS) OVER (
        PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)::VARCHAR AS day
    FROM rows""",
)
def heading_carry_forward(m: Model):
    """Every fourth row of an account's list is a day heading."""
    key = F.col("o_orderkey")
    rows = m.raw("orders").select(
        F.col("o_custkey").alias("file"),
        F.lit(1).alias("page"),
        key.alias("position"),
        F.when(key % 4 == 0, F.col("o_orderdate").cast("date")).alias("heading_day"),
    )
    return ser.heading_carry_forward(rows).select("file", "position", "day")


_CHECKS = """, daily AS (SELECT import_id AS file, posted_at AS date, sum(amount) AS net
        FROM statement_lines GROUP BY ALL),
    running AS (SELECT file, date, (file % 1000 + sum(net) OVER (PARTITION BY file ORDER BY date))::BIGINT
        AS computed FROM daily),
    checks AS (SELECT file, date, computed, computed + (day(date) % 5 = 0)::INTEGER AS declared
        FROM running WHERE day(date) % 3 <> 0) """


def _statement_checks(m: Model):
    from pyspark.sql import Window as W

    lines = m.statement_lines.select(F.col("import_id").alias("file"), "posted_at", "amount")
    openings = lines.select("file", (F.col("file") % 1000).alias("opening_balance")).distinct()
    # What the bank printed: right on most days, one cent off on every fifth day of a month.
    order = W.partitionBy("file").orderBy("date")
    printed = (
        lines.groupBy("file", F.col("posted_at").alias("date"))
        .agg(F.sum("amount").alias("net"))
        .withColumn("balance", F.col("file") % 1000 + F.sum("net").over(order))
        .withColumn("balance", F.col("balance") + (F.dayofmonth("date") % 5 == 0).cast("int"))
        .where(F.dayofmonth("date") % 3 != 0)
        .drop("net")
    )
    return ser.daily_statement_check(lines, openings, printed)


@query(
    "daily_statement_check",
    "statement_lines",
    _CHECKS + "SELECT file, date::VARCHAR AS date, declared, computed, declared = computed AS ok FROM checks",
)
def daily_statement_check(m: Model):
    return _statement_checks(m)


@query(
    "first_divergence",
    "statement_lines",
    _CHECKS + """SELECT file, min(date)::VARCHAR AS first_divergent_day, count(*) AS divergent_days
       FROM checks WHERE declared <> computed GROUP BY file""",
)
def first_divergence(m: Model):
    return ser.first_divergence(_statement_checks(m))


@query(
    "declared_totals_check",
    sql=_OFX + """SELECT file, coalesce(sum(amount) FILTER (amount > 0), 0)::BIGINT AS computed_inflow,
       coalesce(-sum(amount) FILTER (amount < 0), 0)::BIGINT AS computed_outflow,
       (1000 + sum(amount))::BIGINT AS computed_closing, no % 2 = 0 OR coalesce(sum(amount)
           FILTER (amount > 0), 0) = 0 AS inflow_ok, true AS outflow_ok,
       sum(amount) = 0 AS closing_ok FROM ofx GROUP BY file, no""",
)
def declared_totals_check(m: Model):
    """Odd files declare no inflow at all, and every file a closing equal to its opening."""
    lines = ofx.ingest_ofx(m.ofx_files)
    odd = F.substring("file", 2, 20).cast("bigint") % 2 == 1
    nothing = F.lit(None).cast("bigint")
    declared = m.ofx_files.select(
        "file",
        F.lit(1000).cast("bigint").alias("declared_opening"),
        F.when(odd, F.lit(0).cast("bigint")).alias("declared_inflow"),
        nothing.alias("declared_outflow"),
        F.lit(1000).cast("bigint").alias("declared_closing"),
    )
    return canonical.declared_totals_check(lines, declared)


_SHOWN = """CASE WHEN # < 0 THEN '-' ELSE '' END || replace(format('{:,}', abs(#) // 100), ',', '.')
           || ',' || lpad((abs(#) % 100)::VARCHAR, 2, '0')"""


@query(
    "export_cash_flow",
    "transactions accounts",
    """, openings AS (
        SELECT company_id, sum(opening_balance) + coalesce((SELECT sum(amount) FROM transactions t
            WHERE t.company_id = a.company_id AND status = 'realizado'
              AND booking_date < DATE '1999-02-01'), 0) AS opening
        FROM accounts a GROUP BY company_id),
    moved AS (SELECT company_id, booking_date AS date, sum(amount) FILTER (amount > 0) AS inflow,
                     sum(amount) FILTER (amount < 0) AS outflow, sum(amount) AS net FROM transactions
              WHERE status = 'realizado' GROUP BY ALL),
    days AS (SELECT o.company_id, d::DATE AS date, coalesce(inflow, 0)::BIGINT AS inflow,
           coalesce(outflow, 0)::BIGINT AS outflow, coalesce(net, 0)::BIGINT AS net,
           (opening + sum(coalesce(net, 0)) OVER (PARTITION BY o.company_id ORDER BY d))::BIGINT AS balance
        FROM openings o CROSS JOIN unnest(generate_series(DATE '1999-02-01', DATE '1999-02-28',
            INTERVAL 1 DAY)) u(d)
        LEFT JOIN moved m ON m.company_id = o.company_id AND m.date = d::DATE)
    SELECT company_id, strftime(date, '%d/%m/%Y') AS "Data", {inflow} AS "Entradas", {outflow} AS "Saidas",
           {net} AS "Liquido", {balance} AS "Saldo" FROM days"""
    .format(**{c: _SHOWN.replace("#", c) for c in ("inflow", "outflow", "net", "balance")}),
)
def export_cash_flow(m: Model):
    """The exported files, read back: written to a fresh shared folder by the sink."""
    from razao.sources.export import export_cash_flow as write

    days = ser.cash_flow_report(m.accounts, m.transactions, "1999-02-01", "1999-02-28")
    folder = f"{checkpoint_dir(m.spark)}/cash-flow-{uuid.uuid4().hex}"
    write(days, folder)
    titles = ("Data", "Entradas", "Saidas", "Liquido", "Saldo")
    schema = ", ".join(f"{title} string" for title in titles) + ", company_id bigint"
    return m.spark.read.schema(schema).csv(folder, sep=";", header=True).select(
        "company_id", *titles
    )
