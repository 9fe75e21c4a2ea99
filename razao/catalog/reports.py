"""Queries: lookups, orders, the monthly cycle and the portfolio."""

from __future__ import annotations

from pyspark.sql import functions as F

from razao.adapters import AS_OF, Model
from razao.catalog.base import query
from razao.catalog.ledger import _BALANCES, _LOCKED, _PROOF
from razao.functions import dates
from razao.operators import cycle, lookups, ordering


@query(
    "lookup_names",
    "transactions counterparties",
    """SELECT t.id, coalesce(c.name, '—') AS counterparty_name FROM transactions t
       LEFT JOIN counterparties c ON c.id = t.counterparty_id""",
)
def lookup_names(m: Model):
    return lookups.lookup(
        m.transactions, m.counterparties, "counterparty_id", "id", "name", "counterparty_name", "—"
    ).select("id", "counterparty_name")


@query(
    "memo_backfill",
    "transactions statement_lines",
    """SELECT t.id, t.description, l.memo AS bank_memo FROM transactions t
       LEFT JOIN statement_lines l ON l.matched_transaction_id = t.id""",
)
def memo_backfill(m: Model):
    return lookups.memo_backfill(m.transactions, m.statement_lines).select(
        "id", "description", "bank_memo"
    )


@query(
    "existing_keys",
    "statement_lines transactions",
    """SELECT id, 'fitid:F' || id AS dedup_key FROM transactions t WHERE NOT EXISTS (
       SELECT 1 FROM statement_lines l WHERE l.bank_account_id = t.bank_account_id
         AND l.dedup_key = 'fitid:F' || t.id)""",
)
def existing_keys(m: Model):
    from razao.operators.imports import new_lines

    incoming = m.transactions.select(
        "id", "bank_account_id", F.concat(F.lit("fitid:F"), "id").alias("dedup_key")
    )
    return new_lines(incoming, m.statement_lines).select("id", "dedup_key")


@query(
    "unswept_credits",
    "transactions settlements",
    """SELECT id, amount FROM transactions t WHERE status = 'realizado' AND amount > 0
       AND NOT EXISTS (SELECT 1 FROM settlements s WHERE s.transaction_id = t.id)""",
)
def unswept_credits(m: Model):
    return lookups.unswept_credits(m.transactions, m.settlements).select("id", "amount")


@query(
    "has_settlement",
    "transactions settlements",
    "SELECT id FROM transactions WHERE id IN (SELECT transaction_id FROM settlements)",
)
def has_settlement(m: Model):
    return lookups.has_settlement(m.transactions, m.settlements).select("id")


@query(
    "attachment_lock",
    "transactions closings settlements",
    f"""SELECT s.id FROM settlements s JOIN transactions t ON t.id = s.transaction_id
        WHERE NOT {_LOCKED}""",
)
def attachment_lock(m: Model):
    """Child rows that may still change: settlements stand in for attachments."""
    return lookups.open_month_children(m.settlements, m.transactions, m.closings).select("id")


@query(
    "credit_tax_id",
    "transactions counterparties",
    """SELECT t.id, coalesce(c.tax_id, CASE WHEN t.id % 3 = 0 THEN '12345678000190' END)
       AS payer_tax_id
       FROM transactions t LEFT JOIN counterparties c ON c.id = t.counterparty_id
       WHERE t.status = 'realizado' AND t.amount > 0""",
)
def credit_tax_id(m: Model):
    note = F.when(F.col("id") % 3 == 0, " 12.345.678/0001-90").otherwise("")
    credits = m.transactions.where("status = 'realizado' AND amount > 0").withColumn(
        "description", F.concat("description", note)
    )
    return lookups.credit_tax_id(credits, m.counterparties).select("id", "payer_tax_id")


@query(
    "last_import",
    "imports",
    """SELECT company_id, id, created_at::VARCHAR AS created_at, bank_account_id, source FROM imports
       QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY imports.created_at DESC, id DESC) = 1""",
)
def last_import(m: Model):
    return lookups.last_import(m.imports)


@query(
    "compare_sources",
    "transactions statement_lines",
    """, b AS (SELECT bank_account_id, amount, count(*) AS left_count FROM transactions GROUP BY ALL),
    l AS (SELECT bank_account_id, amount, count(*) AS right_count FROM statement_lines GROUP BY ALL)
    SELECT bank_account_id, amount, coalesce(left_count, 0) AS left_count,
           coalesce(right_count, 0) AS right_count
    FROM b FULL JOIN l USING (bank_account_id, amount)
    WHERE coalesce(left_count, 0) <> coalesce(right_count, 0)""",
)
def compare_sources(m: Model):
    return lookups.compare_sources(m.transactions, m.statement_lines, ["bank_account_id", "amount"])


@query(
    "same_company_fk",
    "transactions counterparties categories",
    """SELECT 'counterparty' AS parent, t.id FROM transactions t WHERE counterparty_id IS NOT NULL
         AND NOT EXISTS (SELECT 1 FROM counterparties c WHERE c.id = t.counterparty_id
                         AND c.company_id = t.company_id)
       UNION ALL
       SELECT 'category', id FROM (SELECT id, company_id,
              category_id + CASE WHEN id % 19 = 0 THEN 10 ELSE 0 END AS k FROM transactions) t
       WHERE k IS NOT NULL AND NOT EXISTS (SELECT 1 FROM categories c WHERE c.id = t.k
                                           AND c.company_id = t.company_id)""",
)
def same_company_fk(m: Model):
    moved = m.transactions.withColumn(
        "category_id", F.col("category_id") + F.when(F.col("id") % 19 == 0, 10).otherwise(0)
    )
    parties = lookups.orphans(m.transactions, m.counterparties, "counterparty_id")
    categories = lookups.orphans(moved, m.categories, "category_id")
    return parties.select(F.lit("counterparty").alias("parent"), "id").union(
        categories.select(F.lit("category"), "id")
    )


# Orders and top-k


@query(
    "ledger_order",
    "transactions",
    """SELECT id, company_id, booking_date::VARCHAR AS booking_date FROM transactions
       ORDER BY company_id, transactions.booking_date DESC, created_at DESC, id DESC""",
)
def ledger_order(m: Model):
    return m.transactions.orderBy("company_id", *ordering.ledger_order()).select(
        "id", "company_id", "booking_date"
    )


@query(
    "capped_list",
    "statement_lines",
    """, pending AS (SELECT * FROM statement_lines WHERE status = 'pendente'),
    ranked AS (SELECT id, company_id, posted_at::VARCHAR AS posted_at, row_number() OVER (
            PARTITION BY company_id ORDER BY pending.posted_at, id)::INTEGER AS place,
        count(*) OVER (PARTITION BY company_id) >= 500 AS cap_reached FROM pending)
    SELECT * FROM ranked WHERE place <= 500""",
)
def capped_list(m: Model):
    pending = m.statement_lines.where("status = 'pendente'")
    rows = ordering.capped_list(pending, [F.asc("posted_at"), F.asc("id")], 500)
    return rows.select("id", "company_id", "posted_at", "place", "cap_reached")


@query(
    "next_due",
    "transactions",
    f"""SELECT id, company_id, booking_date::VARCHAR AS booking_date, row_number() OVER (
           PARTITION BY company_id ORDER BY transactions.booking_date, id)::INTEGER AS place
       FROM transactions WHERE status = 'previsto'
         AND booking_date BETWEEN DATE '{AS_OF}' AND DATE '{AS_OF}' + 30
       QUALIFY place <= 10""",
)
def next_due(m: Model):
    rows = ordering.next_due(m.transactions, AS_OF, F.date_add(dates.day(AS_OF), 30), 10)
    return rows.select("id", "company_id", "booking_date", "place")


@query(
    "natural_order",
    "invoices",
    """SELECT id, company_id, number FROM invoices
       ORDER BY company_id, CAST(number AS BIGINT), coalesce(series, ''), id""",
)
def natural_order(m: Model):
    order = [*ordering.natural_order("number"), F.coalesce("series", F.lit("")), F.col("id")]
    return m.invoices.orderBy("company_id", *order).select("id", "company_id", "number")


@query(
    "closing_calendar",
    "companies closings",
    """, spine AS (SELECT company_id, unnest(generate_series(DATE '1999-02-01', DATE '2000-01-01',
            INTERVAL 1 MONTH))::DATE AS period FROM companies)
    SELECT s.company_id, s.period::VARCHAR AS period, c.reopen_reason,
           CASE WHEN locked_at IS NOT NULL THEN 'fechado' WHEN reopened_at IS NOT NULL THEN 'reaberto'
                ELSE 'aberto' END AS state
    FROM spine s LEFT JOIN closings c USING (company_id, period)""",
)
def closing_calendar(m: Model):
    return ordering.closing_calendar(m.companies, m.closings, AS_OF, 12).select(
        "company_id", "period", "reopen_reason", "state"
    )


@query(
    "settlements_by_invoice",
    "settlements",
    """SELECT invoice_id, max(created_at)::DATE::VARCHAR AS last_day, sum(amount)::BIGINT AS total,
       string_agg(id::VARCHAR, ',' ORDER BY created_at DESC, id DESC) AS settlement_ids
       FROM settlements GROUP BY invoice_id""",
)
def settlements_by_invoice(m: Model):
    rows = ordering.settlements_by_invoice(m.settlements)
    ids = F.array_join(F.transform("settlements", lambda s: s["id"].cast("string")), ",")
    return rows.select(
        "invoice_id", F.to_date("last_settlement").alias("last_day"), "total", ids.alias("settlement_ids")
    )


# The monthly cycle

CYCLE_DAY = "1999-12-10"


@query(
    "working_month",
    "accounts closings",
    f"""SELECT a.company_id, (CASE
           WHEN DATE '1999-11-01' < date_trunc('month', min(opening_balance_date) FILTER (is_active))
             OR EXISTS (SELECT 1 FROM closings c WHERE c.company_id = a.company_id
                        AND c.period = DATE '1999-11-01' AND c.locked_at IS NOT NULL)
           THEN DATE '1999-12-01' ELSE DATE '1999-11-01' END)::VARCHAR AS working_month
       FROM accounts a GROUP BY a.company_id""",
)
def working_month(m: Model):
    return cycle.working_month(m.accounts, m.closings, CYCLE_DAY)


@query(
    "statement_coverage",
    "accounts imports",
    """SELECT a.company_id, a.bank_account_id, '1999-11-01' AS period, coalesce(
           max(i.period_end) >= DATE '1999-11-30', false) AS covered
       FROM accounts a LEFT JOIN imports i USING (bank_account_id)
       WHERE a.opening_balance_date <= DATE '1999-11-30' GROUP BY 1, 2""",
)
def statement_coverage(m: Model):
    periods = m.companies.select("company_id", dates.day("1999-11-01").alias("period"))
    return cycle.statement_coverage(m.accounts, m.imports, periods)


@query(
    "lines_by_status",
    "statement_lines",
    "SELECT company_id, status, count(*) AS lines FROM statement_lines GROUP BY ALL",
)
def lines_by_status(m: Model):
    return cycle.line_counts(m.statement_lines)


@query(
    "distinct_ids",
    "audit_log",
    "SELECT DISTINCT changed_by AS user_id FROM audit_log WHERE changed_by IS NOT NULL",
)
def distinct_ids(m: Model):
    return m.audit_log.where("changed_by IS NOT NULL").select(
        F.col("changed_by").alias("user_id")
    ).distinct()


_CYCLE_TABLES = "accounts transactions statement_lines imports invoices settlements closings"
_UNRECONCILED = """(SELECT count(*) FROM transactions t JOIN accounts own USING (bank_account_id)
    WHERE own.company_id = {0} AND t.status = 'realizado' AND t.reconciliation = 'nao_conciliado')"""


@query(
    "close_steps",
    _CYCLE_TABLES,
    _BALANCES + _PROOF.replace(_PROOF[: _PROOF.index("latest")], ", ") + f""", months AS (
        SELECT a.company_id, CASE
               WHEN EXISTS (SELECT 1 FROM closings c WHERE c.company_id = a.company_id
                            AND c.period = DATE '1999-11-01' AND c.locked_at IS NOT NULL)
               THEN DATE '1999-12-01' ELSE DATE '1999-11-01' END AS month
        FROM accounts a GROUP BY a.company_id),
    reach AS (SELECT bank_account_id, max(period_end) AS reach FROM imports GROUP BY 1),
    counts AS (
        SELECT m.company_id, month,
               (SELECT count(*) FROM accounts a LEFT JOIN reach r USING (bank_account_id)
                WHERE a.company_id = m.company_id AND a.is_active
                  AND a.opening_balance_date <= last_day(month)
                  AND coalesce(r.reach < last_day(month), true)) AS statement_count,
               (SELECT count(*) FROM statement_lines l WHERE l.company_id = m.company_id
                  AND l.status = 'pendente') AS review_count,
               (SELECT count(*) FROM balances b WHERE b.company_id = m.company_id
                  AND outstanding_amount > 0 AND issued_on <= DATE '{CYCLE_DAY}' - 45)
                  AS invoice_count,
               {_UNRECONCILED.format('m.company_id')} AS check_count,
               EXISTS (SELECT 1 FROM proof p JOIN accounts a USING (bank_account_id)
                       WHERE a.is_active AND p.company_id = m.company_id
                         AND p.computed_balance <> p.declared_balance) AS differs,
               EXISTS (SELECT 1 FROM closings c WHERE c.company_id = m.company_id
                       AND c.period = m.month AND c.locked_at IS NOT NULL) AS locked
        FROM months m),
    flags AS (
        SELECT *, statement_count = 0 AS statement_done, review_count = 0 AS review_done,
               invoice_count = 0 AS invoice_done, check_count = 0 AND NOT differs AS check_done,
               locked OR last_day(month) >= DATE '{CYCLE_DAY}' AS close_done FROM counts)
    SELECT company_id, month::VARCHAR AS working_month, statement_count, review_count, invoice_count,
           check_count, statement_done, review_done, invoice_done, check_done, close_done,
           CASE WHEN NOT statement_done THEN 'extrato' WHEN NOT review_done THEN 'revisar'
                WHEN NOT invoice_done THEN 'notas' WHEN NOT check_done THEN 'conferir'
                WHEN NOT close_done THEN 'fechar' END AS current_step
    FROM flags""",
)
def close_steps(m: Model):
    return cycle.close_steps(
        m.accounts, m.transactions, m.statement_lines, m.imports, m.invoices, m.settlements,
        m.closings, CYCLE_DAY,
    )


_STATUS = _BALANCES + f""", status AS (
    SELECT a.company_id,
           (sum(a.opening_balance) + coalesce((SELECT sum(t.amount) FROM transactions t
               JOIN accounts b USING (bank_account_id) WHERE b.company_id = a.company_id
               AND t.status = 'realizado' AND t.booking_date <= DATE '{CYCLE_DAY}'), 0))::BIGINT
               AS current_balance,
           count(*) FILTER (is_active) AS active_accounts,
           {_UNRECONCILED.format('a.company_id')} AS unreconciled,
           (SELECT count(DISTINCT bank_account_id) FROM imports i WHERE i.company_id = a.company_id
              AND i.created_at >= TIMESTAMP '1999-12-01') AS imported_accounts,
           (SELECT count(*) FROM statement_lines l WHERE l.company_id = a.company_id
              AND l.status = 'pendente') AS pending_lines,
           (SELECT count(*) FROM balances b WHERE b.company_id = a.company_id
              AND outstanding_amount > 0 AND issued_on <= DATE '{CYCLE_DAY}' - 45)
              AS overdue_invoices,
           (SELECT coalesce(sum(outstanding_amount), 0) FROM balances b
            WHERE b.company_id = a.company_id AND outstanding_amount > 0)::BIGINT AS receivable,
           EXISTS (SELECT 1 FROM closings c WHERE c.company_id = a.company_id
                   AND c.period = DATE '1999-12-01' AND c.locked_at IS NOT NULL) AS month_closed
    FROM accounts a GROUP BY a.company_id),
scored AS (SELECT *, (pending_lines > 0)::INTEGER + (unreconciled > 0)::INTEGER
    + (overdue_invoices > 0)::INTEGER
    + (active_accounts > 0 AND imported_accounts < active_accounts)::INTEGER AS attention_score
    FROM status) """


def _status(m: Model):
    return cycle.portfolio_status(
        m.accounts, m.transactions, m.statement_lines, m.imports, m.invoices, m.settlements,
        m.closings, CYCLE_DAY,
    )


@query("portfolio_status", _CYCLE_TABLES, _STATUS + "SELECT * FROM status")
def portfolio_status(m: Model):
    return _status(m)


@query(
    "attention_score", _CYCLE_TABLES, _STATUS + "SELECT company_id, attention_score FROM scored"
)
def attention_score(m: Model):
    return cycle.with_attention_score(_status(m)).select("company_id", "attention_score")


@query(
    "portfolio_order",
    _CYCLE_TABLES + " companies",
    _STATUS + """SELECT s.company_id, c.name, attention_score FROM scored s
       JOIN companies c USING (company_id) ORDER BY attention_score DESC, c.name, s.company_id""",
)
def portfolio_order(m: Model):
    scored = cycle.with_attention_score(_status(m)).join(m.companies, "company_id")
    return scored.orderBy(*ordering.portfolio_order()).select(
        "company_id", "name", "attention_score"
    )
