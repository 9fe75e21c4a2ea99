"""Queries: filters, balances, grouped views and daily series."""

from __future__ import annotations

from pyspark.sql import functions as F

from razao.adapters import AS_OF, Model
from razao.catalog.base import query
from razao.functions import dates
from razao.operators import balances as bal
from razao.operators import filters as flt
from razao.operators import series as ser

_T = "SELECT id, amount, status, booking_date::VARCHAR AS booking_date FROM transactions"
_TX = ("id", "amount", "status", "booking_date")


@query(
    "scan_table",
    "transactions",
    """SELECT id, bank_account_id, amount, description, booking_date::VARCHAR AS booking_date
       FROM transactions
       WHERE status = 'realizado' AND payment_method IN ('pix', 'ted') AND amount >= 1000000
         AND booking_date <= DATE '2000-01-01' AND document_number IS NOT NULL
       ORDER BY booking_date, id LIMIT 1000""",
)
def scan_table(m: Model):
    from razao.sources.tables import scan_table as scan

    return scan(
        m.transactions,
        columns=["id", "bank_account_id", "amount", "description", "booking_date"],
        equals={"status": "realizado"},
        among={"payment_method": ["pix", "ted"]},
        at_least={"amount": 1000000},
        at_most={"booking_date": "2000-01-01"},
        not_null=["document_number"],
        order=["booking_date", "id"],
        limit=1000,
    )


@query(
    "scan_embedded",
    "companies profile_accounts",
    """SELECT profile_id, p.profile_id // 10 AS company_id, c.name AS company_name,
              string_agg(bank_account_id::VARCHAR, ',' ORDER BY bank_account_id) AS accounts
       FROM profile_accounts p JOIN companies c ON c.company_id = p.profile_id // 10
       GROUP BY ALL""",
)
def scan_embedded(m: Model):
    from razao.sources.tables import embed_many, embed_one

    profiles = m.profile_accounts.select("profile_id").distinct().withColumn(
        "company_id", F.floor(F.col("profile_id") / 10)
    )
    rows = embed_many(profiles, m.profile_accounts, "profile_id", "bank_account_id", "accounts")
    rows = embed_one(rows, m.companies, "company_id", ["name"], "company")
    return rows.select(
        "profile_id",
        "company_id",
        F.col("company.name").alias("company_name"),
        F.array_join(F.transform("accounts", lambda a: a.cast("string")), ",").alias("accounts"),
    )


@query(
    "scan_embedded_chunks",
    "profile_accounts",
    """SELECT profile_id, place // 8 AS chunk, string_agg(bank_account_id::VARCHAR, ',' ORDER BY bank_account_id) AS accounts
       FROM (SELECT profile_id, bank_account_id, row_number() OVER (PARTITION BY profile_id ORDER BY bank_account_id) - 1 AS place
             FROM (SELECT DISTINCT profile_id, bank_account_id FROM profile_accounts))
       GROUP BY profile_id, chunk""",
)
def scan_embedded_chunks(m: Model):
    from razao.sources.tables import embed_chunks

    rows = embed_chunks(m.profile_accounts, "profile_id", "bank_account_id", "accounts", 8)
    return rows.select("profile_id", "chunk", F.array_join(F.transform("accounts", lambda a: a.cast("string")), ",").alias("accounts"))


@query("scope_filter", "transactions", f"{_T} WHERE status = 'realizado'")
def scope_filter(m: Model):
    return flt.scope_filter(m.transactions).select(*_TX)


@query(
    "opening_cutoff",
    "transactions accounts",
    """SELECT t.id, t.amount, t.status, t.booking_date::VARCHAR AS booking_date
       FROM transactions t JOIN accounts a USING (bank_account_id)
       WHERE t.booking_date >= a.opening_balance_date""",
)
def opening_cutoff(m: Model):
    return flt.opening_cutoff(m.transactions, m.accounts).select(*_TX)


@query(
    "month_filter",
    "transactions",
    f"{_T} WHERE booking_date >= DATE '1998-12-01' AND booking_date < DATE '1999-01-01'",
)
def month_filter(m: Model):
    return flt.month_filter(m.transactions, "1998-12-15").select(*_TX)


@query(
    "period_filter",
    "transactions",
    f"{_T} WHERE booking_date BETWEEN DATE '1999-11-20' AND DATE '2000-01-01'",
)
def period_filter(m: Model):
    return flt.period_filter(m.transactions, "1999-11-20", "not a day", AS_OF).select(*_TX)


@query(
    "pending_lines",
    "statement_lines",
    "SELECT id, bank_account_id, amount, memo FROM statement_lines WHERE status = 'pendente'",
)
def pending_lines(m: Model):
    return flt.pending_lines(m.statement_lines).select("id", "bank_account_id", "amount", "memo")


@query(
    "unreconciled_txns",
    "transactions",
    f"{_T} WHERE status = 'realizado' AND reconciliation = 'nao_conciliado'",
)
def unreconciled_txns(m: Model):
    return flt.unreconciled(m.transactions).select(*_TX)


_BALANCES = """, balances AS (
    SELECT i.*, coalesce(s.paid, 0)::BIGINT AS received_amount,
           (i.amount - coalesce(s.paid, 0))::BIGINT AS outstanding_amount
    FROM invoices i LEFT JOIN (
        SELECT invoice_id, sum(amount) AS paid FROM settlements GROUP BY invoice_id) s
      ON s.invoice_id = i.id) """


@query(
    "invoice_balances",
    "invoices settlements",
    _BALANCES + """SELECT id, company_id, number, series, issued_on::VARCHAR AS issued_on, amount,
       withheld_amount, client_name, client_tax_id, status, received_amount, outstanding_amount
       FROM balances""",
)
def invoice_balances(m: Model):
    return bal.invoice_balances(m.invoices, m.settlements).drop("counterparty_id")


@query(
    "open_invoices",
    "invoices settlements",
    _BALANCES + """SELECT id, company_id, outstanding_amount FROM balances
       WHERE outstanding_amount > 0""",
)
def open_invoices(m: Model):
    rows = bal.open_invoices(bal.invoice_balances(m.invoices, m.settlements))
    return rows.select("id", "company_id", "outstanding_amount")


@query(
    "settlement_join",
    "invoices settlements",
    """SELECT i.id, i.number, coalesce(count(s.id), 0) AS settlements,
              max(s.created_at)::DATE::VARCHAR AS last_settlement
       FROM invoices i LEFT JOIN settlements s ON s.invoice_id = i.id GROUP BY i.id, i.number""",
)
def settlement_join(m: Model):
    from razao.operators.lookups import settlement_join as join

    return join(m.invoices, m.settlements).select("id", "number", "settlements", "last_settlement")


@query(
    "accounts_receivable",
    "invoices settlements",
    _BALANCES + """SELECT company_id, sum(outstanding_amount)::BIGINT AS receivable FROM balances
       WHERE outstanding_amount > 0 GROUP BY company_id""",
)
def accounts_receivable(m: Model):
    return bal.accounts_receivable(bal.invoice_balances(m.invoices, m.settlements))


@query(
    "invoice_totals",
    "invoices settlements",
    _BALANCES + f"""SELECT company_id, sum(amount)::BIGINT AS billed,
       sum(received_amount)::BIGINT AS received, sum(outstanding_amount)::BIGINT AS outstanding,
       count(*) FILTER (outstanding_amount > 0 AND issued_on <= DATE '{AS_OF}' - 45)
           AS overdue_count
       FROM balances GROUP BY company_id""",
)
def invoice_totals(m: Model):
    return bal.invoice_totals(bal.invoice_balances(m.invoices, m.settlements), AS_OF)


@query(
    "invoice_overdue",
    "invoices settlements",
    _BALANCES + f"""SELECT id, date_diff('day', issued_on, DATE '{AS_OF}')::INTEGER AS days
       FROM balances WHERE outstanding_amount > 0 AND issued_on <= DATE '{AS_OF}' - 45""",
)
def invoice_overdue(m: Model):
    rows = bal.invoice_balances(m.invoices, m.settlements)
    late = flt.is_invoice_overdue(F.col("issued_on"), F.col("outstanding_amount"), AS_OF)
    return rows.where(late).select(
        "id", F.datediff(dates.day(AS_OF), F.col("issued_on")).alias("days")
    )


@query(
    "active_filter",
    "categories cost_centers counterparties",
    """SELECT 'category' AS kind, id FROM categories WHERE is_active
       UNION ALL SELECT 'cost_center', id FROM cost_centers
       UNION ALL SELECT 'counterparty', id FROM counterparties WHERE is_active""",
)
def active_filter(m: Model):
    parts = [
        flt.active_only(m.categories).select(F.lit("category").alias("kind"), "id"),
        flt.active_only(m.cost_centers, include_inactive=True).select(F.lit("cost_center"), "id"),
        flt.active_only(m.counterparties).select(F.lit("counterparty"), "id"),
    ]
    return parts[0].union(parts[1]).union(parts[2])


_LOCKED = """EXISTS (SELECT 1 FROM closings c WHERE c.company_id = t.company_id
    AND c.period = date_trunc('month', t.booking_date) AND c.locked_at IS NOT NULL)"""


@query(
    "period_locked",
    "transactions closings",
    f"SELECT id, company_id, booking_date::VARCHAR AS booking_date FROM transactions t WHERE {_LOCKED}",
)
def period_locked(m: Model):
    return flt.period_locked(m.transactions, m.closings).select("id", "company_id", "booking_date")


@query(
    "tenant_visibility",
    "transactions memberships",
    """SELECT id, company_id, amount FROM transactions
       WHERE company_id IN (SELECT company_id FROM memberships WHERE user_id = 42)""",
)
def tenant_visibility(m: Model):
    return flt.tenant_visibility(m.transactions, m.memberships, 42).select(
        "id", "company_id", "amount"
    )


@query(
    "role_filter",
    "audit_log memberships",
    """SELECT id, company_id, table_name FROM audit_log
       WHERE company_id IN (SELECT company_id FROM memberships
                            WHERE user_id = 42 AND role IN ('contador', 'owner'))""",
)
def role_filter(m: Model):
    return flt.role_filter(m.audit_log, m.memberships, 42, "contador").select(
        "id", "company_id", "table_name"
    )


@query(
    "role_rank",
    "memberships",
    """SELECT user_id, company_id, role, CASE role WHEN 'cliente_leitura' THEN 1
       WHEN 'assistente' THEN 2 WHEN 'contador' THEN 3 WHEN 'owner' THEN 4 END AS rank
       FROM memberships""",
)
def role_rank(m: Model):
    return m.memberships.withColumn("rank", flt.role_rank(F.col("role")))


@query(
    "account_lens",
    "transactions profile_accounts",
    """SELECT id, bank_account_id FROM transactions WHERE bank_account_id IN
       (SELECT bank_account_id FROM profile_accounts WHERE profile_id IN (10, 31, 99999))""",
)
def account_lens(m: Model):
    rows = flt.account_lens(m.transactions, m.profile_accounts, [10, 31, 99999])
    return rows.select("id", "bank_account_id")


@query(
    "lens_union",
    "profile_accounts",
    "SELECT DISTINCT bank_account_id FROM profile_accounts WHERE profile_id IN (10, 11, 31)",
)
def lens_union(m: Model):
    return flt.lens_union(m.profile_accounts, [10, 11, 31])


@query("not_transfer", "transactions", f"{_T} WHERE transfer_group_id IS NULL")
def not_transfer(m: Model):
    return flt.not_transfer(m.transactions).select(*_TX)


@query(
    "overdue_planned",
    "transactions",
    f"{_T} WHERE status = 'previsto' AND booking_date < DATE '{AS_OF}'",
)
def overdue_planned(m: Model):
    return flt.overdue_planned(m.transactions, AS_OF).select(*_TX)


@query(
    "can_close_month",
    "closings",
    """SELECT company_id, period::VARCHAR AS period, last_day(period) < DATE '1999-10-31' AS can_close
       FROM closings""",
)
def can_close_month(m: Model):
    return m.closings.select(
        "company_id", "period", flt.can_close_month(F.col("period"), "1999-10-31").alias("can_close")
    )


_STATE = f""", state AS (
    SELECT t.*, reconciliation = 'conciliado' AS reconciled,
           EXISTS (SELECT 1 FROM settlements s WHERE s.transaction_id = t.id) AS has_settlement,
           {_LOCKED} AS period_locked
    FROM transactions t) """
_LOCK_SQL = """array_to_string(list_filter([
    CASE WHEN is_transfer AND '{0}' NOT IN ('competence_date', 'text') THEN 'transferencia' END,
    CASE WHEN reconciled AND '{0}' IN ('amount', 'booking_date', 'bank_account_id') THEN 'conciliado' END,
    CASE WHEN has_settlement AND '{0}' = 'amount' THEN 'baixaDeNota' END,
    CASE WHEN period_locked THEN 'mesFechado' END], lambda x: x IS NOT NULL), ',') AS lock_{0}"""


def _state(m: Model):
    return flt.transaction_state(m.transactions, m.settlements, m.closings)


@query(
    "transaction_state",
    "transactions settlements closings",
    _STATE + "SELECT id, status, reconciled, has_settlement, is_transfer, period_locked FROM state",
)
def transaction_state(m: Model):
    return _state(m).select(
        "id", "status", "reconciled", "has_settlement", "is_transfer", "period_locked"
    )


@query(
    "edit_locks",
    "transactions settlements closings",
    _STATE + "SELECT id, " + ", ".join(_LOCK_SQL.format(f) for f in flt.EDITABLE_FIELDS) + " FROM state",
)
def edit_locks(m: Model):
    locked = flt.edit_locks(_state(m))
    return locked.select(
        "id", *[F.array_join(f"lock_{f}", ",").alias(f"lock_{f}") for f in flt.EDITABLE_FIELDS]
    )


@query(
    "can_settle_unsettle",
    "transactions settlements closings",
    _STATE + """SELECT id, status = 'previsto' AND NOT is_transfer AND NOT period_locked AS can_settle,
       status = 'realizado' AND NOT (reconciled OR has_settlement OR is_transfer OR period_locked)
           AS can_unsettle FROM state""",
)
def can_settle_unsettle(m: Model):
    return _state(m).select(
        "id", flt.can_settle().alias("can_settle"), flt.can_unsettle().alias("can_unsettle")
    )


# Balances


@query(
    "account_balances",
    "accounts transactions",
    f"""SELECT a.bank_account_id, a.company_id, a.name, a.kind, a.is_active, a.opening_balance,
       a.opening_balance_date::VARCHAR AS opening_balance_date, a.minimum_balance,
       (a.opening_balance + coalesce(sum(t.amount) FILTER (t.status = 'realizado'
           AND t.booking_date <= DATE '{AS_OF}'), 0))::BIGINT AS current_balance,
       (a.opening_balance + coalesce(sum(t.amount) FILTER (t.status = 'realizado'), 0))::BIGINT
           AS realized_balance,
       (a.opening_balance + coalesce(sum(t.amount), 0))::BIGINT AS projected_balance,
       coalesce(sum(t.amount) FILTER (t.status = 'previsto'
           AND t.booking_date < DATE '{AS_OF}'), 0)::BIGINT AS overdue_amount,
       count(t.id) FILTER (t.status = 'realizado' AND t.reconciliation = 'nao_conciliado')
           AS unreconciled_count
       FROM accounts a LEFT JOIN transactions t ON t.bank_account_id = a.bank_account_id
       GROUP BY a.bank_account_id, a.company_id, a.name, a.kind, a.is_active, a.opening_balance,
                a.opening_balance_date, a.minimum_balance""",
)
def account_balances(m: Model):
    return bal.account_balances(m.accounts, m.transactions, AS_OF)


@query(
    "account_movement_join",
    "accounts transactions",
    """SELECT a.bank_account_id, count(t.id) AS entry_count, count(t.id) > 0 AS has_movement
       FROM accounts a LEFT JOIN transactions t USING (bank_account_id) GROUP BY 1""",
)
def account_movement_join(m: Model):
    from razao.operators.lookups import account_movement_join as join

    return join(m.accounts, m.transactions).select("bank_account_id", "entry_count", "has_movement")


_CUT = """FROM accounts a LEFT JOIN transactions t
    ON t.bank_account_id = a.bank_account_id AND t.booking_date >= a.opening_balance_date"""


@query(
    "balance_on",
    "accounts transactions",
    f"""SELECT a.bank_account_id, a.company_id,
       CASE WHEN a.opening_balance_date > DATE '1995-09-30' THEN 0 ELSE a.opening_balance
            + coalesce(sum(t.amount) FILTER (t.status = 'realizado'
              AND t.booking_date <= DATE '1995-09-30'), 0) END::BIGINT AS balance
       {_CUT} GROUP BY a.bank_account_id, a.company_id, a.opening_balance, a.opening_balance_date""",
)
def balance_on(m: Model):
    return bal.balance_on(m.accounts, m.transactions, "1995-09-30")


_CURRENT = f"""SELECT a.bank_account_id, a.company_id,
       (a.opening_balance + coalesce(sum(t.amount) FILTER (t.status = 'realizado'), 0))::BIGINT
           AS current,
       (a.opening_balance + coalesce(sum(t.amount), 0))::BIGINT AS projected
       {_CUT} GROUP BY a.bank_account_id, a.company_id, a.opening_balance"""


@query("current_balance", "accounts transactions", _CURRENT)
def current_balance(m: Model):
    return bal.current_balance(m.accounts, m.transactions)


@query(
    "consolidate",
    "accounts transactions",
    f""", c AS ({_CURRENT}) SELECT company_id, bank_account_id, sum(current)::BIGINT AS current,
       sum(projected)::BIGINT AS projected FROM c
       GROUP BY GROUPING SETS ((company_id, bank_account_id), (company_id))""",
)
def consolidate(m: Model):
    return bal.consolidate(m.accounts, m.transactions)


_LATEST = """, latest AS (
    SELECT bank_account_id, statement_balance AS declared_balance,
           statement_balance_date AS declared_date
    FROM imports WHERE statement_balance IS NOT NULL AND statement_balance_date IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY bank_account_id
        ORDER BY statement_balance_date DESC, created_at DESC, id DESC) = 1) """


@query(
    "latest_declared_balance",
    "imports",
    _LATEST + """SELECT bank_account_id, declared_balance, declared_date::VARCHAR AS declared_date
       FROM latest""",
)
def latest_declared_balance(m: Model):
    return bal.latest_declared_balance(m.imports)


_PROOF = _LATEST + """, proof AS (
    SELECT a.bank_account_id, a.company_id, l.declared_balance, l.declared_date,
           CASE WHEN l.declared_date < a.opening_balance_date THEN 0
                ELSE a.opening_balance + coalesce(sum(t.amount), 0) END::BIGINT AS computed_balance
    FROM accounts a JOIN latest l USING (bank_account_id)
    LEFT JOIN transactions t ON t.bank_account_id = a.bank_account_id AND t.status = 'realizado'
      AND t.booking_date BETWEEN a.opening_balance_date AND l.declared_date
    GROUP BY a.bank_account_id, a.company_id, l.declared_balance, l.declared_date,
             a.opening_balance, a.opening_balance_date) """


@query(
    "check_balance",
    "accounts transactions",
    f"""SELECT a.bank_account_id, a.company_id, 0::BIGINT AS declared_balance,
       '1999-06-30' AS declared_date,
       (a.opening_balance + coalesce(sum(t.amount) FILTER (t.status = 'realizado'
           AND t.booking_date <= DATE '1999-06-30'), 0))::BIGINT AS computed_balance,
       (a.opening_balance + coalesce(sum(t.amount) FILTER (t.status = 'realizado'
           AND t.booking_date <= DATE '1999-06-30'), 0))::BIGINT AS diff
       {_CUT} GROUP BY a.bank_account_id, a.company_id, a.opening_balance""",
)
def check_balance(m: Model):
    declared = m.accounts.select(
        "bank_account_id",
        F.lit(0).cast("bigint").alias("declared_balance"),
        dates.day("1999-06-30").alias("declared_date"),
    )
    return bal.check_balance(m.accounts, m.transactions, declared)


@query(
    "balance_proof",
    "accounts transactions imports",
    _PROOF + """SELECT bank_account_id, company_id, declared_balance,
       declared_date::VARCHAR AS declared_date, computed_balance,
       computed_balance - declared_balance AS diff FROM proof""",
)
def balance_proof(m: Model):
    return bal.balance_proof(m.accounts, m.transactions, m.imports)


@query(
    "daily_movement",
    "transactions",
    """SELECT company_id, bank_account_id, booking_date::VARCHAR AS booking_date, status,
       sum(amount)::BIGINT AS net_amount, sum(amount) FILTER (amount > 0)::BIGINT AS inflow,
       sum(amount) FILTER (amount < 0)::BIGINT AS outflow, count(*) AS entry_count
       FROM transactions GROUP BY ALL""",
)
def daily_movement(m: Model):
    return bal.daily_movement(m.transactions)


_SUMMARY = """, summary AS (
    SELECT t.company_id, date_trunc('month', booking_date)::DATE::VARCHAR AS period_cash,
           date_trunc('month', competence_date)::DATE::VARCHAR AS period_accrual, category_id,
           c.name AS category_name, direction, status, sum(amount)::BIGINT AS total_amount,
           count(*) AS entry_count
    FROM transactions t LEFT JOIN categories c ON c.id = t.category_id
    WHERE NOT is_transfer GROUP BY ALL) """


@query("category_summary", "transactions categories", _SUMMARY + "SELECT * FROM summary")
def category_summary(m: Model):
    return bal.category_summary(m.transactions, m.categories)


@query(
    "category_join",
    "transactions categories",
    """SELECT t.id, c.name AS category_name FROM transactions t
       LEFT JOIN categories c ON c.id = t.category_id""",
)
def category_join(m: Model):
    from razao.operators.lookups import lookup

    return lookup(m.transactions, m.categories, "category_id", "id", "name", "category_name").select(
        "id", "category_name"
    )


@query(
    "category_report",
    "transactions categories",
    _SUMMARY + """SELECT *, sum(total_amount) OVER (PARTITION BY company_id, direction)::BIGINT
       AS side_total FROM summary WHERE period_accrual = '1999-03-01' AND status = 'realizado'""",
)
def category_report(m: Model):
    return bal.category_report(m.transactions, m.categories, "1999-03-01", accrual=True)


@query(
    "month_totals",
    "transactions",
    """SELECT company_id, coalesce(sum(amount) FILTER (amount > 0), 0)::BIGINT AS inflow,
       coalesce(sum(amount) FILTER (amount < 0), 0)::BIGINT AS outflow
       FROM transactions WHERE NOT is_transfer AND status = 'realizado'
         AND booking_date BETWEEN DATE '1999-12-01' AND DATE '1999-12-28' GROUP BY company_id""",
)
def month_totals(m: Model):
    return bal.month_totals(m.transactions, "1999-12-28")


@query(
    "closing_snapshot",
    "accounts transactions closings",
    """SELECT c.id AS closing_id, a.bank_account_id,
       (a.opening_balance + coalesce(sum(t.amount), 0))::BIGINT AS closing_balance
       FROM closings c JOIN accounts a USING (company_id)
       LEFT JOIN transactions t ON t.bank_account_id = a.bank_account_id
         AND t.status = 'realizado' AND t.booking_date <= last_day(c.period)
       WHERE c.locked_at IS NOT NULL GROUP BY c.id, a.bank_account_id, a.opening_balance""",
)
def closing_snapshot(m: Model):
    periods = m.closings.where("locked_at IS NOT NULL").withColumnRenamed("id", "closing_id")
    return bal.closing_snapshot(m.accounts, m.transactions, periods)


def _bucket(test: str, name: str) -> str:
    return (
        f"coalesce(sum(amount) FILTER ({test}), 0)::BIGINT AS {name}, "
        f"count(*) FILTER ({test}) AS {name}_count"
    )


@query(
    "planned_split",
    "transactions",
    "SELECT company_id, "
    + ", ".join(
        _bucket(f"booking_date {when} DATE '{AS_OF}' AND amount {sign} 0", name)
        for when, sign, name in (
            ("<", ">", "overdue_in"),
            ("<", "<=", "overdue_out"),
            (">=", ">", "upcoming_in"),
            (">=", "<=", "upcoming_out"),
        )
    )
    + " FROM transactions WHERE status = 'previsto' GROUP BY company_id",
)
def planned_split(m: Model):
    return bal.planned_split(m.transactions, AS_OF)


@query(
    "category_usage",
    "transactions",
    """SELECT company_id, category_id, direction, count(*) AS uses FROM transactions
       WHERE category_id IS NOT NULL GROUP BY ALL""",
)
def category_usage(m: Model):
    return bal.category_usage(m.transactions)


@query(
    "earliest_booking",
    "transactions accounts",
    """SELECT bank_account_id, min(t.booking_date)::VARCHAR AS first_booking,
       min(t.booking_date) >= any_value(a.opening_balance_date) AS opening_ok
       FROM transactions t JOIN accounts a USING (bank_account_id) GROUP BY bank_account_id""",
)
def earliest_booking(m: Model):
    first = bal.earliest_booking(m.transactions).drop("company_id")
    return first.join(m.accounts, "bank_account_id").select(
        "bank_account_id",
        "first_booking",
        (F.col("first_booking") >= F.col("opening_balance_date")).alias("opening_ok"),
    )


@query(
    "transfer_check",
    "transactions",
    """SELECT transfer_group_id, count(*) AS legs, sum(amount)::BIGINT AS total,
       count(DISTINCT bank_account_id) = 1 AS same_account
       FROM transactions WHERE transfer_group_id IS NOT NULL GROUP BY 1
       HAVING count(*) <> 2 OR sum(amount) <> 0 OR count(DISTINCT bank_account_id) <> 2""",
)
def transfer_check(m: Model):
    return bal.transfer_check(m.transactions)


@query(
    "safe_sum",
    "transactions",
    "SELECT company_id, sum(amount)::BIGINT AS total FROM transactions GROUP BY company_id",
)
def safe_sum(m: Model):
    return bal.total_movement(m.transactions)


# Series


@query(
    "date_spine",
    "accounts",
    """SELECT bank_account_id, d::DATE::VARCHAR AS date FROM accounts,
       unnest(generate_series(opening_balance_date, DATE '1995-02-28', INTERVAL 1 DAY)) u(d)""",
)
def date_spine(m: Model):
    return ser.date_spine(
        m.accounts, F.col("opening_balance_date"), dates.day("1995-02-28")
    ).select("bank_account_id", "date")


@query(
    "daily_balances",
    "accounts transactions",
    """, spine AS (
        SELECT a.*, d::DATE AS date FROM accounts a, unnest(generate_series(
            greatest(DATE '1995-12-01', opening_balance_date), DATE '1996-01-31', INTERVAL 1 DAY)) u(d)),
    moved AS (
        SELECT t.bank_account_id, t.booking_date AS date, sum(amount) AS net,
               sum(amount) FILTER (amount > 0) AS inflow, sum(amount) FILTER (amount < 0) AS outflow,
               count(*) AS n
        FROM transactions t JOIN accounts a USING (bank_account_id)
        WHERE t.status = 'realizado' AND t.booking_date >= a.opening_balance_date GROUP BY 1, 2),
    carried AS (
        SELECT m.bank_account_id, sum(net) AS before FROM moved m JOIN accounts a USING (bank_account_id)
        WHERE m.date < greatest(DATE '1995-12-01', a.opening_balance_date) GROUP BY 1)
    SELECT s.company_id, s.bank_account_id, s.date::VARCHAR AS date,
           coalesce(inflow, 0)::BIGINT AS inflow, coalesce(outflow, 0)::BIGINT AS outflow,
           coalesce(net, 0)::BIGINT AS net, coalesce(n, 0)::BIGINT AS entry_count,
           (s.opening_balance + coalesce(before, 0) + sum(coalesce(net, 0)) OVER (
               PARTITION BY s.bank_account_id ORDER BY s.date))::BIGINT AS balance
    FROM spine s LEFT JOIN moved m ON m.bank_account_id = s.bank_account_id AND m.date = s.date
    LEFT JOIN carried c ON c.bank_account_id = s.bank_account_id""",
)
def daily_balances(m: Model):
    return ser.daily_balances(m.accounts, m.transactions, "1995-12-01", "1996-01-31")


def _projection_sql(days: int) -> str:
    """Projection of all companies from the current balances and the planned rows."""
    return f""", openings AS (
        SELECT company_id, sum(opening_balance) + coalesce((SELECT sum(amount) FROM transactions t
            WHERE t.company_id = a.company_id AND status = 'realizado'
              AND booking_date <= DATE '{AS_OF}'), 0) AS opening
        FROM accounts a GROUP BY company_id),
    entries AS (
        SELECT company_id, greatest(booking_date, DATE '{AS_OF}') AS date, amount,
               booking_date < DATE '{AS_OF}' AS overdue
        FROM transactions WHERE status = 'previsto'),
    moved AS (
        SELECT company_id, date, sum(amount) FILTER (amount > 0) AS inflow,
               sum(amount) FILTER (amount < 0) AS outflow, sum(amount) AS net,
               sum(amount) FILTER (overdue) AS overdue
        FROM entries GROUP BY ALL),
    days AS (
        SELECT o.company_id, d::DATE AS date, coalesce(inflow, 0)::BIGINT AS inflow,
               coalesce(outflow, 0)::BIGINT AS outflow, coalesce(net, 0)::BIGINT AS net,
               coalesce(overdue, 0)::BIGINT AS overdue_brought_forward,
               (o.opening + sum(coalesce(net, 0)) OVER (PARTITION BY o.company_id ORDER BY d))::BIGINT
                   AS balance
        FROM openings o CROSS JOIN unnest(generate_series(DATE '{AS_OF}', DATE '{AS_OF}' + {days},
            INTERVAL 1 DAY)) u(d)
        LEFT JOIN moved m ON m.company_id = o.company_id AND m.date = d::DATE) """


HOLIDAYS_2000 = "'2000-03-06', '2000-03-07', '2000-04-21', '2000-06-22', '2000-01-01', '2000-05-01'"
_BUSINESS = f"(isodow(date) < 6 AND date::VARCHAR NOT IN ({HOLIDAYS_2000}))"


def _projection(m: Model, days: int):
    balances = bal.account_balances(m.accounts, m.transactions, AS_OF)
    openings = balances.groupBy("company_id").agg(
        F.sum("current_balance").alias("opening_balance"),
        F.lit(None).cast("bigint").alias("minimum_balance"),
    )
    planned = m.transactions.where("status = 'previsto'")
    return openings, planned


@query(
    "project",
    "accounts transactions",
    _projection_sql(60) + f"""SELECT company_id, date::VARCHAR AS date, {_BUSINESS} AS is_business_day,
       inflow, outflow, net, balance, overdue_brought_forward, balance < 0 AS below_minimum,
       balance < 0 AS negative FROM days""",
)
def project(m: Model):
    openings, planned = _projection(m, 60)
    return ser.project(openings, planned, AS_OF, F.date_add(dates.day(AS_OF), 60))


_SUMMARY_SQL = """arg_max(balance, date) AS final_balance, min(balance) AS lowest_balance,
       arg_min(date, (balance, date))::VARCHAR AS lowest_balance_date,
       (min(date) FILTER (balance < 0))::VARCHAR AS first_negative_date,
       (min(date) FILTER (balance < 0))::VARCHAR AS first_below_minimum_date,
       sum(inflow)::BIGINT AS total_inflow, sum(outflow)::BIGINT AS total_outflow,
       sum(overdue_brought_forward)::BIGINT AS overdue_brought_forward"""


@query(
    "projection_summary",
    "accounts transactions",
    _projection_sql(60) + f"SELECT company_id, {_SUMMARY_SQL} FROM days GROUP BY company_id",
)
def projection_summary(m: Model):
    return ser.projection_summary(project(m))


@query(
    "project_horizon",
    "accounts transactions",
    _projection_sql(90) + f"""SELECT company_id, h::INTEGER AS horizon, {_SUMMARY_SQL}
       FROM days, (VALUES (30), (60), (90)) v(h) WHERE date <= DATE '{AS_OF}' + h
       GROUP BY company_id, h""",
)
def project_horizon(m: Model):
    openings, planned = _projection(m, 90)
    return ser.project_horizon(openings, planned, AS_OF)


@query(
    "bring_forward",
    "accounts transactions",
    _projection_sql(30) + """SELECT company_id, date::VARCHAR AS date, overdue_brought_forward, net
       FROM days WHERE overdue_brought_forward <> 0""",
)
def bring_forward(m: Model):
    openings, planned = _projection(m, 30)
    days = ser.project(openings, planned, AS_OF, F.date_add(dates.day(AS_OF), 30))
    return days.where("overdue_brought_forward <> 0").select(
        "company_id", "date", "overdue_brought_forward", "net"
    )


@query(
    "cash_alert",
    "accounts transactions",
    _projection_sql(30) + """SELECT company_id, min(date)::VARCHAR AS first_negative_date,
       min(balance) AS lowest_balance FROM days GROUP BY company_id HAVING min(balance) < 0"""
    .replace("min(date)", "min(date) FILTER (balance < 0)").replace(
        "min(date) FILTER (balance < 0)::", "(min(date) FILTER (balance < 0))::"
    ),
)
def cash_alert(m: Model):
    from razao.plans.dashboard import cash_alert as alert

    return alert(m.accounts, m.transactions, AS_OF)


@query(
    "cash_flow_report",
    "accounts transactions",
    f""", openings AS (
        SELECT company_id, sum(opening_balance) + coalesce((SELECT sum(amount) FROM transactions t
            WHERE t.company_id = a.company_id AND status = 'realizado'
              AND booking_date < DATE '1999-02-01'), 0) AS opening
        FROM accounts a GROUP BY company_id),
    moved AS (SELECT company_id, booking_date AS date, sum(amount) FILTER (amount > 0) AS inflow,
                     sum(amount) FILTER (amount < 0) AS outflow, sum(amount) AS net
              FROM transactions WHERE status = 'realizado' GROUP BY ALL)
    SELECT o.company_id, d::DATE::VARCHAR AS date, coalesce(inflow, 0)::BIGINT AS inflow,
           coalesce(outflow, 0)::BIGINT AS outflow, coalesce(net, 0)::BIGINT AS net,
           (opening + sum(coalesce(net, 0)) OVER (PARTITION BY o.company_id ORDER BY d))::BIGINT
               AS balance
    FROM openings o CROSS JOIN unnest(generate_series(DATE '1999-02-01', DATE '1999-04-30',
        INTERVAL 1 DAY)) u(d)
    LEFT JOIN moved m ON m.company_id = o.company_id AND m.date = d::DATE""",
)
def cash_flow_report(m: Model):
    return ser.cash_flow_report(m.accounts, m.transactions, "1999-02-01", "1999-04-30").select(
        "company_id", "date", "inflow", "outflow", "net", "balance"
    )


@query(
    "monthly_evolution",
    "accounts transactions",
    """, active AS (SELECT * FROM accounts WHERE is_active),
    scoped AS (SELECT t.* FROM transactions t JOIN active USING (bank_account_id)
               WHERE status = 'realizado' AND booking_date <= DATE '1999-12-20'),
    months AS (SELECT unnest(generate_series(DATE '1999-01-01', DATE '1999-12-01',
        INTERVAL 1 MONTH))::DATE AS month),
    openings AS (SELECT company_id, sum(opening_balance) + coalesce((SELECT sum(amount) FROM scoped t
            WHERE t.company_id = a.company_id AND booking_date < DATE '1999-01-01'), 0) AS opening
        FROM active a GROUP BY company_id),
    flows AS (SELECT company_id, date_trunc('month', booking_date)::DATE AS month,
                     sum(amount) FILTER (amount > 0) AS inflow, sum(amount) FILTER (amount < 0) AS outflow,
                     sum(amount) AS net
              FROM scoped WHERE NOT is_transfer AND booking_date >= DATE '1999-01-01' GROUP BY ALL)
    SELECT o.company_id, m.month::VARCHAR AS month, coalesce(inflow, 0)::BIGINT AS inflow,
           coalesce(outflow, 0)::BIGINT AS outflow, coalesce(net, 0)::BIGINT AS result,
           (opening + sum(coalesce(net, 0)) OVER (PARTITION BY o.company_id ORDER BY m.month))::BIGINT
               AS balance
    FROM openings o CROSS JOIN months m
    LEFT JOIN flows f ON f.company_id = o.company_id AND f.month = m.month""",
)
def monthly_evolution(m: Model):
    return ser.monthly_evolution(m.accounts, m.transactions, "1999-12-20", 12)


