"""Queries: recurrences, decision jobs, data quality and the audit trail."""

from __future__ import annotations

from pyspark.sql import functions as F

from razao.adapters import AS_OF, Model
from razao.catalog.base import query
from razao.catalog.ledger import _BALANCES, _LOCKED, _STATE
from razao.operators import audit, quality
from razao.operators import decisions as dec
from razao.operators import recurrences as rec
from razao.operators.filters import transaction_state

# Recurrences: the oracle walks the months one by one.
_STEPS = """WITH RECURSIVE recurrences AS ({model}), walk AS (
    SELECT id, frequency, day_of_month, start_date, start_date AS d, 0 AS k FROM recurrences
    UNION ALL
    SELECT id, frequency, day_of_month, start_date,
           CASE frequency WHEN 'semanal' THEN d + 7 WHEN 'quinzenal' THEN d + 14 ELSE CAST(
               date_trunc('month', d) + to_months(CASE frequency WHEN 'anual' THEN 12 ELSE 1 END) AS DATE)
               + least(coalesce(day_of_month, day(d)), day(last_day(CAST(date_trunc('month', d)
                   + to_months(CASE frequency WHEN 'anual' THEN 12 ELSE 1 END) AS DATE))))::INTEGER - 1
           END, k + 1
    FROM walk WHERE d <= DATE '2000-12-31') """


def _steps() -> str:
    from razao.catalog.model_sql import MODEL

    return _STEPS.replace("{model}", MODEL["recurrences"])


@query(
    "expand_recurrence",
    sql=_steps() + """SELECT w.id, w.d::VARCHAR AS booking_date, r.amount FROM walk w
       JOIN recurrences r USING (id) WHERE w.d BETWEEN DATE '1999-01-01' AND least(
           coalesce(r.end_date, DATE '2000-12-31'), DATE '2000-12-31')""",
)
def expand_recurrence(m: Model):
    rows = rec.expand_recurrences(m.recurrences, "1999-01-01", "2000-12-31")
    return rows.select("id", "booking_date", "amount")


_GENERATED = _steps() + f""", due AS (SELECT *, coalesce(generated_until + 1, start_date) AS begin
        FROM recurrences WHERE is_active AND start_date <= DATE '2000-02-29'),
    planned AS (SELECT w.id AS recurrence_id, w.d AS booking_date FROM walk w JOIN due r USING (id)
        WHERE w.d BETWEEN begin AND least(coalesce(r.end_date, DATE '2000-02-29'), DATE '2000-02-29')),
    existing AS (SELECT DISTINCT o_orderkey % 100 AS recurrence_id, CAST(o_orderdate AS DATE) AS booking_date
                 FROM orders WHERE o_orderkey % 13 = 0) """


@query(
    "generate_planned",
    sql=_GENERATED + """SELECT recurrence_id, booking_date::VARCHAR AS booking_date,
       e.recurrence_id IS NULL AS created FROM planned p
       LEFT JOIN existing e USING (recurrence_id, booking_date)""".replace("e.recurrence_id IS NULL", "e.found IS NULL")
    .replace("LEFT JOIN existing e", "LEFT JOIN (SELECT *, 1 AS found FROM existing) e"),
)
def generate_planned(m: Model):
    rows, existed, _ = rec.generate_planned(m.recurrences, m.transactions, AS_OF)
    columns = ("recurrence_id", "booking_date")
    return rows.select(*columns, F.lit(True).alias("created")).unionByName(
        existed.select(*columns, F.lit(False).alias("created"))
    )


# Decisions. Requests come from the lines themselves, some of them wrong on purpose.


def _requests(rows, key: str, **columns):
    """Requests with an id and a time; every request's second copy comes later."""
    return rows.select(
        F.col(key).alias("decision_id"),
        (F.lit("2000-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col(key) % 500).cast("int"))).alias(
            "requested_at"
        ),
        *[value.alias(name) for name, value in columns.items()],
    )


_FIRST = """row_number() OVER (PARTITION BY {0}, reason IS NULL ORDER BY decision_id % 500, decision_id) = 1"""

_RECONCILE = """, asked AS (SELECT id AS decision_id, id - id % 3 AS line_id,
        CASE WHEN id % 6 = 0 THEN id - id % 3 + 1 ELSE id - id % 3 END AS transaction_id
        FROM statement_lines),
    judged AS (SELECT a.*, CASE WHEN l.id IS NULL THEN 'line_not_found'
            WHEN l.status <> 'pendente' THEN 'line_already_handled'
            WHEN t.id IS NULL THEN 'transaction_not_found'
            WHEN t.bank_account_id <> l.bank_account_id THEN 'other_account'
            WHEN t.reconciliation = 'conciliado' THEN 'transaction_already_reconciled'
            WHEN t.reconciliation <> 'nao_conciliado' THEN 'transaction_not_open' END AS reason
        FROM asked a LEFT JOIN statement_lines l ON l.id = a.line_id
        LEFT JOIN transactions t ON t.id = a.transaction_id),
    by_line AS (SELECT * EXCLUDE (reason), CASE WHEN reason IS NULL AND NOT """ + _FIRST.format("line_id") + """
            THEN 'line_taken_in_batch' ELSE reason END AS reason FROM judged),
    final AS (SELECT * EXCLUDE (reason), CASE WHEN reason IS NULL AND NOT """ + _FIRST.format("transaction_id") + """
            THEN 'transaction_taken_in_batch' ELSE reason END AS reason FROM by_line) """


def _reconcile(m: Model):
    key = F.col("id")
    home = key - key % 3
    asked = _requests(
        m.statement_lines, "id", line_id=home, transaction_id=F.when(key % 6 == 0, home + 1).otherwise(home)
    )
    return dec.reconcile(asked, m.statement_lines, m.transactions)


@query(
    "apply_reconcile",
    "statement_lines transactions",
    _RECONCILE + "SELECT decision_id, line_id, transaction_id, reason AS reject_reason FROM final",
)
def apply_reconcile(m: Model):
    return _reconcile(m)


@query(
    "reconciled_state",
    "statement_lines transactions",
    _RECONCILE + """SELECT l.id, CASE WHEN f.line_id IS NOT NULL THEN 'conciliada' ELSE l.status END AS status,
       coalesce(f.transaction_id, l.matched_transaction_id) AS matched_transaction_id
       FROM statement_lines l LEFT JOIN final f ON f.line_id = l.id AND f.reason IS NULL""",
)
def reconciled_state(m: Model):
    return dec.reconciled_lines(m.statement_lines, _reconcile(m)).select(
        "id", "status", "matched_transaction_id"
    )


_LINE_LOCKED = _LOCKED.replace("t.company_id", "l.company_id").replace("t.booking_date", "l.posted_at")


def _line_requests(m: Model):
    return m.statement_lines, F.col("id") - F.col("id") % 2


@query(
    "apply_unreconcile",
    "statement_lines transactions closings",
    f""", judged AS (SELECT a.id AS decision_id, a.id - a.id % 2 AS line_id, l.matched_transaction_id
            AS transaction_id, CASE WHEN l.id IS NULL THEN 'line_not_found'
            WHEN l.status <> 'conciliada' THEN 'line_not_reconciled'
            WHEN {_LOCKED} THEN 'month_closed' END AS reason
        FROM statement_lines a
        LEFT JOIN statement_lines l ON l.id = a.id - a.id % 2
        LEFT JOIN transactions t ON t.id = l.matched_transaction_id)
    SELECT decision_id, line_id, transaction_id, CASE WHEN reason IS NULL AND NOT {_FIRST.format('line_id')}
           THEN 'line_taken_in_batch' ELSE reason END AS reject_reason FROM judged""",
)
def apply_unreconcile(m: Model):
    rows, line = _line_requests(m)
    return dec.unreconcile(
        _requests(rows, "id", line_id=line), m.statement_lines, m.transactions, m.closings
    )


_CREATE = f""", judged AS (SELECT a.id AS decision_id, a.id - a.id % 2 AS line_id, l.company_id,
            l.bank_account_id, l.posted_at, l.amount, l.memo, a.id % 5 AS g,
            CASE WHEN l.id IS NULL THEN 'line_not_found'
            WHEN l.status <> 'pendente' THEN 'line_already_handled'
            WHEN {_LINE_LOCKED} THEN 'month_closed' END AS reason
        FROM statement_lines a
        LEFT JOIN statement_lines l ON l.id = a.id - a.id % 2) """


@query(
    "create_from_line",
    "statement_lines closings",
    _CREATE + f"""SELECT decision_id, line_id, company_id, bank_account_id, posted_at::VARCHAR AS booking_date,
       amount, CASE WHEN g = 0 THEN 'Texto dado' ELSE coalesce(memo, 'Movimento sem descricao') END
           AS description,
       CASE WHEN reason IS NULL AND NOT {_FIRST.format('line_id')} THEN 'line_taken_in_batch'
            ELSE reason END AS reject_reason FROM judged""",
)
def create_from_line(m: Model):
    rows, line = _line_requests(m)
    asked = _requests(
        rows,
        "id",
        line_id=line,
        category_id=F.col("company_id") * 10 + 1,
        description=F.when(F.col("id") % 5 == 0, " Texto dado ").otherwise(" "),
        rule_id=F.lit(None).cast("bigint"),
    )
    judged = dec.create_from_line(asked, m.statement_lines, m.closings)
    return judged.select(
        "decision_id", "line_id", "company_id", "bank_account_id", "booking_date", "amount",
        "description", "reject_reason",
    )


@query(
    "undo_from_line",
    "statement_lines transactions settlements closings",
    f""", judged AS (SELECT l.id AS decision_id, l.id AS line_id, l.matched_transaction_id AS transaction_id,
            CASE WHEN l.status <> 'criada' THEN 'nothing_created'
                 WHEN {_LOCKED} THEN 'month_closed'
                 WHEN EXISTS (SELECT 1 FROM settlements s WHERE s.transaction_id = t.id)
                 THEN 'has_settlement' END AS reject_reason
        FROM statement_lines l LEFT JOIN transactions t ON t.id = l.matched_transaction_id)
    SELECT * FROM judged""",
)
def undo_from_line(m: Model):
    asked = _requests(m.statement_lines, "id", line_id=F.col("id"))
    return dec.undo_from_line(asked, m.statement_lines, m.transactions, m.settlements, m.closings)


@query(
    "ignore_line",
    "statement_lines",
    f""", judged AS (SELECT id AS decision_id, id - id % 2 AS line_id, CASE WHEN id % 7 = 1 THEN '' ELSE 'repetida' END
            AS ignored_reason FROM statement_lines),
    reasons AS (SELECT j.*, CASE WHEN j.ignored_reason = '' THEN 'reason_required' WHEN l.id IS NULL
            THEN 'line_not_found' WHEN l.status <> 'pendente' THEN 'line_already_handled' END AS reason
        FROM (SELECT decision_id, line_id, ignored_reason FROM judged) j
        LEFT JOIN statement_lines l ON l.id = j.line_id),
    final AS (SELECT decision_id, line_id, ignored_reason, CASE WHEN reason IS NULL AND NOT
            {_FIRST.format('line_id')} THEN 'line_taken_in_batch' ELSE reason END AS reject_reason FROM reasons)
    SELECT *, CASE WHEN reject_reason IS NULL THEN 'ignorada' END AS new_status FROM final""",
)
def ignore_line(m: Model):
    rows, line = _line_requests(m)
    asked = _requests(
        rows, "id", line_id=line, reason=F.when(F.col("id") % 7 == 1, " ").otherwise("repetida")
    )
    return dec.ignore_line(asked, m.statement_lines)


_ALLOCATED = _BALANCES + f""", asked AS (SELECT id AS decision_id, id AS transaction_id,
        i AS n, CASE i WHEN 0 THEN id - id % 4 ELSE id - id % 4 + 1 END AS invoice_id,
        amount // CASE WHEN id % 3 = 0 THEN 1 ELSE 3 END AS amount
        FROM transactions, range(0, 2) r(i) WHERE amount > 0 AND (i = 0 OR id % 5 = 0)),
    rows AS (SELECT a.*, t.company_id, t.amount AS credit, b.outstanding_amount,
        CASE WHEN t.status <> 'realizado' THEN 'transaction_not_realized'
             WHEN {_LOCKED} THEN 'month_closed' WHEN a.amount <= 0 THEN 'amount_not_positive'
             WHEN b.id IS NULL OR b.company_id <> t.company_id THEN 'invoice_not_found'
             WHEN b.status = 'cancelada' THEN 'invoice_cancelled'
             WHEN EXISTS (SELECT 1 FROM settlements s WHERE s.invoice_id = a.invoice_id
                          AND s.transaction_id = a.transaction_id) THEN 'invoice_repeated' END AS own
        FROM asked a JOIN transactions t ON t.id = a.transaction_id
        LEFT JOIN balances b ON b.id = a.invoice_id),
    alone AS (SELECT decision_id, coalesce(min(own), CASE WHEN sum(amount) > max(credit) THEN 'over_credit' END)
            AS own, decision_id - decision_id % 4 AS h,
            coalesce(sum(amount) FILTER (n = 0), 0) AS a0, coalesce(sum(amount) FILTER (n = 1), 0) AS a1
        FROM rows GROUP BY decision_id),
    queue AS (SELECT a.*, row_number() OVER (PARTITION BY h ORDER BY decision_id % 500, decision_id) AS k,
            b0.outstanding_amount AS o0, b1.outstanding_amount AS o1
        FROM alone a LEFT JOIN balances b0 ON b0.id = h LEFT JOIN balances b1 ON b1.id = h + 1),
    walk AS (SELECT h, 0::BIGINT AS k, 0::HUGEINT AS u0, 0::HUGEINT AS u1, NULL::BIGINT AS decision_id,
            NULL::VARCHAR AS reject_reason FROM queue GROUP BY h
        UNION ALL
        SELECT h, k, CASE WHEN why IS NULL THEN u0 + a0 ELSE u0 END, CASE WHEN why IS NULL THEN u1 + a1 ELSE u1 END,
            decision_id, why FROM (SELECT q.*, u0, u1, coalesce(own, CASE WHEN (a0 > 0 AND u0 + a0 > o0)
                OR (a1 > 0 AND u1 + a1 > o1) THEN 'over_outstanding' END) AS why
            FROM walk w JOIN queue q ON q.h = w.h AND q.k = w.k + 1)),
    used AS (SELECT * FROM rows),
    verdict AS (SELECT decision_id, reject_reason FROM walk WHERE decision_id IS NOT NULL) """


def _settle(m: Model):
    key = F.col("id")
    size = F.when(key % 3 == 0, 1).otherwise(3)
    share = ((F.col("amount") - F.col("amount") % size) / size).cast("bigint")
    places = F.when(key % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = m.transactions.where("amount > 0").select("id", "amount", F.explode(places).alias("n"))
    asked = _requests(
        rows, "id", transaction_id=key, invoice_id=key - key % 4 + F.col("n"), amount=share
    )
    return dec.settle_invoices(asked, m.transactions, m.invoices, m.settlements, m.closings)


@query(
    "settle_invoices",
    "transactions invoices settlements closings",
    _ALLOCATED + """SELECT u.decision_id, u.transaction_id, u.invoice_id, u.amount, v.reject_reason
       FROM used u JOIN verdict v USING (decision_id)""",
)
def settle_invoices(m: Model):
    return _settle(m).drop("company_id")


@query(
    "invoice_status",
    "invoices settlements",
    _BALANCES + """SELECT id, CASE WHEN status = 'cancelada' THEN 'cancelada' WHEN received_amount = 0
       THEN 'aberta' WHEN amount <= received_amount THEN 'recebida' ELSE 'recebida_parcial' END AS status
       FROM balances""",
)
def invoice_status(m: Model):
    return dec.invoice_status(m.invoices, m.settlements).select("id", "status")


@query(
    "unsettle_invoice",
    "settlements transactions closings",
    f"""SELECT s.id AS decision_id, s.id AS settlement_id, s.invoice_id, CASE WHEN t.id IS NOT NULL
           AND {_LOCKED} THEN 'month_closed' END AS reject_reason
       FROM settlements s LEFT JOIN transactions t ON t.id = s.transaction_id""",
)
def unsettle_invoice(m: Model):
    asked = _requests(m.settlements, "id", settlement_id=F.col("id"))
    return dec.unsettle(asked, m.settlements, m.transactions, m.closings)


@query(
    "settle_planned",
    "transactions closings",
    f""", asked AS (SELECT *, booking_date + 40 AS new_date, CASE WHEN id % 7 = 0 THEN -amount
            WHEN id % 7 = 1 THEN NULL ELSE amount + 100 * sign(amount)::BIGINT END AS new_amount
        FROM transactions)
    SELECT t.id AS decision_id, t.id AS transaction_id, new_date::VARCHAR AS booking_date,
           coalesce(new_amount, amount)::BIGINT AS amount,
           CASE WHEN status <> 'previsto' THEN 'not_planned' WHEN is_transfer THEN 'transfer'
                WHEN {_LOCKED} OR {_LOCKED.replace('t.booking_date', 't.new_date')} THEN 'month_closed'
                WHEN sign(coalesce(new_amount, amount)) <> sign(amount) THEN 'sign_changed' END
               AS reject_reason
    FROM asked t""",
)
def settle_planned(m: Model):
    key, amount = F.col("id"), F.col("amount")
    changed = F.when(key % 7 == 0, -amount).when(key % 7 == 1, None).otherwise(
        amount + 100 * F.signum(amount).cast("bigint")
    )
    asked = _requests(
        m.transactions, "id", transaction_id=key, new_date=F.date_add("booking_date", 40), new_amount=changed
    )
    return dec.settle_planned(asked, m.transactions, m.closings)


@query(
    "unsettle_planned",
    "transactions settlements closings",
    _STATE + """SELECT id AS decision_id, id AS transaction_id, CASE WHEN status <> 'realizado' THEN 'not_realized'
       WHEN reconciled THEN 'conciliado' WHEN has_settlement THEN 'baixaDeNota'
       WHEN is_transfer THEN 'transferencia' WHEN period_locked THEN 'mesFechado' END AS reject_reason
       FROM state""",
)
def unsettle_planned(m: Model):
    state = transaction_state(m.transactions, m.settlements, m.closings)
    return dec.unsettle_planned(_requests(m.transactions, "id", transaction_id=F.col("id")), state)


@query(
    "edit_transaction",
    "transactions settlements closings",
    _STATE + f""", asked AS (SELECT *, abs(amount) + CASE WHEN id % 3 = 0 THEN 100 ELSE 0 END AS new_amount,
            booking_date + CASE WHEN id % 5 = 0 THEN 35 ELSE 0 END::INTEGER AS new_date,
            CASE WHEN id % 50 = 0 AND id % 4 = 0 THEN 1 ELSE category_id END AS new_category FROM state)
    SELECT t.id AS decision_id, t.id AS transaction_id,
           (CASE WHEN amount < 0 THEN -1 ELSE 1 END * new_amount)::BIGINT AS new_amount, direction,
           CASE WHEN period_locked THEN 'month_closed'
                WHEN (is_transfer OR reconciled OR has_settlement) AND new_amount <> abs(amount)
                    THEN 'locked_amount'
                WHEN (is_transfer OR reconciled) AND new_date <> booking_date THEN 'locked_booking_date'
                WHEN is_transfer AND new_category IS DISTINCT FROM category_id THEN 'locked_category_id'
                WHEN {_LOCKED.replace('t.booking_date', 't.new_date')} THEN 'target_month_closed' END
               AS reject_reason
    FROM asked t""",
)
def edit_transaction(m: Model):
    key = F.col("id")
    asked = _requests(
        m.transactions,
        "id",
        transaction_id=key,
        new_amount=F.abs("amount") + F.when(key % 3 == 0, 100).otherwise(0),
        new_date=F.date_add("booking_date", F.when(key % 5 == 0, 35).otherwise(0).cast("int")),
        new_account=F.col("bank_account_id"),
        new_category=F.when((key % 50 == 0) & (key % 4 == 0), 1).otherwise(F.col("category_id")),
        new_description=F.col("description"),
    )
    state = transaction_state(m.transactions, m.settlements, m.closings)
    return dec.edit_transactions(asked, state, m.closings)


def _close_requests(m: Model):
    """Two users of every company ask to close the months that were reopened."""
    users = F.explode(F.array(F.col("company_id"), F.col("company_id") + 18)).alias("user_id")
    months = m.closings.where("reopened_at IS NOT NULL").select("id", "company_id", "period", users)
    rows = months.withColumn("key", F.col("id") * 100 + F.col("user_id"))
    return _requests(
        rows, "key", company_id=F.col("company_id"), period=F.col("period"), user_id=F.col("user_id"),
        reason=F.when(F.col("user_id") % 2 == 0, "ajuste"), closing_id=F.col("id"),
    )


_CLOSERS = """, asked AS (SELECT c.id * 100 + m.user_id AS decision_id, c.company_id, c.period, m.user_id,
        m.role IN ('contador', 'owner') AS may
        FROM closings c JOIN memberships m ON m.company_id = c.company_id
          AND m.user_id IN (c.company_id, c.company_id + 18) WHERE c.reopened_at IS NOT NULL) """


@query(
    "close_month",
    "closings memberships",
    _CLOSERS + """, newest AS (SELECT company_id, period, arg_max(user_id, (decision_id % 500, user_id))
            AS user_id FROM asked WHERE may GROUP BY company_id, period)
    SELECT c.company_id, c.period::VARCHAR AS period, c.locked_at IS NOT NULL OR n.user_id IS NOT NULL
               AS locked, coalesce(n.user_id, c.locked_by) AS locked_by,
           CASE WHEN n.user_id IS NULL THEN c.reopen_reason END AS reopen_reason
    FROM closings c LEFT JOIN newest n USING (company_id, period)""",
)
def close_month(m: Model):
    rows = dec.close_months(_close_requests(m), m.closings, m.memberships)
    return rows.select(
        "company_id", "period", F.col("locked_at").isNotNull().alias("locked"), "locked_by", "reopen_reason"
    )


@query(
    "reopen_month",
    "closings memberships",
    _CLOSERS + """SELECT decision_id, company_id, period::VARCHAR AS period, CASE WHEN NOT may THEN 'role'
       WHEN user_id % 2 <> 0 THEN 'reason_required' END AS reject_reason FROM asked""",
)
def reopen_month(m: Model):
    return dec.reopen_months(_close_requests(m), m.closings, m.memberships)


# Data quality

_DQ = "SELECT '{0}' AS rule, '{1}' AS table_name, {2}::VARCHAR AS row_id, {3}::VARCHAR AS detail FROM {4}"


@query(
    "dq_before_opening",
    "transactions accounts",
    _DQ.format("before_opening", "transactions", "t.id", "opening_balance_date",
               "transactions t JOIN accounts a USING (bank_account_id) WHERE t.booking_date < a.opening_balance_date"),
)
def dq_before_opening(m: Model):
    return quality.before_opening(m.transactions, m.accounts)


@query(
    "dq_category_direction",
    "transactions categories",
    _DQ.format("category_direction", "transactions", "t.id", "c.kind",
               "transactions t JOIN categories c ON c.id = t.category_id WHERE c.kind NOT IN ('ambos', t.direction)"),
)
def dq_category_direction(m: Model):
    return quality.category_direction(m.transactions, m.categories)


@query(
    "dq_transfer_group",
    "transactions",
    _DQ.format("transfer_group", "transactions", "transfer_group_id", "n",
               """(SELECT transfer_group_id, count(*) AS n FROM transactions WHERE is_transfer GROUP BY 1
               HAVING count(*) <> 2 OR sum(amount) <> 0 OR min(bank_account_id) = max(bank_account_id))"""),
)
def dq_transfer_group(m: Model):
    return quality.transfer_group(m.transactions)


@query(
    "dq_nonzero_amount",
    "statement_lines settlements",
    _DQ.format("amount", "statement_lines", "id", "0", "statement_lines WHERE id % 37 = 0") + " UNION ALL "
    + _DQ.format("amount", "invoice_settlements", "id", "(-amount)", "settlements WHERE id % 41 = 0"),
)
def dq_nonzero_amount(m: Model):
    lines = m.statement_lines.withColumn("amount", F.when(F.col("id") % 37 != 0, F.col("amount")).otherwise(0))
    paid = m.settlements.withColumn(
        "amount", F.when(F.col("id") % 41 != 0, F.col("amount")).otherwise(-F.col("amount"))
    )
    return quality.union_reports(
        quality.nonzero(lines, "statement_lines"),
        quality.nonzero(paid, "invoice_settlements", positive=True),
        quality.nonzero(m.transactions, "transactions"),
        quality.nonzero(m.recurrences, "recurrences"),
        quality.nonzero(m.invoices, "invoices", positive=True),
    )


_UNIQUE = """SELECT 'unique' AS rule, '{0}' AS table_name, {1} AS row_id, count(*)::VARCHAR AS detail
    FROM {2} GROUP BY {1} HAVING count(*) > 1"""


@query(
    "dq_unique",
    "invoices imports statement_lines transactions",
    _UNIQUE.format("invoices", "company_id || '|' || number || '|' || coalesce(series, '')", "invoices")
    + " UNION ALL " + _UNIQUE.format("statement_imports", "bank_account_id || '|' || file_hash",
                                     "imports WHERE file_hash IS NOT NULL")
    + " UNION ALL " + _UNIQUE.format("statement_lines", "bank_account_id || '|' || memo", "statement_lines"),
)
def dq_unique(m: Model):
    series = F.coalesce("series", F.lit(""))
    return quality.union_reports(
        quality.not_unique(m.companies, "companies", ["tax_id"]),
        quality.not_unique(m.counterparties, "counterparties", ["company_id", "tax_id"]),
        quality.not_unique(m.categories, "categories", ["company_id", F.coalesce("parent_id", F.lit(0)), "name"]),
        quality.not_unique(m.cost_centers, "cost_centers", ["company_id", "name"]),
        quality.not_unique(m.invoices, "invoices", ["company_id", "number", series]),
        quality.not_unique(m.imports, "statement_imports", ["bank_account_id", "file_hash"]),
        quality.not_unique(m.statement_lines, "statement_lines", ["bank_account_id", "memo"]),
        quality.not_unique(m.statement_lines, "statement_lines", ["matched_transaction_id"]),
        quality.not_unique(m.closings, "monthly_closings", ["company_id", "period"]),
        quality.not_unique(m.settlements, "invoice_settlements", ["invoice_id", "transaction_id"]),
        quality.not_unique(m.profile_accounts, "account_profile_accounts", ["profile_id", "bank_account_id"]),
    )


@query(
    "dq_tax_id",
    "companies counterparties invoices",
    _DQ.format("tax_id", "companies", "company_id", "tax_id", "companies WHERE length(tax_id) <> 14") + " UNION ALL "
    + _DQ.format("tax_id", "counterparties", "id", "tax_id", "counterparties WHERE length(tax_id) NOT IN (11, 14)")
    + " UNION ALL "
    + _DQ.format("tax_id", "invoices", "id", "client_tax_id", "invoices WHERE length(client_tax_id) NOT IN (11, 14)"),
)
def dq_tax_id(m: Model):
    person = "^([0-9]{11}|[0-9]{14})$"
    return quality.union_reports(
        quality.tax_id(m.companies, "companies", "^[0-9]{14}$", key="company_id"),
        quality.tax_id(m.counterparties, "counterparties", person),
        quality.tax_id(m.invoices, "invoices", person, "client_tax_id"),
    )


@query(
    "dq_same_company",
    "transactions categories",
    _DQ.format("same_company", "transactions", "id", "k",
               """(SELECT id, company_id, category_id + CASE WHEN id % 23 = 0 THEN 10 ELSE 0 END AS k
               FROM transactions) WHERE k IS NOT NULL AND (k, company_id) NOT IN
               (SELECT (id, company_id) FROM categories)"""),
)
def dq_same_company(m: Model):
    moved = m.transactions.withColumn(
        "category_id", F.col("category_id") + F.when(F.col("id") % 23 == 0, 10).otherwise(0)
    )
    return quality.union_reports(
        quality.same_company(moved, m.categories, "category_id", "transactions"),
        quality.same_company(m.transactions, m.counterparties, "counterparty_id", "transactions"),
        quality.same_company(m.transactions, m.accounts, "bank_account_id", "transactions", "bank_account_id"),
    )


@query(
    "dq_line_state",
    "statement_lines rules",
    _DQ.format("line_without_transaction", "statement_lines", "id", "NULL",
               "statement_lines WHERE status = 'conciliada' AND matched_transaction_id % 3 = 0")
    + " UNION ALL " + _DQ.format("ignored_without_reason", "statement_lines", "id", "NULL",
                                 "statement_lines WHERE status = 'ignorada' AND ignored_reason IS NULL")
    + " UNION ALL " + _DQ.format("rule_sets_nothing", "matching_rules", "id", "NULL", "rules WHERE id % 18 = 0"),
)
def dq_line_state(m: Model):
    lines = m.statement_lines.withColumn(
        "matched_transaction_id",
        F.when(F.col("matched_transaction_id") % 3 != 0, F.col("matched_transaction_id")),
    )
    rules = m.rules.withColumn(
        "counterparty_id", F.when(F.col("id") % 18 != 0, F.col("counterparty_id"))
    )
    return quality.line_state(lines, rules)


@query(
    "dq_period",
    "closings recurrences",
    _DQ.format("reopened_without_reason", "monthly_closings", "id", "NULL",
               "closings WHERE reopened_at IS NOT NULL AND reopen_reason IS NULL")
    + " UNION ALL " + _DQ.format("day_of_month", "recurrences", "id", "NULL", "recurrences WHERE day_of_month > 28"),
)
def dq_period(m: Model):
    shifted = m.recurrences.withColumn("day_of_month", F.col("day_of_month") + 3)
    return quality.period(m.closings, shifted)


@query(
    "dq_not_blank",
    "companies rules",
    _DQ.format("blank", "companies", "company_id", "'name'", "companies WHERE trim(name) = ''") + " UNION ALL "
    + _DQ.format("blank", "matching_rules", "id", "'match_text'", "rules WHERE trim(match_text) = ''"),
)
def dq_not_blank(m: Model):
    return quality.union_reports(
        quality.not_blank(m.companies, "companies", "name", "company_id"),
        quality.not_blank(m.accounts, "bank_accounts", "name", "bank_account_id"),
        quality.not_blank(m.transactions, "transactions", "description"),
        quality.not_blank(m.invoices, "invoices", "client_name"),
        quality.not_blank(m.rules, "matching_rules", "match_text"),
    )


def _snapshots(m: Model):
    """The transactions before and after a day's work: changed and moved rows, and some that
    carry another id on one side, which makes them new and removed."""
    key = F.col("id")
    columns = ["id", "company_id", "bank_account_id", "booking_date", "amount", "description"]
    moved = F.lit(1_000_000_000_000)
    before = m.transactions.select(*columns).withColumn("updated_at", F.lit("a"))
    before = before.withColumn("id", key + F.when(key % 31 == 3, moved).otherwise(0))
    after = (
        m.transactions.select(*columns)
        .withColumn("amount", F.col("amount") + F.when(key % 31 == 5, 1).otherwise(0))
        .withColumn("booking_date", F.date_add("booking_date", F.when(key % 31 == 6, 40).otherwise(0).cast("int")))
        .withColumn("updated_at", F.lit("b"))
        .withColumn("id", key + F.when(key % 31 == 4, moved).otherwise(0))
    )
    return before, after


@query(
    "dq_locked_change",
    "transactions closings",
    f""", changed AS (SELECT id, id % 31 <> 3 AND {_LOCKED} AS old_locked, id % 31 <> 4 AND
            {_LOCKED.replace('t.booking_date', '(t.booking_date + CASE WHEN t.id % 31 = 6 THEN 40 ELSE 0 END::INTEGER)')}
            AS new_locked FROM transactions t WHERE id % 31 IN (3, 4, 5, 6)
        UNION ALL SELECT id + 1000000000000, id % 31 = 3 AND {_LOCKED}, id % 31 = 4 AND {_LOCKED}
            FROM transactions t WHERE id % 31 IN (3, 4))
    SELECT 'locked_change' AS rule, 'transactions' AS table_name, id::VARCHAR AS row_id, concat_ws('+',
           CASE WHEN old_locked THEN 'old' END, CASE WHEN new_locked THEN 'new' END) AS detail
    FROM changed WHERE old_locked OR new_locked""",
)
def dq_locked_change(m: Model):
    before, after = (side.drop("updated_at") for side in _snapshots(m))
    return quality.locked_change(before, after, m.closings)


# Audit


@query(
    "audit_capture",
    "transactions",
    """SELECT id + 1000000000000 AS row_id, CASE id % 31 WHEN 3 THEN 'DELETE' ELSE 'INSERT' END AS action,
           CASE WHEN id % 31 = 3 THEN amount END AS old_amount, CASE WHEN id % 31 = 4 THEN amount END AS new_amount
       FROM transactions WHERE id % 31 IN (3, 4)
       UNION ALL
       SELECT id AS row_id, CASE id % 31 WHEN 3 THEN 'INSERT' WHEN 4 THEN 'DELETE' ELSE 'UPDATE' END AS action,
       CASE WHEN id % 31 <> 3 THEN amount END AS old_amount, CASE WHEN id % 31 <> 4
           THEN amount + (id % 31 = 5)::INTEGER END AS new_amount
       FROM transactions WHERE id % 31 IN (3, 4, 5, 6)""",
)
def audit_capture(m: Model):
    before, after = _snapshots(m)
    log = audit.audit_capture(before, after, "transactions")
    return log.select(
        "row_id",
        "action",
        F.get_json_object("old_data", "$.amount").cast("bigint").alias("old_amount"),
        F.get_json_object("new_data", "$.amount").cast("bigint").alias("new_amount"),
    )


@query(
    "audit_report",
    "audit_log",
    """, newest AS (SELECT * FROM audit_log WHERE changed_at >= TIMESTAMP '2024-01-01' AND changed_at < TIMESTAMP '2024-02-01'
          AND table_name = 'bank_accounts')
    SELECT n.id, n.company_id, 'Contas' AS table_label,
           CASE WHEN changed_by IS NULL THEN 'Fora do app' ELSE coalesce(c.c_name, '—') END AS actor
    FROM newest n LEFT JOIN (SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN c_name END AS c_name FROM customer) c ON c.c_custkey = n.changed_by""",
)
def audit_report(m: Model):
    profiles = m.raw("customer").select(
        F.col("c_custkey").alias("user_id"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_name")).alias("full_name")
    )
    start, end = (F.lit(d).cast("timestamp_ntz") for d in ("2024-01-01", "2024-02-01"))
    rows = audit.audit_report(m.audit_log, profiles, start, end, "bank_accounts")
    return rows.select("id", "company_id", "table_label", "actor")


_FIELDS = """, sides AS (SELECT id, unnest(['k', 'gone']) AS field, old_data, new_data FROM audit_log),
    diff AS (SELECT id, field, json_extract_string(old_data, '$.' || field) AS before,
                    json_extract_string(new_data, '$.' || field) AS after FROM sides) """


@query(
    "json_diff",
    "audit_log",
    _FIELDS + "SELECT id, field, before, after FROM diff WHERE before IS DISTINCT FROM after",
)
def json_diff(m: Model):
    return audit.json_diff(m.audit_log)


@query(
    "audit_fields",
    "audit_log",
    _FIELDS + """SELECT a.table_name, d.field, count(*) AS changes FROM diff d JOIN audit_log a USING (id)
       WHERE d.before IS DISTINCT FROM d.after GROUP BY ALL""",
)
def audit_fields(m: Model):
    tables = m.audit_log.select("id", "table_name")
    return audit.json_diff(m.audit_log).join(tables, "id").groupBy("table_name", "field").agg(
        F.count("*").alias("changes")
    )


@query(
    "keys_union",
    "audit_log",
    """SELECT id, CASE action WHEN 'INSERT' THEN 'k' ELSE 'gone,k,updated_at' END AS fields FROM audit_log""",
)
def keys_union(m: Model):
    names = audit.keys_union(F.col("old_data"), F.col("new_data"))
    return m.audit_log.select("id", F.array_join(F.array_sort(names), ",").alias("fields"))


