"""Queries: receivables.

The SQL twin plays the credits of every company one by one: a recursive query whose state is the
list of outstanding amounts, in the order in which invoices are issued.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from razao.adapters import Model
from razao.catalog.base import query
from razao.catalog.ledger import _BALANCES, _LOCKED
from razao.operators import receivables as rcv
from razao.plans import receive


UNIT = 1 << 40


def played_sql(invoices: str, credits: str) -> str:
    """CTEs up to ``matches`` for tables like those of ``match_receivables``.

    Sums are kept as ``sum * 2 ** 40 + mask`` with the lowest mask of each sum, so a client has at most
    40 open invoices here.
    """
    return f"""
    companies AS (SELECT DISTINCT company_id FROM {credits}),
    invoice_lists AS (
      SELECT company_id, list(id ORDER BY issued_on, id) AS ids, list(issued_on ORDER BY issued_on, id) AS days,
             list(client_tax_id ORDER BY issued_on, id) AS clients, list(outstanding ORDER BY issued_on, id) AS amounts
      FROM {invoices} WHERE outstanding > 0 GROUP BY company_id
    ),
    queue AS (
      SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY booking_date, id) AS k FROM {credits}
    ),
    play AS (
      SELECT c.company_id, 0::BIGINT AS k, coalesce(amounts, [])::BIGINT[] AS open, 0 AS rule, []::BIGINT[] AS chosen,
             []::BIGINT[] AS used, NULL::BIGINT AS credit, NULL::BIGINT AS amount
      FROM companies c LEFT JOIN invoice_lists l ON l.company_id = c.company_id
      UNION ALL
      SELECT company_id, k,
             list_transform(open, lambda x, i: x - CASE WHEN NOT list_contains(chosen, i) THEN 0 WHEN rule = 2 THEN x ELSE amount END),
             rule, chosen, list_transform(chosen, lambda i: CASE WHEN rule = 2 THEN open[i] ELSE amount END), credit, amount
      FROM (
        SELECT *, CASE WHEN exact IS NOT NULL THEN 1 WHEN mask IS NOT NULL THEN 2 WHEN short IS NOT NULL THEN 3
                       WHEN len(sighted) = 1 THEN 4 ELSE 0 END AS rule,
               CASE WHEN exact IS NOT NULL THEN [exact]
                    WHEN mask IS NOT NULL
                      THEN list_filter(list_transform(own, lambda i, j: CASE WHEN (mask >> (j - 1)::INT) & 1 = 1 THEN i END), lambda i: i IS NOT NULL)
                    WHEN short IS NOT NULL THEN [short] WHEN len(sighted) = 1 THEN sighted ELSE []::BIGINT[] END AS chosen
        FROM (
          SELECT *, CASE WHEN exact IS NULL AND len(own) >= 2 THEN
                 (list_filter(list_reduce(
                   list_prepend([0::HUGEINT], list_transform(own, lambda i, j: [open[i]::HUGEINT * {UNIT} + (1::BIGINT << (j - 1)::INT)])),
                   lambda sums, part: list_concat(sums, list_filter(
                     list_transform(sums, lambda s: s + part[1]),
                     lambda s: s // {UNIT} <= amount AND NOT list_contains(list_transform(sums, lambda t: t // {UNIT}), s // {UNIT})))),
                   lambda s: s // {UNIT} = amount)[1] % {UNIT})::BIGINT END AS mask,
                 list_filter(own, lambda i: open[i] > amount AND amount >= open[i] * 0.8::DOUBLE)[1] AS short
          FROM (
            SELECT *, list_filter(own, lambda i: open[i] = amount)[1] AS exact
            FROM (
              SELECT p.company_id, q.k, p.open, q.id AS credit, q.amount,
                     CASE WHEN q.payer_tax_id IS NULL THEN []::BIGINT[] ELSE
                       list_filter(range(1, len(p.open) + 1), lambda i: coalesce(l.clients[i] = q.payer_tax_id, false) AND p.open[i] > 0) END AS own,
                     CASE WHEN q.payer_tax_id IS NOT NULL THEN []::BIGINT[] ELSE
                       list_filter(range(1, len(p.open) + 1), lambda i: p.open[i] = q.amount AND q.booking_date - l.days[i] BETWEEN 0 AND 90) END AS sighted
              FROM play p JOIN queue q ON q.company_id = p.company_id AND q.k = p.k + 1
              LEFT JOIN invoice_lists l ON l.company_id = p.company_id
            )
          )
        )
      )
    ),
    matches AS (
      SELECT p.company_id, p.credit AS transaction_id, p.rule, (u.j - 1)::INTEGER AS position,
             l.ids[p.chosen[u.j]] AS invoice_id, p.used[u.j] AS amount,
             CASE WHEN p.rule = 1 THEN 'exact' ELSE 'likely' END AS confidence
      FROM (SELECT * FROM play WHERE rule > 0) p JOIN invoice_lists l ON l.company_id = p.company_id, unnest(range(1, len(p.chosen) + 1)) u(j)
      UNION ALL
      SELECT company_id, credit, 0, 0, NULL, amount, 'none' FROM play WHERE k > 0 AND rule = 0
    )"""


CONTESTED = "contested_invoices contested_credits"
CONTESTED_MATCHES = "," + played_sql("contested_invoices", "contested_credits")


def _matches(m: Model):
    return rcv.match_receivables(m.contested_credits, m.contested_invoices), m.contested_invoices


@query("match_receivables", CONTESTED, CONTESTED_MATCHES + " SELECT * FROM matches")
def match_receivables(m: Model):
    return _matches(m)[0]


@query("receivable_reasons", CONTESTED, CONTESTED_MATCHES + """,
    numbered AS (
      SELECT m.company_id, transaction_id, confidence, rule, string_agg(i.number, ', ' ORDER BY position) AS invoices, count(*) AS n
      FROM matches m JOIN contested_invoices i ON i.id = m.invoice_id GROUP BY ALL
    )
    SELECT company_id, transaction_id, confidence, rule, invoices,
           CASE rule
             WHEN 1 THEN 'Mesmo CNPJ/CPF e valor exatamente igual ao saldo em aberto da nota ' || invoices || '.'
             WHEN 2 THEN 'Mesmo CNPJ/CPF; o valor bate com a soma de ' || n || ' notas em aberto (' || invoices || ').'
             WHEN 3 THEN 'Mesmo CNPJ/CPF; valor abaixo do saldo em aberto da nota ' || invoices || ' — provável retenção de imposto.'
             ELSE 'O extrato não trouxe CNPJ/CPF do pagador; valor exato e dentro da janela de vencimento da nota ' || invoices || '.' END AS reason
    FROM numbered
    """)
def receivable_reasons(m: Model):
    matches, invoices = _matches(m)
    return rcv.match_reasons(matches, invoices)


@query("subset_sum", CONTESTED, CONTESTED_MATCHES + " SELECT * FROM matches WHERE rule = 2")
def subset_sum(m: Model):
    """Credits explained by several invoices, with the parts."""
    matches, _ = _matches(m)
    return matches.where(F.col("rule") == rcv.GROUPED)


# Every exact match asks for the whole outstanding amount of one invoice, so of those that hold alone
# the first one of an invoice is settled.
_AUTO = _BALANCES + """,
    swept AS (
      SELECT t.company_id, t.id, t.booking_date, t.amount, c.tax_id AS payer_tax_id
      FROM transactions t LEFT JOIN counterparties c ON c.id = t.counterparty_id
      WHERE t.status = 'realizado' AND t.amount > 0 AND NOT EXISTS (SELECT 1 FROM settlements s WHERE s.transaction_id = t.id)
    ),
    notes AS (
      SELECT id, company_id, issued_on, client_tax_id, status, outstanding_amount AS outstanding FROM balances WHERE outstanding_amount > 0
    ),""" + played_sql("notes", "swept") + f""",
    alone AS (
      SELECT m.transaction_id, m.invoice_id, i.outstanding AS amount,
             t.status = 'realizado' AND NOT {_LOCKED} AND i.company_id = t.company_id AND i.status <> 'cancelada' AND i.outstanding <= t.amount AS fits
      FROM matches m JOIN notes i ON i.id = m.invoice_id JOIN transactions t ON t.id = m.transaction_id WHERE m.rule = 1
    )
    SELECT transaction_id, invoice_id, amount,
           CASE WHEN fits AND row_number() OVER (PARTITION BY invoice_id, fits ORDER BY transaction_id) = 1 THEN 'settled' ELSE 'failed' END AS outcome
    FROM alone
    UNION ALL
    SELECT transaction_id, invoice_id, amount, CASE WHEN rule = 0 THEN 'unmatched' ELSE 'suggested' END FROM matches WHERE rule <> 1"""


@query("auto_apply_receivables", "transactions invoices settlements counterparties closings", _AUTO)
def auto_apply_receivables(m: Model):
    at = F.lit("2000-01-01").cast("timestamp_ntz")
    result = receive.auto_apply_receivables(
        m.transactions, m.invoices, m.settlements, m.counterparties, m.closings, at
    )
    return (
        result.settlements.select(
            "transaction_id", "invoice_id", "amount",
            F.when(F.col("reject_reason").isNull(), "settled").otherwise("failed").alias("outcome"),
        )
        .unionByName(result.suggested.select("transaction_id", "invoice_id", "amount", F.lit("suggested").alias("outcome")))
        .unionByName(result.unmatched.select("transaction_id", "invoice_id", "amount", F.lit("unmatched").alias("outcome")))
    )
