"""The model tables once more, as DuckDB SQL over the same given tables."""

from __future__ import annotations


def _cents(column: str) -> str:
    return f"CAST(CAST({column} AS DECIMAL(20,2)) * 100 AS BIGINT)"


def _pick(index: str, values: str) -> str:
    items = ", ".join(f"'{v}'" for v in values.split("|"))
    return f"[{items}][CAST(({index}) % {len(values.split('|'))} AS INTEGER) + 1]"


WORDS = "PIX ENVIADO|TED RECEBIDA|Pagto. boleto|Débito automático|DOC|Tarifa"
METHODS = "pix|ted|doc|boleto|debito_automatico|cartao|dinheiro|cheque|outro"
_MONTH = "(year({0}) * 12 + month({0}) - 1 - 1995 * 12)"
_PRICE = _cents("o_totalprice")
_SIZE = "CASE WHEN {0} % 29 = 3 THEN 12 WHEN {0} % 2 = 0 THEN 14 ELSE 11 END"
_MOVED = (
    "(CASE WHEN o_orderkey % 100 = 0 THEN -1 ELSE 1 END) * (5000 + 100 * ((o_orderkey // 100) % 1000)"
    " + CASE WHEN o_orderkey % 100 <> 0 AND (o_orderkey // 100) % 7 = 0 THEN 1 ELSE 0 END)"
)
_AMOUNT = (
    f"CASE WHEN o_orderkey % 50 = 0 THEN {_MOVED} "
    f"WHEN o_orderkey % 4 >= 2 THEN -{_PRICE} ELSE {_PRICE} END"
)
_POSTED = "CAST(o_orderdate AS DATE) + CAST(o_orderkey % 45 AS INTEGER)"

MODEL = {
    "companies": """
        SELECT CAST(n_nationkey AS BIGINT) AS company_id,
               CASE WHEN n_nationkey % 12 = 5 THEN ' ' ELSE n_name END AS name,
               lpad(CAST(n_nationkey * 7919 + 11 AS VARCHAR),
                    CASE WHEN n_nationkey % 10 = 7 THEN 13 ELSE 14 END, '0') AS tax_id,
               n_nationkey % 9 <> 4 AS is_active
        FROM nation""",
    "accounts": f"""
        SELECT c_custkey AS bank_account_id, c_custkey % 25 AS company_id, c_name AS name,
               {_pick("c_custkey", "corrente|poupanca|aplicacao|cartao_credito|caixa")} AS kind,
               {_cents("c_acctbal")} AS opening_balance,
               DATE '1995-01-01' + CAST(c_custkey % 400 AS INTEGER) AS opening_balance_date,
               CASE WHEN c_custkey % 3 = 0 THEN CAST(100000 AS BIGINT) END AS minimum_balance,
               c_custkey % 10 <> 0 AS is_active
        FROM customer""",
    "transactions": f"""
        SELECT o_orderkey AS id, o_custkey % 25 AS company_id, o_custkey AS bank_account_id,
               CASE WHEN o_orderkey % 50 <> 0 AND o_orderkey % 11 <> 0
                    THEN (o_custkey % 25) * 10 + CAST(substr(o_orderpriority, 1, 1) AS BIGINT)
               END AS category_id,
               CASE WHEN o_custkey % 7 <> 0 THEN o_custkey END AS counterparty_id,
               CASE WHEN o_orderkey % 4 = 0 THEN (o_custkey % 25) * 10 + o_orderkey % 3 END
                   AS cost_center_id,
               CAST(o_orderdate AS DATE) AS booking_date,
               CAST(CAST(o_orderdate AS DATE) - to_months(CAST(o_orderkey % 2 AS INTEGER)) AS DATE)
                   AS competence_date,
               CAST({_AMOUNT} AS BIGINT) AS amount,
               CASE WHEN ({_AMOUNT}) > 0 THEN 'entrada' ELSE 'saida' END AS direction,
               CASE WHEN o_orderstatus = 'P' THEN 'previsto' ELSE 'realizado' END AS status,
               CASE WHEN o_orderkey % 5 = 0 THEN 'conciliado'
                    WHEN o_orderkey % 17 = 0 THEN 'ignorado' ELSE 'nao_conciliado' END
                   AS reconciliation,
               CASE WHEN o_orderkey % 8 <> 0 THEN {_pick("o_orderkey", METHODS)} END
                   AS payment_method,
               {_pick("o_orderkey", WORDS)} || ' ' || o_orderpriority || ' cliente ' || o_custkey
                   AS description,
               CASE WHEN o_orderkey % 6 = 0 THEN CAST(o_orderkey AS VARCHAR) END
                   AS document_number,
               CASE WHEN o_orderkey % 50 = 0 THEN o_orderkey // 100 END AS transfer_group_id,
               o_orderkey % 50 = 0 AS is_transfer,
               CASE WHEN o_orderkey % 13 = 0 THEN o_orderkey % 100 END AS recurrence_id,
               o_orderdate + to_seconds(CAST(o_orderkey % 86400 AS INTEGER)) AS created_at
        FROM orders""",
    "statement_lines": f"""
        SELECT o_orderkey AS id, o_custkey % 25 AS company_id,
               o_custkey * 1000 + {_MONTH.format("(" + _POSTED + ")")} AS import_id,
               o_custkey AS bank_account_id, {_POSTED} AS posted_at,
               CASE WHEN o_orderkey % 4 >= 2 THEN -{_PRICE} ELSE {_PRICE} END
                   + CASE WHEN o_orderkey % 7 = 0 THEN 3 ELSE 0 END AS amount,
               {_pick("o_orderkey", WORDS)} || ' ' || lower(o_orderpriority) || ' Cliente '
                   || o_custkey || ' doc ' || o_orderkey AS memo,
               CASE WHEN o_orderkey % 9 <> 0 THEN 'F' || o_orderkey END AS fitid,
               'fitid:F' || o_orderkey AS dedup_key,
               CASE o_orderkey % 10 WHEN 0 THEN 'conciliada' WHEN 1 THEN 'criada'
                    WHEN 2 THEN 'ignorada' ELSE 'pendente' END AS status,
               CASE WHEN o_orderkey % 10 < 2 THEN o_orderkey END AS matched_transaction_id,
               CASE WHEN o_orderkey % 10 = 2 AND o_orderkey % 20 <> 2 THEN 'duplicada' END
                   AS ignored_reason
        FROM orders
        UNION ALL
        SELECT o_orderkey + 1000000000000, o_custkey % 25,
               o_custkey * 1000 + {_MONTH.format("(" + _POSTED + ")")}, o_custkey, {_POSTED},
               -1250, 'TARIFA MANUTENÇÃO DE CONTA', NULL, 'c:fee|' || o_orderkey, 'pendente',
               NULL, NULL
        FROM orders WHERE o_orderkey % 5 = 0""",
    "categories": f"""
        SELECT CAST(n_nationkey AS BIGINT) * 10 + d AS id,
               CAST(n_nationkey AS BIGINT) AS company_id,
               CASE WHEN d >= 4 THEN CAST(n_nationkey AS BIGINT) * 10 + 1 END AS parent_id,
               'Categoria ' || d AS name,
               {_pick("d", "entrada|ambos|entrada|saida|ambos")} AS kind, d <> 5 AS is_active
        FROM nation, range(1, 6) r(d)""",
    "cost_centers": """
        SELECT CAST(n_nationkey AS BIGINT) * 10 + d AS id,
               CAST(n_nationkey AS BIGINT) AS company_id, 'Centro ' || d AS name,
               d <> 2 AS is_active
        FROM nation, range(0, 3) r(d)""",
    "counterparties": f"""
        SELECT c_custkey AS id, c_custkey % 25 AS company_id, c_name AS name,
               CASE WHEN c_custkey % 13 <> 0
                    THEN lpad(CAST(c_custkey * 7919 + 11 AS VARCHAR), {_SIZE.format("c_custkey")}, '0')
               END AS tax_id,
               c_custkey % 11 <> 0 AS is_active
        FROM customer""",
    "imports": f"""
        SELECT id, bank_account_id % 25 AS company_id, bank_account_id,
               {_pick("id", "ofx|csv|pdf")} AS source,
               CASE WHEN id % 23 <> 0 THEN 'h' || (id - id % 2) END AS file_hash, period_start,
               CASE WHEN id % 5 = 0 THEN NULL WHEN id % 3 = 0 THEN last_day(period_start)
                    ELSE last END AS period_end,
               CASE WHEN id % 7 <> 0 THEN total END AS statement_balance,
               CASE WHEN id % 11 <> 0 THEN last END AS statement_balance_date, line_count,
               CAST(period_start AS TIMESTAMP) + to_days(CAST((id * 37) % 90 AS INTEGER))
                   AS created_at
        FROM (SELECT o_custkey * 1000 + {_MONTH.format("period_start")} AS id,
                     o_custkey AS bank_account_id, period_start, max(d) AS last,
                     CAST(sum(c) AS BIGINT) AS total, count(*) AS line_count
              FROM (SELECT o_custkey, CAST(o_orderdate AS DATE) AS d, {_PRICE} AS c,
                           CAST(date_trunc('month', o_orderdate) AS DATE) AS period_start
                    FROM orders) GROUP BY o_custkey, period_start)""",
    "rules": """
        SELECT p_partkey AS id, p_partkey % 25 AS company_id,
               CASE p_partkey % 8 WHEN 0 THEN 'urgent cliente' WHEN 1 THEN 'Pix Enviado'
                    WHEN 2 THEN 'cliente ' || (p_partkey % 500) WHEN 3 THEN 'TED'
                    WHEN 4 THEN p_name WHEN 5 THEN 'boleto 3-medium' WHEN 6 THEN 'manutenção'
                    ELSE '  ' END AS match_text,
               CASE WHEN p_partkey % 31 = 0 THEN p_partkey % 1000 END AS bank_account_id,
               CASE p_partkey % 6 WHEN 0 THEN 'entrada' WHEN 1 THEN 'saida' END AS direction,
               CASE WHEN p_partkey % 9 <> 0 THEN (p_partkey % 25) * 10 + 1 + p_partkey % 5 END
                   AS category_id,
               CASE WHEN p_partkey % 9 = 0 THEN p_partkey % 100 END AS counterparty_id,
               p_size AS priority, p_partkey % 4 AS hit_count, p_partkey % 13 <> 0 AS is_active
        FROM part""",
    "recurrences": f"""
        SELECT *, CASE WHEN id % 5 = 0 THEN start_date + 400 END AS end_date FROM (
        SELECT s_suppkey AS id, s_suppkey % 25 AS company_id, s_suppkey AS bank_account_id,
               'Recorrência ' || s_name AS description,
               CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE -1 END * {_cents("s_acctbal")} AS amount,
               {_pick("s_suppkey", "mensal|semanal|quinzenal|anual")} AS frequency,
               CASE WHEN s_suppkey % 3 <> 0 THEN CAST(1 + (s_suppkey * 7) % 31 AS INTEGER) END
                   AS day_of_month,
               DATE '1998-01-01' + CAST((s_suppkey * 17) % 700 AS INTEGER) AS start_date,
               CASE WHEN s_suppkey % 4 = 0 THEN DATE '1999-06-30' END AS generated_until,
               s_suppkey % 10 <> 0 AS is_active
        FROM supplier)""",
    "closings": f"""
        SELECT id, company_id, period,
               CASE WHEN locked THEN stamp END AS locked_at,
               CASE WHEN locked THEN company_id END AS locked_by,
               CASE WHEN NOT locked THEN stamp END AS reopened_at,
               CASE WHEN NOT locked THEN company_id + 1 END AS reopened_by,
               CASE WHEN NOT locked AND id % 2 = 0 THEN 'ajuste' END AS reopen_reason
        FROM (SELECT *, id % 3 <> 0 AND period < DATE '1999-12-01' AS locked FROM (SELECT DISTINCT o_custkey % 25 AS company_id,
                     CAST(date_trunc('month', o_orderdate) AS DATE) AS period,
                     CAST(period AS TIMESTAMP) + INTERVAL 40 DAY AS stamp,
                     (o_custkey % 25) * 1000 + {_MONTH.format("period")} AS id
              FROM orders))""",
    "invoices": f"""
        SELECT o_orderkey AS id, o_custkey % 25 AS company_id,
               CAST(o_orderkey - o_orderkey % 2 AS VARCHAR) AS number,
               CASE WHEN o_orderkey % 3 = 0 THEN 'A' END AS series,
               CAST(o_orderdate AS DATE) AS issued_on, {_PRICE} AS amount,
               ({_PRICE} * 65) // 1000 AS withheld_amount, o_custkey AS counterparty_id,
               'Cliente ' || o_custkey AS client_name,
               CASE WHEN o_custkey % 13 <> 0
                    THEN lpad(CAST(o_custkey * 7919 + 11 AS VARCHAR), {_SIZE.format("o_custkey")}, '0')
               END AS client_tax_id,
               CASE WHEN o_orderkey % 17 = 0 THEN 'cancelada' ELSE 'aberta' END AS status
        FROM orders""",
    "settlements": f"""
        SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS invoice_id,
               l_orderkey + l_linenumber - 1 AS transaction_id,
               CAST(sum({_cents("l_extendedprice")}) AS BIGINT) AS amount,
               max(l_shipdate) AS created_at
        FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "audit_log": f"""
        SELECT event_id AS id, user_id % 25 AS company_id,
               {_pick("event_id", "transactions|bank_accounts|invoices|monthly_closings")}
                   AS table_name,
               user_id AS row_id,
               CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'error' THEN 'DELETE'
                    ELSE 'UPDATE' END AS action,
               CASE WHEN event_type <> 'signup' THEN '{{"k": ' || (event_id % 100)
                    || ', "updated_at": "' || event_id || '", "gone": ' || (event_id % 3) || '}}'
               END AS old_data,
               CASE WHEN event_type <> 'error' THEN props END AS new_data,
               CASE WHEN event_id % 6 <> 0 THEN user_id % 40 END AS changed_by, ts AS changed_at
        FROM events""",
    "memberships": f"""
        SELECT m.c AS company_id, user_id, {_pick("m.r", "cliente_leitura|assistente|contador|owner")} AS role
        FROM (SELECT c_custkey AS user_id,
                     unnest([{{'c': c_custkey % 25, 'r': c_custkey % 4}},
                             {{'c': (c_custkey + 7) % 25, 'r': (c_custkey + 1) % 4}}]) AS m
              FROM customer)""",
    "profile_accounts": """
        SELECT unnest([(c_custkey % 25) * 10 + (c_custkey // 25) % 4,
                       (c_custkey % 25) * 10 + (c_custkey // 25 + 1) % 4]) AS profile_id,
               c_custkey AS bank_account_id
        FROM customer""",
    "contested_invoices": """
        SELECT o_orderkey AS id, o_custkey % 25 AS company_id, CAST(o_orderkey AS VARCHAR) AS number,
               CAST(o_orderdate AS DATE) AS issued_on, 100 * (1 + o_orderkey % 97) AS outstanding,
               CASE WHEN o_custkey % 13 <> 0 THEN lpad(CAST(o_custkey + 11 AS VARCHAR), 14, '0') END
                   AS client_tax_id
        FROM orders""",
    "contested_credits": """
        SELECT o_orderkey AS id, o_custkey % 25 AS company_id,
               CAST(o_orderdate AS DATE) + 20 AS booking_date,
               CASE o_orderkey % 3 WHEN 0 THEN 100 * (1 + o_orderkey % 97)
                   WHEN 1 THEN 100 * (2 + o_orderkey % 150) ELSE 90 * (1 + o_orderkey % 97) END AS amount,
               CASE WHEN o_orderkey % 5 <> 0 THEN lpad(CAST(o_custkey + 11 AS VARCHAR), 14, '0') END
                   AS payer_tax_id
        FROM orders""",
    "contested_transactions": f"""
        SELECT o_orderkey AS id, (o_custkey // 15) % 25 AS company_id,
               o_custkey // 15 AS bank_account_id, CAST(o_orderdate AS DATE) AS booking_date,
               CASE WHEN o_orderkey % 4 >= 2 THEN -1000 ELSE 1000 END * (1 + o_orderkey % 3)
                   AS amount,
               {_pick("o_orderkey", WORDS)} || ' ' || o_orderpriority AS description,
               CASE WHEN o_orderkey % 6 = 0 THEN CAST(o_orderkey AS VARCHAR) END
                   AS document_number
        FROM orders""",
    "contested_lines": f"""
        SELECT o_orderkey AS id, (o_custkey // 15) % 25 AS company_id,
               o_custkey // 15 AS bank_account_id,
               CAST(o_orderdate AS DATE) + CAST(o_orderkey % 9 AS INTEGER) AS posted_at,
               CASE WHEN o_orderkey % 4 >= 2 THEN -1000 ELSE 1000 END * (1 + o_orderkey % 3)
                   + CASE WHEN o_orderkey % 10 = 3 THEN 7 ELSE 0 END
                   + CASE WHEN o_orderkey % 7 = 0 THEN 11 ELSE 0 END AS amount,
               {_pick("o_orderkey", WORDS)} || ' ' || lower(o_orderpriority)
                   || CASE WHEN o_orderkey % 12 = 0 THEN ' nr ' || o_orderkey ELSE '' END AS memo
        FROM orders""",
}

NORMAL = (
    "trim(regexp_replace(strip_accents(lower({0})), '[^a-z0-9]+', ' ', 'g'))"
)
TAX_ID = (
    r"(?:^|[^0-9.])([0-9]{2}\.[0-9]{3}\.[0-9]{3}/[0-9]{4}-[0-9]{2}"
    r"|[0-9]{3}\.[0-9]{3}\.[0-9]{3}-[0-9]{2})(?:[^0-9-]|$)"
)


def with_model(tables: str, body: str) -> str:
    """``body`` preceded by the model tables it reads, as common table expressions."""
    parts = ", ".join(f"{name} AS ({MODEL[name]})" for name in tables.split())
    body = body.strip()
    glue = "," if body.startswith(",") else ""
    return f"WITH RECURSIVE {parts}{glue} {body.lstrip(',')}"
