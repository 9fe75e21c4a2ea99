"""Tables of the ledger model and their enumerations.

Money is held in integer cents (``bigint``) and cash dates as ``date``.
"""

from __future__ import annotations

# Enumeration literals stored in the tables.
ROLE_RANK = {"cliente_leitura": 1, "assistente": 2, "contador": 3, "owner": 4}
ACCOUNT_KINDS = ("corrente", "poupanca", "aplicacao", "cartao_credito", "caixa")
CATEGORY_KINDS = ("entrada", "saida", "ambos")
PLANNED, REALIZED = "previsto", "realizado"
INFLOW, OUTFLOW = "entrada", "saida"
NOT_RECONCILED, RECONCILED, IGNORED = "nao_conciliado", "conciliado", "ignorado"
PAYMENT_METHODS = (
    "pix", "ted", "doc", "boleto", "debito_automatico", "cartao", "dinheiro", "cheque", "outro",
)
STATEMENT_SOURCES = ("ofx", "csv", "manual", "open_finance", "pdf")
IMPORTABLE_SOURCES = ("ofx", "csv", "pdf")
LINE_PENDING, LINE_MATCHED, LINE_CREATED, LINE_IGNORED = (
    "pendente", "conciliada", "criada", "ignorada",
)
FREQUENCIES = ("mensal", "semanal", "quinzenal", "anual")
INVOICE_OPEN, INVOICE_PARTIAL, INVOICE_PAID, INVOICE_CANCELLED = (
    "aberta", "recebida_parcial", "recebida", "cancelada",
)

ACCOUNTS = (
    "bank_account_id bigint, company_id bigint, name string, kind string, "
    "opening_balance bigint, opening_balance_date date, minimum_balance bigint, is_active boolean"
)
TRANSACTIONS = (
    "id bigint, company_id bigint, bank_account_id bigint, category_id bigint, "
    "counterparty_id bigint, cost_center_id bigint, booking_date date, competence_date date, "
    "amount bigint, direction string, status string, reconciliation string, "
    "payment_method string, description string, document_number string, "
    "transfer_group_id bigint, is_transfer boolean, recurrence_id bigint, created_at timestamp"
)
STATEMENT_LINES = (
    "id bigint, company_id bigint, import_id bigint, bank_account_id bigint, posted_at date, "
    "amount bigint, memo string, fitid string, dedup_key string, status string, "
    "matched_transaction_id bigint, ignored_reason string"
)
INVOICES = (
    "id bigint, company_id bigint, number string, series string, issued_on date, amount bigint, "
    "withheld_amount bigint, counterparty_id bigint, client_name string, client_tax_id string, "
    "status string"
)
CANONICAL_LINE = (
    "file string, line_no int, posted_at date, amount bigint, memo string, fitid string, "
    "check_number string, counterparty_name string, counterparty_document string, "
    "name_truncated boolean, dedup_key string"
)
