"""Queries: single functions of families, the whole reconciliation, and the streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from razao.adapters import Model, statement_lines_from
from razao.catalog.base import query
from razao.catalog.jobs import _STATE
from razao.catalog.ledger import _state
from razao.catalog.matching import _CONTESTED, _PLAN
from razao.catalog.scalars import _NEXT, _ORDERS, _days, grouped
from razao.functions import dates, money
from razao.operators import filters as flt
from razao.operators import ordering
from razao.session import checkpoint_dir

_FLAGS = "transactions settlements closings"


@query(
    "can_settle",
    _FLAGS,
    _STATE + "SELECT id FROM state WHERE status = 'previsto' AND NOT is_transfer AND NOT period_locked",
)
def can_settle(m: Model):
    return _state(m).where(flt.can_settle()).select("id")


@query(
    "can_unsettle",
    _FLAGS,
    _STATE + """SELECT id FROM state WHERE status = 'realizado'
       AND NOT (reconciled OR has_settlement OR is_transfer OR period_locked)""",
)
def can_unsettle(m: Model):
    return _state(m).where(flt.can_unsettle()).select("id")


@query("is_inflow", "transactions", "SELECT id FROM transactions WHERE amount > 0")
def is_inflow(m: Model):
    return m.transactions.where(money.is_inflow(F.col("amount"))).select("id")


@query("is_outflow", "transactions", "SELECT id FROM transactions WHERE amount < 0")
def is_outflow(m: Model):
    return m.transactions.where(money.is_outflow(F.col("amount"))).select("id")


_PLAIN = """CASE WHEN amount < 0 THEN '-' ELSE '' END || (abs(amount) // 100) || '.'
    || lpad((abs(amount) % 100)::VARCHAR, 2, '0')"""


@query("to_db", "transactions", f"SELECT id, {_PLAIN} AS stored FROM transactions")
def to_db(m: Model):
    return m.transactions.select("id", money.to_db(F.col("amount")).alias("stored"))


@query("from_db", "transactions", "SELECT id, amount AS cents FROM transactions")
def from_db(m: Model):
    return m.transactions.select("id", money.from_db(money.to_db(F.col("amount"))).alias("cents"))


@query(
    "from_decimal",
    sql="""SELECT o_orderkey AS id, round(o_totalprice * 100)::BIGINT AS cents FROM orders""",
)
def from_decimal(m: Model):
    return m.raw("orders").select(
        F.col("o_orderkey").alias("id"), money.from_decimal(F.col("o_totalprice")).alias("cents")
    )


@query("to_decimal", "transactions", "SELECT id, (amount / 100.0)::DOUBLE AS units FROM transactions")
def to_decimal(m: Model):
    return m.transactions.select("id", money.to_decimal(F.col("amount")).cast("double").alias("units"))


@query("format_amount", "transactions", f"SELECT id, {grouped('amount')} AS shown FROM transactions")
def format_amount(m: Model):
    return m.transactions.select("id", money.format_amount(F.col("amount")).alias("shown"))


@query(
    "add_days",
    sql=f"SELECT id, (d - CAST(id % 90 AS INTEGER))::VARCHAR AS day FROM ({_ORDERS})",
)
def add_days(m: Model):
    return _days(m).select("id", F.date_add("d", -(F.col("id") % 90).cast("int")).alias("day"))


@query(
    "add_months",
    sql=f"SELECT id, CAST(d - to_months(CAST(id % 30 AS INTEGER)) AS DATE)::VARCHAR AS day FROM ({_ORDERS})",
)
def add_months(m: Model):
    return _days(m).select("id", F.add_months("d", -(F.col("id") % 30).cast("int")).alias("day"))


@query(
    "days_between",
    sql=f"SELECT id, date_diff('day', DATE '1998-02-28', d)::INTEGER AS days FROM ({_ORDERS})",
)
def days_between(m: Model):
    return _days(m).select("id", F.datediff("d", dates.day("1998-02-28")).alias("days"))


@query(
    "compare",
    sql=f"""SELECT id, CASE WHEN d < DATE '1998-02-28' THEN 'before' WHEN d > DATE '1998-02-28' THEN 'after'
            ELSE 'same' END AS place FROM ({_ORDERS})""",
)
def compare(m: Model):
    pivot = dates.day("1998-02-28")
    place = F.when(F.col("d") < pivot, "before").when(F.col("d") > pivot, "after").otherwise("same")
    return _days(m).select("id", place.alias("place"))


@query(
    "next_business_day",
    sql="WITH " + _NEXT.lstrip(", ") + f"""SELECT id, later::VARCHAR AS day FROM ({_ORDERS}) JOIN near USING (d)""",
)
def next_business_day(m: Model):
    return _business(m, "next_business_day")


@query(
    "previous_business_day",
    sql="WITH " + _NEXT.lstrip(", ") + f"""SELECT id, earlier::VARCHAR AS day FROM ({_ORDERS}) JOIN near USING (d)""",
)
def previous_business_day(m: Model):
    return _business(m, "previous_business_day")


def _business(m: Model, column: str):
    table = dates.calendar_of(_days(m), "d")
    return _days(m).join(table, F.col("d") == F.col("date"), "left").select("id", F.col(column).alias("day"))


@query(
    "chronological",
    "statement_lines",
    """SELECT id, import_id AS file, posted_at::VARCHAR AS posted_at, row_number() OVER (PARTITION BY import_id
           ORDER BY statement_lines.posted_at, id)::INTEGER AS place FROM statement_lines""",
)
def chronological(m: Model):
    lines = m.statement_lines.select(
        "id", F.col("import_id").alias("file"), "posted_at", F.col("id").alias("line_no")
    )
    return ordering.chronological(lines).select("id", "file", "posted_at", "place")


# Every tenth transaction was reconciled by somebody else after the plan was made.
_APPLIED = _PLAN + """, done AS (
        SELECT company_id, line_id, NULL::BIGINT AS rule_id, CASE WHEN day_gap > 3 THEN 'suggested'
               WHEN transaction_id % 10 = 1 THEN 'failed' ELSE 'reconciled' END AS outcome,
               CASE WHEN day_gap <= 3 AND transaction_id % 10 = 1 THEN 'transaction_already_reconciled' END AS reason
        FROM matches
        UNION ALL
        SELECT company_id, id, CASE WHEN category_id IS NOT NULL THEN rule_id END,
               CASE WHEN category_id IS NULL THEN 'uncategorized' WHEN locked THEN 'failed' ELSE 'created' END,
               CASE WHEN category_id IS NOT NULL AND locked THEN 'month_closed' END
        FROM (SELECT item.company_id, item.id, top.rule_id, top.category_id, EXISTS (
                  SELECT 1 FROM closings c WHERE c.company_id = item.company_id
                  AND c.locked_at IS NOT NULL AND c.period = date_trunc('month', item.posted_at)) AS locked
              FROM item LEFT JOIN top ON top.line_id = item.id)) """


def _applied(m: Model):
    from razao.plans.reconcile import auto_apply_reconciliation as run

    lines = m.contested_lines.withColumns(
        {"status": F.lit("pendente"), "matched_transaction_id": F.lit(None).cast("bigint")}
    )
    state = F.when(F.col("id") % 10 == 1, "conciliado").otherwise("nao_conciliado")
    return run(lines, m.contested_transactions.withColumn("reconciliation", state), m.rules, m.closings)


@query(
    "auto_apply_reconciliation",
    _CONTESTED + " rules closings",
    _APPLIED + "SELECT line_id, outcome, reason FROM done",
)
def auto_apply_reconciliation(m: Model):
    return _applied(m).outcomes.select("line_id", "outcome", "reason")


@query(
    "auto_apply_counts",
    _CONTESTED + " rules closings",
    _APPLIED + "SELECT company_id, outcome, reason, count(*) AS lines FROM done GROUP BY company_id, outcome, reason",
)
def auto_apply_counts(m: Model):
    return _applied(m).counts()


@query(
    "auto_apply_hits",
    _CONTESTED + " rules closings",
    _APPLIED + """SELECT rules.id, hit_count + (SELECT count(*) FROM done WHERE outcome = 'created'
           AND rule_id = rules.id) AS hit_count FROM rules""",
)
def auto_apply_hits(m: Model):
    return _applied(m).rules.select("id", "hit_count")


def _folders(m: Model) -> tuple[str, str]:
    """A fresh table and checkpoint folder in the shared checkpoint directory."""
    root = f"{checkpoint_dir(m.spark)}/stream-{uuid.uuid4().hex}"
    return f"{root}/table", f"{root}/progress"


def _stream(m: Model, table: str):
    schema = m.raw(table).schema
    return m.spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(m.sf_dir)


@query(
    "stream_import",
    "statement_lines",
    """SELECT min(id) AS id, bank_account_id, 'day:' || posted_at AS dedup_key FROM statement_lines
       GROUP BY bank_account_id, posted_at""",
)
def stream_import(m: Model):
    """One line per account and day: the day stands for the key, so that keys repeat."""
    from razao.streaming import loads

    table, progress = _folders(m)
    lines = statement_lines_from(_stream(m, "orders")).select(
        "id", "bank_account_id", F.concat(F.lit("day:"), F.col("posted_at").cast("string")).alias("dedup_key")
    )
    loads.prepare_table(m.spark, lines.schema, table)
    loads.stream_import(lines, table, progress).awaitTermination()
    return loads.read_table(m.spark, lines.schema, table).drop("bucket", "batch")


@query(
    "stream_balances",
    sql="""SELECT o_custkey AS bank_account_id, declared_balance, declared_date::VARCHAR AS declared_date
       FROM (SELECT o_custkey, (o_totalprice * 100)::BIGINT AS declared_balance, CAST(o_orderdate AS DATE) AS declared_date
             FROM orders WHERE o_orderkey % 5 <> 0
             QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey DESC) = 1)""",
)
def stream_balances(m: Model):
    """Each order stands for an import that declares its total on its day; one in five declares none."""
    from razao.streaming import loads

    table, progress = _folders(m)
    key = F.col("o_orderkey")
    imports = _stream(m, "orders").select(
        key.alias("id"),
        F.col("o_custkey").alias("bank_account_id"),
        F.when(key % 5 != 0, money.from_decimal(F.col("o_totalprice"))).alias("statement_balance"),
        F.col("o_orderdate").cast("date").alias("statement_balance_date"),
        F.lit("2000-01-01").cast("timestamp_ntz").alias("created_at"),
    )
    schema = loads.newest_declarations(imports).schema
    loads.prepare_table(m.spark, schema, table)
    loads.stream_balances(imports, table, progress).awaitTermination()
    return loads.read_balances(m.spark, schema, table)


@query(
    "stream_audit",
    sql="SELECT event_id AS id, strftime(ts, '%Y-%m') AS month, event_type AS action FROM events",
)
def stream_audit(m: Model):
    from razao.streaming import loads

    table, progress = _folders(m)
    changes = _stream(m, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("action"), F.col("ts").alias("changed_at")
    )
    loads.stream_audit(changes, table, progress).awaitTermination()
    schema = "id bigint, action string, month string"
    return m.spark.read.schema(schema).parquet(table)
