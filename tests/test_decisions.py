"""Batches of decisions: a refused one takes nothing from the others."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from razao.operators import assign
from razao.operators import decisions as dec

DAY = dt.date(2024, 6, 3)
AT = dt.datetime(2024, 6, 4)


def requests(spark, rows, columns):
    full = [(n, AT + dt.timedelta(minutes=50 * n), *row) for n, row in enumerate(rows)]
    return spark.createDataFrame(full, "decision_id bigint, requested_at timestamp, " + columns)


def test_reconcile_as_one_by_one(spark):
    rng = random.Random(5)
    pairs = [(7, 50), (8, 50), (8, 51), *[(rng.randrange(20, 40), rng.randrange(60, 80)) for _ in range(80)]]
    ids = sorted({a for a, _ in pairs} | {b for _, b in pairs})
    lines = spark.createDataFrame(
        [(i, 1, 1, DAY, 5, "m", "pendente", None) for i in ids],
        "id bigint, company_id bigint, bank_account_id bigint, posted_at date, amount bigint, memo string, status string, matched_transaction_id bigint",
    )
    transactions = spark.createDataFrame([(i, 1, "nao_conciliado") for i in ids], "id bigint, bank_account_id bigint, reconciliation string")
    judged = dec.reconcile(requests(spark, pairs, "line_id bigint, transaction_id bigint"), lines, transactions)
    got = {r.decision_id: r.reject_reason for r in judged.collect()}
    used_lines, used_transactions, expected = set(), set(), {}
    for n, (line, transaction) in enumerate(pairs):
        expected[n] = "line" if line in used_lines else "transaction" if transaction in used_transactions else None
        if expected[n] is None:
            used_lines.add(line)
            used_transactions.add(transaction)
    assert got == {n: r and f"{r}_taken_in_batch" for n, r in expected.items()}
    assert got[1] == "transaction_taken_in_batch" and got[2] is None


def test_settle_as_one_by_one(spark):
    rng = random.Random(9)
    asked = [[(100, 50), (101, 900)], [(100, 60)], *[[(i, rng.randrange(1, 60)) for i in rng.sample(range(100, 106), rng.choice([1, 2, 3]))] for _ in range(60)]]
    kinds = "company_id bigint, client_tax_id string, status string"
    invoices = spark.createDataFrame(
        [(i, 100, 0, DAY, 1, None, "aberta") for i in range(100, 106)], "id bigint, amount bigint, withheld_amount bigint, issued_on date, " + kinds
    )
    transactions = spark.createDataFrame(
        [(n, 1, "realizado", 2000, DAY) for n in range(len(asked))], "id bigint, company_id bigint, status string, amount bigint, booking_date date"
    )
    settlements = spark.createDataFrame([], "id bigint, invoice_id bigint, transaction_id bigint, amount bigint, created_at timestamp")
    closings = spark.createDataFrame([], "company_id bigint, period date, locked_at timestamp")
    rows = [(n, AT + dt.timedelta(minutes=50 * n), n, invoice, amount) for n, parts in enumerate(asked) for invoice, amount in parts]
    table = spark.createDataFrame(rows, "decision_id bigint, requested_at timestamp, transaction_id bigint, invoice_id bigint, amount bigint")
    got = {r.decision_id: r.reject_reason for r in dec.settle_invoices(table, transactions, invoices, settlements, closings).collect()}
    left, expected = dict.fromkeys(range(100, 106), 100), {}
    for n, parts in enumerate(asked):
        fits = all(amount <= left[i] for i, amount in parts)
        expected[n] = None if fits else "over_outstanding"
        for i, amount in parts if fits else []:
            left[i] -= amount
    assert got == expected
    assert (got[0], got[1]) == ("over_outstanding", None)


@pytest.fixture
def written(monkeypatch):
    """Counts the tables that a job writes between its steps."""
    count = []
    for module in (dec, assign):
        plain = module.cut_lineage
        monkeypatch.setattr(module, "cut_lineage", lambda df, plain=plain: (count.append(1), plain(df))[1])
    return count


def test_a_chain_of_reconciliations_takes_few_steps(spark, written):
    n = 1000
    # decision k wants line k // 2 and transaction (k + 1) // 2: each one hangs on the one before
    pairs = [(k // 2, (k + 1) // 2) for k in range(n)]
    ids = list(range(n))
    lines = spark.createDataFrame(
        [(i, 1, 1, DAY, 5, "m", "pendente", None) for i in ids],
        "id bigint, company_id bigint, bank_account_id bigint, posted_at date, amount bigint, memo string, status string, matched_transaction_id bigint",
    )
    transactions = spark.createDataFrame([(i, 1, "nao_conciliado") for i in ids], "id bigint, bank_account_id bigint, reconciliation string")
    judged = dec.reconcile(requests(spark, pairs, "line_id bigint, transaction_id bigint"), lines, transactions)
    accepted = {r.decision_id for r in judged.collect() if r.reject_reason is None}
    lines_used, transactions_used, expected = set(), set(), set()
    for k, (line, transaction) in enumerate(pairs):
        if line not in lines_used and transaction not in transactions_used:
            lines_used.add(line)
            transactions_used.add(transaction)
            expected.add(k)
    assert accepted == expected and len(written) < 40


def chained(spark, n):
    """Decision k asks 60 of invoice k and of invoice k + 1, which hold 100."""
    invoices = spark.createDataFrame(
        [(i, 100, 0, DAY, 1, None, "aberta") for i in range(n + 1)],
        "id bigint, amount bigint, withheld_amount bigint, issued_on date, company_id bigint, client_tax_id string, status string",
    )
    transactions = spark.createDataFrame(
        [(k, 1, "realizado", 2000, DAY) for k in range(n)], "id bigint, company_id bigint, status string, amount bigint, booking_date date"
    )
    settlements = spark.createDataFrame([], "id bigint, invoice_id bigint, transaction_id bigint, amount bigint, created_at timestamp")
    closings = spark.createDataFrame([], "company_id bigint, period date, locked_at timestamp")
    rows = [(k, AT + dt.timedelta(minutes=k), k, i, 60) for k in range(n) for i in (k, k + 1)]
    table = spark.createDataFrame(rows, "decision_id bigint, requested_at timestamp, transaction_id bigint, invoice_id bigint, amount bigint")
    return table, transactions, invoices, settlements, closings


@pytest.mark.parametrize("folded_rows", [100_000, 0])
def test_a_chain_of_settlements(spark, written, monkeypatch, folded_rows):
    n = 1000 if folded_rows else 8
    monkeypatch.setattr(dec, "FOLDED_ROWS", folded_rows)
    got = {r.decision_id: r.reject_reason for r in dec.settle_invoices(*chained(spark, n)).collect()}
    assert got == {k: "over_outstanding" if k % 2 else None for k in range(n)}
    assert not folded_rows or len(written) < 40


def test_lines_without_a_transaction_do_not_meet_in_one_task(spark):
    from pyspark.sql import functions as F

    lines = spark.range(4000).selectExpr(
        "id", "1L company_id", "1L bank_account_id", "date'2024-06-03' posted_at", "5L amount", "'m' memo",
        "'pendente' status", "if(id % 10 = 0, id, null) matched_transaction_id",
    )
    transactions = spark.range(0, 4000, 20).selectExpr("id", "1L company_id", "date'2024-06-03' booking_date")
    closings = spark.createDataFrame([(1, DAY.replace(day=1), AT)], "company_id bigint, period date, locked_at timestamp")
    asked = spark.range(4000).selectExpr("id decision_id", "timestamp'2024-06-04' requested_at", "id line_id")
    changed = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {key: spark.conf.get(key) for key in changed}
    try:
        for key, value in changed.items():
            spark.conf.set(key, value)
        judged = dec._matched_month(asked, lines, transactions, closings)
        sizes = [r["count"] for r in judged.groupBy(F.spark_partition_id()).count().collect()]
        months = {r.txn_locked: r["count"] for r in judged.groupBy("txn_locked").count().collect()}
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert months == {True: 200, None: 3800}
    assert sum(sizes) == 4000
    assert max(sizes) < 2000
