"""Balances, ledgers, projections and recurrences."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from razao.operators import balances as bal
from razao.operators import recurrences as rec
from razao.operators import series as ser
from razao.operators.cycle import working_month
from razao.schema import ACCOUNTS


def day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def accounts(spark, *rows):
    full = [(i, 1, f"Conta {i}", "corrente", cents, day(opened), None, True) for i, cents, opened in rows]
    return spark.createDataFrame(full, ACCOUNTS)


def movement(spark, *rows):
    full = [
        (n, 1, account, day(date), cents, status, "nao_conciliado", False)
        for n, (account, date, cents, status) in enumerate(rows)
    ]
    return spark.createDataFrame(
        full,
        "id bigint, company_id bigint, bank_account_id bigint, booking_date date, amount bigint, "
        "status string, reconciliation string, is_transfer boolean",
    )


DONE, PLANNED = "realizado", "previsto"


OPENED, OPENING = "2024-02-10", 41235
MOVES = [
    (1, "2024-02-12", 1999, DONE), (1, "2024-02-28", -50001, DONE), (1, "2024-02-28", 733, DONE),
    (1, "2024-03-01", 120, PLANNED), (1, "2024-03-01", 64, DONE), (1, "2024-03-19", 8800, DONE),
]


def plain_balance(date: str) -> int:
    return OPENING + sum(cents for _, on, cents, status in MOVES if status == DONE and on <= date) if date >= OPENED else 0


def test_balance_on(spark):
    one, moves = accounts(spark, (1, OPENING, OPENED)), movement(spark, *MOVES)
    for date in ("2024-02-09", "2024-02-10", "2024-02-27", "2024-02-28", "2024-03-01", "2024-03-31"):
        assert bal.balance_on(one, moves, date).first().balance == plain_balance(date)


def test_daily_balances(spark):
    one, moves = accounts(spark, (1, OPENING, OPENED)), movement(spark, *MOVES)

    def series(first, last):
        return {r.date.isoformat(): r.balance for r in ser.daily_balances(one, moves, first, last).collect()}

    for first, last, days in (("2024-02-10", "2024-03-20", 40), ("2024-03-04", "2024-03-06", 3)):
        found = series(first, last)
        assert len(found) == days and found == {d: plain_balance(d) for d in found}
    before = series("2024-02-08", "2024-02-11")
    assert set(before.values()) == {OPENING}


def project(spark, opening, first, last, *entries, minimum=None):
    openings = spark.createDataFrame(
        [(1, opening, minimum)], "company_id bigint, opening_balance bigint, minimum_balance bigint"
    )
    rows = movement(spark, *[(1, *entry) for entry in entries])
    days = ser.project(openings, rows, first, last)
    return days.orderBy("date").collect(), ser.projection_summary(days).first()


def plain_projection(opening, first, last, entries):
    """(balance per day, what overdue plans bring to the first day)."""
    overdue = sum(c for on, c, status in entries if status == PLANNED and on < first)
    days = [day(first) + dt.timedelta(n) for n in range((day(last) - day(first)).days + 1)]
    sums = [sum(c for on, c, _ in entries if first <= on <= d.isoformat()) for d in days]
    return [opening + overdue + total for total in sums], overdue


def test_projection(spark):
    entries = [("2024-11-13", 2310, PLANNED), ("2024-11-14", -9125, PLANNED), ("2024-11-18", 6400, PLANNED)]
    days, total = project(spark, 5050, "2024-11-13", "2024-11-19", *entries)
    expected, _ = plain_projection(5050, "2024-11-13", "2024-11-19", entries)
    assert [d.balance for d in days] == expected
    # The 15th is a holiday, the 16th and 17th a weekend.
    assert [d.is_business_day for d in days] == [True, True, False, False, False, True, True]
    lowest = min(expected)
    assert (total.lowest_balance, total.final_balance) == (lowest, expected[-1])
    assert total.first_negative_date == total.lowest_balance_date == day("2024-11-14")


def test_projection_brings_overdue_forward(spark):
    entries = [("2024-10-30", -710, PLANNED), ("2024-11-02", -1290, PLANNED), ("2024-11-13", 45, PLANNED)]
    days, total = project(spark, 9000, "2024-11-12", "2024-11-14", *entries, ("2024-11-03", 31, DONE), minimum=7040)
    expected, overdue = plain_projection(9000, "2024-11-12", "2024-11-14", entries)
    assert ([d.balance for d in days], days[0].overdue_brought_forward) == (expected, overdue)
    assert (total.first_below_minimum_date, total.first_negative_date) == (day("2024-11-12"), None)


def test_horizons(spark):
    openings = spark.createDataFrame([(1, 0, None)], "company_id bigint, opening_balance bigint, minimum_balance bigint")
    rows = ser.project(openings, movement(spark, (1, "2025-03-05", 1, PLANNED)), "2025-03-01", F.lit("2025-05-30").cast("date"))
    assert rows.count() == 91


def test_recurrences(spark):
    def expand(start, frequency, first, last, dom=None, end=None):
        row = [(1, day(start), frequency, dom, end and day(end))]
        df = spark.createDataFrame(row, "id int, start_date date, frequency string, day_of_month int, end_date date")
        rows = rec.expand_recurrences(df, first, last).orderBy("booking_date").collect()
        return [r.booking_date.isoformat()[5:] for r in rows]

    assert expand("2025-01-10", "mensal", "2025-01-01", "2025-04-30") == ["01-10", "02-10", "03-10", "04-10"]
    assert expand("2025-01-31", "mensal", "2025-01-01", "2025-05-31", 31) == ["01-31", "02-28", "03-31", "04-30", "05-31"]
    assert expand("2025-01-31", "mensal", "2025-01-01", "2025-03-31") == ["01-31", "02-28", "03-28"]
    assert expand("2025-01-10", "mensal", "2025-01-01", "2025-12-31", None, "2025-03-01") == ["01-10", "02-10"]
    assert expand("2025-03-03", "semanal", "2025-03-01", "2025-03-24") == ["03-03", "03-10", "03-17", "03-24"]
    assert expand("2025-03-03", "quinzenal", "2025-03-01", "2025-03-31") == ["03-03", "03-17", "03-31"]
    assert expand("2024-01-10", "mensal", "2025-02-01", "2025-03-31") == ["02-10", "03-10"]
    assert expand("2024-02-29", "anual", "2024-01-01", "2028-12-31") == ["02-29", "02-28", "02-28", "02-28", "02-28"]
    assert len(expand("1900-01-01", "semanal", "1900-01-01", "2024-12-31")) == (day("2024-12-31") - day("1900-01-01")).days // 7 + 1
    assert expand("1900-01-01", "semanal", "2024-12-01", "2024-12-31")[-1] == "12-30"
    assert expand("2024-02-29", "anual", "2028-01-01", "2028-12-31", 29) == ["02-29"]


def test_working_month(spark):
    one = accounts(spark, (1, 0, "2025-01-15"))
    closing = spark.createDataFrame(
        [(1, day("2025-08-01"), dt.datetime(2025, 9, 1))], "company_id bigint, period date, locked_at timestamp"
    )
    none = closing.limit(0)
    assert working_month(one, none, "2025-09-01").first().working_month == day("2025-08-01")
    assert working_month(one, closing, "2025-09-01").first().working_month == day("2025-09-01")
    assert working_month(one, none, "2025-01-20").first().working_month == day("2025-01-01")


def test_many_children_spread_over_chunks(spark):
    from razao.sources.tables import embed_chunks

    children = spark.range(300_000).selectExpr("1L AS parent", "id AS child").union(spark.createDataFrame([(2, 5), (2, 5), (2, 3)], "parent bigint, child bigint"))
    rows = embed_chunks(children, "parent", "child", "children", 1000).collect()
    assert sorted((r.chunk, r.children[0], len(r.children)) for r in rows if r.parent == 1) == [(i, 1000 * i, 1000) for i in range(300)]
    assert [(r.chunk, list(r.children)) for r in rows if r.parent == 2] == [(0, [3, 5])]
