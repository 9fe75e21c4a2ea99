"""Receivables against a plain re-statement of the four rules, credit by credit."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from razao.operators import receivables as rcv

CREDITS = "company_id bigint, id bigint, booking_date date, amount bigint, payer_tax_id string"
INVOICES = "company_id bigint, id bigint, issued_on date, outstanding bigint, client_tax_id string"


def plain_subset(amounts, target):
    for mask in range(1, 1 << len(amounts)):
        chosen = [i for i in range(len(amounts)) if mask >> i & 1]
        if sum(amounts[i] for i in chosen) == target:
            return chosen
    return None


def one_by_one(credits, invoices):
    left = {row[1]: row[3] for row in invoices}
    out = set()
    for company, credit, day, amount, tax_id in sorted(credits, key=lambda r: (r[2], r[1])):
        mine = sorted((r for r in invoices if r[0] == company), key=lambda r: (r[2], r[1]))
        if tax_id:
            live = [r[1] for r in mine if r[4] == tax_id and left[r[1]] > 0]
            exact = [i for i in live if left[i] == amount]
            group = plain_subset([left[i] for i in live], amount) if len(live) >= 2 and not exact else None
            short = [i for i in live if left[i] > amount >= left[i] * 0.8]
            if exact:
                chosen, rule = exact[:1], 1
            elif group and len(group) >= 2:
                chosen, rule = [live[i] for i in group], 2
            elif short:
                chosen, rule = short[:1], 3
            else:
                chosen, rule = [], 0
        else:
            seen = [r[1] for r in mine if left[r[1]] == amount and 0 <= (day - r[2]).days <= 90]
            chosen, rule = (seen, 4) if len(seen) == 1 else ([], 0)
        for i in chosen:
            left[i] -= left[i] if rule == 2 else amount
            out.add((credit, rule, i))
        if not chosen:
            out.add((credit, 0, None))
    return out


def run(spark, credits, invoices, **options):
    rows = rcv.match_receivables(
        spark.createDataFrame(credits, CREDITS), spark.createDataFrame(invoices, INVOICES), **options
    ).collect()
    return {(r.transaction_id, r.rule, r.invoice_id) for r in rows}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_plain_restatement(spark, seed):
    rng = random.Random(seed)
    day = lambda: dt.date(2025, 1, 1) + dt.timedelta(days=rng.randrange(200))
    clients = [None, "A", "B", "C", "D"]
    invoices = [
        (rng.randrange(2), 100 + i, day(), 100 * rng.randrange(1, 12), rng.choice(clients)) for i in range(70)
    ]
    credits = [
        (rng.randrange(2), 1000 + i, day(), rng.choice([100, 90, 50]) * rng.randrange(1, 14), rng.choice(clients))
        for i in range(90)
    ]
    assert run(spark, credits, invoices) == one_by_one(credits, invoices)


def test_subset_is_the_lowest_mask():
    rng = random.Random(7)
    for _ in range(200):
        amounts = [rng.randrange(1, 30) for _ in range(rng.randrange(1, 11))]
        target = rng.randrange(1, 90)
        assert rcv.subset_with_sum(amounts, target) == plain_subset(amounts, target)


D = dt.date


@pytest.mark.parametrize(
    ("credits", "invoices", "expected"),
    [
        ([(1, 1, D(2025, 5, 1), 100000, "T")], [(1, 9, D(2025, 4, 1), 100000, "T")], {(1, 1, 9)}),
        ([(1, 1, D(2025, 5, 1), 93500, "T")], [(1, 9, D(2025, 4, 1), 100000, "T")], {(1, 3, 9)}),
        ([(1, 1, D(2025, 5, 1), 50000, "T")], [(1, 9, D(2025, 4, 1), 100000, "T")], {(1, 0, None)}),
        (
            [(1, 1, D(2025, 5, 1), 150000, "T")],
            [(1, 8, D(2025, 4, 1), 100000, "T"), (1, 9, D(2025, 4, 1), 50000, "T")],
            {(1, 2, 8), (1, 2, 9)},
        ),
        (
            [(1, 1, D(2025, 5, 1), 50000, "T"), (1, 2, D(2025, 5, 1), 50000, "T")],
            [(1, 8, D(2025, 4, 1), 50000, "T"), (1, 9, D(2025, 4, 1), 50000, "T")],
            {(1, 1, 8), (2, 1, 9)},
        ),
        (
            [(1, 1, D(2025, 5, 1), 20000, "T")],
            [(1, 10 + i, D(2025, 4, 1), 10000, "T") for i in range(25)],
            {(1, 2, 10), (1, 2, 11)},
        ),
        ([(1, 1, D(2025, 4, 20), 100000, None)], [(1, 9, D(2025, 4, 1), 100000, "T")], {(1, 4, 9)}),
        ([(1, 1, D(2025, 8, 1), 100000, None)], [(1, 9, D(2025, 4, 1), 100000, "T")], {(1, 0, None)}),
        (
            [(1, 1, D(2025, 4, 20), 100000, None)],
            [(1, 8, D(2025, 4, 1), 100000, "T"), (1, 9, D(2025, 4, 1), 100000, "U")],
            {(1, 0, None)},
        ),
        ([(1, 1, D(2025, 5, 1), 100000, "X")], [(1, 9, D(2025, 4, 1), 100000, "T")], {(1, 0, None)}),
    ],
)
def test_known_cases(spark, credits, invoices, expected):
    assert run(spark, credits, invoices) == expected


def test_a_ceiling_for_groups_can_be_set(spark):
    credits = [(1, 1, D(2025, 5, 1), 20000, "T")]
    invoices = [(1, 10 + i, D(2025, 4, 1), 10000, "T") for i in range(25)]
    assert run(spark, credits, invoices, group_ceiling=24) == {(1, 0, None)}
    assert run(spark, credits, invoices[:24], group_ceiling=24) == {(1, 2, 10), (1, 2, 11)}


@pytest.mark.parametrize("n", [25, 60])
def test_groups_of_many_open_invoices(n):
    rng = random.Random(n)
    amounts = [rng.randrange(10_000, 90_000_000) for _ in range(n)]
    wanted = sorted(rng.sample(range(n // 2), 5))
    target = sum(amounts[i] for i in wanted)
    got = rcv.subset_with_sum(amounts, target)
    assert sum(amounts[i] for i in got) == target and max(got) <= max(wanted)
    assert rcv.subset_with_sum([2 * a for a in amounts], 2 * target + 1) is None
    small = [rng.randrange(1, 400) * 25 for _ in range(n)]
    got = rcv.subset_with_sum(small, 25 * 3000)
    assert sum(small[i] for i in got) == 25 * 3000
    # no mask below: the sum cannot be reached before the last part, and so on downwards
    for place in range(len(got) - 1, -1, -1):
        rest = sum(small[i] for i in got[: place + 1])
        assert rcv.first_reach(small[: got[place]], rest) is None


def test_sparse_and_dense_sums_agree(monkeypatch):
    rng = random.Random(3)
    cases = [([rng.randrange(1, 300) for _ in range(rng.randrange(1, 12))], rng.randrange(1, 900)) for _ in range(150)]
    dense = [rcv.subset_with_sum(a, t) for a, t in cases]
    monkeypatch.setattr(rcv, "BITS_A_SUM", 0)
    assert [rcv.subset_with_sum(a, t) for a, t in cases] == dense == [plain_subset(a, t) for a, t in cases]


def test_exact_clients_skip_the_stream(spark, monkeypatch):
    rng = random.Random(11)
    invoices = [(i % 3, 1000 + i, D(2025, 1, 1) + dt.timedelta(days=rng.randrange(90)), 100 * rng.randrange(1, 4), "A") for i in range(300)]
    credits = [(c, 5000 + i, day + dt.timedelta(days=rng.randrange(60)), a, t) for i, (c, _, day, a, t) in enumerate(rng.sample(invoices, 200))]
    expected = one_by_one(credits, invoices)
    rows = (spark.createDataFrame(credits, CREDITS), spark.createDataFrame(invoices, INVOICES))
    assert rcv.short_clients(rows[0].withColumnRenamed("payer_tax_id", "client_tax_id"), rows[1]).isEmpty()
    assert run(spark, credits, invoices) == expected and {r for _, r, _ in expected} == {1}
    # a credit without tax id that takes one of their invoices sends its client through the stream
    odd = [(0, 9000, D(2025, 2, 1), 777, "A")]
    blind = [(0, 9001, D(2025, 2, 2), 777, None), (1, 9002, D(2025, 2, 2), 100, None)]
    invoices += [(r[0], r[1] + 100, r[2], r[3], "B") for r in odd]
    assert run(spark, credits + blind, invoices) == one_by_one(credits + blind, invoices)


def test_thousands_of_open_invoices_of_one_amount(spark):
    """The sum of their id hashes is far beyond one hash; a credit that sees one still finds it."""
    day = dt.date(2024, 1, 10)
    crowd = [(1, i, day, 100, None) for i in range(1, 5001)]
    invoices = [*crowd, (1, 9001, day, 700, None)]
    credits = [(1, 1, dt.date(2024, 1, 20), 100, None), (1, 2, dt.date(2024, 1, 21), 700, None)]
    assert run(spark, credits, invoices) == {(1, 0, None), (2, 4, 9001)}
