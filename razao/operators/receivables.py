"""Matching credits with open invoices.

Credits are taken in order (day, id) and use up outstanding amounts:

1. same tax id and amount equal to one invoice: exact;
2. same tax id, two or more invoices that add up to the credit: likely;
3. same tax id, the oldest invoice the credit falls short of by a plausible withholding: likely;
4. no tax id: exactly one invoice of that amount issued up to 90 days before: likely.

Rules 1 to 3 only touch one client. A client whose credits all find an invoice of their amount is
settled by ranks: the n-th credit of an amount takes the n-th invoice of it, in joins that are
spread by amount and month. The other clients are independent and are processed side by side as
sorted streams.

Rule 4 looks across the clients of a company. It is decided for all such credits at once by a
sweep over the time in which each invoice stood at an amount, and both steps alternate until
the decisions no longer change: only clients whose outside uses changed are played again, and only
the (company, amount) groups in which an invoice's time changed are swept again. The decisions up
to the n-th credit of a company are right after n alternations at the latest, so what does not
change any more is the sequential result; in practice a few alternations are enough.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from razao.operators.assign import running_sums
from razao.session import cut_lineage, forget

# Share of an invoice a credit must reach, and days after issue.
RETENTION_FLOOR = 0.8
WINDOW_DAYS = 90

EXACT, GROUPED, WITHHELD, BY_AMOUNT = 1, 2, 3, 4

# Reachable sums are a bit field once it takes no more than this many bits for each sum.
BITS_A_SUM = 4096


def subset_with_sum(amounts: list[int], target: int) -> list[int] | None:
    """Indices of the first subset, by bit mask, that sums to ``target``.

    The lowest mask has the lowest highest bit, so it ends with the first invoice at which the
    target becomes reachable; the rest of the mask is the lowest one for what is left, among the
    invoices before it.
    """
    chosen: list[int] = []
    while target:
        last = first_reach(amounts, target)
        if last is None:
            return None
        chosen.append(last)
        target -= amounts[last]
        amounts = amounts[:last]
    return chosen[::-1]


def first_reach(amounts: list[int], target: int) -> int | None:
    """The index at which a sum equal to ``target`` first becomes reachable.

    The table of reachable sums up to the target grows amount by amount. It holds each sum once,
    as a sorted array while sums are few and as a field of bits when they are dense, in units of
    the amounts' common divisor. Sums that the remaining amounts cannot lift to the target are
    dropped from the array.
    """
    usable = [(i, a) for i, a in enumerate(amounts) if 0 < a <= target]
    left = sum(a for _, a in usable)
    unit = gcd(*(a for _, a in usable)) or 1
    if left < target or target % unit:
        return None
    goal, left = target // unit, left // unit
    sums, bits, full = np.zeros(1, dtype=np.int64), 0, 0
    for i, amount in usable:
        amount //= unit
        left -= amount
        if not bits and goal <= BITS_A_SUM * len(sums):
            field = np.zeros(goal + 1, dtype=np.uint8)
            field[sums] = 1
            bits = int.from_bytes(np.packbits(field, bitorder="little").tobytes(), "little")
            full = (1 << goal + 1) - 1
        if bits:
            bits |= bits << amount & full
            if bits >> goal & 1:
                return i
            continue
        grown = sums + amount
        if (grown == goal).any():
            return i
        sums = np.union1d(sums, grown[grown < goal])
        sums = sums[sums + left >= goal]
        if not len(sums):
            return None
    return None


class _Client:
    """Open invoices of one client, in issue order, while its credits stream past."""

    def __init__(self, company, tax_id):
        self.key = (company, tax_id)
        self.ids: list = []
        self.issued: list = []
        self.since: list = []
        self.left: np.ndarray | list[int] = []
        self.place: dict = {}
        self.by_amount: dict[int, list[int]] = {}
        self.open = 0

    def add(self, invoice, amount: int, issued) -> None:
        i = len(self.ids)
        self.ids.append(invoice)
        self.issued.append(issued)
        self.since.append((None, None))
        self.left.append(amount)
        self.place[invoice] = i
        self.by_amount.setdefault(amount, []).append(i)  # ascending, so already a heap
        self.open += 1

    def ready(self) -> None:
        if isinstance(self.left, list):
            self.left = np.array(self.left, dtype=np.int64)

    def oldest_with(self, amount: int) -> int | None:
        heap = self.by_amount.get(amount)
        while heap:
            if self.left[heap[0]] == amount:
                return heap[0]
            heapq.heappop(heap)
        return None

    def use(self, i: int, amount: int, when: tuple) -> tuple:
        """Take ``amount`` from invoice i; returns the interval that ends here."""
        ended = (self.ids[i], int(self.left[i]), self.issued[i], *self.since[i], *when)
        self.left[i] -= amount
        self.since[i] = when
        if self.left[i] == 0:
            self.open -= 1
        else:
            heapq.heappush(self.by_amount.setdefault(int(self.left[i]), []), i)
        return ended

    def choose(self, amount: int, floor: float, ceiling: int | None) -> tuple[int, list[int], list[int]]:
        """(rule, invoices, amounts) for a credit of this client; rule 0 when none fits."""
        exact = self.oldest_with(amount)
        if exact is not None:
            return EXACT, [exact], [amount]
        if self.open >= 2 and (ceiling is None or self.open <= ceiling):
            live = np.flatnonzero(self.left > 0)
            chosen = subset_with_sum([int(v) for v in self.left[live]], amount)
            if chosen and len(chosen) >= 2:
                places = [int(live[i]) for i in chosen]
                return GROUPED, places, [int(self.left[i]) for i in places]
        short = (self.left > amount) & (amount >= self.left * floor)
        if short.any():
            return WITHHELD, [int(np.argmax(short))], [amount]
        return 0, [], []


_COLUMNS = [
    "kind", "company_id", "client_tax_id", "credit_id", "rule", "position", "invoice_id", "amount",
    "issued_on", "from_day", "from_ref", "to_day", "to_ref",
]


def _stream(floor: float, ceiling: int | None):
    """Batches sorted by client, invoices first, then credits and outside uses in order."""

    def finish(client: _Client, out: list) -> None:
        client.ready()
        for i in np.flatnonzero(client.left > 0):
            row = (client.ids[i], int(client.left[i]), client.issued[i], *client.since[i], None, None)
            out.append(_interval(client, row))

    def _interval(client: _Client, row: tuple) -> tuple:
        return ("interval", *client.key, None, None, None, *row)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client: _Client | None = None
        for batch in batches:
            out: list[tuple] = []
            for company, tax_id, phase, day, ref, invoice, amount in zip(
                batch.company_id, batch.client_tax_id, batch.phase, batch.day, batch.ref,
                batch.invoice_id, batch.amount, strict=True,
            ):
                if client is None or client.key != (company, tax_id):
                    if client is not None:
                        finish(client, out)
                    client = _Client(company, tax_id)
                if phase == 0:
                    client.add(ref, int(amount), day)
                    continue
                client.ready()
                when = (day, ref)
                if phase == 2:  # used up by a credit without tax id
                    i = client.place.get(invoice)
                    if i is not None and client.left[i] == amount:
                        out.append(_interval(client, client.use(i, int(amount), when)))
                    continue
                rule, places, amounts = client.choose(int(amount), floor, ceiling)
                if rule == 0:
                    out.append(("match", *client.key, ref, 0, 0, None, int(amount), *[None] * 5))
                for position, (i, used) in enumerate(zip(places, amounts, strict=True)):
                    out.append(_interval(client, client.use(i, used, when)))
                    out.append(
                        ("match", *client.key, ref, rule, position, client.ids[i], used, *[None] * 5)
                    )
            if out:
                yield pd.DataFrame(out, columns=_COLUMNS)
        if client is not None:
            out = []
            finish(client, out)
            if out:
                yield pd.DataFrame(out, columns=_COLUMNS)

    return run


CLIENT = ["company_id", "client_tax_id"]
GROUP = ["company_id", "amount"]
SPAN = [*CLIENT, "invoice_id", "amount", "issued_on", "from_day", "from_ref", "to_day", "to_ref"]


def _result_schema(credits: DataFrame, kind: str) -> str:
    company = dict(credits.dtypes)["company_id"]
    return (
        f"kind string, company_id {company}, client_tax_id string, credit_id {kind}, rule int, "
        f"position int, invoice_id {kind}, amount bigint, issued_on date, from_day date, "
        f"from_ref {kind}, to_day date, to_ref {kind}"
    )


def _play_clients(
    credits: DataFrame, invoices: DataFrame, uses: DataFrame, floor: float, ceiling: int | None
) -> DataFrame:
    """Rules 1 to 3 for the clients with credits, given the outside uses of their invoices.

    One sorted stream per partition of (company, tax id); a task holds the open invoices of
    one client at a time, never its credits.
    """
    kind = dict(invoices.dtypes)["id"]
    none = F.lit(None).cast(kind)
    clients = credits.select(*CLIENT).distinct()
    parts = [
        invoices.join(clients, CLIENT, "left_semi").select(
            *CLIENT, F.lit(0).alias("phase"), F.col("issued_on").alias("day"), F.col("id").alias("ref"),
            none.alias("invoice_id"), F.col("outstanding").alias("amount"),
        ),
        credits.select(
            *CLIENT, F.lit(1).alias("phase"), F.col("booking_date").alias("day"), F.col("id").alias("ref"),
            none.alias("invoice_id"), "amount",
        ),
        uses.join(clients, CLIENT, "left_semi").select(
            *CLIENT, F.lit(2).alias("phase"), "day", "ref", "invoice_id", "amount"
        ),
    ]
    ordered = (
        parts[0]
        .unionByName(parts[1])
        .unionByName(parts[2])
        .withColumn("_later", F.col("phase") > 0)
        # Hashed as a column of its own: a shuffle on the plain key may be dropped where all
        # parts already have that partitioning, and the union of parts coalesced at run time
        # to different widths does not keep a client together.
        .withColumn("_client", F.xxhash64(*CLIENT))
        .repartition("_client")
        .sortWithinPartitions(*CLIENT, "_later", "day", "ref")
        .drop("_later", "_client")
    )
    schema = _result_schema(credits, kind)
    # Ids stay text on the Python side so that nulls do not turn integers into floats.
    as_text = ordered.withColumns({c: F.col(c).cast("string") for c in ("invoice_id", "ref")})
    # The order inside a client was set on typed ids above; the cast keeps the row order.
    text_schema = schema
    for name in ("credit_id", "invoice_id", "from_ref", "to_ref"):
        text_schema = text_schema.replace(f"{name} {kind}", f"{name} string")
    played = as_text.mapInPandas(_stream(floor, ceiling), text_schema)
    return played.withColumns(
        {c: F.col(c).cast(kind) for c in ("credit_id", "invoice_id", "from_ref", "to_ref")}
    )


def short_clients(credits: DataFrame, invoices: DataFrame) -> DataFrame:
    """Clients with more credits of some amount than invoices of that amount."""
    asked = credits.groupBy(*CLIENT, "amount").agg(F.count("*").alias("_asked"))
    held = invoices.groupBy(*CLIENT, F.col("outstanding").alias("amount")).agg(F.count("*").alias("_held"))
    return (
        asked.join(held, [*CLIENT, "amount"], "left")
        .where(F.col("_asked") > F.coalesce("_held", F.lit(0)))
        .select(*CLIENT)
        .distinct()
    )


def _zip_clients(credits: DataFrame, invoices: DataFrame) -> DataFrame:
    """Clients in which every credit has an invoice of its amount: the n-th takes the n-th.

    Without outside uses the sequential scan does the same: an exact invoice comes before the
    other rules, and it is always the oldest one of the amount. Rows like those of the streams.
    """
    kind = dict(invoices.dtypes)["id"]
    none = F.lit(None)
    one = {"_rank": F.lit(1)}
    taking = running_sums(
        credits.withColumn("_month", F.trunc("booking_date", "MM")), [*CLIENT, "amount"], ["booking_date", "id"], "_month", one
    ).select(*CLIENT, "amount", "_rank", F.col("booking_date").alias("_day"), F.col("id").alias("_credit"))
    held = running_sums(
        invoices.withColumnRenamed("outstanding", "amount").withColumn("_month", F.trunc("issued_on", "MM")),
        [*CLIENT, "amount"], ["issued_on", "id"], "_month", one,
    )
    pairs = held.join(taking, [*CLIENT, "amount", "_rank"], "left")
    span = F.struct(
        F.lit("interval").alias("kind"), none.cast(kind).alias("credit_id"), none.cast("int").alias("rule"),
        none.cast("int").alias("position"), F.col("issued_on").alias("issued_on"),
        F.col("_day").alias("to_day"), F.col("_credit").alias("to_ref"),
    )
    match = F.struct(
        F.lit("match").alias("kind"), F.col("_credit").alias("credit_id"), F.lit(EXACT).alias("rule"),
        F.lit(0).alias("position"), none.cast("date").alias("issued_on"),
        none.cast("date").alias("to_day"), none.cast(kind).alias("to_ref"),
    )
    both = F.when(F.col("_credit").isNotNull(), F.array(span, match)).otherwise(F.array(span))
    return pairs.select(*CLIENT, F.col("id").alias("invoice_id"), "amount", F.inline(both)).select(
        "kind", *CLIENT, "credit_id", "rule", "position", "invoice_id", "amount", "issued_on",
        none.cast("date").alias("from_day"), none.cast(kind).alias("from_ref"), "to_day", "to_ref",
    )


def _decide_by_amount(spans: DataFrame, blind: DataFrame, window: int) -> DataFrame:
    """Rule 4: credits without tax id that see exactly one invoice of their amount.

    A sweep instead of pairs: each interval adds one at its start and takes it away at its
    end, and a running count tells each credit how many invoices it sees; a running sum of
    id hashes tells which one when it is one. Sums run per company, amount and month.
    """
    seen = spans.join(blind.select(*GROUP).distinct(), GROUP, "left_semi").withColumn(
        "_hash", F.xxhash64("invoice_id")
    )
    no_ref = F.lit(None).cast(dict(spans.dtypes)["invoice_id"]).alias("ref")

    def place(day, ref, phase):
        return F.struct(day.alias("day"), ref.alias("ref"), F.lit(phase).alias("phase"))

    opened = place(F.col("issued_on"), no_ref, 0)
    after = F.when(F.col("from_day").isNotNull(), place(F.col("from_day"), F.col("from_ref"), 2))
    expired = place(F.date_add("issued_on", window + 1), no_ref, 0)
    used = F.when(F.col("to_day").isNotNull(), place(F.col("to_day"), F.col("to_ref"), 2))
    timed = seen.withColumn("_start", F.greatest(opened, after)).withColumn(
        "_end", F.least(expired, used)
    ).where(F.col("_start") < F.col("_end"))
    marks = F.array(
        F.struct(F.col("_start").alias("at"), F.lit(1).alias("delta")),
        F.struct(F.col("_end").alias("at"), F.lit(-1).alias("delta")),
    )
    moves = timed.select(*GROUP, "_hash", F.explode(marks).alias("_m")).select(
        *GROUP, "_m.at.day", "_m.at.ref", "_m.at.phase", "_m.delta",
        (F.col("_hash").cast("decimal(20,0)") * F.col("_m.delta")).alias("hash"),
    )
    asks = blind.select(
        *GROUP, F.col("booking_date").alias("day"), F.col("id").alias("ref"), F.lit(1).alias("phase"),
        F.lit(0).alias("delta"), F.lit(0).cast("decimal(31,0)").alias("hash"),
    )
    swept = running_sums(
        moves.unionByName(asks).withColumn("month", F.trunc("day", "MM")),
        GROUP,
        ["day", "ref", "phase"],
        "month",
        {"_count": F.col("delta"), "_which": F.col("hash")},
    )
    alone = swept.where((F.col("phase") == 1) & (F.col("_count") == 1)).select(*GROUP, "day", "ref", "_which")
    # The hash takes the type of the sums, not the sums that of a hash: the planner may cast a sum over
    # many open invoices before it looks at the count.
    named = seen.select(
        *GROUP, "invoice_id", "client_tax_id", F.col("_hash").cast(dict(swept.dtypes)["_which"]).alias("_which")
    ).distinct()
    return alone.join(named, [*GROUP, "_which"]).select(*CLIENT, "day", "ref", "invoice_id", "amount")


def _difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of both has; neither holds a row twice."""
    both = a.unionByName(b)
    return both.groupBy(*a.columns).agg(F.count("*").alias("_n")).where("_n = 1").drop("_n")


def match_receivables(
    credits: DataFrame,
    invoices: DataFrame,
    retention_floor: float = RETENTION_FLOOR,
    window_days: int = WINDOW_DAYS,
    group_ceiling: int | None = None,
) -> DataFrame:
    """One row per (credit, invoice) proposed, and one with a null invoice per unmatched credit.

    ``credits`` (company_id, id, booking_date, amount, payer_tax_id or null), ``invoices``
    (company_id, id, issued_on, outstanding, client_tax_id or null). With ``group_ceiling``, rule 2
    only looks at clients with at most so many open invoices.
    """
    # Both sides are read in every round: their few columns are written once.
    credits = cut_lineage(credits.select("company_id", "id", "booking_date", "amount", "payer_tax_id"))
    invoices = cut_lineage(
        invoices.select("company_id", "id", "issued_on", "outstanding", "client_tax_id").where(F.col("outstanding") > 0)
    )
    kind = dict(invoices.dtypes)["id"]
    blind = credits.where(F.col("payer_tax_id").isNull()).drop("payer_tax_id")
    credits = credits.where(F.col("payer_tax_id").isNotNull()).withColumnRenamed("payer_tax_id", "client_tax_id")
    uses = blind.select(
        "company_id", F.lit(None).cast("string").alias("client_tax_id"), F.col("booking_date").alias("day"),
        F.col("id").alias("ref"), F.lit(None).cast(kind).alias("invoice_id"), "amount",
    ).limit(0)
    short = cut_lineage(short_clients(credits, invoices))
    payers = credits.select(*CLIENT).distinct()
    zipped = _zip_clients(
        credits.join(short, CLIENT, "left_anti"),
        invoices.join(payers.join(short, CLIENT, "left_anti"), CLIENT, "left_semi"),
    )
    streamed = _play_clients(credits.join(short, CLIENT, "left_semi"), invoices, uses, retention_floor, group_ceiling)
    first = cut_lineage(zipped.unionByName(streamed))
    # Invoices of clients without credits (and without tax id) stand as they are until used.
    idle = cut_lineage(
        invoices.join(payers, CLIENT, "left_anti")
        .withColumnRenamed("outstanding", "amount")
        .join(blind.select(*GROUP).distinct(), GROUP, "left_semi")
        .select(*CLIENT, F.col("id").alias("invoice_id"), "amount", "issued_on")
    )

    def idle_spans(rows: DataFrame, used: DataFrame) -> DataFrame:
        first_use = used.groupBy("invoice_id").agg(F.min(F.struct("day", "ref")).alias("_u"))
        return rows.join(first_use, "invoice_id", "left").select(
            *CLIENT, "invoice_id", "amount", "issued_on", F.lit(None).cast("date").alias("from_day"),
            F.lit(None).cast(kind).alias("from_ref"), F.col("_u.day").alias("to_day"), F.col("_u.ref").alias("to_ref"),
        )

    def spans_of(played: DataFrame) -> DataFrame:
        return played.where("kind = 'interval'").select(*SPAN)

    decided = cut_lineage(_decide_by_amount(spans_of(first).unionByName(idle_spans(idle, uses)), blind, window_days))
    again = first.limit(0)  # the latest play of every client that was played again
    while True:
        moved = _difference(decided, uses)
        if moved.isEmpty():
            break
        clients = moved.where(F.col("client_tax_id").isNotNull()).select(*CLIENT).distinct()
        played = cut_lineage(
            _play_clients(
                credits.join(clients, CLIENT, "left_semi"), invoices, decided.join(clients, CLIENT, "left_semi"),
                retention_floor, group_ceiling,
            )
        )
        before = again.select(*CLIENT).distinct()
        old = spans_of(again).unionByName(spans_of(first).join(before, CLIENT, "left_anti"))
        touched = _difference(spans_of(played), old.join(clients, CLIENT, "left_semi"))
        groups = moved.select(*GROUP).union(touched.select(*GROUP)).distinct()
        groups = cut_lineage(groups)
        latest = cut_lineage(again.join(clients, CLIENT, "left_anti").unionByName(played))
        forget(again, played)
        again = latest
        now = (
            spans_of(first).join(groups, GROUP, "left_semi").join(again.select(*CLIENT).distinct(), CLIENT, "left_anti")
            .unionByName(spans_of(again).join(groups, GROUP, "left_semi"))
            .unionByName(idle_spans(idle.join(groups, GROUP, "left_semi"), decided))
        )
        swept = _decide_by_amount(now, blind.join(groups, GROUP, "left_semi"), window_days)
        after = cut_lineage(decided.join(groups, GROUP, "left_anti").unionByName(swept))
        forget(uses, groups)
        uses, decided = decided, after
    changed = again.select(*CLIENT).distinct()
    played = first.where("kind = 'match'").join(changed, CLIENT, "left_anti").unionByName(again.where("kind = 'match'"))
    by_client = played.select(
        "company_id", F.col("credit_id").alias("transaction_id"), "rule", "position", "invoice_id", "amount"
    )
    by_amount = uses.select(
        "company_id", F.col("ref").alias("transaction_id"), F.lit(BY_AMOUNT).alias("rule"),
        F.lit(0).alias("position"), "invoice_id", "amount",
    )
    unmatched = blind.join(uses.select(F.col("ref").alias("id")), "id", "left_anti").select(
        "company_id", F.col("id").alias("transaction_id"), F.lit(0).alias("rule"),
        F.lit(0).alias("position"), F.lit(None).cast(kind).alias("invoice_id"), "amount",
    )
    confidence = F.when(F.col("rule") == EXACT, "exact").when(F.col("rule") > 0, "likely").otherwise("none")
    return by_client.unionByName(by_amount).unionByName(unmatched).withColumn("confidence", confidence)


def match_reasons(matches: DataFrame, invoices: DataFrame) -> DataFrame:
    """Why each credit is matched, in the words the screens show."""
    numbered = matches.where(F.col("rule") > 0).join(
        invoices.select(F.col("id").alias("invoice_id"), "number"), "invoice_id"
    )
    # The parts of one credit, invoices of one client.
    per_credit = numbered.groupBy("company_id", "transaction_id", "confidence", "rule").agg(
        F.array_sort(F.collect_list(F.struct("position", "number"))).alias("_n")
    )
    numbers = F.array_join(F.transform("_n", lambda n: n["number"]), ", ")
    rule = F.col("rule")
    reason = (
        F.when(
            rule == EXACT,
            F.concat(F.lit("Mesmo CNPJ/CPF e valor exatamente igual ao saldo em aberto da nota "), numbers, F.lit(".")),
        )
        .when(
            rule == GROUPED,
            F.concat(
                F.lit("Mesmo CNPJ/CPF; o valor bate com a soma de "), F.size("_n").cast("string"),
                F.lit(" notas em aberto ("), numbers, F.lit(")."),
            ),
        )
        .when(
            rule == WITHHELD,
            F.concat(
                F.lit("Mesmo CNPJ/CPF; valor abaixo do saldo em aberto da nota "), numbers,
                F.lit(" — provável retenção de imposto."),
            ),
        )
        .otherwise(
            F.concat(
                F.lit("O extrato não trouxe CNPJ/CPF do pagador; valor exato e dentro da janela de "
                      "vencimento da nota "),
                numbers,
                F.lit("."),
            )
        )
    )
    return per_credit.select(
        "company_id", "transaction_id", "confidence", "rule", numbers.alias("invoices"), reason.alias("reason")
    )


def settlement_requests(matches: DataFrame, invoices: DataFrame) -> DataFrame:
    """Allocations asked for by the exact matches, with the outstanding read at the start."""
    start = invoices.select(F.col("id").alias("invoice_id"), F.col("outstanding").alias("_outstanding"))
    return matches.where(F.col("confidence") == "exact").join(start, "invoice_id").select(
        F.col("transaction_id").alias("decision_id"),
        "transaction_id",
        "invoice_id",
        F.col("_outstanding").alias("amount"),
    )
