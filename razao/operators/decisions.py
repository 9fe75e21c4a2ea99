"""State transitions as batch jobs.

The reference changes one row per call. Here a table of requested decisions meets the state
tables; each job returns the decisions with ``reject_reason`` (null means accepted), and the
state functions apply the accepted ones. One bad decision never blocks the others.

Inside a batch the earliest valid request (``requested_at``, then id) wins a line or a
transaction; later ones are returned with a reason and can be asked again. The first request
is found with a minimum, which reduces on the map side, so many requests for one row cost
nothing extra.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from razao.functions.money import direction_of
from razao.functions.text import description_fallback
from razao.operators.assign import components, running_sums
from razao.operators.balances import invoice_balances
from razao.operators.filters import EDITABLE_FIELDS, lock_reasons, role_rank, with_period_lock
from razao.schema import (
    INVOICE_CANCELLED,
    INVOICE_OPEN,
    INVOICE_PAID,
    INVOICE_PARTIAL,
    LINE_CREATED,
    LINE_IGNORED,
    LINE_MATCHED,
    LINE_PENDING,
    NOT_RECONCILED,
    PLANNED,
    REALIZED,
    RECONCILED,
)
from razao.session import cut_lineage, forget


def _first_wins(decisions: DataFrame, key: str, reason: str) -> DataFrame:
    """Reject valid decisions that are not the first on ``key``."""
    order = F.struct("requested_at", "decision_id")
    valid = decisions.where(F.col("reject_reason").isNull() & F.col(key).isNotNull())
    first = valid.groupBy(key).agg(F.min(order).alias("_first"))
    later = F.col("reject_reason").isNull() & (F.col("_first") != order)
    return (
        decisions.join(first, key, "left")
        .withColumn("reject_reason", F.when(later, reason).otherwise(F.col("reject_reason")))
        .drop("_first")
    )


def _prefixed(rows: DataFrame, columns: dict[str, str], key: str) -> DataFrame:
    return rows.select(
        F.col("id").alias(key),
        *[F.col(c).alias(name) for c, name in columns.items()],
    )


def _line(lines: DataFrame) -> DataFrame:
    return _prefixed(
        lines,
        {
            "status": "line_status",
            "company_id": "line_company",
            "bank_account_id": "line_account",
            "posted_at": "line_date",
            "amount": "line_amount",
            "memo": "line_memo",
            "matched_transaction_id": "line_transaction",
        },
        "line_id",
    )


def reconcile(decisions: DataFrame, lines: DataFrame, transactions: DataFrame) -> DataFrame:
    """Judge (decision_id, requested_at, line_id, transaction_id)."""
    txn = _prefixed(
        transactions, {"bank_account_id": "txn_account", "reconciliation": "txn_state"}, "transaction_id"
    )
    judged = (
        decisions.join(_line(lines), "line_id", "left")
        .join(txn, "transaction_id", "left")
        .withColumn(
            "reject_reason",
            F.when(F.col("line_status").isNull(), "line_not_found")
            .when(F.col("line_status") != LINE_PENDING, "line_already_handled")
            .when(F.col("txn_state").isNull(), "transaction_not_found")
            .when(F.col("txn_account") != F.col("line_account"), "other_account")
            .when(F.col("txn_state") == RECONCILED, "transaction_already_reconciled")
            .when(F.col("txn_state") != NOT_RECONCILED, "transaction_not_open"),
        )
    )
    return _one_to_one(judged).select("decision_id", "line_id", "transaction_id", "reject_reason")


# Rounds that judge what conflicts in parallel before the rest is folded component by component,
# and the rows up to which one component is folded in one task. Larger ones go on in rounds.
ROUNDS = 2
FOLDED_ROWS = 100_000


def _one_to_one(judged: DataFrame) -> DataFrame:
    """Reject valid decisions whose line or transaction an accepted earlier one has taken.

    A decision that comes first for both its sides is accepted, and what it takes is closed to
    the others. Two such rounds settle most; of the rest, every connected component of lines and
    transactions is folded in request order. A refused decision takes nothing.
    """
    order = F.struct("requested_at", "decision_id")
    columns = ["requested_at", "decision_id", "line_id", "transaction_id"]
    waiting = cut_lineage(judged.where(F.col("reject_reason").isNull()).select(*columns))
    taken: DataFrame | None = None
    done = 0
    while not waiting.isEmpty():
        if done >= ROUNDS:
            sides = waiting.select(
                F.concat(F.lit("l"), F.col("line_id").cast("string")).alias("u"),
                F.concat(F.lit("t"), F.col("transaction_id").cast("string")).alias("v"),
            )
            named = waiting.withColumn("node", F.concat(F.lit("l"), F.col("line_id").cast("string")))
            grouped, waiting = _small_components(named, components(sides))
            won = cut_lineage(grouped.groupBy("component").applyInPandas(_first_come, waiting.select(*columns).schema))
            taken = won if taken is None else taken.unionByName(won)
            waiting = cut_lineage(waiting.select(*columns))
        marked = waiting
        for key in ("line_id", "transaction_id"):
            marked = marked.join(waiting.groupBy(key).agg(F.min(order).alias(f"_{key}")), key)
        won = cut_lineage(marked.where((F.col("_line_id") == order) & (F.col("_transaction_id") == order)).select(*columns))
        taken = won if taken is None else taken.unionByName(won)
        after = cut_lineage(waiting.join(won.select("line_id"), "line_id", "left_anti").join(won.select("transaction_id"), "transaction_id", "left_anti"))
        forget(waiting)
        waiting, done = after, done + 1
    if taken is None:
        return judged
    by_line = taken.select("line_id", order.alias("_by_line"))
    # Whoever is refused although no earlier decision took its line lost its transaction.
    reason = F.when(F.col("_by_line") < order, "line_taken_in_batch").when(
        ~F.coalesce(F.col("_by_line") == order, F.lit(False)), "transaction_taken_in_batch"
    )
    return judged.join(by_line, "line_id", "left").withColumn("reject_reason", F.coalesce("reject_reason", reason))


def _small_components(rows: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (with ``node``) of components that one task may fold, and the rows of the others."""
    named = cut_lineage(rows.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")).drop("node"))
    large = named.groupBy("component").agg(F.count("*").alias("_n")).where(F.col("_n") > FOLDED_ROWS).select("component")
    return named.join(large, "component", "left_anti"), named.join(large, "component", "left_semi").drop("component")


def _first_come(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one component, the decisions that find both sides free, in request order."""
    pdf = pdf.sort_values(["requested_at", "decision_id"])
    lines, transactions, kept = set(), set(), []
    for line, transaction in zip(pdf["line_id"], pdf["transaction_id"], strict=True):
        free = line not in lines and transaction not in transactions
        kept.append(free)
        if free:
            lines.add(line)
            transactions.add(transaction)
    return pdf.loc[kept, ["requested_at", "decision_id", "line_id", "transaction_id"]]


def accepted(judged: DataFrame) -> DataFrame:
    return judged.where(F.col("reject_reason").isNull())


def reconciled_lines(lines: DataFrame, judged: DataFrame) -> DataFrame:
    """Statement lines after the accepted reconciliations."""
    done = accepted(judged).select(F.col("line_id").alias("id"), F.col("transaction_id").alias("_t"))
    hit = F.col("_t").isNotNull()
    return (
        lines.join(done, "id", "left")
        .withColumn("status", F.when(hit, LINE_MATCHED).otherwise(F.col("status")))
        .withColumn("matched_transaction_id", F.coalesce("_t", "matched_transaction_id"))
        .drop("_t")
    )


def reconciled_transactions(transactions: DataFrame, judged: DataFrame) -> DataFrame:
    done = accepted(judged).select(F.col("transaction_id").alias("id"), F.lit(True).alias("_done"))
    return (
        transactions.join(done, "id", "left")
        .withColumn(
            "reconciliation", F.when(F.col("_done"), RECONCILED).otherwise(F.col("reconciliation"))
        )
        .drop("_done")
    )


def _matched_month(
    decisions: DataFrame, lines: DataFrame, transactions: DataFrame, closings: DataFrame, *facts: DataFrame
) -> DataFrame:
    """Decisions on lines with their transaction, whether its month is closed, and other ``facts`` by
    ``line_transaction``.

    Only lines that have a transaction are shuffled by it: most have none, and their nulls would
    meet in one task.
    """
    locked = with_period_lock(transactions, closings)
    line = _line(lines)
    known = line.where(F.col("line_transaction").isNotNull())
    for fact in (_prefixed(locked, {"period_locked": "txn_locked"}, "line_transaction"), *facts):
        known = known.join(fact, "line_transaction", "left")
    every = known.unionByName(line.where(F.col("line_transaction").isNull()), allowMissingColumns=True)
    return decisions.join(every, "line_id", "left")


def unreconcile(
    decisions: DataFrame, lines: DataFrame, transactions: DataFrame, closings: DataFrame
) -> DataFrame:
    """Judge (decision_id, requested_at, line_id): back to pending while the month is open."""
    judged = _matched_month(decisions, lines, transactions, closings).withColumn(
        "reject_reason",
        F.when(F.col("line_status").isNull(), "line_not_found")
        .when(F.col("line_status") != LINE_MATCHED, "line_not_reconciled")
        .when(F.col("txn_locked"), "month_closed"),
    )
    judged = _first_wins(judged, "line_id", "line_taken_in_batch")
    return judged.select(
        "decision_id", "line_id", F.col("line_transaction").alias("transaction_id"), "reject_reason"
    )


def create_from_line(decisions: DataFrame, lines: DataFrame, closings: DataFrame) -> DataFrame:
    """Judge (decision_id, requested_at, line_id, category_id, description, rule_id).

    Accepted rows carry the fields of the new realised, reconciled transaction.
    """
    locked = with_period_lock(lines, closings, "posted_at", "line_locked")
    line = _line(lines).join(
        locked.select(F.col("id").alias("line_id"), "line_locked"), "line_id"
    )
    judged = decisions.join(line, "line_id", "left").withColumn(
        "reject_reason",
        F.when(F.col("line_status").isNull(), "line_not_found")
        .when(F.col("line_status") != LINE_PENDING, "line_already_handled")
        .when(F.col("line_locked"), "month_closed"),
    )
    judged = _first_wins(judged, "line_id", "line_taken_in_batch")
    return judged.select(
        "decision_id",
        "line_id",
        F.col("line_company").alias("company_id"),
        F.col("line_account").alias("bank_account_id"),
        "category_id",
        F.col("line_date").alias("booking_date"),
        F.col("line_date").alias("competence_date"),
        F.col("line_amount").alias("amount"),
        description_fallback(F.col("description"), F.col("line_memo")).alias("description"),
        F.lit(REALIZED).alias("status"),
        F.lit(RECONCILED).alias("reconciliation"),
        "rule_id",
        "reject_reason",
    )


def created_lines(lines: DataFrame, created: DataFrame) -> DataFrame:
    """Statement lines after accepted creations (``line_id``, ``transaction_id``)."""
    done = created.select(F.col("line_id").alias("id"), F.col("transaction_id").alias("_t"))
    hit = F.col("_t").isNotNull()
    return (
        lines.join(done, "id", "left")
        .withColumn("status", F.when(hit, LINE_CREATED).otherwise(F.col("status")))
        .withColumn("matched_transaction_id", F.coalesce("_t", "matched_transaction_id"))
        .drop("_t")
    )


def undo_from_line(
    decisions: DataFrame,
    lines: DataFrame,
    transactions: DataFrame,
    settlements: DataFrame,
    closings: DataFrame,
) -> DataFrame:
    """Judge (decision_id, requested_at, line_id): remove the transaction a line created."""
    settled = settlements.select(
        F.col("transaction_id").alias("line_transaction"), F.lit(True).alias("_settled")
    ).distinct()
    judged = (
        _matched_month(decisions, lines, transactions, closings, settled)
        .withColumn(
            "reject_reason",
            F.when(F.col("line_status").isNull(), "line_not_found")
            .when(
                (F.col("line_status") != LINE_CREATED) | F.col("line_transaction").isNull(),
                "nothing_created",
            )
            .when(F.col("txn_locked").isNull(), "transaction_not_found")
            .when(F.col("txn_locked"), "month_closed")
            .when(F.col("_settled"), "has_settlement"),
        )
    )
    judged = _first_wins(judged, "line_id", "line_taken_in_batch")
    return judged.select(
        "decision_id", "line_id", F.col("line_transaction").alias("transaction_id"), "reject_reason"
    )


def pending_again(lines: DataFrame, judged: DataFrame) -> DataFrame:
    """Statement lines after accepted undo or unreconcile decisions."""
    done = accepted(judged).select(F.col("line_id").alias("id"), F.lit(True).alias("_undone"))
    undone = F.col("_undone").isNotNull()
    return (
        lines.join(done, "id", "left")
        .withColumn("status", F.when(undone, LINE_PENDING).otherwise(F.col("status")))
        .withColumn("matched_transaction_id", F.when(~undone, F.col("matched_transaction_id")))
        .drop("_undone")
    )


def without_undone(transactions: DataFrame, judged: DataFrame) -> DataFrame:
    gone = accepted(judged).select(F.col("transaction_id").alias("id"))
    return transactions.join(gone, "id", "left_anti")


def ignore_line(decisions: DataFrame, lines: DataFrame) -> DataFrame:
    """Judge (decision_id, requested_at, line_id, reason): a reason is required."""
    judged = decisions.join(_line(lines), "line_id", "left").withColumn(
        "reject_reason",
        F.when(F.trim(F.coalesce("reason", F.lit(""))) == "", "reason_required")
        .when(F.col("line_status").isNull(), "line_not_found")
        .when(F.col("line_status") != LINE_PENDING, "line_already_handled"),
    )
    judged = _first_wins(judged, "line_id", "line_taken_in_batch")
    return judged.select(
        "decision_id",
        "line_id",
        F.when(F.col("reject_reason").isNull(), LINE_IGNORED).alias("new_status"),
        F.trim("reason").alias("ignored_reason"),
        "reject_reason",
    )


# Receivables


def settle_invoices(
    allocations: DataFrame,
    transactions: DataFrame,
    invoices: DataFrame,
    settlements: DataFrame,
    closings: DataFrame,
) -> DataFrame:
    """Judge (decision_id, requested_at, transaction_id, invoice_id, amount).

    All allocations of one decision hold together: one bad allocation rejects them all.
    Outstanding amounts are used up in request order by accepted decisions only, so two credits
    cannot both take the rest of one invoice and a refused one takes nothing.
    """
    credit = _prefixed(
        with_period_lock(transactions, closings),
        {"company_id": "company_id", "status": "txn_status", "amount": "txn_amount", "period_locked": "txn_locked"},
        "transaction_id",
    )
    invoice = invoice_balances(invoices, settlements).select(
        F.col("id").alias("invoice_id"),
        F.col("company_id").alias("invoice_company"),
        F.col("status").alias("invoice_status"),
        "outstanding_amount",
    )
    stored = settlements.select("invoice_id", "transaction_id", F.lit(True).alias("_stored")).distinct()
    repeated = allocations.groupBy("decision_id", "invoice_id").agg(F.count("*").alias("_times"))
    rows = (
        allocations.join(credit, "transaction_id", "left")
        .join(invoice, "invoice_id", "left")
        .join(stored, ["invoice_id", "transaction_id"], "left")
        .join(repeated, ["decision_id", "invoice_id"], "left")
    )
    own = (
        F.when(F.col("txn_status").isNull(), "transaction_not_found")
        .when(F.col("txn_status") != REALIZED, "transaction_not_realized")
        .when(F.col("txn_locked"), "month_closed")
        .when(F.coalesce(F.col("amount") <= 0, F.lit(True)), "amount_not_positive")
        .when(
            F.col("invoice_status").isNull() | (F.col("invoice_company") != F.col("company_id")),
            "invoice_not_found",
        )
        .when(F.col("invoice_status") == INVOICE_CANCELLED, "invoice_cancelled")
        .when((F.col("_times") > 1) | F.col("_stored"), "invoice_repeated")
    )
    rows = cut_lineage(
        rows.withColumn("_own", own).select(
            "decision_id", "requested_at", "company_id", "transaction_id", "invoice_id", "amount", "txn_amount",
            "outstanding_amount", "_own",
        )
    )
    whole = rows.groupBy("decision_id").agg(
        F.min("_own").alias("_any"),
        F.sum("amount").alias("_total"),
        F.max("txn_amount").alias("_credit"),
    )
    reason = F.coalesce("_any", F.when(F.col("_total") > F.col("_credit"), "over_credit"))
    alone = whole.select("decision_id", reason.alias("_alone"))
    columns = ["decision_id", "requested_at", "invoice_id", "amount", "outstanding_amount"]
    refused = _over_asked(rows.join(alone.where(F.col("_alone").isNull()), "decision_id", "left_semi").select(columns))
    verdict = alone.join(refused.withColumn("_over", F.lit("over_outstanding")), "decision_id", "left").select(
        "decision_id", F.coalesce("_alone", "_over").alias("reject_reason")
    )
    return rows.join(verdict, "decision_id").select(
        "decision_id", "company_id", "transaction_id", "invoice_id", "amount", "reject_reason"
    )


def _over_asked(rows: DataFrame) -> DataFrame:
    """The decisions whose amounts do not fit, judged in request order, as (decision_id).

    An invoice that can bear all that is asked of it refuses nobody, so only the rows of the
    others are judged. Each round sums what earlier decisions take from an invoice twice: with the
    open ones and without them. Who fits in either case is accepted, who fits in neither is
    refused. Two rounds settle most; of the rest, every connected component of decisions and
    invoices is folded in request order.
    """
    asked = rows.groupBy("invoice_id").agg(F.sum("amount").alias("_asked"))
    contested = rows.join(asked, "invoice_id").where(F.col("_asked") > F.col("outstanding_amount")).drop("_asked")
    rows = cut_lineage(contested.withColumn("_hour", F.date_trunc("hour", "requested_at")).withColumn("_in", F.lit(None).cast("boolean")))
    everyone, done = rows, 0
    while not rows.where(F.col("_in").isNull()).isEmpty():
        if done >= ROUNDS:
            rows = _fold_rest(rows)
            if rows.where(F.col("_in").isNull()).isEmpty():
                break
        summed = running_sums(
            rows,
            ["invoice_id"],
            ["requested_at", "decision_id"],
            "_hour",
            {"_most": F.col("amount"), "_least": F.when(F.col("_in"), F.col("amount"))},
        )
        fits = F.col("_most") <= F.col("outstanding_amount")
        hopeless = F.col("_least") + F.col("amount") > F.col("outstanding_amount")
        judged = summed.where(F.col("_in").isNull()).groupBy("decision_id").agg(
            F.when(F.bool_or(hopeless), False).when(F.bool_and(fits), True).alias("_now")
        )
        after = rows.join(judged, "decision_id", "left").withColumn("_in", F.coalesce("_in", "_now")).drop("_now")
        # Refused amounts are given back.
        rows, done = cut_lineage(after.where(F.coalesce("_in", F.lit(True)))), done + 1
    return everyone.select("decision_id").distinct().join(rows.select("decision_id").distinct(), "decision_id", "left_anti")


def _fold_rest(rows: DataFrame) -> DataFrame:
    """Open decisions folded by component; accepted rows stay, what a large component leaves open too.

    Only open rows meet in a task: what the accepted ones took before an open one is summed first.
    """
    decision = F.concat(F.lit("d"), F.col("decision_id").cast("string"))
    summed = running_sums(rows, ["invoice_id"], ["requested_at", "decision_id"], "_hour", {"_before": F.when(F.col("_in"), F.col("amount"))})
    opened = summed.where(F.col("_in").isNull()).withColumn("node", decision)
    sides = opened.select(decision.alias("u"), F.concat(F.lit("i"), F.col("invoice_id").cast("string")).alias("v"))
    grouped, _ = _small_components(opened, components(sides))
    judged = cut_lineage(
        grouped.groupBy("component").applyInPandas(_fitting_in_order, opened.select("decision_id", F.lit(True).alias("_now")).schema)
    )
    after = rows.join(judged, "decision_id", "left").withColumn("_in", F.coalesce("_in", "_now")).drop("_now")
    return cut_lineage(after.where(F.coalesce("_in", F.lit(True))))


def _fitting_in_order(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one component, whether each decision fits what the accepted ones before it leave."""
    pdf = pdf.sort_values(["requested_at", "decision_id"], kind="stable")
    taken: dict = {}
    out = []
    for (_, decision), rows in pdf.groupby(["requested_at", "decision_id"], sort=False):
        fits = all(
            taken.get(i, 0) + before + amount <= left
            for i, before, amount, left in zip(rows["invoice_id"], rows["_before"].fillna(0), rows["amount"], rows["outstanding_amount"], strict=True)
        )
        out.append((decision, fits))
        if fits:
            for i, amount in zip(rows["invoice_id"], rows["amount"], strict=True):
                taken[i] = taken.get(i, 0) + amount
    return pd.DataFrame(out, columns=["decision_id", "_now"])


def invoice_status(invoices: DataFrame, settlements: DataFrame) -> DataFrame:
    """Status from the settlements; a cancelled invoice keeps its state."""
    paid, amount = F.col("received_amount"), F.col("amount")
    status = (
        F.when(F.col("status") == INVOICE_CANCELLED, INVOICE_CANCELLED)
        .when(paid == 0, INVOICE_OPEN)
        .when(amount <= paid, INVOICE_PAID)
        .otherwise(INVOICE_PARTIAL)
    )
    return invoice_balances(invoices, settlements).withColumn("status", status)


def unsettle(
    decisions: DataFrame, settlements: DataFrame, transactions: DataFrame, closings: DataFrame
) -> DataFrame:
    """Judge (decision_id, requested_at, settlement_id): removable while the month is open."""
    txn = _prefixed(
        with_period_lock(transactions, closings), {"period_locked": "txn_locked"}, "transaction_id"
    )
    found = settlements.select(F.col("id").alias("settlement_id"), "invoice_id", "transaction_id")
    judged = (
        decisions.join(found, "settlement_id", "left")
        .join(txn, "transaction_id", "left")
        .withColumn(
            "reject_reason",
            F.when(F.col("invoice_id").isNull(), "settlement_not_found").when(
                F.col("txn_locked"), "month_closed"
            ),
        )
    )
    judged = _first_wins(judged, "settlement_id", "settlement_taken_in_batch")
    return judged.select("decision_id", "settlement_id", "invoice_id", "reject_reason")


# Planned rows and edits


def settle_planned(decisions: DataFrame, transactions: DataFrame, closings: DataFrame) -> DataFrame:
    """Judge (decision_id, requested_at, transaction_id, new_date, new_amount).

    A null date or amount keeps the planned one. Old and new month must be open, and the sign
    must stay.
    """
    txn = _prefixed(
        with_period_lock(transactions, closings),
        {
            "company_id": "company_id",
            "status": "txn_status",
            "amount": "txn_amount",
            "booking_date": "txn_date",
            "is_transfer": "txn_transfer",
            "period_locked": "txn_locked",
        },
        "transaction_id",
    )
    judged = (
        decisions.join(txn, "transaction_id", "left")
        .withColumn("booking_date", F.coalesce("new_date", "txn_date"))
        .withColumn("amount", F.coalesce("new_amount", "txn_amount"))
    )
    judged = with_period_lock(judged, closings, "booking_date", "target_locked").withColumn(
        "reject_reason",
        F.when(F.col("txn_status").isNull(), "transaction_not_found")
        .when(F.col("txn_status") != PLANNED, "not_planned")
        .when(F.col("txn_transfer"), "transfer")
        .when(F.col("txn_locked") | F.col("target_locked"), "month_closed")
        .when(F.signum("amount") != F.signum("txn_amount"), "sign_changed"),
    )
    judged = _first_wins(judged, "transaction_id", "transaction_taken_in_batch")
    return judged.select(
        "decision_id", "transaction_id", "booking_date", "amount", "reject_reason"
    )


def unsettle_planned(decisions: DataFrame, state: DataFrame) -> DataFrame:
    """Judge (decision_id, requested_at, transaction_id) against ``transaction_state`` rows."""
    txn = state.select(
        F.col("id").alias("transaction_id"),
        "status", "reconciled", "has_settlement", "is_transfer", "period_locked",
    )
    judged = decisions.join(txn, "transaction_id", "left").withColumn(
        "reject_reason",
        F.when(F.col("status").isNull(), "transaction_not_found")
        .when(F.col("status") != REALIZED, "not_realized")
        .when(F.col("reconciled"), "conciliado")
        .when(F.col("has_settlement"), "baixaDeNota")
        .when(F.col("is_transfer"), "transferencia")
        .when(F.col("period_locked"), "mesFechado"),
    )
    judged = _first_wins(judged, "transaction_id", "transaction_taken_in_batch")
    return judged.select("decision_id", "transaction_id", "reject_reason")


def edit_transactions(decisions: DataFrame, state: DataFrame, closings: DataFrame) -> DataFrame:
    """Judge (decision_id, requested_at, transaction_id, new_amount, new_date, new_account,
    new_category, new_description).

    ``new_amount`` is a magnitude: the sign of the row never changes. A locked field may be
    repeated unchanged, not changed.
    """
    flags = ("is_transfer", "reconciled", "has_settlement", "period_locked")
    txn = state.select(
        F.col("id").alias("transaction_id"),
        "company_id", "amount", "booking_date", "bank_account_id", "category_id", *flags,
    )
    joined = decisions.join(txn, "transaction_id", "left")
    joined = with_period_lock(joined, closings, "new_date", "target_locked")

    def locked(field: str) -> Column:
        return F.size(lock_reasons(field)) > 0

    changes = {
        "amount": F.abs("new_amount") != F.abs("amount"),
        "booking_date": F.col("new_date") != F.col("booking_date"),
        "bank_account_id": F.col("new_account") != F.col("bank_account_id"),
        "category_id": ~F.col("new_category").eqNullSafe(F.col("category_id")),
    }
    assert set(changes) < set(EDITABLE_FIELDS)
    reason = F.coalesce(
        F.when(F.col("amount").isNull(), "transaction_not_found"),
        F.when(F.col("period_locked"), "month_closed"),
        F.when(F.coalesce(F.col("new_amount") == 0, F.lit(True)), "amount_zero"),
        *[F.when(locked(field) & change, F.lit(f"locked_{field}")) for field, change in changes.items()],
        F.when(F.col("target_locked"), "target_month_closed"),
    )
    judged = _first_wins(joined.withColumn("reject_reason", reason), "transaction_id", "transaction_taken_in_batch")
    size = F.abs("new_amount")
    return judged.select(
        "decision_id",
        "transaction_id",
        F.when(F.col("amount") < 0, -size).otherwise(size).alias("new_amount"),
        direction_of(F.col("amount")).alias("direction"),
        "reject_reason",
    )


# Months


def close_months(requests: DataFrame, closings: DataFrame, memberships: DataFrame) -> DataFrame:
    """Closings after (company_id, period, user_id, requested_at, notes) requests.

    The newest permitted request of a month locks it and clears the reopening; the role
    ``contador`` is needed. Months nobody asked for stay as they are.
    """
    allowed = _with_role(requests, memberships)
    newest = (
        allowed.groupBy("company_id", F.trunc("period", "MM").alias("period"))
        .agg(F.max(F.struct("requested_at", "user_id")).alias("_n"))
        .select("company_id", "period", "_n.requested_at", "_n.user_id")
    )
    asked = F.col("requested_at").isNotNull()
    return closings.join(newest, ["company_id", "period"], "full_outer").select(
        "company_id",
        "period",
        F.when(asked, F.col("requested_at")).otherwise(F.col("locked_at")).alias("locked_at"),
        F.when(asked, F.col("user_id")).otherwise(F.col("locked_by")).alias("locked_by"),
        F.when(~asked, F.col("reopened_at")).alias("reopened_at"),
        F.when(~asked, F.col("reopened_by")).alias("reopened_by"),
        F.when(~asked, F.col("reopen_reason")).alias("reopen_reason"),
    )


def reopen_months(requests: DataFrame, closings: DataFrame, memberships: DataFrame) -> DataFrame:
    """Judge (decision_id, company_id, period, user_id, reason): role, closing and reason."""
    members = _with_role(requests, memberships).select("decision_id", F.lit(True).alias("_may"))
    known = closings.select("company_id", "period", F.lit(True).alias("_closing"))
    return (
        requests.withColumn("period", F.trunc("period", "MM"))
        .join(members, "decision_id", "left")
        .join(known, ["company_id", "period"], "left")
        .select(
            "decision_id",
            "company_id",
            "period",
            F.when(F.col("_may").isNull(), "role")
            .when(F.trim(F.coalesce("reason", F.lit(""))) == "", "reason_required")
            .when(F.col("_closing").isNull(), "closing_not_found")
            .alias("reject_reason"),
        )
    )


def _with_role(requests: DataFrame, memberships: DataFrame, minimum: int = 3) -> DataFrame:
    ranked = memberships.where(role_rank(F.col("role")) >= minimum).select("company_id", "user_id")
    return requests.join(ranked, ["company_id", "user_id"], "left_semi")
