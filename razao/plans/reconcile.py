"""Reconciliation of all accounts: what to apply without asking, and what a person decides."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from razao.operators.decisions import create_from_line, reconcile
from razao.operators.matching import match_statement
from razao.operators.rules import rule_hits, top_rule
from razao.session import cut_lineage

RULE_COLUMNS = ["applied_rule_id", "rule_category_id", "rule_counterparty_id", "rule_cost_center_id"]


@dataclass(frozen=True)
class AutoApplyPlan:
    """Every input line once, with its match, its rule and what to do with it.

    ``decided`` holds the lines' columns, ``match`` (a struct, or null), the rule columns and
    ``action``. The four outputs are disjoint parts of it.
    """

    decided: DataFrame

    def _matches(self, action: str) -> DataFrame:
        return self.decided.where(F.col("action") == action).select("match.*")

    def _rest(self, action: str) -> DataFrame:
        return self.decided.where(F.col("action") == action).drop("match", "action")

    @property
    def reconcile(self) -> DataFrame:
        return self._matches("reconcile")

    @property
    def suggested(self) -> DataFrame:
        return self._matches("suggested")

    @property
    def create(self) -> DataFrame:
        return self._rest("create")

    @property
    def uncategorized(self) -> DataFrame:
        return self._rest("uncategorized")


def plan_auto_apply(
    lines: DataFrame, transactions: DataFrame, rules: DataFrame, **options
) -> AutoApplyPlan:
    """Exact matches reconcile; unmatched lines with a categorising rule create a transaction.

    Matching and rules each run once: rules look at distinct memos, so asking them for matched
    lines too costs less than a second pass of the matching.
    """
    matches = match_statement(lines, transactions, **options)
    found = matches.select(F.col("line_id").alias("id"), F.struct(*matches.columns).alias("match"))
    matched = F.col("match").isNotNull()
    action = (
        F.when(F.col("match.confidence") == "exact", "reconcile")
        .when(matched, "suggested")
        .when(F.col("rule_category_id").isNotNull(), "create")
        .otherwise("uncategorized")
    )
    labelled = top_rule(lines, rules).join(found, "id", "left")
    unmatched_only = {c: F.when(~matched, F.col(c)) for c in RULE_COLUMNS}
    return AutoApplyPlan(labelled.withColumns(unmatched_only).withColumn("action", action))


def plan_decisions(plan: AutoApplyPlan) -> DataFrame:
    """The plan as one table: line, action, and what the action refers to."""
    creates = F.col("action") == "create"
    return plan.decided.select(
        "company_id",
        "bank_account_id",
        F.col("id").alias("line_id"),
        "action",
        F.col("match.transaction_id").alias("transaction_id"),
        F.when(creates, F.col("rule_category_id")).alias("category_id"),
        F.when(creates, F.col("applied_rule_id")).alias("rule_id"),
    )


def review_queue(lines: DataFrame, transactions: DataFrame, rules: DataFrame, **options) -> DataFrame:
    """Matches to confirm and lines to categorise in one queue by day."""
    decided = plan_auto_apply(lines, transactions, rules, **options).decided
    return decided.select(
        F.when(F.col("match").isNotNull(), "match").otherwise("categorize").alias("kind"),
        "company_id",
        "posted_at",
        F.col("id").alias("line_id"),
        F.col("match.transaction_id").alias("transaction_id"),
        F.col("rule_category_id").alias("category_id"),
    ).orderBy("posted_at", "line_id")


@dataclass(frozen=True)
class AutoApplyResult:
    """What became of every line, and the rules with the hits of this run."""

    outcomes: DataFrame  # company_id, line_id, transaction_id, rule_id, outcome, reason
    rules: DataFrame

    def counts(self) -> DataFrame:
        """Lines per company and outcome, failures by reason."""
        return self.outcomes.groupBy("company_id", "outcome", "reason").agg(F.count("*").alias("lines"))


def auto_apply_reconciliation(
    lines: DataFrame, transactions: DataFrame, rules: DataFrame, closings: DataFrame, **options
) -> AutoApplyResult:
    """Send the plan through the guarded decisions; one refused item never stops the others.

    A line ends as reconciled, created, failed (with the reason of the refusal), suggested or
    uncategorized. Only creations that went through count as hits of their rule.
    """
    # The plan feeds two kinds of decisions and the report, so it is written once.
    decided = cut_lineage(plan_decisions(plan_auto_apply(lines, transactions, rules, **options)))
    asked = decided.select(
        F.col("line_id").alias("decision_id"), F.lit(0).alias("requested_at"), "*", F.lit("").alias("description")
    )
    reconciled = reconcile(
        asked.where("action = 'reconcile'").select("decision_id", "requested_at", "line_id", "transaction_id"),
        lines,
        transactions,
    )
    created = create_from_line(
        asked.where("action = 'create'").select(
            "decision_id", "requested_at", "line_id", "category_id", "description", "rule_id"
        ),
        lines,
        closings,
    )
    refused = (
        reconciled.select("line_id", "reject_reason")
        .unionByName(created.select("line_id", "reject_reason"))
        .where(F.col("reject_reason").isNotNull())
    )
    action, reason = F.col("action"), F.col("reject_reason")
    outcome = (
        F.when(reason.isNotNull(), "failed")
        .when(action == "reconcile", "reconciled")
        .when(action == "create", "created")
        .otherwise(action)
    )
    outcomes = decided.join(refused, "line_id", "left").select(
        "company_id", "line_id", "transaction_id", "rule_id", outcome.alias("outcome"), reason.alias("reason")
    )
    return AutoApplyResult(outcomes, rule_hits(rules, outcomes.where("outcome = 'created'")))
