"""The change log: capture from two snapshots, report, and changed fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from razao.operators.lookups import lookup
from razao.operators.ordering import capped_list

# Fixed value: a field whose change alone is not a change.
TOUCHED = "updated_at"

# How the audited tables are called on screen.
TABLE_LABELS = {
    "transactions": "Lançamentos",
    "bank_accounts": "Contas",
    "monthly_closings": "Fechamentos de mês",
    "memberships": "Equipe",
    "invoices": "Notas fiscais",
    "invoice_settlements": "Baixas de recebimento",
    "categories": "Categorias",
    "counterparties": "Clientes e fornecedores",
    "cost_centers": "Centros de custo",
    "matching_rules": "Regras de correspondência",
    "statement_imports": "Importações de extrato",
    "statement_lines": "Linhas de extrato",
    "account_profiles": "Perfis de contas",
    "account_profile_accounts": "Contas do perfil",
}


def audit_capture(before: DataFrame, after: DataFrame, table: str, key: str = "id") -> DataFrame:
    """One row per inserted, deleted or changed row, with both versions as JSON.

    A row of which only ``updated_at`` differs is not logged.
    """
    compared = [c for c in after.columns if c not in (key, TOUCHED)]

    def side(rows: DataFrame, name: str) -> DataFrame:
        everything = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
        return rows.select(
            key, everything.alias(f"{name}_data"), F.struct(*compared).alias(f"_{name}")
        )

    action = (
        F.when(F.col("old_data").isNull(), "INSERT")
        .when(F.col("new_data").isNull(), "DELETE")
        .otherwise("UPDATE")
    )
    return (
        side(before, "old")
        .join(side(after, "new"), key, "full_outer")
        .where(~F.col("_old").eqNullSafe(F.col("_new")))
        .select(
            F.lit(table).alias("table_name"),
            F.col(key).alias("row_id"),
            action.alias("action"),
            "old_data",
            "new_data",
        )
    )


def audit_report(
    log: DataFrame, profiles: DataFrame, month_start: Column, month_end: Column,
    table: str | None = None, cap: int | None = None,
) -> DataFrame:
    """Rows of a month with actor and table names; the newest ``cap`` per company if one is given.

    ``profiles`` (user_id, full_name). The month is cut by instants, in UTC. With a cap the rows
    carry their ``place`` and whether the cap was reached.
    """
    rows = log.where((F.col("changed_at") >= month_start) & (F.col("changed_at") < month_end))
    if table is not None:
        rows = rows.where(F.col("table_name") == table)
    newest = rows if cap is None else capped_list(rows, [F.desc("changed_at"), F.desc("id")], cap)
    labels = F.create_map(*[F.lit(x) for pair in TABLE_LABELS.items() for x in pair])
    named = lookup(newest, profiles, "changed_by", "user_id", "full_name", "_name")
    actor = F.when(F.col("changed_by").isNull(), "Fora do app").otherwise(
        F.coalesce("_name", F.lit("—"))
    )
    return named.withColumn("actor", actor).drop("_name").withColumn(
        "table_label", F.coalesce(F.try_element_at(labels, F.col("table_name")), "table_name")
    )


def _fields(json: Column) -> Column:
    empty = F.create_map().cast("map<string,string>")
    return F.coalesce(F.from_json(json, "map<string,string>"), empty)


def keys_union(old: Column, new: Column) -> Column:
    """Field names of either version."""
    return F.array_union(F.map_keys(_fields(old)), F.map_keys(_fields(new)))


def json_diff(log: DataFrame) -> DataFrame:
    """(id, field, before, after) for every field that differs, without ``updated_at``."""
    parsed = log.select(
        "id", _fields(F.col("old_data")).alias("_old"), _fields(F.col("new_data")).alias("_new")
    )
    names = F.array_union(F.map_keys("_old"), F.map_keys("_new"))
    fields = parsed.withColumn("field", F.explode(names)).select(
        "id",
        "field",
        F.try_element_at("_old", F.col("field")).alias("before"),
        F.try_element_at("_new", F.col("field")).alias("after"),
    )
    return fields.where(
        (F.col("field") != TOUCHED) & ~F.col("before").eqNullSafe(F.col("after"))
    )


def json_rows(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """One row per element of a JSON array column."""
    parsed = F.from_json(F.col(column), f"array<struct<{schema}>>")
    return rows.withColumn("_item", F.explode(parsed)).select(
        *[c for c in rows.columns if c != column], "_item.*"
    )
