"""Table reads with the filters the screens use, and reads that embed a related table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from razao.operators.assign import rank_in_group


def scan_table(
    table: DataFrame,
    columns: list[str] | None = None,
    equals: dict | None = None,
    among: dict[str, list] | None = None,
    at_least: dict | None = None,
    at_most: dict | None = None,
    not_null: list[str] | None = None,
    order: list | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Filters on plain columns, so the Parquet scan takes them; then the column list."""
    rows = table
    for column, value in (equals or {}).items():
        rows = rows.where(F.col(column) == value)
    for column, values in (among or {}).items():
        rows = rows.where(F.col(column).isin(values))
    for column, value in (at_least or {}).items():
        rows = rows.where(F.col(column) >= F.lit(value))
    for column, value in (at_most or {}).items():
        rows = rows.where(F.col(column) <= F.lit(value))
    for column in not_null or ():
        rows = rows.where(F.col(column).isNotNull())
    if order:
        rows = rows.orderBy(*order)
    if limit is not None:
        rows = rows.limit(limit)
    return rows.select(*columns) if columns else rows


def embed_one(
    rows: DataFrame, parent: DataFrame, key: str, fields: list[str], name: str
) -> DataFrame:
    """The parent row as one struct column."""
    folded = parent.select(key, F.struct(*fields).alias(name))
    return rows.join(folded, key, "left")


def embed_many(
    rows: DataFrame, children: DataFrame, key: str, field: str, name: str
) -> DataFrame:
    """The children's values as one sorted array.

    For link tables such as the accounts of a profile, whose lists a person keeps by hand.
    """
    lists = children.groupBy(key).agg(F.array_sort(F.collect_set(field)).alias(name))
    return rows.join(lists, key, "left").withColumn(
        name, F.coalesce(name, F.array().cast(lists.schema[name].dataType))
    )


def embed_chunks(children: DataFrame, key: str, field: str, name: str, size: int) -> DataFrame:
    """The children's values in sorted arrays of ``size``, numbered from 0 within each parent.

    For link tables without a bound: ranks are taken in slices, so a parent with any number of
    children is spread over rows and tasks.
    """
    ranked = rank_in_group(children.select(key, field).distinct(), [key], field)
    return (
        ranked.groupBy(key, F.floor(F.col("rank") / size).cast("bigint").alias("chunk"))
        .agg(F.array_sort(F.collect_list(field)).alias(name))
    )
